"""Text helpers as columns, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_SPLIT = r"(?<=[.!?])\s+"


def py_strip(c: Column) -> Column:
    """Strip all Unicode white space, as str.strip() does."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def sql_trim(c: Column) -> Column:
    """Strip spaces of any width, but no tabs or line ends, as trim() of DuckDB does."""
    return F.regexp_replace(F.regexp_replace(c, r"^\p{Zs}+", ""), r"\p{Zs}+\z", "")


def match_form(c: Column) -> Column:
    """Text for answer matching: white space and dots deleted, case kept."""
    return F.regexp_replace(c, r"(?U)[\s.]+", "")


def sentences(c: Column) -> Column:
    """Trimmed, non-empty sentences."""
    parts = F.transform(F.split(py_strip(c), SENTENCE_SPLIT), py_strip)
    return F.filter(parts, lambda s: s != "")


def sentence_groups(c: Column, size: int) -> Column:
    """array<struct<text, start_sentence, end_sentence>> of up to ``size`` sentences each."""

    def groups(s: Column) -> Column:
        starts = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts,
            lambda i: F.struct(F.array_join(F.slice(s, i + 1, size), " ").alias("text"), i.alias("start_sentence"), F.least(i + size, F.size(s)).alias("end_sentence")),
        )

    return F.flatten(F.transform(F.array(sentences(c)), groups))  # the sentences are bound once, not split again for every group


def windows(length: Column, size: int, overlap: int) -> Column:
    """Starts of windows that step by size - overlap, up to the first that reaches the end."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((length - size) / step)) * step
    return F.when(length > 0, F.sequence(F.lit(0), last.cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))


def truthy(*columns: Column) -> Column:
    """First that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def present(*columns: Column) -> Column:
    """First that is not null; an empty string counts."""
    return F.coalesce(*columns, F.lit(""))


def title_and_text(title: Column, text: Column) -> Column:
    t, b = py_strip(F.coalesce(title, F.lit(""))), py_strip(F.coalesce(text, F.lit("")))
    return py_strip(F.when(t == "", b).otherwise(F.concat(t, F.lit("\n\n"), b)))


def preview(c: Column, n: int, strip: Callable[[Column], Column] = py_strip) -> Column:
    """One line, at most n characters, with an ellipsis where cut."""
    line = strip(F.regexp_replace(c, "\n", " "))
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n), F.lit("…"))).otherwise(line)


def truncated(c: Column, n: int) -> Column:
    """At most n characters and how many more there are."""
    more = F.length(c) - n
    return F.when(more > 0, F.concat(F.substring(c, 1, n), F.lit("… ["), more.cast("string"), F.lit(" more chars]"))).otherwise(c)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def digest_id(prefix: str, c: Column, length: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(c), 1, length))


def word_tokens(c: Column) -> Column:
    """Words between white space: the default token count."""
    trimmed = F.btrim(F.regexp_replace(c, r"\s+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " ")))


def extractive(answers: Column, text: Column) -> Column:
    """Answers that occur in the text as they are."""
    return F.filter(answers, lambda a: F.contains(text, a))


def free(answers: Column, text: Column) -> Column:
    return F.filter(answers, lambda a: ~F.contains(text, a))


def clean_answers(answers: Column, strip: Callable[[Column], Column] = py_strip) -> Column:
    """Trimmed, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(answers, F.array().cast("array<string>")), lambda a: strip(a)), lambda a: a.isNotNull() & (a != "")))


def valid_spans(text: Column, spans: Column) -> Column:
    """Texts of the [start, end) pairs that lie in the text."""
    ok = F.filter(spans, lambda s: (F.size(s) == 2) & (s[0] >= 0) & (s[0] < s[1]) & (s[1] <= F.length(text)))
    return F.array_distinct(F.transform(ok, lambda s: F.substring(text, s[0] + 1, s[1] - s[0])))


def occurrences(text: Column, needle: Column) -> Column:
    """All positions (from 0) of a non-empty needle, overlapping ones too: ``locate`` goes from one to the next."""
    none = F.array().cast("array<int>")
    most = F.size(F.split(text, F.concat(F.lit("\\Q"), F.substring(needle, 1, 1), F.lit("\\E")), -1)) - 1  # times its first character occurs
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(s: Column, _: Column) -> Column:
        at = F.when(s["at"] < 0, F.lit(0)).otherwise(F.call_function("locate", needle, text, s["at"] + 1))
        return F.struct(F.when(at > 0, at).otherwise(-1).alias("at"), F.when(at > 0, F.concat(s["found"], F.array(at - 1))).otherwise(s["found"]).alias("found"))

    fits = (F.length(needle) > 0) & F.contains(text, needle)
    return F.when(fits, F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), start, step, lambda s: s["found"])).otherwise(none)
