import pytest
from pyspark.sql import functions as F

from chunkwright.functions import boundary, text, vectors


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items()))
    return frame.select(column.alias("x")).first()["x"]


def test_unicode_white_space(spark):
    assert one(spark, text.py_strip(F.col("t")), t=("   a b \n", "string")) == "a b"
    assert one(spark, text.match_form(F.col("t")), t=("A. b c .D", "string")) == "AbcD"


def test_sentences_and_groups(spark):
    t = " One two.  Three?\nFour! Five "
    assert one(spark, text.sentences(F.col("t")), t=(t, "string")) == ["One two.", "Three?", "Four!", "Five"]
    groups = one(spark, text.sentence_groups(F.col("t"), 3), t=(t, "string"))
    assert [tuple(g) for g in groups] == [("One two. Three? Four!", 0, 3), ("Five", 3, 4)]
    assert one(spark, text.sentence_groups(F.col("t"), 3), t=("  ", "string")) == []


@pytest.mark.parametrize("n,expected", [(0, []), (1, [0]), (5, [0]), (6, [0, 3]), (8, [0, 3]), (9, [0, 3, 6])])
def test_windows_stop_at_the_first_that_reaches_the_end(spark, n, expected):
    assert one(spark, text.windows(F.col("n"), 5, 2), n=(n, "int")) == expected


def test_occurrences_overlap(spark):
    assert one(spark, text.occurrences(F.col("t"), F.col("a")), t=("aaa", "string"), a=("aa", "string")) == [0, 1]
    assert one(spark, text.occurrences(F.col("t"), F.col("a")), t=("aaa", "string"), a=("", "string")) == []


def test_answers_and_spans(spark):
    assert one(spark, text.clean_answers(F.col("a")), a=([" x ", "", None, "x", "y"], "array<string>")) == ["x", "y"]
    spans = [[0, 2], [1, 99], [3, 3], [-1, 2], [2]]
    assert one(spark, text.valid_spans(F.col("t"), F.col("s")), t=("abcd", "string"), s=(spans, "array<array<int>>")) == ["ab"]


def test_truthy_and_present(spark):
    cells = {"a": ("", "string"), "b": ("x", "string"), "c": (None, "string")}
    assert one(spark, text.truthy(F.col("a"), F.col("b")), **cells) == "x"
    assert one(spark, text.present(F.col("c"), F.col("a"), F.col("b")), **cells) == ""


def test_titles_previews_and_slugs(spark):
    assert one(spark, text.title_and_text(F.col("a"), F.col("b")), a=(" T ", "string"), b=("x\n", "string")) == "T\n\nx"
    assert one(spark, text.title_and_text(F.col("a"), F.col("b")), a=(None, "string"), b=("x", "string")) == "x"
    assert one(spark, text.preview(F.col("a"), 3), a=(" ab\ncd", "string")) == "ab …"
    assert one(spark, text.truncated(F.col("a"), 2), a=("abcde", "string")) == "ab… [3 more chars]"
    assert one(spark, text.slug(F.col("a")), a=("/Nat Q / dev!", "string")) == "Nat_Q_dev"
    assert one(spark, text.word_tokens(F.col("a")), a=(" a  b\nc ", "string")) == 3


def test_vectors(spark):
    cells = {"a": ([3.0, 4.0], "array<double>"), "b": ([0.0, 0.0], "array<double>")}
    assert one(spark, vectors.unit(F.col("a")), **cells) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.unit(F.col("b")), **cells) == [0.0, 0.0]
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), **cells) == 0.0


@pytest.mark.parametrize(
    "current,following,ok",
    [
        ("", "x", True), ("  \n", "x", True), ("a\n \nb", "c", True), ("text\n# Heading", "c", True), ("It ends.", "Next", True), ("It ends.", "next", False), ("It ends!»", "", True),
        ("see Dr.", "next", False), ("see Dr.", "Smith", True), ("initial J.", "doe", False), ("open\n", "\nWord", True), ("open\n", "\n9 lives", True), ("open\n", "\nword", False),
        ("open", "- item", True), ("open", "2) item", True), ("open", "Żaba", True), ("open", "word", False),
    ],
)
def test_boundaries(spark, current, following, ok):
    assert one(spark, boundary.boundary_ok(F.col("a"), F.col("b")), a=(current, "string"), b=(following, "string")) is ok


def test_occurrences_overlap_and_need_no_scan_of_every_position(spark):
    rows = [("aaaa", "aa"), ("abcabcab", "abcab"), ("x.y.x", "."), ("", "a"), ("a", ""), (None, "a"), ("a\\Eb\\E", "\\E")]
    found = spark.createDataFrame(rows, "t string, n string").select(text.occurrences(F.col("t"), F.col("n")).alias("o")).collect()
    assert [r["o"] for r in found] == [[0, 1, 2], [0, 3], [1, 3], [], [], [], [1, 4]]
