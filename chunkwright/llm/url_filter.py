"""URL filters by a temporal list join, with DataFrame functions only.

A list is a set of dated changes: on ``since`` an entry (a host, or a host and
path prefix) is added as ``block`` or ``allow``, or taken off (``remove``).
The changes of an entry become validity intervals, each ending where the next
begins.  A capture asks for every host suffix and path prefix of its URL and
meets, as of its fetch time, the entries then active.  The longest entry
decides; among equals ``block`` does.

The list side is windowed by entry, so a frequent host of the captures costs
nothing there; the join is a plain equi-join on the entry with the interval as
a residual condition, which Spark may split where one key is frequent, and the
verdicts are combined map-side.

Defined cases: a null or unparsable URL, or a null fetch time, matches nothing
and is kept; changes without entry, date or action are ignored; of the changes
of one entry at one time the last action in the order allow, block, remove
holds; identical captures are judged alike, one row each; texts of any length
are taken whole; without captures there are no rows, without a list all are
kept; further columns stay as they are, whatever their names, but for those
called entry, action or kept, which the verdict replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwright.llm.common import renamed, table

#: Days after the epoch of the first capture and of the first list entry, and the length of either period.
FIRST_DAY, DAYS = 19_723, 366


def intervals(changes: DataFrame) -> DataFrame:
    """entry, action, valid_from, valid_to (exclusive, null: still open) of dated changes (entry, action, since)."""
    known = changes.filter("entry IS NOT NULL AND since IS NOT NULL AND action IN ('allow', 'block', 'remove')")
    at_once = known.groupBy("entry", "since").agg(F.max("action").alias("action"))
    following = F.lead("since").over(Window.partitionBy("entry").orderBy("since"))
    return at_once.withColumn("valid_to", following).filter("action <> 'remove'").select("entry", "action", F.col("since").alias("valid_from"), "valid_to")


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(found != "", F.regexp_replace(found, r"\.$", ""))


def keys_of(url: Column) -> Column:
    """Every entry that may speak of the URL: suffixes of its host, and its host with each leading part of its path."""
    labels = F.split(host_of(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    return F.array_distinct(F.concat(suffixes, F.coalesce(prefixes, F.array().cast("array<string>"))))


def url_filter(captures: DataFrame, changes: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """The captures with entry (that decides, if any), action and kept.

    Captures are told apart by url and time only, so the verdict is made once
    for each such pair and joined back.
    """
    asked = captures.select(F.col(f"`{url_col}`").alias("u"), F.col(f"`{time_col}`").alias("t")).filter("u IS NOT NULL AND t IS NOT NULL").distinct()
    keyed = asked.select("u", "t", F.explode(keys_of(F.col("u"))).alias("entry"))
    active = keyed.join(intervals(changes), "entry").filter("valid_from <= t AND (valid_to IS NULL OR t < valid_to)")
    rank = F.struct(F.length("entry").alias("n"), (F.col("action") == "block").alias("b"), F.col("entry").alias("e"))
    verdict = active.groupBy("u", "t").agg(F.max(rank).alias("r")).select("u", "t", F.col("r.e").alias("entry"), F.when(F.col("r.b"), "block").otherwise("allow").alias("action"))
    plain, own = renamed(captures)
    u, t = plain[own[url_col]], plain[own[time_col]]
    joined = plain.join(verdict, (u == verdict["u"]) & (t == verdict["t"]), "left")
    kept = [c for c in captures.columns if c not in ("entry", "action", "kept")]
    out = joined.select(*[plain[own[c]] for c in kept], verdict["entry"], verdict["action"], (F.coalesce(verdict["action"], F.lit("allow")) == "allow").alias("kept"))
    return out.toDF(*kept, "entry", "action", "kept")


def dated_list(pages: DataFrame) -> DataFrame:
    """A list to try the operator on: every host that occurs, and its path's first part, changes by a fixed rule.

    The rule is arithmetic on the lengths of the parts of the entry, so that
    SQL can repeat it: a host is blocked early and removed later, or allowed;
    each first part of a path is allowed or blocked some days after.
    """
    host = host_of(F.col("url"))
    first = F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([^/?#]+)", 1)
    hosts = pages.select(host.alias("entry")).filter("entry IS NOT NULL").distinct()
    paths = pages.select(F.concat(host, F.lit("/"), first).alias("entry")).filter("entry IS NOT NULL AND entry NOT LIKE '%/'").distinct()
    n = F.length("entry")
    day = lambda x: F.date_add(F.lit("1970-01-01").cast("date"), (F.lit(FIRST_DAY) + x).cast("int"))
    return (
        hosts.filter(n % 3 != 0).select("entry", F.lit("block").alias("action"), day((n * 7) % 120).alias("since"))
        .unionByName(hosts.filter(n % 3 == 1).select("entry", F.lit("remove").alias("action"), day(150 + (n * 11) % 100).alias("since")))
        .unionByName(hosts.filter(n % 3 == 2).select("entry", F.lit("allow").alias("action"), day(200 + (n * 13) % 100).alias("since")))
        .unionByName(paths.select("entry", F.when(n % 2 == 0, "block").otherwise("allow").alias("action"), day(60 + (n * 17) % 200).alias("since")))
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("1970-01-01").cast("date"), (F.lit(FIRST_DAY) + F.pmod("page_id", F.lit(DAYS))).cast("int"))
    return url_filter(pages.withColumn("fetched", fetched), dated_list(pages))


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '1970-01-01' + (19723 + page_id % 366)::INTEGER AS fetched,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts,
         regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]+)', 1) AS part1
  FROM pages
), h AS (SELECT DISTINCT host AS entry, length(host) AS n FROM p WHERE host IS NOT NULL),
f AS (SELECT DISTINCT host || '/' || part1 AS entry, length(host || '/' || part1) AS n FROM p WHERE host IS NOT NULL AND part1 <> ''),
c AS (
  SELECT entry, 'block' AS action, DATE '1970-01-01' + (19723 + (n * 7) % 120)::INTEGER AS since FROM h WHERE n % 3 <> 0
  UNION ALL SELECT entry, 'remove', DATE '1970-01-01' + (19723 + 150 + (n * 11) % 100)::INTEGER FROM h WHERE n % 3 = 1
  UNION ALL SELECT entry, 'allow', DATE '1970-01-01' + (19723 + 200 + (n * 13) % 100)::INTEGER FROM h WHERE n % 3 = 2
  UNION ALL SELECT entry, CASE WHEN n % 2 = 0 THEN 'block' ELSE 'allow' END, DATE '1970-01-01' + (19723 + 60 + (n * 17) % 200)::INTEGER FROM f
), o AS (SELECT entry, since, max(action) AS action FROM c GROUP BY ALL),
i AS (SELECT entry, action, since AS valid_from, lead(since) OVER (PARTITION BY entry ORDER BY since) AS valid_to FROM o),
k AS (
  SELECT page_id, unnest(list_distinct(list_transform(range(1, len(string_split(host, '.')) + 1), lambda j: array_to_string(string_split(host, '.')[j:], '.'))
         || list_transform(range(1, len(parts) + 1), lambda j: host || '/' || array_to_string(parts[1:j], '/')))) AS entry, fetched
  FROM p WHERE host IS NOT NULL
), a AS (
  SELECT k.page_id, i.entry, i.action, row_number() OVER (PARTITION BY k.page_id ORDER BY length(i.entry) DESC, i.action = 'block' DESC, i.entry DESC) AS r
  FROM k JOIN i ON k.entry = i.entry AND i.action <> 'remove' AND i.valid_from <= k.fetched AND (i.valid_to IS NULL OR k.fetched < i.valid_to)
)
SELECT p.page_id, p.url, p.fetched, a.entry, a.action, coalesce(a.action, 'allow') = 'allow' AS kept
FROM p LEFT JOIN a ON p.page_id = a.page_id AND a.r = 1
"""
