"""Mixing of overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they count
for); one row per pattern reaches the driver, at most ``MAX_PATTERNS``.  There
``flow.route`` sends token capacity to the source quotas, further copies at a
convex cost.  Of a pattern that gives c whole copies and a part of one more,
every document is taken c times, and once more the documents that come first
in a seeded order, up to the part.

That cut is found without sorting a source: sums over 4,096 hash ranges of a
pattern narrow it to one range, again where the range still holds over
``CELL`` documents, and only the last range is put in order (identical rows go
together).  No task holds a
source, and all that moves is sums.

Defined cases: null text has size 0; a null source is a source of its own,
last in order; documents of size 0 take nothing and are no target's part;
identical rows count once each; an empty table gives no rows; extra columns
are carried by ``mix`` untouched.  The same table gives the same result,
whatever its partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwright.llm.common import WORD_PATTERN, materialise, pick, renamed, table
from chunkwright.llm.flow import quotas, route

MAX_PATTERNS, MAX_COPIES, SEED, CELL = 20_000, 3, 42, 1000
_BITS = 12
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _hash(seed: int, *by: str) -> Column:
    """60 bits of order."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 4)


def _cuts(rows: DataFrame, parts: dict[int, int]) -> DataFrame | None:
    """For each pattern with a part: pattern, low, high, left.

    Documents hashed below ``low`` lie inside the part, at or above ``high``
    outside; those between fill ``left`` words in order.
    """
    spark = rows.sparkSession
    todo = {p: (0, 60, left) for p, left in parts.items() if left > 0}
    done = []
    while todo:
        state = spark.createDataFrame([(p, low, low + (1 << bits), bits, left) for p, (low, bits, left) in todo.items()], "pattern int, low long, high long, bits int, part long")
        cell = rows.join(F.broadcast(state), "pattern").filter("h >= low AND h < high")  # state: a row per pattern at most
        bucket = F.expr(f"shiftright(h - low, bits - {_BITS})")
        sums = cell.groupBy("pattern", "low", "bits", "part", bucket.cast("long").alias("b")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        over = Window.partitionBy("pattern").orderBy("b")
        upto = sums.withColumn("upto", F.sum("size").over(over)).filter("upto >= part").withColumn("r", F.row_number().over(over)).filter("r = 1")
        for x in upto.collect():  # a row per pattern
            bits = x["bits"] - _BITS
            low, left = x["low"] + (x["b"] << bits), x["part"] - (x["upto"] - x["size"])
            if x["n"] > CELL and bits >= _BITS:
                todo[x["pattern"]] = (low, bits, left)
            else:
                done.append((x["pattern"], low, low + (1 << bits), left))
                todo.pop(x["pattern"])
        found = {x[0] for x in done}
        todo = {p: v for p, v in todo.items() if p not in found}
    return spark.createDataFrame(done, "pattern int, low long, high long, part long") if done else None


def mix(docs: DataFrame, sources: Column, size: Column, targets=None, id_col: str = "doc_id", weights: tuple = WEIGHTS, seed: int = SEED, max_copies: int = MAX_COPIES) -> DataFrame:
    """``docs`` with __size, __copies, __targets: how often the mix takes each document, and the targets of its sources.

    ``sources``: array of the sources that a document counts for (null: one
    unnamed source).  ``targets``: a function of {source: size} that gives
    {source: tokens}; by default ``weights`` share the whole size.
    """
    spark = docs.sparkSession
    key = F.array_sort(F.array_distinct(F.transform(F.coalesce(sources, F.array(F.lit(None).cast("string"))), lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("~")))))
    rows = docs.withColumns({"__key": key, "__size": size})
    sizes_of = materialise(rows.select("__key", "__size", _hash(seed, id_col, "__size").alias("h")), "sizes")
    totals = [(tuple(x["__key"]), x["size"]) for x in sizes_of.groupBy("__key").agg(F.sum("__size").alias("size")).limit(MAX_PATTERNS + 1).collect()]
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns")
    order = sorted({s for p, _ in totals for s in p})  # by code point; "~", which stands for null, comes after "="
    sizes = {s: sum(n for p, n in totals if s in p) for s in order}
    if targets is None:
        wanted = quotas(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, sum(n for _, n in totals), max_copies)
    else:
        own = targets({None if s == "~" else s[1:]: n for s, n in sizes.items()})
        wanted = {s: float(own.get(None if s == "~" else s[1:], 0)) for s in order}
    taken = route(dict(totals), wanted, max_copies)
    table_ = [(i, list(p), taken[p] // n if n else 1, [sizes[s] for s in p], [wanted[s] for s in p]) for i, (p, n) in enumerate(sorted(totals))]
    if not table_:
        return docs.withColumns({"__size": size, "__copies": F.lit(0), "__source_sizes": F.array().cast("array<bigint>"), "__targets": F.array().cast("array<double>")})
    patterns = spark.createDataFrame(table_, "__pattern int, __key array<string>, __base long, __source_sizes array<long>, __targets array<double>")
    parts = {i: taken[p] % n for i, (p, n) in enumerate(sorted(totals)) if n}
    rows = rows.join(F.broadcast(patterns), "__key").withColumn("__h", _hash(seed, id_col, "__size"))  # a row per pattern
    small = sizes_of.join(F.broadcast(patterns), "__key").select(F.col("__pattern").alias("pattern"), "h", F.col("__size").alias("size")).filter("size > 0")
    cuts = _cuts(small, parts)
    if cuts is None:
        return rows.withColumn("__copies", F.col("__base").cast("int")).drop("__key", "__h", "__base", "__pattern")
    cell = small.join(F.broadcast(cuts), "pattern").filter("h >= low AND h < high").groupBy("pattern", "part", "low", "h").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("pattern").orderBy("h"))
    inside = F.col("upto") - F.col("size") / 2 <= F.col("part")
    last = cell.withColumn("upto", upto).groupBy("pattern", "low").agg(F.max(F.when(inside, F.col("h"))).alias("last"))
    last = last.select(F.col("pattern").alias("__pattern"), F.coalesce("last", F.col("low") - 1).alias("__last"))  # a row per pattern
    rows = rows.join(F.broadcast(last), "__pattern", "left")
    extra = F.coalesce(F.col("__h") <= F.col("__last"), F.lit(False)).cast("int")
    return rows.withColumn("__copies", (F.col("__base") + extra).cast("int")).drop("__key", "__h", "__base", "__pattern", "__last")


def mixed_rows(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of the mix with the columns of ``docs``: each as often as it is taken."""
    plain, own = renamed(docs)
    mixed = mix(plain, F.array(own[source_col]), words(F.col(own[text_col])), id_col=own[id_col])
    taken = mixed.filter("__copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return taken.select(*own.values()).toDF(*docs.columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", source="source", text="text")
    small = materialise(docs.select("doc_id", "source", words(F.col("text")).alias("n")), "sizes")
    mixed = mix(small, F.array("source"), F.col("n"))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.try_element_at("__source_sizes", F.lit(1)).alias("source_size"), F.try_element_at("__targets", F.lit(1)).alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))
