"""Every operator on a table with columns whose names it uses itself, and with hostile rows."""

import pytest
from pyspark.sql import functions as F

from chunkwright.llm import bwt_dedup, exact_dedup, mixing, packing, quality, simhash, topk, tree_dedup
from tests.llm.helpers import DOCS, HOSTILE, docs

NAMES = ["id", "row", "digest", "fp", "size", "copies", "keep_id", "component_id", "gram", "at", "pattern", "h", "__size_", "__size", "__key", "__h", "__n", "__id", "__sha", "__mark", "__copies", "c0", "mark", "label", "score", "taken", "start", "kind"]


@pytest.mark.parametrize(
    "run",
    [
        exact_dedup.exact_dedup, simhash.near_classes, packing.pack, bwt_dedup.suffix_array_dedup, tree_dedup.substring_dedup, exact_dedup.kept_rows, simhash.near_dedup, mixing.mixed_rows,
    ],
)
def test_clashing_names_change_nothing(spark, run):
    rows = [(i, t, None, None if i % 3 else "s", None) for i, t in enumerate(HOSTILE)] + docs(1, n=10)[:20]
    rows = [(1000 + i, *r[1:]) for i, r in enumerate(rows)]
    frame = spark.createDataFrame(rows, DOCS)
    clashing = frame.withColumns({n: F.lit("x") for n in NAMES})
    plain, other = run(frame), run(clashing)
    common = [c for c in plain.columns if c in other.columns and c not in NAMES] or plain.columns
    key = lambda df: sorted(str(tuple(r)) for r in df.select(*common).collect())
    assert key(plain) == key(other)


def test_classifier_and_topk_with_clashing_names(spark):
    frame = spark.createDataFrame(docs(1, n=10), DOCS).withColumns({n: F.lit("x") for n in NAMES})
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int").withColumn("y", F.lit("x")).withColumn("id", F.lit("z"))
    assert quality.score(frame, quality.train(frame, labels)).count() == frame.count()
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "vec": F.lit("y"), "v": F.lit("z")})
    assert topk.exact_topk(vectors, vectors.filter("vec_id % 50 = 0"), 2).count() == 4
