import hashlib
from collections import defaultdict

import numpy as np

from chunkwright.llm import exact_dedup
from chunkwright.llm.mph import PerfectHash
from tests.llm.helpers import DOCS, docs


def test_perfect_hash_is_minimal_and_survives_bytes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 5000):
        digests = rng.integers(0, 256, (n, 32), np.uint8)
        mph = PerfectHash.from_bytes(PerfectHash.build(digests).to_bytes())
        assert sorted(mph.index(digests).tolist()) == list(range(n))
        other = rng.integers(0, 256, (100, 32), np.uint8)
        assert ((mph.index(other) >= -1) & (mph.index(other) < max(n, 1))).all()


def test_op1_equals_brute_force(spark, tables):
    rows = docs(5) + [(None, "lone", None, None, None), (7000, "rep", None, None, None), (7000, "rep", None, None, None)]
    got = [tuple(r) for r in exact_dedup.op1(spark, tables(documents=(rows, DOCS))).collect()]
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    expected, seen = [], set()
    for r in rows:
        own = groups[r[1] or ""]
        keep = max((x for x in own if x is not None), default=None)
        first = (r[0], r[1]) not in seen
        seen.add((r[0], r[1]))
        expected.append((r[0], keep, len(own), r[0] == keep and first, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_kept_rows_keep_columns_and_one_of_each(spark):
    frame = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3), (3, "b", 3), (4, None, 4), (5, "", 5)], "doc_id long, text string, digest int")
    out = exact_dedup.kept_rows(frame)
    assert out.columns == frame.columns
    assert sorted(tuple(r) for r in out.collect()) == [(2, "a", 2), (3, "b", 3), (5, "", 5)]


def test_empty_table(spark, tables):
    assert exact_dedup.op1(spark, tables(documents=([], DOCS))).collect() == []
