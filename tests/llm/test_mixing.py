import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chunkwright.llm import flow, mixing
from tests.llm.helpers import DOCS, docs


def water(sizes, weights, total, most):
    """Targets by repeated reshares, one source at a time."""
    fixed = {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed[over[0]] = most * sizes[over[0]]


def test_op7_meets_targets(spark, tables):
    rows = docs(3, n=900)
    got = mixing.op7(spark, tables(documents=(rows, DOCS))).collect()
    sizes = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    by = defaultdict(int)
    for i, s in source.items():
        by[s] += sizes[i]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    target = water(by, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(by.values()), 3)
    taken, largest = defaultdict(int), defaultdict(int)
    assert sorted(x["doc_id"] for x in got) == sorted(sizes)
    for x in got:
        i = x["doc_id"]
        assert x["size"] == sizes[i] and x["source_size"] == by[source[i]]
        assert x["target"] == pytest.approx(target[source[i]])
        assert 0 <= x["taken"] <= 3 * x["size"]
        assert x["size"] == 0 or x["taken"] % x["size"] == 0
        taken[source[i]] += x["taken"]
        largest[source[i]] = max(largest[source[i]], x["size"])
    for s in order:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1, s


def test_reruns_and_partitions_agree(spark, tables):
    d = tables(documents=(docs(4, n=300), DOCS))
    first = sorted(map(tuple, mixing.op7(spark, d).collect()))
    frame = spark.read.parquet(f"{d}/documents.parquet").repartition(7)
    mixed = mixing.mix(frame.select("doc_id", "source", mixing.words(F.col("text")).alias("n")), F.array("source"), F.col("n"))
    again = sorted((r["doc_id"], r["__size"] * r["__copies"]) for r in mixed.collect())
    assert again == sorted((x[0], x[4]) for x in first)


def test_cut_is_refined_to_a_small_cell(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 2)
    monkeypatch.setattr(mixing, "_BITS", 4)
    frame = spark.createDataFrame([(i, "ab"[i % 2], 1 + i % 5) for i in range(400)], "doc_id long, source string, n long")
    out = mixing.mix(frame, F.array("source"), F.col("n")).groupBy("source").agg(F.sum(F.col("__size") * F.col("__copies")).alias("t"), F.first("__targets").alias("x")).collect()
    assert all(abs(r["t"] - r["x"][0]) <= 3 for r in out)


def test_flow_prefers_first_copies():
    r = random.Random(2)
    for _ in range(30):
        patterns = {("a",): r.randint(0, 50), ("b",): r.randint(0, 50), ("a", "b"): r.randint(0, 50)}
        quota = {"a": r.randint(0, 120), "b": r.randint(0, 120)}
        taken = flow.route(patterns, quota, 3)

        def feasible(t, quota=quota):
            return t[("a",)] <= quota["a"] and t[("b",)] <= quota["b"] and sum(t.values()) <= sum(quota.values())

        def cost(t, patterns=patterns):
            return sum(max(0, t[p] - n) + max(0, t[p] - 2 * n) for p, n in patterns.items())

        assert feasible(taken) and all(taken[p] <= 3 * n for p, n in patterns.items())
        best = max((sum(t.values()), -cost(t)) for x in range(0, 3 * patterns[("a",)] + 1) for y in range(0, 3 * patterns[("b",)] + 1) for z in [min(3 * patterns[("a", "b")], quota["a"] + quota["b"] - x - y, max(0, quota["a"] - x) + max(0, quota["b"] - y))] if z >= 0 for t in [{("a",): x, ("b",): y, ("a", "b"): z}] if feasible(t))
        assert sum(taken.values()) == best[0]
        assert -cost(taken) >= best[1]


def test_mixed_rows_repeat_and_keep_columns(spark):
    frame = spark.createDataFrame([(1, "a b c", "x", 5), (2, "d e", None, 6), (3, None, "y", 7)], "doc_id long, text string, source string, __n int")
    out = mixing.mixed_rows(frame.drop("__n").withColumn("extra", F.lit(1)))
    assert out.columns == ["doc_id", "text", "source", "extra"]
    assert {r["doc_id"] for r in out.collect()} <= {1, 2, 3}


def test_empty_table(spark, tables):
    assert mixing.op7(spark, tables(documents=([], DOCS))).collect() == []
