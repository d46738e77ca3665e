import datetime as dt
import math
import random

from chunkwright.llm import topk, url_filter

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    import numpy as np

    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in ok if j != i and len(c) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def vectors(n=230, dim=8):
    r = random.Random(3)
    rows = [(i, [r.choice([-1.0, -0.5, 0.25, 0.1, 1.0]) for _ in range(dim)]) for i in range(n)]
    return [*rows, (500, None), (550, [float("nan")] * dim), (600, [None] + [1.0] * (dim - 1)), (650, [1.0, 2.0]), (651, [3.0, 1.0]), (700, []), (701, [float("inf")] * dim)]


def test_op3_equals_brute_force(spark, tables):
    rows = vectors()
    got = topk.op3(spark, tables(embeddings=([(i, v, 0) for i, v in rows], VECTORS)))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_blocks_and_merges_do_not_matter(spark, monkeypatch):
    rows = vectors(300)
    monkeypatch.setattr(topk, "TILE", 16)
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(9)
    got = topk.exact_topk(frame, frame.filter("vec_id % 50 = 0"), 5, block_bytes=200, shard_bytes=900, fan_in=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(0, [1e10, 3e3]), (1, [1e3, 1.0]), (2, [1e3, 1.00390625])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.exact_topk(frame, frame.filter("vec_id = 0"), 2).orderBy("rank").collect()]
    q = [math.floor(256 * x) for x in rows[0][1]]
    want = sorted(((sum(a * math.floor(256 * b) for a, b in zip(q, v, strict=True)), -i) for i, v in rows[1:]), reverse=True)
    assert got == [(-i, s) for s, i in want]


def test_op3_empty(spark, tables):
    assert topk.op3(spark, tables(embeddings=([], VECTORS))).collect() == []


D = dt.date
CHANGES = [
    ("bad.com", "block", D(2024, 1, 10)), ("bad.com", "remove", D(2024, 2, 10)), ("bad.com", "block", D(2024, 3, 1)),
    ("good.bad.com", "allow", D(2024, 1, 1)), ("bad.com/ok", "allow", D(2024, 3, 5)), ("bad.com/ok/not", "block", D(2024, 3, 5)),
    ("twice.org", "allow", D(2024, 1, 1)), ("twice.org", "block", D(2024, 1, 1)), (None, "block", D(2024, 1, 1)), ("x.org", "block", None), ("x.org", "odd", D(2024, 1, 1)),
]


def test_captures_meet_entries_active_at_fetch_time(spark):
    cases = [
        ("http://bad.com/", D(2024, 1, 9), True), ("http://bad.com/", D(2024, 1, 10), False), ("https://WWW.BAD.com:80/x", D(2024, 2, 9), False),
        ("http://bad.com/", D(2024, 2, 10), True), ("http://a.good.bad.com/", D(2024, 1, 20), True), ("http://bad.com/ok/fine?q#f", D(2024, 3, 6), True),
        ("http://bad.com/ok/not/", D(2024, 3, 6), False), ("http://bad.com/okay", D(2024, 3, 6), False), ("http://notbad.com/", D(2024, 1, 20), True),
        ("http://twice.org/", D(2024, 5, 1), False), ("http://x.org/", D(2024, 5, 1), True), (None, D(2024, 5, 1), True), ("http://bad.com/", None, True), ("nonsense", D(2024, 5, 1), True),
    ]
    cases += [cases[1]]
    captures = spark.createDataFrame([(i, u, t, "own") for i, (u, t, _) in enumerate(cases)], "page_id long, url string, fetched date, entry string")
    got = {r["page_id"]: r["kept"] for r in url_filter.url_filter(captures, spark.createDataFrame(CHANGES, "entry string, action string, since date")).collect()}
    assert got == {i: kept for i, (_, _, kept) in enumerate(cases)}


def test_columns_of_any_name_stay(spark):
    changes = spark.createDataFrame(CHANGES, "entry string, action string, since date")
    captures = spark.createDataFrame([("http://bad.com/", D(2024, 1, 10), 1, "x", "y", "z", "w")], "`the.url` string, fetched date, `a.b` int, u string, t string, kept string, r string")
    row = url_filter.url_filter(captures, changes, "the.url").first().asDict()
    assert row == {"the.url": "http://bad.com/", "fetched": D(2024, 1, 10), "a.b": 1, "u": "x", "t": "y", "r": "w", "entry": "bad.com", "action": "block", "kept": False}
    assert url_filter.url_filter(captures, changes.filter("false"), "the.url").first()["kept"] is True


def test_no_python_in_the_plan(spark, tables):
    d = tables(pages=([(1, "http://a.b/c", "x")], "page_id long, url string, html string"))
    plan = url_filter.op5(spark, d)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op5_empty(spark, tables):
    assert url_filter.op5(spark, tables(pages=([], "page_id long, url string, html string"))).collect() == []
