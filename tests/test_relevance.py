import random

import pytest

from chunkwright.operators import analytics, relevance

QUERIES = "query_id string, query_ord int, relevant array<string>, answers array<string>"
PASSAGES = "passage_id string, parent_id string, passage_ord long, contents string"


def test_overlap_is_the_longest():
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(2))
        if r.random() < 0.5:
            b = a[len(a) // 3 :] + b
        assert relevance.overlap_length(a, b) == next((n for n in range(min(len(a), len(b)), 0, -1) if a.endswith(b[:n])), 0)


def test_merged_spans_and_their_order():
    assert relevance.merge_spans(["hello", "loXXyyy", "yyyabcde"]) == ("helloXXyyyabcde", [(0, 5, 0), (3, 10, 2), (7, 15, 3)])
    assert [s[0] for s in relevance.merge_spans(["ab", "cd", "abcdxyz"])[1]] == [0, 2, 0]
    assert relevance.merge_spans(["ab", "bc"], [(0, 2), (2, 4)])[0] == "abbc"


@pytest.mark.parametrize("start,end,runs", [(0, 4, [range(0, 1)]), (3, 5, [range(0, 1), range(1, 2)]), (4, 12, [range(0, 3), range(1, 3)]), (9, 10, [range(1, 2), range(2, 3)]), (14, 15, [range(2, 3)])])
def test_covering_runs(start, end, runs):
    assert relevance.covering([(0, 5, 0), (3, 10, 2), (8, 15, 2)], start, end) == runs


def test_relevance_of_queries(spark):
    passages = spark.createDataFrame([("pA", "d1", 0, "Alpha Beta"), ("pB", "d1", 1, "Gamma"), ("pC", "d2", 2, "Delta"), ("pD", "d3", 3, "x. Ga"), ("pE", "d3", 4, "mma y")], PASSAGES)
    passages = relevance.renumbered(passages)
    queries = spark.createDataFrame(
        [("q1", 0, ["d1"], None), ("q2", 1, ["d1"], ["Alpha"]), ("q3", 2, ["d2"], ["NotFound"]), ("q4", 3, ["d1", "d1"], None), ("q5", 4, ["d2"], []), ("q6", 5, ["d3"], ["Ga mma"]), ("q7", 6, ["gone"], None), ("q8", 7, None, ["Alpha"])],
        QUERIES,
    )
    got = {r["query_id"]: (r["relevant"], r["relevant_scores"]) for r in relevance.passage_relevance(queries, passages).collect()}
    assert got == {
        "q1": (["0", "1"], [1.0, 1.0]), "q2": (["0"], [1.0]), "q3": (["-1"], [0.0]), "q4": (["0", "1"], [1.0, 1.0]), "q5": (["-1"], [0.0]), "q6": (["3", "4"], [0.5, 0.5]), "q7": (["-1"], [0.0]), "q8": (["-1"], [0.0]),
    }


def test_key_presence(spark):
    rows = [("{}",), ('{"extractive_span_text_answer": null}',), ('{"extractive_span_text_answer": []}',), ('{"extractive_span_text_answer": ["a"]}',), ('{"extractive_span_text_answer": "b"}',), (None,)]
    got = [r["a"] for r in spark.createDataFrame(rows, "metadata string").select(relevance.answers_of().alias("a")).collect()]
    assert got == [None, [], [], ["a"], ["b"], None]


def test_numbers_are_contiguous_whatever_the_partitions(spark):
    frame = spark.range(1000).repartition(13).selectExpr("id * 7 as passage_ord", "cast(id as string) as passage_id")
    got = relevance.renumbered(frame).orderBy("passage_ord").collect()
    assert [r["passage_id"] for r in got] == [str(i) for i in range(1000)] and [r["original_id"] for r in got] == [str(i) for i in range(1000)]


def test_missing_relevance_and_signatures(spark):
    rows = [("r", "q1", ["1", "2"], [1.0, 0.5], 0), ("r", "q2", ["-1"], [0.0], 1), ("r", "q3", [], [], 2)]
    frame = spark.createDataFrame(rows, "run string, id string, relevant array<string>, relevant_scores array<double>, o int")
    report = analytics.missing_relevance(frame, ["run"]).first()
    assert (report["missing_count"], report["total"], round(report["percent"], 2)) == (1, 3, 33.33)
    a = analytics.query_signatures(frame.repartition(3), ["run"], "o").first()
    b = analytics.query_signatures(frame.coalesce(1), ["run"], "o").first()
    assert a == b and a["minus_one_query_count"] == 1


def test_comparison_names_the_field_and_the_delay(spark):
    schema = "run string, minus_one_query_count long, relevance_sha256 string, duration_sec int"
    base = spark.createDataFrame([("a", 0, "x", 4), ("b", 0, "x", 4), ("c", 0, "x", 4)], schema)
    now = spark.createDataFrame([("a", 0, "x", 5), ("b", 1, "y", 12)], schema)
    got = {r["run"]: r for r in analytics.compared_signatures(base, now).collect()}
    assert got["a"]["passed"] and not got["b"]["passed"] and not got["c"]["present"]
    assert got["b"]["differing"] == ["minus_one_query_count", "relevance_sha256"] and got["b"]["delta_sec"] == 8
    total = analytics.comparison_summary(analytics.compared_signatures(base, now)).first()
    assert (total["runs"], total["passed"], total["failed"], total["missing"]) == (3, 1, 2, 1)
