import time

import pytest
from pyspark.sql import functions as F

from chunkwright.operators import analytics
from chunkwright.plans import analyzer, runs
from chunkwright.streaming import chunk_stream


def test_param_grid_and_plan():
    assert runs.param_grid({"a": [1, 2], "b": 3}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]
    assert runs.param_grid(None) == [{}]
    plan = runs.run_plan({"documents": ["x", "y"], "chunkers": ["fixed_size", {"name": "passage", "params": {"passage_length": 2}}], "repeats": 2})
    assert len(plan) == 8 and plan[0]["run"] == "run_0001" and plan[3]["params"] == {"passage_length": 2}


@pytest.mark.parametrize("value,expected", [("Yes", True), ("off", False), (1, True), (None, False), (True, True)])
def test_booleans(value, expected):
    assert runs.boolean(value) is expected
    with pytest.raises(ValueError):
        runs.boolean("maybe")


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("documents: x\nchunkers: [fixed_size]\n")
    assert runs.load_config(str(tmp_path / "a.yaml"))["documents"] == "x"
    (tmp_path / "b.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        runs.load_config(str(tmp_path / "b.yaml"))


def test_sweep_goes_on_after_a_failure_and_resumes(spark, tmp_path):
    docs = spark.createDataFrame([(0, "One. Two. Three.")], "doc_id long, text string")
    config = {"documents": ["d"], "chunkers": ["passage", {"name": "fixed_size", "param_grid": {"chunk_size": [8, 0], "overlap": 0}}]}
    entries = runs.run_sweep(spark, config, lambda _: docs, str(tmp_path / "s"))
    assert [e["status"] for e in entries] == ["success", "success", "failed"] and entries[1]["passages"] == 2
    assert runs.resumed(runs.run_plan(config), entries) == {"run_0001", "run_0002"}
    again = runs.run_sweep(spark, config, lambda _: docs, str(tmp_path / "s"), done=runs.resumed(runs.run_plan(config), entries))
    assert [e["run"] for e in again] == ["run_0003"]
    counts = runs.status_counts(runs.run_table(spark, entries)).first()
    assert tuple(counts) == (3, 2, 1)
    with pytest.raises(ValueError):
        runs.run_sweep(spark, config, lambda _: docs, str(tmp_path / "t"), continue_on_error=False)


def test_time_limit_cancels_jobs(spark):
    started = time.monotonic()
    with pytest.raises(TimeoutError):
        runs.with_time_limit(spark, lambda: spark.range(4, numPartitions=4).selectExpr("java_method('java.lang.Thread', 'sleep', 30000L)").collect(), 1)
    assert time.monotonic() - started < 25
    assert runs.with_time_limit(spark, lambda: spark.range(3).count(), 60) == 3


def test_baseline_keeps_finished_runs(spark):
    signatures = spark.createDataFrame([("a", 1), ("b", 2)], "run string, query_count long")
    timing = spark.createDataFrame([("a", "finished", 4), ("b", "timed_out", 60)], "run string, status string, duration_sec int")
    assert [tuple(r) for r in runs.cached_baseline(signatures, timing).collect()] == [("a", 1, 4)]


@pytest.fixture
def corpus(spark):
    make = spark.createDataFrame
    return {
        "experiments": make([("e1", "ds", "fixed", 4), ("e2", "ds_merged", "fixed", 4), ("e3", "ds", "hac", 0)], "exp string, dataset string, chunker string, chunk_count int"),
        "queries": make([("e1", "q1", "What?", ["p1", "p2"], ["Yes"]), ("e3", "q1", "What?", ["p9"], None), ("e1", "q2", "Else", [], None)], "exp string, query_id string, contents string, relevant array<string>, answers array<string>"),
        "retrieved": make([("e1", "q1", ["p2", "px"], [0.9, 0.5], ["p2"])], "exp string, query_id string, retrieved array<string>, retrieved_scores array<double>, retrieved_relevant array<string>"),
        "passages": make([("e1", "p1", "d", "alpha"), ("e1", "p2", "d", "beta")], "exp string, passage_id string, parent_id string, contents string"),
        "documents": make([("ds", "d", "xx alpha beta")], "dataset string, doc_id string, contents string"),
    }


def test_analyzer_requests(corpus, spark):
    c = corpus
    assert {r["dataset"]: r["experiments"] for r in analyzer.datasets(c["experiments"]).collect()} == {"ds": 2, "ds_merged": 1}
    got = {r["query_id"]: r for r in analyzer.dataset_queries(c["experiments"], c["queries"], c["retrieved"], "ds").collect()}
    assert got["q1"]["contents"] == "What?" and got["q1"]["bucket"] == "partial"
    assert (got["q1"]["per_exp"]["e1"]["hit"], got["q1"]["per_exp"]["e1"]["relevant_pct"], got["q1"]["per_exp"]["e3"]["relevant_pct"]) == (True, 50.0, None)
    detail = analyzer.query_detail(c["retrieved"], c["passages"], "e1", "q1").collect()
    assert [(r["passage_id"], r["rank"], r["is_relevant"], r["contents"]) for r in detail] == [("p2", 1, True, "beta"), ("px", 2, False, "")]
    one = analyzer.chunk(c["passages"], c["experiments"], c["documents"], "e1", "p2").first()
    assert (one["position"], one["document_truncated"]) == (9, False)
    assert analyzer.full_document(c["passages"], c["experiments"], c["documents"], "e1", "p1").first()["words"] == 3
    assert [r["query_id"] for r in analyzer.relevant_queries(c["queries"], "e1", "p1").collect()] == ["q1"]
    texts = {r["passage_id"]: (r["contents"], r["score"], r["was_retrieved"]) for r in analyzer.relevant_chunk_texts(c["queries"], c["retrieved"], c["passages"], "e1", "q1").collect()}
    assert texts == {"p1": ("alpha", None, False), "p2": ("beta", 0.9, True)}
    assert [r["query_id"] for r in analyzer.search(c["queries"], "YES").collect()] == ["q1"]
    results = spark.createDataFrame([("e1", 1.0)], "exp string, mrr double")
    assert sorted((r["exp"], r["mrr"]) for r in analyzer.dataset_metrics(c["experiments"], results, "ds").collect()) == [("e1", 1.0), ("e3", None)]
    assert [r["mrr"] for r in analyzer.sorted_by_score(spark.createDataFrame([(None,), (1.0,)], "mrr double"), "mrr").collect()] == [1.0, None]


def test_pairs_and_partner(spark, corpus):
    facts = spark.createDataFrame([("e1", "q", False), ("e2", "q", True), ("e1", "r", True), ("e2", "r", True)], "exp string, query_id string, hit boolean")
    assert {r["query_id"]: r["status"] for r in analyzer.pair_info(corpus["experiments"], facts).collect()} == {"q": "better", "r": "same"}
    got = spark.createDataFrame([("a",), ("a_merged",)], "d string").select(analyzer.partner(F.col("d")).alias("p")).collect()
    assert [r["p"] for r in got] == ["a_merged", "a"]


def test_injected_scores(spark):
    pairs = spark.createDataFrame([("a", "aa"), ("b", "")], "query string, text string")
    assert [r["score"] for r in analyzer.scored(pairs, lambda q, t: [float(len(x)) for x in t]).orderBy("query").collect()] == [2.0, 0.0]


def test_close_but_apart_takes_the_first(spark):
    pairs = spark.createDataFrame([("q", "m", 0, 0.5, 0.5, 1.0, 9.0), ("q", "m", 1, 0.5, 0.52, 1.0, 9.0), ("q", "m", 2, 0.5, 0.51, 1.0, 9.0), ("q", "n", 0, 0.5, 0.51, 1.0, 1.1)], "query_id string, chunk_m string, pos_n int, ret_m double, ret_n double, rer_m double, rer_n double")
    assert [(r["chunk_m"], r["pos_n"]) for r in analytics.close_but_apart(pairs, 0.05, 1).collect()] == [("m", 1)]


def test_streams_give_the_batch_rows(spark, tmp_path):
    rows = [(i, f"Sentence one of {i}. Two! Three?" * 20, None) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, arrived timestamp").withColumn("arrived", F.timestamp_seconds(F.col("doc_id") * 600))
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    for name in ("fixed_size", "passage", "text_tiling", "sequential_hac_chunker"):
        batch = chunk_stream.chunk_stream(frame, name).collect()
        query = chunk_stream.chunk_stream(chunk_stream.document_stream(spark, str(tmp_path / "in")), name).writeStream.format("memory").queryName(f"out_{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert sorted(map(tuple, spark.table(f"out_{name}").collect())) == sorted(map(tuple, batch))
    counts = chunk_stream.arrivals_per_window(chunk_stream.distinct_arrivals(chunk_stream.document_stream(spark, str(tmp_path / "in"))), size="20 minutes")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert all(r["documents"] <= 2 for r in spark.table("counts").collect())


def test_registered_queries_have_sql_or_a_reason():
    import __spark_entry__
    from chunkwright.plans import queries, source_queries

    assert set(queries.ORACLES) <= set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert queries.QUERIES["s1_document_scan"] is source_queries.s1_document_scan
    without = set(queries.QUERIES) - set(queries.ORACLES)
    models = {f"chunker_{x}" for x in ("text_tiling", "max_min_chunker", "recursive_semantic", "graphseg", "lumberchunker")}
    assert without <= models | {"c12_late_chunking", "d6_html_text", "e1_embedded"}


def test_groups_and_counts_of_experiments(spark):
    rows = [("a", "x", "q", "why", "f"), ("b", "y", "q", "how", "g"), ("c", "x", "q", "who", "h")]
    results = spark.createDataFrame(rows, "exp string, dataset string, query_id string, question string, free_text_answer string")
    groups = {r["dataset"]: (r["question"], r["exps"]) for r in analytics.query_groups(results).collect()}
    assert groups == {"x": ("why", ["a", "c"]), "y": ("how", ["b"])}
    whole = analytics.query_groups(results, True).first()
    assert (whole["dataset"], whole["free_text_answer"], whole["exps"]) == ("MULTI", "f", ["a", "b", "c"])
    experiments = spark.createDataFrame([("x", "m"), ("y", "m"), ("y", "n")], "dataset string, chunker string")
    assert {tuple(r) for r in analytics.chosen_experiments(experiments, ["y"], ["n"]).collect()} == {("y", "m")}
    assert analytics.chosen_experiments(experiments).count() == 3
    assert {r["chunker"]: r["runs"] for r in analytics.runs_per_method(experiments).collect()} == {"m": 2, "n": 1}
    passages = spark.createDataFrame([("d",), ("d",), ("e",)], "parent_id string")
    assert tuple(analytics.passages_per_document(passages).first()) == (2, 2)
    assert tuple(analytics.passages_per_document(passages.filter("false")).first()) == (1, 0)
