import json

from pyspark.sql import functions as F

from chunkwright.plans import export
from chunkwright.sources import jsonl


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")


PARTS = {
    "river": ["The Oder rises in Moravia.", "It runs north past Opole.", "It meets the sea near Szczecin."],
    "bridge": ["Work on the bridge began in 1903.", "It opened to carts in 1907."],
    "mill": ["The mill burned twice."],
}
PASSAGES = [(f"{parent}-{i}", parent, text) for parent, texts in PARTS.items() for i, text in enumerate(texts)]
ASKED = {
    "course": (["river"], "Moravia. It runs north"), "mouth": (["river"], "Szczecin"), "danube": (["river"], "Danube"),
    "carts": (["bridge"], "to carts"), "works": (["mill", "bridge"], None),
}


def expected(parents, answer):
    """Numbers and scores by hand: positions of the answer in the parents' laid-out text."""
    own = [(n, text) for n, (_, parent, text) in enumerate(PASSAGES) if parent in parents]
    if answer is None:
        return {str(n): 1.0 for n, _ in own}
    begin = " ".join(t for _, t in own).find(answer)
    if begin < 0:
        return {"-1": 0.0}
    hit, at = [], 0
    for n, text in own:
        if at < begin + len(answer) and begin < at + len(text):
            hit.append(str(n))
        at += len(text) + 1
    return {n: 1 / len(hit) for n in hit}


def make_run(root, name="run_0007"):
    run = root / "waterways" / name
    write(run / "passages.jsonl", [{"id": i, "contents": text, "metadata": {"parentId": parent}} for i, parent, text in PASSAGES])
    write(run / "queries/queries.jsonl", [{"id": q, "contents": f"about {q}", "relevant": parents} | ({"metadata": {"extractive_span_text_answer": [answer]}} if answer else {}) for q, (parents, answer) in ASKED.items()])
    write(run / "documents/documents.jsonl", [{"id": parent, "contents": " ".join(texts)} for parent, texts in PARTS.items()])
    write(run / "metadata.json", [{"dataset_slug": "waterways"}])
    return run


def test_runs_are_exported_and_failures_noted(spark, tmp_path):
    make_run(tmp_path)
    (tmp_path / "waterways" / "run_0008").mkdir()
    rows = export.export_runs(spark, str(tmp_path / "waterways"), str(tmp_path / "out"))
    assert [(r["run"], r["status"]) for r in rows] == [("run_0007", "finished"), ("run_0008", "failed")] and "passages.jsonl" in rows[1]["note"]
    assert {k: rows[0][k] for k in ("passages", "queries", "extractive", "not_found")} == {"passages": 6, "queries": 5, "extractive": 4, "not_found": 1}
    got = {r["query_id"]: dict(zip(r["relevant"], r["relevant_scores"], strict=True)) for r in jsonl.queries(spark, str(tmp_path / "out/run_0007/queries")).collect()}
    assert got == {q: expected(*x) for q, x in ASKED.items()} and got["course"] == {"0": 0.5, "1": 0.5}
    passages = jsonl.passages(spark, str(tmp_path / "out/run_0007/passages")).collect()
    assert sorted((int(r["passage_id"]), r["parent_id"], json.loads(r["metadata"])["original_id"]) for r in passages) == [(n, parent, i) for n, (i, parent, _) in enumerate(PASSAGES)]


def test_slow_export_times_out(spark, tmp_path):
    make_run(tmp_path)
    slow = lambda s, *_: s.range(1).selectExpr("java_method('java.lang.Thread', 'sleep', 20000L)").collect()
    assert [(r["status"], r["exit_code"]) for r in export.export_runs(spark, str(tmp_path), str(tmp_path / "out"), 1, slow)] == [("timed_out", 124)]


def test_prepared_and_merged(spark):
    docs = spark.createDataFrame([("a", "A", 0), ("b", "B", 1)], "doc_id string, contents string, doc_ord long")
    queries = spark.createDataFrame([("q", 0, ["a"], ["x"], None), ("r", 1, ["b"], ["y"], None)], "query_id string, query_ord int, relevant array<string>, extractive_span_text_answer array<string>, free_text_answer array<string>")
    d, q = export.prepared(docs, queries, 1)
    assert d.count() == 1 and [r["query_id"] for r in q.collect()] == ["q"]
    d, q = export.merged_dataset(docs, queries)
    assert d.first()["contents"] == "A\n\nB" and q.filter(F.col("relevant") == F.array(F.lit("merged"))).count() == 2


def test_stated_answers_and_annotations(spark):
    frame = spark.createDataFrame([(["YES", "true", "No", "None", "other", None], [1, 2], ["a"])], "a array<string>, b array<int>, c array<string>")
    assert frame.select(export.stated_answers(F.col("a")).alias("x")).first()["x"] == ["yes", "no", "unanswerable", "other"]
    assert [tuple(r) for r in frame.select(export.annotation_list({"b": F.col("b"), "c": F.col("c")}).alias("x")).first()["x"]] == [(1, "a"), (2, None)]
