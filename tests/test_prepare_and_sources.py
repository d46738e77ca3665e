import hashlib
import json

import pytest
from chunkwright.operators import prepare, relevance
from chunkwright.sources import datasets, jsonl, sinks


def test_coverage_drops_sparse_keys_and_keeps_full_queries(spark):
    rows = [(i, ["x"] if i < 9 else None, ["y"] if i < 3 else []) for i in range(10)]
    out = prepare.coverage_filtered(spark.createDataFrame(rows, "query_id int, extractive_span_text_answer array<string>, free_text_answer array<string>")).collect()
    assert sorted(r["query_id"] for r in out) == list(range(9)) and all(r["free_text_answer"] is None for r in out)
    none = spark.createDataFrame([(1, None, None)], "query_id int, extractive_span_text_answer array<string>, free_text_answer array<string>")
    assert prepare.coverage_filtered(none).count() == 1


def test_first_documents_keep_repeats_in_order(spark):
    docs = spark.createDataFrame([("b", 1), ("a", 0), ("c", 2)], "doc_id string, doc_ord long")
    queries = spark.createDataFrame([("q", 0, ["c", "b", "a", "b"]), ("r", 1, ["c"]), ("s", 2, [])], "query_id string, query_ord int, relevant array<string>")
    kept, cut = prepare.first_documents(docs, queries, 2)
    assert {r["doc_id"] for r in kept.collect()} == {"a", "b"}
    assert [(r["query_id"], r["relevant"]) for r in cut.collect()] == [("q", ["b", "a", "b"])]


@pytest.mark.parametrize("text,expected", [("train", ("train", None, None)), ("train[:5]", ("train", None, 5)), ("dev[2:-1]", ("dev", 2, -1))])
def test_split_expressions(text, expected):
    assert prepare.split_expression(text) == expected
    with pytest.raises(ValueError):
        prepare.split_expression("a[1]")


def test_slices(spark):
    frame = spark.range(10)
    assert [r["id"] for r in prepare.sliced(frame, "x[2:-3]", "id").orderBy("id").collect()] == [2, 3, 4, 5, 6]
    assert [r["id"] for r in prepare.sliced(frame, "x[-2:]", "id").orderBy("id").collect()] == [8, 9]


def test_hash_slices_are_the_least_digests(spark):
    texts = [f"t{i}" for i in range(30)]
    key = lambda t: hashlib.md5(f"42:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
    got = prepare.hash_slices(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), {"a": 3, "b": 4}).collect()
    order = sorted(texts, key=key)
    assert {r["text"]: r["slice"] for r in got} == {**dict.fromkeys(order[:3], "a"), **dict.fromkeys(order[3:7], "b")}


def test_contexts_accumulate_without_repeats(spark):
    rows = [("t", 0, "abc"), ("t", 1, "bc"), ("t", 2, "xyz"), ("u", 3, "q")]
    got = {r["k"]: r for r in prepare.accumulated_contexts(spark.createDataFrame(rows, "k string, o int, c string"), "k", "o", "c").collect()}
    assert got["t"]["contents"] == "abc\n\nxyz" and [tuple(s) for s in got["t"]["starts"]] == [(0, 0), (1, 1), (2, 5)]


def test_merged_dataset(spark):
    docs = spark.createDataFrame([("a", "A", 0), ("b", "B", 1)], "doc_id string, contents string, doc_ord long")
    queries = spark.createDataFrame([("q", ["b", "a"], None), ("r", ["a"], ["x"])], "query_id string, relevant array<string>, answers array<string>")
    assert prepare.super_document(docs).first()["contents"] == "A\n\nB"
    got = {r["query_id"]: (r["relevant"], r["answers"]) for r in prepare.merged_queries(queries, docs).collect()}
    assert got == {"q": (["merged"], ["B", "A"]), "r": (["merged"], ["x"])}


def test_colliding_ids_get_suffixes(spark):
    frame = spark.createDataFrame([("x", 2), ("x", 1), ("y", 3)], "content_id string, first_ord int")
    assert sorted((r["first_ord"], r["content_id"]) for r in prepare.collision_free(frame).collect()) == [(1, "x"), (2, "x-1"), (3, "y")]


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_jsonl_scans(spark, tmp_path):
    d = lines(tmp_path / "d.jsonl", {"id": "a", "contents": "x"}, "", {"id": 0, "text": "y", "metadata": {"k": 1}}, {"id": "", "contents": None})
    got = jsonl.documents(spark, d).collect()
    assert [(r["contents"]) for r in got] == ["x", "y", ""] and got[0]["doc_id"] == "a" and json.loads(got[1]["metadata"]) == {"k": 1} and len(got[2]["doc_id"]) == 36
    q = lines(tmp_path / "q.jsonl", {"id": "q", "contents": "c", "relevant": ["1", 2], "relevant_scores": [1, 0.5]}, {"id": "r", "relevant": None}, {"id": "s", "relevant": "7"})
    assert [(r["relevant"], r["relevant_scores"]) for r in jsonl.queries(spark, q).collect()] == [(["1", "2"], [1.0, 0.5]), ([], []), (["7"], [])]
    p = lines(tmp_path / "p.jsonl", {"id": "p", "parentId": "d", "contents": "x"}, {"id": "q", "metadata": {"parentId": "e"}, "text": "y"}, {"id": "r"})
    assert [(r["passage_id"], r["parent_id"], r["contents"]) for r in jsonl.passages(spark, p).collect()] == [("p", "d", "x"), ("q", "e", "y"), ("r", "", "")]


def test_strict_scan_and_bad_lines(spark, tmp_path):
    d = lines(tmp_path / "d.jsonl", {"id": "a"}, "[1]", "{broken", {"id": "b"})
    assert sorted(r["value"] for r in jsonl.bad_lines(spark, d).collect()) == ["[1]", "{broken"]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        jsonl.strict_lines(spark, d, "id string").collect()


def test_timing_report_and_runs(spark, tmp_path):
    t = tmp_path / "t.tsv"
    t.write_text("run\tstatus\texit_code\tduration_sec\tnote\nrun_0001\tfinished\t0\t4\t\nrun_0002\ttimed_out\t124\t\t>60s\n")
    assert [(r["run"], r["exit_code"], r["duration_sec"], r["note"]) for r in jsonl.timing_report(spark, str(t)).collect()] == [("run_0001", 0, 4, ""), ("run_0002", 124, 0, ">60s")]
    for run, files in (("run_0001", jsonl.REQUIRED), ("run_0002", jsonl.REQUIRED[:2])):
        for name in files:
            path = tmp_path / "session" / run / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text("{}")
    assert [p.name for p in jsonl.run_dirs(str(tmp_path))] == ["run_0001", "run_0002"]
    assert [p.name for p in jsonl.valid_run_dirs(str(tmp_path))] == ["run_0001"]
    assert jsonl.missing_files(tmp_path / "session" / "run_0002") == list(jsonl.REQUIRED[2:])
    digest = jsonl.file_digests(spark, str(t)).first()
    assert digest["sha256"] == hashlib.sha256(t.read_bytes()).hexdigest()
    one = tmp_path / "exp1" / "m.json"
    one.parent.mkdir()
    one.write_text('{\n "a": 1\n}')
    assert [(r["a"], r["exp"]) for r in jsonl.json_files(spark, str(one)).collect()] == [(1, "exp1")]


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(2, "ż"), (1, None)], "id int, contents string")
    sinks.write_jsonl(frame, str(tmp_path / "o"), single_file_order=["id"])
    text = next((tmp_path / "o").glob("part-*")).read_text(encoding="utf-8").splitlines()
    assert [json.loads(x) for x in text] == [{"id": 1, "contents": None}, {"id": 2, "contents": "ż"}] and "ż" in text[1]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_jsonl(frame, str(tmp_path / "o"))
    sinks.write_jsonl(frame, str(tmp_path / "o"), overwrite=True)
    assert json.loads(open(sinks.sidecar(str(tmp_path / "x"), {"n": 1})).read()) == {"n": 1}
    assert sinks.stamped("/a/b.jsonl").startswith("/a/b_2") and sinks.stamped("/a/b.jsonl").endswith("Z.jsonl")
    report = spark.createDataFrame([("d", "r", 1, 3, 100 / 3)], "dataset string, run string, missing_count long, total long, percent double")
    assert sinks.missing_report(report).first()["percent"] == "33.33"


def test_question_sources(spark):
    rows = spark.createDataFrame([(0, "t", "ctx one", "q?", "i0", ["one"], [4], False), (1, "t", "ctx one", "r?", "i1", [" "], [0], True), (2, "t", "two", "s?", "i2", ["two"], [0], False)], "ord int, title string, context string, question string, question_id string, answers array<string>, answer_starts array<int>, is_impossible boolean")
    docs, queries = datasets.poquad(rows)
    assert docs.count() == 2 and queries.count() == 3
    docs, queries = datasets.squad(rows)
    assert docs.first()["contents"] == "ctx one\n\ntwo"
    assert [json.loads(r["metadata"])["answer_starts"] for r in queries.orderBy("query_ord").collect()] == [[4], [9]]
    assert datasets.squad(rows, skip_impossible=False, sample=2)[1].count() == 2


def test_gutenberg_sources(spark):
    chunks = spark.createDataFrame([(0, "b", 0, "once upon"), (1, "b", 1, "a time")], "ord int, book string, chunk_id int, text string")
    asked = spark.createDataFrame([(0, "b", 1, "when?", "a time", "time")], "ord int, book string, chunk_id int, question string, answer string, must_contain string")
    _, q = datasets.gutenqa(chunks, asked)
    assert (q.first()["relevant"], q.first()["extractive_span_text_answer"]) == (["b_1"], ["a time", "time"])
    d, q = datasets.gutenqa_concat(chunks, asked)
    assert d.first()["contents"] == "once upon\n\na time" and (q.first()["relevant"], q.first()["extractive_span_text_answer"]) == (["b"], ["a time", "time"])


def test_collections_and_articles(spark):
    corpus = spark.createDataFrame([(0, "d1", "T", "x"), (1, "d2", "", "y")], "ord int, id string, title string, text string")
    asked = spark.createDataFrame([(0, "q", "why")], "ord int, id string, text string")
    qrels = spark.createDataFrame([("q", "d2", "1"), ("q", "d1", "2"), ("q", "gone", "1"), ("q", "d3", "0"), ("p", "d1", "bad")], "query_id string, doc_id string, score string")
    docs, queries = datasets.judged_collection(corpus, asked, qrels)
    assert {r["doc_id"]: r["contents"] for r in docs.collect()} == {"d1": "T\n\nx", "d2": "y", "gone": ""}
    assert [(r["query_id"], r["relevant"]) for r in queries.collect()] == [("q", ["d1", "d2", "gone"])]
    passages = spark.createDataFrame([("p1", "A", "one"), ("p2", "A", "two")], "passage_id string, title string, text string")
    pages = spark.createDataFrame([("A", "<p>one<script>no</script></p><div>two &amp; three</div>")], "title string, html string")
    judged = spark.createDataFrame([("q", "p1", 1.0), ("q", "p2", 2.0)], "query_id string, passage_id string, score double")
    docs, queries = datasets.articles(judged, passages, pages, asked)
    assert docs.first()["contents"] == "one\ntwo & three" and queries.first()["extractive_span_text_answer"] == ["two", "one"]


def test_other_sources(spark):
    crud = spark.createDataFrame([(0, "a", "q", ["x"], "n1", "n2"), (1, "b", "r", ["y"], "n1", None)], "ord int, id string, question string, answers array<string>, news1 string, news2 string")
    docs, queries = datasets.crud(crud)
    assert docs.count() == 2 and [len(r["relevant"]) for r in queries.orderBy("query_ord").collect()] == [2, 1]
    trivia = spark.createDataFrame([(0, "hello world", "q", "i", ["0:5", "9:99", "x", "6:11"])], "ord int, text string, question string, question_id string, spans array<string>")
    assert datasets.triviaqa_spans(trivia)[1].first()["extractive_span_text_answer"] == ["hello", "world"]
    books = spark.createDataFrame([("b", "T", "text")], "book string, title string, text string")
    asked = spark.createDataFrame([(0, "b", "i", "q", "o", "a", "asp", "c"), (1, "z", "j", "q", "o", "a", "asp", "c")], "ord int, book string, question_id string, question string, options string, answer string, aspect string, complexity string")
    docs, queries = datasets.novelqa(books, asked)
    assert docs.count() == 2 and queries.count() == 2
    lit = spark.createDataFrame([(0, "b", "T", "the answer is here", [("q?", ["answer", "none"])])], "ord int, id string, title string, text string, qas array<struct<question: string, answers: array<string>>>")
    q = datasets.literaryqa(lit)[1].first()
    assert (q["extractive_span_text_answer"], q["free_text_answer"]) == (["answer"], ["none"])
    paper = spark.createDataFrame([(0, "p", "T", "abs", [("S", ["one", "two"])], None, [("q", "i", [("fr", ["one"], None, False), (None, [], True, False)])])], "ord int, id string, title string, abstract string, sections array<struct<name: string, paragraphs: array<string>>>, captions array<string>, qas array<struct<question: string, question_id: string, answers: array<struct<free: string, spans: array<string>, yes_no: boolean, unanswerable: boolean>>>>")
    docs, queries = datasets.qasper(paper)
    assert docs.first()["contents"] == "T\n\nabs\n\nS\none\ntwo" and queries.first()["extractive_span_text_answer"] == ["one"] and queries.first()["free_text_answer"] == ["fr", "yes"]


def test_registry_reads_landed_files(spark, tmp_path):
    lines(tmp_path / "corpus.jsonl", {"ord": 0, "id": "d", "title": "T", "text": "x"})
    lines(tmp_path / "queries.jsonl", {"ord": 0, "id": "q", "text": "why"})
    lines(tmp_path / "qrels.jsonl", {"query_id": "q", "doc_id": "d", "score": 1})
    docs, queries = datasets.load("SciFact", spark, str(tmp_path))
    assert docs.count() == queries.count() == 1
    with pytest.raises(KeyError):
        datasets.load("none", spark, "")
    with pytest.raises(ValueError):
        datasets.dataset("squad")(None)
    assert {"poquad", "qasper", "literary_qa", "novelqa", "NFCorpus", "FiQA2018", "beir_nq_wiki_articles", "triviaqa-span-annotated", "gutenqa_concat", "crud"} <= set(datasets.DATASETS)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<b>bold</b>er", "bold er"), ("one<h5>two</h5>", "one two"), ("<h2>head</h2>body", "head body"), ("a<br>b", "a\nb"), ("<ul><li>x</li><li> y </li></ul>", "x\ny"),
        ("<script>s</script>t<style>u</style>", "t"), ("<td>a</td><td>b</td>", "a b"), ("x &lt; y\n  z", "x < y\nz"), ("", ""), ("<script>never closed", ""),
    ],
)
def test_lines_of_a_page(page, text):
    assert datasets._Text.of(page) == text


def test_answer_key_beside_the_metadata(spark, tmp_path):
    key = "extractive_span_text_answer"
    rows = [{"id": "a", key: ["x", "y"]}, {"id": "b", key: None}, {"id": "c", key: "z", "metadata": {key: None}}, {"id": "d", key: ["no"], "metadata": {key: ["in"]}}, {"id": "e", "metadata": {}, "meta": {key: ["old"]}}, {"id": "f", "contents": key}]
    read = jsonl.queries(spark, lines(tmp_path / "q.jsonl", *rows))
    got = {r["query_id"]: r["a"] for r in read.select("query_id", relevance.answers_of(own="own_answers").alias("a")).collect()}
    assert got == {"a": ["x", "y"], "b": [], "c": ["z"], "d": ["in"], "e": ["old"], "f": None}


def test_rows_keep_the_order_of_their_lines(spark, tmp_path):
    """Small files are packed by size; the order is still that of names and lines."""
    (tmp_path / "p").mkdir()
    for i, n in enumerate((3, 400, 1, 90)):
        lines(tmp_path / "p" / f"part-{i}.jsonl", *[{"id": f"{i}-{k:03d}", "contents": "x" * n} for k in range(n)])
    got = [r["passage_id"] for r in jsonl.passages(spark, str(tmp_path / "p")).orderBy("line").collect()]
    assert got == sorted(got) and len(got) == 494


def test_metadata_overrides_the_document(spark):
    frame = spark.createDataFrame([("a", "t", '{"doc_id": "b"}'), ("c", "t", "{}"), ("d", "t", '{"doc_id": null}')], "doc_id string, contents string, metadata string")
    assert [r["doc_id"] for r in jsonl.chunker_rows(frame).collect()] == ["b", "c", None]
