"""Dataset sources: landed files to (documents, queries).

``DATASETS`` maps a name to a function (spark, path, split) that returns two
DataFrames.  Nothing is fetched; files are landed beforehand.
Documents: doc_id, contents, metadata, doc_ord.  Queries: query_id, contents,
relevant, answers columns, query_ord.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwright.functions import text as T
from chunkwright.operators.prepare import accumulated_contexts, collision_free, concatenated, hash_slices, seeded_sample

Artifacts = tuple[DataFrame, DataFrame]
DATASETS: dict[str, Callable[..., Artifacts]] = {}


def dataset(*names: str):
    def register(f):
        for name in names:
            if name in DATASETS:
                raise ValueError(f"dataset {name!r} is already registered")
            DATASETS[name] = f
        return f

    return register


def load(name: str, *args, **kwargs) -> Artifacts:
    if name not in DATASETS:
        raise KeyError(f"unknown dataset {name!r}; there are {', '.join(sorted(DATASETS))}")
    return DATASETS[name](*args, **kwargs)


def _meta(**columns) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]))


def _strings() -> Column:
    return F.array().cast("array<string>")


def documents_of(df: DataFrame, doc_id: Column, contents: Column, order: Column, **meta) -> DataFrame:
    return df.select(doc_id.cast("string").alias("doc_id"), contents.alias("contents"), (_meta(**meta) if meta else F.lit("{}")).alias("metadata"), order.cast("long").alias("doc_ord"))


def queries_of(df: DataFrame, query_id: Column, contents: Column, relevant: Column, order: Column, extractive: Column | None = None, free: Column | None = None, strip: Callable[[Column], Column] = T.py_strip, **meta) -> DataFrame:
    null = F.lit(None).cast("array<string>")
    return df.select(
        query_id.cast("string").alias("query_id"), contents.alias("contents"), relevant.alias("relevant"), (null if extractive is None else T.clean_answers(extractive, strip)).alias("extractive_span_text_answer"),
        (null if free is None else T.clean_answers(free, strip)).alias("free_text_answer"), (_meta(**meta) if meta else F.lit("{}")).alias("metadata"), order.cast("long").alias("query_ord"),
    )


# -- question answering over contexts ------------------------------------------


def poquad(rows: DataFrame) -> Artifacts:
    """rows: ord, title, context, question, question_id, answers, is_impossible.  One document per context."""
    digest = T.digest_id("poquad-", F.col("context"), 12)
    docs = rows.groupBy("context").agg(F.min("ord").alias("ord"), F.min_by("title", "ord").alias("title"))
    return (
        documents_of(docs, digest, F.col("context"), F.col("ord"), title=F.col("title")),
        queries_of(rows, F.col("question_id"), F.col("question"), F.array(digest), F.col("ord"), F.col("answers")),
    )


def squad(rows: DataFrame, skip_impossible: bool = True, sample: int | None = None, limit: int | None = None, seed: int = 42) -> Artifacts:
    """rows: ord, title, context, question, question_id, answers (text), answer_starts, is_impossible.  One document per title."""
    rows = rows.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("context", F.lit("")) != "") & (F.coalesce("question", F.lit("")) != ""))
    if skip_impossible:
        rows = rows.filter(~F.coalesce("is_impossible", F.lit(False)))
    docs = accumulated_contexts(rows, "title", "ord", "context").join(rows.groupBy("title").agg(F.min("ord").alias("ord")), "title")
    starts = docs.select("title", F.inline("starts")).select("title", F.col("o").alias("ord"), F.col("start").alias("context_start"))
    asked = rows.join(starts, ["title", "ord"])
    queries = queries_of(asked, F.col("question_id"), F.col("question"), F.array("title"), F.col("ord"), F.col("answers"), None, answer_starts=F.transform("answer_starts", lambda x: x + F.col("context_start")))
    if sample is not None:
        queries = seeded_sample(queries, sample, seed, "query_id", "query_ord")
    if limit is not None:
        queries = queries.orderBy("query_ord").limit(limit)
    return documents_of(docs, F.col("title"), F.col("contents"), F.col("ord")), queries


def qasper(papers: DataFrame, strip: Callable[[Column], Column] = T.py_strip) -> Artifacts:
    """papers: ord, id, title, abstract, sections array<struct<name, paragraphs array<string>>>, captions array<string>, qas array<struct<question, question_id, answers array<struct<free, spans array<string>, yes_no, unanswerable>>>>.  What ``strip`` leaves empty is left out."""
    body = F.transform("sections", lambda s: F.array_join(F.filter(F.concat(F.array(s["name"]), s["paragraphs"]), lambda x: x.isNotNull() & (strip(x) != "")), "\n"))
    text = F.array_join(F.filter(F.concat(F.array("title", "abstract"), body, F.coalesce("captions", _strings())), lambda x: x.isNotNull() & (strip(x) != "")), "\n\n")
    rendered = papers.withColumn("body", text)
    q = rendered.select("ord", "id", "body", F.posexplode("qas").alias("p", "q"))
    answers = F.flatten(F.transform("q.answers", lambda a: F.coalesce(a["spans"], _strings())))
    stated = F.transform("q.answers", lambda a: F.when(a["unanswerable"], "unanswerable").when(a["yes_no"].isNotNull(), F.when(a["yes_no"], "yes").otherwise("no")).otherwise(a["free"]))
    every = F.concat(answers, F.filter(stated, lambda a: a.isNotNull()))
    return (
        documents_of(rendered, F.col("id"), F.col("body"), F.col("ord"), title=F.col("title"), sections=F.size("sections")),
        queries_of(q, F.col("q.question_id"), F.col("q.question"), F.array("id"), F.col("ord") * 1000 + F.col("p"), T.extractive(every, F.col("body")), T.free(every, F.col("body")), strip),
    )


def literaryqa(books: DataFrame, limit: int | None = None) -> Artifacts:
    """books: ord, id, title, text, qas array<struct<question, answers array<string>>>."""
    kept = books.filter(F.coalesce("text", F.lit("")) != "")
    kept = kept if limit is None else kept.orderBy("ord").limit(limit)
    q = kept.select("ord", "id", "text", F.posexplode("qas").alias("p", "q"))
    answers = T.clean_answers(F.col("q.answers"))
    return (
        documents_of(kept, F.col("id"), F.col("text"), F.col("ord"), title=F.col("title")),
        queries_of(q, F.concat_ws("-", "id", "p"), F.col("q.question"), F.array("id"), F.col("ord") * 10_000 + F.col("p"), T.extractive(answers, F.col("text")), T.free(answers, F.col("text"))),
    )


def gutenqa(chunks: DataFrame, questions: DataFrame) -> Artifacts:
    """chunks: ord, book, chunk_id, text; questions: ord, book, chunk_id, question, answer, must_contain.  A document per chunk."""
    key = F.concat_ws("_", "book", "chunk_id")
    joined = questions.join(chunks.select("book", "chunk_id", F.col("text").alias("own")), ["book", "chunk_id"])
    return (
        documents_of(chunks, key, F.col("text"), F.col("ord"), book=F.col("book")),
        queries_of(joined, F.concat_ws("_q", key, F.col("ord").cast("string")), F.col("question"), F.array(key), F.col("ord"), T.extractive(F.array("answer", "must_contain"), F.col("own")), F.array("answer")),
    )


def gutenqa_concat(chunks: DataFrame, questions: DataFrame) -> Artifacts:
    """As gutenqa, with the chunks of a book joined to one document."""
    books = concatenated(chunks, "book", "chunk_id", "text").join(chunks.groupBy("book").agg(F.min("ord").alias("ord")), "book")
    joined = questions.join(books.select("book", F.col("contents").alias("body")), "book")
    return (
        documents_of(books, F.col("book"), F.col("contents"), F.col("ord"), chunks=F.col("pieces")),
        queries_of(joined, F.concat_ws("_q", "book", F.col("ord").cast("string")), F.col("question"), F.array("book"), F.col("ord"), T.extractive(F.array("answer", "must_contain"), F.col("body")), F.array("answer")),
    )


def crud(rows: DataFrame, fields: tuple = ("news1", "news2", "news3"), strip: Callable[[Column], Column] = T.py_strip, strip_answers: Callable[[Column], Column] = T.py_strip) -> Artifacts:
    """rows: ord, id, question, answers, and up to three document fields.  Documents by content, with their occurrences; what ``strip`` leaves empty is none."""
    used = [F.col(f) for f in fields if f in rows.columns]
    texts = F.filter(F.array(*used), lambda x: x.isNotNull() & (strip(x) != ""))
    each = rows.select("ord", F.posexplode(texts).alias("p", "contents"))
    docs = each.groupBy("contents").agg(F.min(F.struct("ord", "p")).alias("first_ord"), F.count(F.lit(1)).alias("occurrences")).withColumn("content_id", F.substring(F.md5("contents"), 1, 16))
    docs = collision_free(docs)
    own = each.join(docs.select("contents", "content_id"), "contents").groupBy("ord").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("p", "content_id"))), lambda x: x["content_id"])).alias("relevant"))
    return (
        documents_of(docs, F.col("content_id"), F.col("contents"), F.col("first_ord.ord") * 8 + F.col("first_ord.p"), occurrences=F.col("occurrences")),
        queries_of(rows.join(own, "ord"), F.col("id"), F.col("question"), F.col("relevant"), F.col("ord"), None, F.col("answers"), strip_answers),
    )


def novelqa(books: DataFrame, questions: DataFrame) -> Artifacts:
    """books: book, title, text; questions: ord, book, question_id, question, options, answer, aspect, complexity.  Books without text get a stub."""
    asked = questions.groupBy("book").agg(F.min("ord").alias("ord"))
    joined = asked.join(books, "book", "left").withColumn("contents", F.coalesce("text", F.concat(F.lit("[text of "), "book", F.lit(" is not available]"))))
    docs = joined.groupBy("contents").agg(F.min("ord").alias("first_ord"), F.min_by("title", "ord").alias("title"), F.count(F.lit(1)).alias("occurrences")).withColumn("content_id", F.substring(F.md5("contents"), 1, 16))
    docs = collision_free(docs)
    of_book = joined.join(docs.select("contents", "content_id"), "contents").select("book", "content_id", "contents")
    q = questions.join(of_book, "book")
    return (
        documents_of(docs, F.col("content_id"), F.col("contents"), F.col("first_ord"), title=F.col("title"), occurrences=F.col("occurrences")),
        queries_of(q, F.col("question_id"), F.col("question"), F.array("content_id"), F.col("ord"), None, F.array("answer"), options=F.col("options"), aspect=F.col("aspect"), complexity=F.col("complexity")),
    )


def triviaqa_spans(rows: DataFrame, slices: dict[str, int] | None = None, name: str | None = None) -> Artifacts:
    """rows: ord, text, question, question_id, spans array<string> ("start:end").  Documents by content; optional hash slices."""
    docs = rows.groupBy(F.col("text")).agg(F.min("ord").alias("ord")).withColumn("doc_id", F.substring(F.md5("text"), 1, 16))
    if slices:
        docs = hash_slices(docs, slices).filter(F.col("slice") == name)
        rows = rows.join(docs.select("text"), "text", "left_semi")
    pair = F.transform("spans", lambda s: F.transform(F.split(s, ":"), lambda x: x.try_cast("int")))
    ok = F.filter(pair, lambda s: (F.size(s) == 2) & s[0].isNotNull() & s[1].isNotNull())
    return (
        documents_of(docs, F.col("doc_id"), F.col("text"), F.col("ord")),
        queries_of(rows, F.col("question_id"), F.col("question"), F.array(F.substring(F.md5("text"), 1, 16)), F.col("ord"), T.valid_spans(F.col("text"), ok)),
    )


# -- judged collections -----------------------------------------------------------


def judged_collection(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, min_score: float = 1.0, limit: int | None = None) -> Artifacts:
    """corpus: ord, id, title, text; queries: ord, id, text; qrels: query_id, doc_id, score.

    Judged pairs at the least score or above, by falling score; texts that are
    missing are empty.  Only judged documents become documents.
    """
    kept = qrels.withColumn("score", F.col("score").try_cast("double")).filter(F.col("score") >= min_score)
    own = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))).alias("j"))
    ids = kept.select("doc_id").distinct()
    docs = ids.join(corpus, ids["doc_id"] == corpus["id"], "left")
    out = documents_of(docs, F.col("doc_id"), T.title_and_text(F.col("title"), F.col("text")), F.col("ord"), title=F.col("title"))
    asked = own.join(queries.select(F.col("id").alias("query_id"), F.col("text"), F.col("ord")), "query_id", "left")
    scores = F.map_from_entries(F.transform("j", lambda x: F.struct(x["doc_id"], -x["s"])))
    q = queries_of(asked, F.col("query_id"), F.coalesce("text", F.lit("")), F.transform("j", lambda x: x["doc_id"]), F.coalesce("ord", F.lit(0)), None, None, qrels_scores=scores)
    return out, q if limit is None else q.orderBy("query_ord", "query_id").limit(limit)


class _Text(HTMLParser):
    """Text of a page: a space after every piece, lines at block tags, no scripts or styles, no blank lines."""

    # Tags that begin a line, and those whose end begins one as well.
    OPENING = frozenset("p br div li tr h1 h2 h3 h4".split())
    CLOSING = frozenset("p div li tr".split())
    HIDDEN = frozenset(("script", "style"))

    def __init__(self):
        super().__init__()
        self.lines, self.hidden = [[]], False

    def handle_starttag(self, tag, attrs):
        self.hidden |= tag in self.HIDDEN
        if tag in self.OPENING:
            self.lines.append([])

    def handle_endtag(self, tag):
        self.hidden &= tag not in self.HIDDEN
        if tag in self.CLOSING:
            self.lines.append([])

    def handle_data(self, data):
        if not self.hidden and not data.isspace():
            self.lines[-1].append(data.strip())

    @classmethod
    def of(cls, source: str) -> str:
        p = cls()
        p.feed(source)
        p.close()
        found = (part.strip() for line in p.lines for part in " ".join(line).splitlines())
        return "\n".join(x for x in found if x)


def html_text(source: str) -> Column:
    """Plain text of an HTML column, by batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.fillna("").map(_Text.of)

    return run(source)


def articles(qrels: DataFrame, passages: DataFrame, pages: DataFrame, queries: DataFrame, max_evidence: int = 10) -> Artifacts:
    """Passage judgements to article judgements: qrels (query_id, passage_id, score), passages (passage_id, title, text), pages (title, html), queries (ord, id, text).

    An article scores as its best passage; the judged passages are the evidence.
    """
    doc = F.concat(F.lit("wiki-"), F.substring(F.md5("title"), 1, 16))
    judged = qrels.join(passages, "passage_id").withColumn("doc_id", doc)
    best = judged.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    own = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))).alias("j"))
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "passage_id")
    evidence = judged.withColumn("r", F.row_number().over(over)).filter(F.col("r") <= max_evidence).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]).alias("evidence"))
    needed = judged.select("title", "doc_id").distinct().join(pages, "title")
    docs = documents_of(needed, F.col("doc_id"), html_text("html"), F.xxhash64("doc_id"), title=F.col("title"))
    asked = own.join(evidence, "query_id").join(queries.select(F.col("id").alias("query_id"), "text", "ord"), "query_id", "left")
    return docs, queries_of(asked, F.col("query_id"), F.coalesce("text", F.lit("")), F.transform("j", lambda x: x["doc_id"]), F.coalesce("ord", F.lit(0)), F.col("evidence"))


# -- registered names: landed files under a path ------------------------------------


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.json(f"{path}/{name}.jsonl")


def _one(f):
    return lambda spark, path, **kwargs: f(_read(spark, path, "rows"), **kwargs)


def _two(f, a, b):
    return lambda spark, path, **kwargs: f(_read(spark, path, a), _read(spark, path, b), **kwargs)


dataset("poquad")(_one(poquad))
dataset("squad")(_one(squad))
dataset("qasper", "QASPER")(_one(qasper))
dataset("literaryqa", "literary_qa")(_one(literaryqa))
dataset("crud")(_one(crud))
dataset("triviaqa_span_annotated", "triviaqa-span-annotated")(_one(triviaqa_spans))
dataset("gutenqa")(_two(gutenqa, "chunks", "questions"))
dataset("gutenqa_concat")(_two(gutenqa_concat, "chunks", "questions"))
dataset("novelqa")(_two(novelqa, "books", "questions"))
for _names in (("scifact", "SciFact"), ("nfcorpus", "NFCorpus"), ("fiqa2018", "FiQA2018")):
    dataset(*_names)(lambda spark, path, **kwargs: judged_collection(*(_read(spark, path, x) for x in ("corpus", "queries", "qrels")), **kwargs))
dataset("natural_questions", "NaturalQuestions", "beir_nq_wiki_articles")(lambda spark, path, **kwargs: articles(*(_read(spark, path, x) for x in ("qrels", "passages", "pages", "queries")), **kwargs))
