from collections import Counter

import corpus_pipeline
from chunkwright.llm.common import table
from tests.llm.helpers import DOCS
from tests.llm.test_packing import check
from tests.llm.test_quality import LABELS, corpus


def test_stages_take_effect(spark, tables):
    rows, labels = corpus(250)
    rows += [(9000, rows[1][1], "en", "s1", 0), (9001, rows[2][1] + " more", "en", "s1", 0), (9002, None, None, None, None)]
    d = tables(documents=(rows, DOCS), labels=(labels, LABELS))
    docs, before = table(spark, d, "documents"), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == docs.columns, name
            out.write.parquet(f"{d}/out{k}")
            out = spark.read.parquet(f"{d}/out{k}")
        after = [tuple(r) for r in out.collect()]
        if name == "exact_dedup":
            assert len({r[1] or "" for r in after}) == len(after) and {r[1] or "" for r in after} == {r[1] or "" for r in before}
        if name == "simhash_near_dedup":
            assert set(after) <= set(before)
            assert len(after) >= 0.8 * len(before)
        if name == "mixing":
            assert set(after) <= set(before) and max(Counter(after).values()) <= 3
        docs, before = out, after
    pieces = corpus_pipeline.run(spark, d).collect()
    assert len(pieces) and {p["doc_id"] for p in pieces} <= {r[0] for r in rows}


def test_packing_of_repeated_documents(spark):
    frame = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    check([(1, "a b c"), (2, "d e")], corpus_pipeline.pack(spark, frame, "").collect())


def test_empty_documents(spark, tables):
    d = tables(documents=([], DOCS), labels=([], LABELS))
    assert corpus_pipeline.run(spark, d).collect() == []
