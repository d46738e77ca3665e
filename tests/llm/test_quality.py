import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwright.llm import quality
from tests.llm.helpers import DOCS, HOSTILE

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=500):
    r = random.Random(8)
    words = [a + b for a in ("th", "er", "on", "an") for b in ("ing", "tion", "ed", "ly", "re")]
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.8
        text = [r.choice(words) for _ in range(r.randint(20, 80))]
        if not good:
            mark = r.choice(["***", "$$$", "!!"])
            text = [(w.upper() if mark == "!!" else w) + mark for w in text]
        rows.append((i, " ".join(text), "en", f"s{i % 3}", 0))
        if r.random() < 0.7:
            labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_columns(spark, tables):
    rows, labels = corpus()
    rows += [(10_000 + i, t, None, None, None) for i, t in enumerate(HOSTILE)] + [rows[0]]
    got = quality.op6(spark, tables(documents=(rows, DOCS), labels=(labels + labels[:5], LABELS))).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in labels}
    for x in got:
        assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0)
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3)
    held = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert len(held) > 40
    assert np.mean([x["predicted"] == truth[x["doc_id"]] for x in held]) >= 0.95
    assert len({x["score"] for x in got if x["doc_id"] in (10_000, 10_001)}) == 1  # null as empty


def test_held_out_labels_are_not_read(spark, tables):
    rows, labels = corpus(120)
    frame = spark.createDataFrame(rows, DOCS)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = (quality.train(frame, spark.createDataFrame(x, LABELS)).net for x in (labels, flipped))
    assert np.array_equal(a.a, b.a) and a.temperature == b.temperature


def test_word_vectors_are_the_neighbours_sums(spark):
    texts = ["a b c", "b c", "c", "", "A b"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    index, known = quality.index_vectors(), quality._Buckets()
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts:
        for units in quality._streams(t.encode(), known):
            for i, u in enumerate(units):
                for j in range(max(0, i - 2), min(len(units), i + 3)):
                    if j != i:
                        want[u] += index[units[j]]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert quality.word_vectors(frame) == pytest.approx(want / np.where(norm > 0, norm, 1), abs=1e-6)


def test_accepted_rows_keep_columns_and_good_documents(spark):
    rows, labels = corpus(300)
    frame = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x")).withColumn("id", F.lit(1))
    out = quality.accepted_rows(frame, spark.createDataFrame(labels, LABELS))
    assert out.columns == frame.columns
    kept = {r["doc_id"] for r in out.collect()}
    good = {r[0] for r in rows if "***" not in r[1] and "$$$" not in r[1] and "!!" not in r[1]}
    assert len(good - kept) <= 0.02 * len(good) and len(kept - good) <= 0.1 * (len(rows) - len(good))


def test_no_labels_and_empty_tables(spark, tables):
    d = tables(documents=([(1, "a", None, None, None)], DOCS), labels=([], LABELS))
    assert [x["score"] for x in quality.op6(spark, d).collect()] == [0.5]


def test_empty_documents(spark, tables):
    assert quality.op6(spark, tables(documents=([], DOCS), labels=([(1, 1, 0)], LABELS))).collect() == []
