import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import tokenizers

from chunkwright.llm import packing
from tests.llm.helpers import DOCS, docs


def reference_ids(texts):
    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [x.ids + [0] for x in own.encode_batch(texts, add_special_tokens=False)]


def check(rows, pieces, window=1024):
    ids = {r[0]: x for r, x in zip(rows, reference_ids([r[1] or "" for r in rows]), strict=True)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[doc])
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[doc][p["start"] : at], "<u4").tobytes())
        assert at == len(ids[doc])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_round_trip(spark, tables):
    rows = docs(2) + [(900, "word " * 9000, "en", "s", 1), (901, "y", None, None, None)]
    pieces = packing.op9(spark, tables(documents=(rows, DOCS))).collect()
    check(rows, pieces)


def test_very_long_white_space_runs(spark):
    runs = [" " * 1_200_000, "\n" * 1_100_000, "\u3000 " * 550_000, " " * 150_000]
    texts = [f"word{x}next" for x in runs] + [f"a {x}" for x in runs] + [f"{x}\x1c1{x}\n!{x}<|endoftext|>{x}" for x in runs[3:]] + [" " * 99_999 + "b", "1" * 1_200_000]
    own = packing.vocabulary()
    for text, ids in zip(texts, reference_ids(texts), strict=True):
        assert np.array_equal(packing.encode(text, own), ids[:-1]), (text[:10], len(text))
    rows = [(1, texts[0]), (2, "after it")]
    check(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_little_padding(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 2500)))) for i in range(400)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert check(rows, pieces) <= 1024


def test_rule_takes_the_level_of_least_growth():
    r = random.Random(3)
    levels = packing.SumOfSquares(16)
    for _ in range(500):
        size = r.randint(1, 15)
        counts = levels.counts.copy()

        def grown(h, size=size, counts=counts):
            c = counts.copy()
            c[h] -= h > 0
            c[h + size] += h + size < 16
            return int((c**2).sum())

        open_ = [h for h in range(16 - size + 1) if h == 0 or counts[h]]
        assert grown(levels.level_for(size)) == min(map(grown, open_))
        levels.place(size, (0, 0, np.zeros(size, np.uint32), size))


def test_open_windows_are_bounded():
    docs_ = ((i, np.full(600, i, np.uint32)) for i in range(300))
    sequences = list(packing.pack_stream(docs_, 1024, max_open=10))
    assert sum(len(x[2]) for s in sequences for x in s) == 300 * 600
    assert sum(sum(len(x[2]) for x in s) == 1024 for s in sequences) >= len(sequences) - 8


def test_placements_stay():
    """The fullest windows keep what the rule placed; little is moved, even from few documents."""
    r = random.Random(6)
    sizes = [r.randint(1, 1023) for _ in range(300)]
    moved = []
    sequences = list(packing.pack_stream(((i, np.full(n, i, np.uint32)) for i, n in enumerate(sizes)), moved=moved))
    assert sum(moved) <= 0.2 * sum(sizes)
    whole = {i: 0 for i in range(300)}
    for held in sequences:
        for doc, start, ids, total in held:
            assert total == sizes[doc] and len(ids) and (ids == doc).all()
            whole[doc] += len(ids)
    assert [whole[i] for i in range(300)] == sizes
    assert sum(n & (n - 1) != 0 for n in (sum(len(x[2]) for x in s) for s in sequences)) <= 1


def test_ids_are_those_of_tokenizers_on_a_whole_table(spark):
    texts = [x["text"] or "" for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    own = packing.vocabulary()
    for text, ids in zip(texts, reference_ids(texts), strict=True):
        assert np.array_equal(packing.encode(text, own), ids[:-1])


def test_long_text_is_encoded_whole(monkeypatch):
    text = "Don't stop  here, 漢字 don't 12 ab\n cd <|endoftext|> é " * 50
    whole = reference_ids([text])[0][:-1]
    monkeypatch.setattr(packing, "LONG_TEXT", 37)
    assert packing.encode(text, packing.vocabulary()).tolist() == whole


def test_empty_table(spark, tables):
    assert packing.op9(spark, tables(documents=([], DOCS))).collect() == []
