import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from chunkwright.llm import anchors, bwt_dedup, repeats, tree_dedup
from tests.llm.helpers import DOCS, docs


def brute_bytes(rows, n=100):
    seen, out = set(), {}
    for i, text in sorted(((r[0], (r[1] or "").encode()) for r in rows)):
        gone = np.zeros(len(text), bool)
        for a in range(len(text) - n + 1):
            w = text[a : a + n]
            if w in seen:
                gone[a : a + n] = True
            seen.add(w)
        left = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(text), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def brute_words(rows, n=35):
    split = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows}
    count = Counter(tuple(w[a : a + n]) for w in split.values() for a in range(len(w) - n + 1))
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for a in range(len(w) - n + 1):
            if count[tuple(w[a : a + n])] > 1:
                gone[a : a + n] = [True] * n
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


def corpus():
    r = random.Random(9)
    passage = " ".join(f"q{r.randint(0, 99)}" for _ in range(80))
    extra = [f"{' '.join(r.choice('abcdefg') for _ in range(40))} {passage} {' '.join(r.choice('hijk') for _ in range(r.randint(0, 60)))}" for _ in range(40)]
    extra += ["ab" * 300, "ab" * 301, "z" * 101, "z" * 100, "z" * 99, "é" * 120, "x y " * 40, "x y " * 17 + "x", "x y " * 17]
    return docs(7, vocabulary=500) + [(5000 + 7 * i, t, None, None, None) for i, t in enumerate(extra)]


@pytest.mark.parametrize("hot", ["no", "dealt", "by window"])
def test_op8_and_op10_equal_brute_force(spark, tables, monkeypatch, hot):
    if hot != "no":  # every k-gram of the sample is dealt to many tasks
        monkeypatch.setattr(repeats, "SAMPLE", 1.0)
        monkeypatch.setattr(repeats, "HOT_LEAST", 2)
    if hot == "by window":
        monkeypatch.setattr(repeats, "SPANS", 1)
    d = tables(documents=(corpus(), DOCS))
    got = {r["doc_id"]: tuple(r)[1:] for r in bwt_dedup.op8(spark, d).collect()}
    assert got == brute_bytes(corpus())
    got = {r["doc_id"]: tuple(r)[1:] for r in tree_dedup.op10(spark, d).collect()}
    assert got == brute_words(corpus())


def test_repeated_rows_and_null_ids(spark, tables):
    text = " ".join(f"v{i}" for i in range(60))
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, text, None, None, None), (2, None, None, None, None)]
    d = tables(documents=(rows, DOCS))
    n = len(text)
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in bwt_dedup.op8(spark, d).collect()) == [("1", n), ("1", n), ("2", 0), ("None", 0)]
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in tree_dedup.op10(spark, d).collect()) == [("1", 60), ("1", 60), ("2", 0), ("None", 60)]


def test_long_document_in_parts(spark, tables, monkeypatch):
    monkeypatch.setattr(anchors, "CHUNK_BITS", 10)
    monkeypatch.setattr(anchors, "_LOW", np.uint64(1023))
    monkeypatch.setattr(repeats, "CHUNK_BITS", 10)
    r = random.Random(4)
    long = " ".join(r.choice(["aa", "bb", "cc", "dd"]) + str(r.randint(0, 30)) for _ in range(3000))
    rows = [(1, long), (2, long[500:2500] + " tail"), (3, long[3000:3300])]
    units = [np.frombuffer(x.encode(), np.uint8) for _, x in rows]
    seen = defaultdict(int)
    for row, offset, lengths, laid in repeats._pieces([1, 2, 3], units, 100):
        doc, pos, first, last, _ = anchors.anchors(laid, lengths, 100, 32)
        for d, a, b in zip(doc, first, last, strict=True):
            for w in range(a, b + 1):
                seen[row[d], offset[d] + w] += 1
    assert set(seen.values()) == {1}
    assert len(seen) == sum(len(u) - 99 for u in units)


def test_kernels_equal_brute_force_on_random_spans():
    r = random.Random(6)
    for _ in range(200):
        n, window = r.randint(1, 12), r.choice([2, 3, 5, 8])
        spans = [bytes(r.choice(b"abc") for _ in range(r.randint(window, 30))) for _ in range(n)]
        seen, expected = set(), []
        for i, s in enumerate(spans):
            for a in range(len(s) - window + 1):
                if s[a : a + window] in seen:
                    expected.append((i, a))
                seen.add(s[a : a + window])
        assert list(zip(*map(list, bwt_dedup.repeated(spans, window)), strict=True)) == expected
        words = [b" ".join(bytes([c]) for c in s) for s in spans]
        count = Counter(s[a : a + window] for s in spans for a in range(len(s) - window + 1))
        expected = [(i, a) for i, s in enumerate(spans) for a in range(len(s) - window + 1) if count[s[a : a + window]] > 1]
        assert sorted(zip(*map(list, tree_dedup.repeated(words, window)), strict=True)) == expected


def test_empty_table(spark, tables):
    d = tables(documents=([], DOCS))
    assert bwt_dedup.op8(spark, d).collect() == [] and tree_dedup.op10(spark, d).collect() == []


def test_shared_parts_lose_no_repeat():
    r = random.Random(12)
    for _ in range(60):
        window, gram = 20, b"0123456789"
        spans, before, count = [], [], []
        for _ in range(r.randint(1, 8)):
            b, m = r.randint(0, 10), 0
            m = r.randint(1, b + 1)
            left, right = bytes(r.choice(b"ab") for _ in range(b)), bytes(r.choice(b"ab") for _ in range(30))
            if spans and r.random() < 0.7:
                left, right = (spans[0][: before[0]][-b:] if b else b"").rjust(b, b"a"), spans[0][before[0] + 10 :] + right
            spans.append((left + gram + right)[: m - 1 + window])
            before.append(b)
            count.append(m)
        who, begin, end = repeats.shared_parts(np.zeros(len(spans), np.int64), spans, np.array(before), np.array(count), window)
        kept = {(w, j) for w, a, z in zip(who.tolist(), begin.tolist(), end.tolist(), strict=True) for j in range(a, z + 1)}
        windows = defaultdict(list)
        for i, (s, b, m) in enumerate(zip(spans, before, count, strict=True)):
            for j in range(m):
                windows[b - j, s[j : j + window]].append((i, j))
        assert all(x in kept for same in windows.values() if len(same) > 1 for x in same)
        assert all(j < count[i] for i, j in kept)


def test_setting_of_the_session_comes_back(spark):
    from chunkwright.llm.common import _CLEANUP, drop_materialised, materialise

    before = spark.conf.get(_CLEANUP)
    kept = materialise(spark.range(50).repartition(4, "id"), "freed", free_shuffles=True)
    assert kept.count() == 50 and spark.conf.get(_CLEANUP) == before
    drop_materialised(kept)
