import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from chunkwright.llm import simhash
from tests.llm.helpers import DOCS, docs


def fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps, distance):
    """id -> least id of its component."""
    ids = list(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_op4_equals_brute_force(spark, tables):
    rows = docs(1) + [(1000 + i, t, None, None, None) for i, t in enumerate(["a b c d e f", "a b c d e f g", "A B C d e f"])]
    got = {r["doc_id"]: r for r in simhash.op4(spark, tables(documents=(rows, DOCS))).collect()}
    fps = {r[0]: fingerprint(r[1], 3) for r in rows}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{x:016x}" for i, x in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute(fps, 3)


def test_links_keep_every_component(spark):
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(12)]
    fps = {x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for x in centres for _ in range(60)} | {r.getrandbits(64) for _ in range(200)}
    signed = [((x - (1 << 64) if x >> 63 else x),) for x in sorted(fps)]
    frame = spark.createDataFrame(signed, "fp long").selectExpr("fp", "fp AS node", "0L AS more")
    for distance, block in ((3, 4096), (3, 7), (7, 4096), (7, 50)):
        links = [(x["u"] % (1 << 64), x["v"] % (1 << 64)) for x in simhash.fingerprint_links(frame, distance, block).collect()]
        groups = defaultdict(set)
        for i, c in brute({x: x for x in sorted(fps)}, distance).items():
            groups[c].add(i)
        parent = {x: x for x in fps}

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in links:
            parent[find(a)] = find(b)
        got = defaultdict(set)
        for x in fps:
            got[find(x)].add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values())), (distance, block)


def test_second_half_decides_with_wide_fingerprints(spark):
    rows = [(1, 0, 0), (2, 7, 0), (3, 7, (1 << 40) - 1), (4, 1, 3)]
    frame = spark.createDataFrame(rows, "node long, fp long, more long")
    links = {tuple(sorted(x)) for x in simhash.fingerprint_links(frame, 3, total=5).collect()}
    assert {x for pair in links for x in pair} == {1, 2, 4}


def test_stage_budgets_find_near_copies_and_leave_others(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    base = [[r.choice(words) for _ in range(200)] for _ in range(60)]
    rows, copies = [], set()
    for i, text in enumerate(base):
        rows.append((2 * i, " ".join(text)))
        if i % 2:
            changed = list(text)
            for k in r.sample(range(200), 2):
                changed[k] = "changed"
            rows.append((2 * i + 1, " ".join(changed)))
            copies.add(2 * i + 1)
    kept = {x["doc_id"] for x in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * i for i in range(60)} <= kept
    assert len(copies - kept) >= 0.9 * len(copies)


def test_long_text_is_counted_in_parts():
    text = " ".join(f"w{i % 977}" for i in range(450_000))
    assert int(simhash.fingerprints([text.encode()], 3)[0, 0]) == fingerprint(text, 3)
    halves = np.array(simhash.fingerprints([text.encode(), b"a b c"], 3, wide=True))
    hashes = [xxhash.xxh3_128_digest(x) for x in simhash.shingles(text.encode(), 3)]
    bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 16), axis=1, bitorder="little")
    assert np.unpackbits(halves[0].view(np.uint8), bitorder="little").tolist() == (2 * bits.sum(axis=0, dtype=int) > len(hashes)).astype(int).tolist()


def test_near_dedup_keeps_one_of_each_class_and_all_columns(spark):
    rows = [(1, "a b c d e f g h " * 20, "x"), (2, "a b c d e f g h " * 20, "y"), (3, "other words here now and then again", "z"), (3, "other words here now and then again", "z"), (4, None, "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    assert sorted((r["doc_id"], r["fp"]) for r in simhash.near_dedup(frame).collect()) == [(1, "x"), (3, "z"), (4, "n")]


def test_near_dedup_tells_rows_with_null_or_repeated_ids_apart(spark):
    r = random.Random(7)
    base, alone, other, third, fourth = (" ".join(f"{k}{r.randrange(5000)}" for _ in range(150)) for k in "abcde")
    near = base + " more"
    rows = [(3, base), (None, near), (None, alone), (None, other), (7, third), (7, near + " end"), (8, fourth), (8, "short text of its own"), (None, alone)]
    kept = [(x["doc_id"], x["text"]) for x in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([(3, base), (None, alone), (None, other), (7, third), (8, fourth), (8, "short text of its own")], key=str)


def jaccard(a, b):
    x, y = (set(simhash.shingles(t.encode(), 5)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_dedup_joins_by_similarity_of_shingles(spark):
    """Pairs from 0.65 to 0.95, each on words of its own: those at 0.8 or more are joined, no others."""
    r = random.Random(3)
    rows, near = [], set()
    for i in range(150):
        text = [f"w{i}x{r.randrange(10**6)}" for _ in range(300)]
        changed = list(text)
        for k in r.sample(range(300), r.randint(2, 14)):
            changed[k] = "other"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(changed))]
        if jaccard(rows[-2][1], rows[-1][1]) >= 0.8:
            near.add(2 * i + 1)
    gone = {i for i, _ in rows} - {x["doc_id"] for x in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone <= near and len(near) > 30
    assert len(gone) >= 0.97 * len(near)


def test_text_links_equal_brute_force_in_blocks(spark):
    r = random.Random(4)
    texts = ["", " ", "A b", "a B"]
    for _ in range(12):
        words = [f"v{r.randrange(10**6)}" for _ in range(120)]
        for _ in range(6):
            texts.append(" ".join("x" if r.random() < 0.012 else w for w in words))
    texts = sorted(set(texts))
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    parent = list(range(len(texts)))

    def find(i, parent):
        return i if parent[i] == i else find(parent[i], parent)

    for a in range(len(texts)):
        for b in range(a):
            if not sets[a] | sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[find(a, parent)] = find(b, parent)
    frame = spark.createDataFrame([(1, i, t.encode()) for i, t in enumerate(texts)], "root long, key long, text binary")
    for block in (1000, 9):
        got = list(range(len(texts)))
        for x in simhash.text_links(frame, 5, block).collect():
            got[find(x["u"], got)] = find(x["v"], got)
        for a in range(len(texts)):
            for b in range(a):
                assert (find(a, got) == find(b, got)) == (find(a, parent) == find(b, parent)), (block, texts[a], texts[b])


def test_empty_table(spark, tables):
    assert simhash.op4(spark, tables(documents=([], DOCS))).collect() == []


def test_crowded_least_shingles_lose_no_near_copy(spark):
    """A passage that most texts share: its least shingle is taken with others, then in blocks; the rows that stay are those of brute force."""
    r = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(40):
        own = [f"w{i}x{r.randrange(10**6)}" for _ in range(120)]
        for copy in range(3):
            text = own[:50] + passage + own[50:]
            for k in r.sample(range(len(text)), copy):
                text[k] = f"other{copy}"
            rows.append((3 * i + copy, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    gone = {a for a in texts for b in range(a - a % 3, a) if jaccard(texts[a], texts[b]) >= 0.8}
    for block in (4096, 6):
        kept = {x["doc_id"] for x in simhash.near_dedup(frame, block=block).collect()}
        assert set(texts) - kept == gone, block


def test_keys_of_a_fingerprint_do_not_grow_with_their_number(spark):
    for n in (2_000, 20_000):
        rows = spark.range(n).selectExpr("xxhash64(id) AS node", "xxhash64(id, 1) AS fp", "xxhash64(id, 2) AS more", "transform(sequence(3, 8), x -> xxhash64(id, x)) AS mins")
        assert simhash.gathered_links(rows).count() == 0
        assert rows.selectExpr("explode(mins)").count() == simhash.MINS * n


def test_least_shingle_that_is_crowded_and_the_only_one_shared_still_links(spark):
    """Links through the crowded key alone, in one cell, in a few blocks and in many, against brute force."""
    r = random.Random(21)
    rows = []
    for i in range(150):
        bits = r.getrandbits(128)
        for flips in (0, r.randint(20, 44)):
            x = bits ^ sum(1 << b for b in r.sample(range(128), flips))
            crowd = 7 if i % 5 else 100 + i
            rows.append((len(rows), x % (1 << 64), x >> 64, [r.getrandbits(60), crowd, *(r.getrandbits(60) for _ in range(simhash.MINS - 2))]))
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[3][1] == b[3][1] and ((a[1] ^ b[1]).bit_count() + (a[2] ^ b[2]).bit_count()) <= 32}
    assert 40 < len(expected) < 110
    signed = [(n, *(x - (1 << 64) if x >> 63 else x for x in halves), mins) for n, *halves, mins in rows]
    frame = spark.createDataFrame(signed, "node long, fp long, more long, mins array<long>")
    for block in (4096, 100, 7):
        assert {tuple(sorted(x)) for x in simhash.gathered_links(frame, block=block).collect()} == expected, block


def test_crowd_roots_equal_brute_force_when_links_are_folded_in(monkeypatch):
    r = random.Random(22)
    monkeypatch.setattr(simhash, "PENDING", 5)
    values = [x ^ sum(1 << b for b in r.sample(range(128), r.randint(0, 20))) for x in (r.getrandbits(128) for _ in range(8)) for _ in range(15)]
    r.shuffle(values)
    fp, more = (np.array(x, np.uint64) for x in ([v % (1 << 64) for v in values], [v >> 64 for v in values]))
    got = simhash.crowd_roots(fp, more, np.zeros(len(values), np.int64), 32)
    assert dict(enumerate(got.tolist())) == brute(dict(enumerate(values)), 32)
    cut = 70
    links = [(a, b) for a in range(cut) for b in range(cut, len(values)) if (values[a] ^ values[b]).bit_count() <= 32]
    across = simhash.crowd_roots(fp, more, np.repeat([0, 1], [cut, len(values) - cut]), 32)
    expected = simhash.joined(np.arange(len(values)), *np.array(links).T)
    assert len(links) > 100 and across.tolist() == expected.tolist()


def test_near_copies_that_share_only_the_least_shingle_of_a_crowd_are_joined(spark):
    """Each pair (similarity 0.85) agrees in one least shingle, which the passage gives to all the texts."""
    texts = []
    for seed in (3277, 20258, 27841, 37872):
        r = random.Random(seed)
        own = [f"w{r.randrange(10**6)}" for _ in range(60)]
        text = own[:30] + [f"p{i}" for i in range(60)] + own[30:]
        changed = ["other" if k in (3, 100) else x for k, x in enumerate(text)][:-1]
        texts += [" ".join(text), " ".join(changed)]
    least = simhash.fingerprints([x.encode() for x in texts], 5, wide=True, mins=True)[:, 2:]
    assert [int((least[i] == least[i + 1]).sum()) for i in range(0, 8, 2)] == [1] * 4 and len(set(least[:, 5].tolist())) == 1
    assert all(jaccard(texts[i], texts[i + 1]) >= 0.8 for i in range(0, 8, 2))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (4096, 6, 2):
        assert sorted(x["doc_id"] for x in simhash.near_dedup(frame, block=block).collect()) == [0, 2, 4, 6], block
