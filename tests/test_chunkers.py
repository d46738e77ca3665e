import random

import numpy as np
import pytest

from chunkwright.operators import chunkers, kernels


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def restated_windows(text, size, overlap):
    out, at = [], 0
    while text and (not out or out[-1][1] < len(text)):
        out.append((at, min(at + size, len(text))))
        at += size - overlap
    return out


def test_fixed_size_equals_a_plain_loop(spark):
    texts = ["", "a", "abcde" * 9, "x" * 20, "𝒳y" * 15]
    got = chunkers.get_chunker("fixed_size", chunk_size=10, overlap=3)(docs(spark, *texts)).orderBy("doc_id", "chunk_index").collect()
    expected = [(i, k, t[a:b], a, b) for i, t in enumerate(texts) for k, (a, b) in enumerate(restated_windows(t, 10, 3))]
    assert [(r["doc_id"], r["chunk_index"], r["text"], r["start_char"], r["end_char"]) for r in got] == expected


@pytest.mark.parametrize("params", [{"chunk_size": 0, "overlap": 0}, {"chunk_size": 5, "overlap": 5}, {"chunk_size": 5, "overlap": -1}])
def test_fixed_size_rejects_bad_windows(spark, params):
    with pytest.raises(ValueError):
        chunkers.get_chunker("fixed_size", **params)(docs(spark, "x"))


def test_registry():
    assert {"fixed_size", "passage", "passage_regexp", "text_tiling", "max_min_chunker", "sequential_hac_chunker", "recursive_semantic", "graphseg", "lumberchunker", "lumberchunker_api", "dense_x_retrieval", "passage_spacy"} <= set(chunkers.list_chunkers())
    with pytest.raises(KeyError):
        chunkers.get_chunker("moc")
    with pytest.raises(ValueError):
        chunkers.chunker("fixed_size")(lambda d: d)


def test_chain_rule_equals_adjacent_merging(spark):
    r = np.random.default_rng(4)
    for _ in range(60):
        v = r.normal(size=(r.integers(1, 12), 3))
        groups = kernels.chain_by_merging(v, 0.6)
        got = kernels.chain_chunks([str(i) for i in range(len(v))], lambda _, v=v: v, 0.6)
        assert [g["text"] for g in got] == [" ".join(map(str, g)) for g in groups]
    rows = [(0, i, str(i), x.tolist()) for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "doc_id long, sentence_index int, text string, embedding array<double>")
    assert [x["text"] for x in chunkers.sequential_hac(frame, 0.6).orderBy("chunk_index").collect()] == [g["text"] for g in got]


def prose(seed, topics=4, sentences=30):
    r = random.Random(seed)
    out = []
    for t in range(topics):
        words = [f"{'abcdefgh'[t]}{'aeiou'[k % 5]}word{'xyz'[k % 3]}{'klmn'[k % 4]}" for k in range(25)]
        out += [" ".join(r.choice(words) for _ in range(r.randint(6, 14))).capitalize() + r.choice(".!?") for _ in range(sentences)]
    return " ".join(out)


@pytest.mark.parametrize("name", ["text_tiling", "recursive_semantic", "max_min_chunker", "sequential_hac_chunker", "graphseg", "passage_spacy"])
def test_kernels_keep_the_text(spark, name):
    texts = [prose(1), prose(2, 1, 3), "no end", "", "   "]
    got = chunkers.get_chunker(name)(docs(spark, *texts)).orderBy("doc_id", "chunk_index").collect()
    for i, t in enumerate(texts):
        own = [r for r in got if r["doc_id"] == i]
        assert "".join("".join(r["text"].split()) for r in own) == "".join(t.split())
        if own and "start_char" in own[0].asDict():
            assert all(a["end_char"] <= b["start_char"] for a, b in zip(own, own[1:], strict=False))
            assert all("".join(t[r["start_char"] : r["end_char"]].split()) == "".join(r["text"].split()) for r in own)


def test_tiling_cuts_between_topics():
    p = kernels.Tiling(20, 10, 2, 1, "hc", frozenset(), kernels.sentence_spans)
    text = prose(3, 3, 80)
    parts = p.chunks(text)
    assert len(parts) > 1
    assert all(text.find(x["text"]) >= 0 and x["text"][-1] in ".!?" for x in parts)


def test_tiling_depths_and_flat_scores():
    p = kernels.Tiling(20, 10, 2, 1, "hc", frozenset(), kernels.sentence_spans)
    depth = p.depths([0.5, 0.6, 0.7, 0.2, 0.8, 0.6, 0.5])
    assert depth.tolist()[:2] == [0, 0] and depth[3] == pytest.approx(0.7 + 0.8 - 0.4)
    assert not p.depths([0.3] * 30).any()


def test_max_min_rules():
    v = np.array([[1, 0], [1, 0.1], [0, 1], [0.1, 1], [-1, 0]], float)
    got = kernels.max_min_chunks(list("abcde"), lambda _: v, 0.9, 0.6, 1.5)
    assert [x["text"] for x in got] == ["a b", "c d", "e"]


def test_recursive_joins_short_pieces_and_sizes_long_ones():
    r = kernels.Recursive(max_chunk_size=15000, recursive_threshold=1500, delta=3, merge_threshold=3, final_threshold=8, breakpoint_percentile=95, embed=kernels.hashing_embedder, splitter=kernels.sentence_list)
    assert r.join_short(["abcd", "x", "efgh"]) in (["abcdx", "efgh"], ["abcd", "xefgh"])
    assert all(len(x) <= 8 for x in r.sized("one two three four fiiiiiiiiiiive"))
    assert kernels.offsets("a  b c", ["ab", "zz", "c"]) == [(0, 4), (4, 6), (5, 6)]


def test_lumber_with_a_model_and_its_failures():
    sentences = [f"s{i} " + "w " * 20 for i in range(30)]
    got = kernels.lumber_chunks(sentences, lambda p: "Answer: ID " + p.split("ID ")[-1].split(":")[0], 100)
    assert len(got) > 2 and "".join("".join(x["text"].split()) for x in got) == "".join("".join(s.split()) for s in sentences)

    def broken(_):
        raise RuntimeError("no answer")

    for ask in (broken, lambda _: "", lambda _: "Answer: ID zero", lambda _: "Answer: ID 0"):
        assert "".join("".join(x["text"].split()) for x in kernels.lumber_chunks(sentences, ask, 100)) == "".join("".join(s.split()) for s in sentences)
    with pytest.raises(ValueError):
        chunkers.get_chunker("lumberchunker")(None)


@pytest.mark.parametrize(
    "output,expected",
    [('["a", " b ", ""]', ["a", "b"]), ('Sure: {"propositions": ["x"]} done', ["x"]), ("- one\n* two\n\n", ["one", "two"]), ('{"other": 1}', ['{"other": 1}']), ("", []), ("[broken", ["[broken"])],
)
def test_proposition_salvage(output, expected):
    assert kernels.proposition_list(output) == expected


def test_token_windows_overlap():
    assert kernels.token_windows(10, 4, 0.25) == [(0, 4), (3, 7), (6, 10)]
    got = kernels.propositions("a b c d e f", lambda t: f'["{t}"]', 4, 0.25)
    assert [(g["text"], g["window_segment_index"], g["total_window_segments"]) for g in got] == [("a b c d", 0, 2), ("d e f", 1, 2)]


def test_graph_segments_respect_the_least_size():
    v = np.array([[1, 0]] * 4 + [[0, 1]] * 4 + [[1, 1]], float)
    segments = kernels.graph_segments(v, 0.9, 3)
    assert segments[0] == (0, 4) and all(b - a >= 3 for a, b in segments)


def test_kernel_chunkers_keep_the_type_of_ids(spark):
    frame = spark.createDataFrame([("doc-1", "One here. Two there. Three more."), ("doc-2", None)], "doc_id string, text string")
    for name in ("text_tiling", "passage_spacy", "max_min_chunker", "sequential_hac_chunker", "recursive_semantic", "graphseg"):
        out = chunkers.get_chunker(name)(frame)
        assert dict(out.dtypes)["doc_id"] == "string"
        found = out.collect()
        assert {r["doc_id"] for r in found} <= {"doc-1", "doc-2"} and any(r["chunk_id"] == "doc-1#0" for r in found), name


def test_tiling_scores_equal_sums_of_blocks():
    p = kernels.Tiling(3, 4, 2, 1, "hc", frozenset({"a"}), kernels.sentence_spans)
    r = random.Random(5)
    for n in (0, 2, 7, 40, 101):
        words = [r.choice("abcdefgh") for _ in range(n)]
        blocks = [[x for x in words[i : i + 3] if x != "a"] for i in range(0, n, 3)]
        expected = []
        for g in range(len(blocks) - 1):
            reach = min(4, g + 1, len(blocks) - 1 - g)
            left, right = sum(blocks[g + 1 - reach : g + 1], []), sum(blocks[g + 1 : g + 1 + reach], [])
            norm = sum(left.count(x) ** 2 for x in set(left)) * sum(right.count(x) ** 2 for x in set(right))
            expected.append(sum(left.count(x) * right.count(x) for x in set(left)) / norm**0.5 if norm else 0.0)
        assert p.scores(words) == pytest.approx(expected, abs=1e-12)


def listed_cliques(like, threshold):
    """All maximal cliques, from all subsets."""
    n = len(like)
    sets = [c for c in range(1, 1 << n) if all(like[i, j] > threshold for i in range(n) for j in range(i) if c >> i & 1 and c >> j & 1)]
    return [{i for i in range(n) if c >> i & 1} for c in sets if not any(c != d and c & d == c for d in sets)]


def test_graph_segments_equal_shared_cliques():
    r = np.random.default_rng(8)
    for _ in range(80):
        v = r.normal(size=(r.integers(1, 9), 3))
        like = kernels.cosines(v, v)
        cliques = listed_cliques(like, 0.3)
        groups = [[0]]
        for i in range(1, len(v)):
            if any({i, i - 1} <= c for c in cliques):
                groups[-1].append(i)
            else:
                groups.append([i])
        joined = groups[:1]
        for s in groups[1:]:
            if any(c & set(s) and c & set(joined[-1]) for c in cliques):
                joined[-1] = joined[-1] + s
            else:
                joined.append(s)
        assert kernels.graph_segments(v, 0.3, 1) == [(s[0], s[-1] + 1) for s in joined]


def test_narrow_scans_are_dealt_out(spark, tmp_path):
    docs(spark, *"abcdef").coalesce(1).write.parquet(str(tmp_path / "one"))
    scan = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert chunkers.spread(scan).rdd.getNumPartitions() == max(cores, scan.rdd.getNumPartitions())
    assert sorted(r["text"] for r in chunkers.spread(scan).collect()) == list("abcdef")
    wide = spark.range(10).repartition(cores + 1)
    assert chunkers.spread(wide) is wide
