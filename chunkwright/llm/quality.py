"""Quality classifier: random-indexing word vectors and a small network.

1. Random indexing over all documents.  A text is read as two streams of
   units: its words (lower case) and their shapes (runs of capitals, letters,
   digits and signs).  Units fall into a fixed number of buckets by hash; each
   bucket has a sparse random index vector.  The vector of a bucket is the sum
   of the index vectors of its neighbours (two to each side) over the whole
   corpus.  Tasks add up their part and emit one row per bucket, so what moves
   is bounded by the buckets, whatever a frequent word's share.
2. A document is the mean of its units' vectors, by stream, and a few ratios of
   its characters.
3. A two-layer network, in numpy, learns ``quality`` from a bounded sample of
   the labelled rows (``MAX_TRAIN``, by hash order); a fifth of them is left
   out of the fit and sets the temperature that calibrates its probabilities.
4. Every document is scored from its whole text.

Label, language, source and id are no inputs.  Rows whose crc32(id as text)
modulo 5 is 0 are held out: their labels are never read for the fit.

Defined cases: null text is the empty text, and an empty text has the vector 0
and gets a score like any other; without labels of both kinds every score is
the share of ones (0.5 without labels); repeated labels of an id count once
(the largest); identical rows get one row each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.llm.common import pick, table, tidied

BUCKETS, DIM, NONZERO, REACH = 4096, 48, 4, 2
#: At most so many labelled rows are fitted on, the first by a hash of the id.
MAX_TRAIN, HIDDEN, EPOCHS, THRESHOLD, FOLDS, SEED = 12_000, 32, 60, 0.3, 5, 7
_WORDS = 3 * BUCKETS // 4  # buckets of words; the rest are shapes'

_CLASS = bytes(65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 97 if c >= 128 or 97 <= c <= 122 else c for c in range(256))


def index_vectors(seed: int = SEED) -> np.ndarray:
    """Sparse ternary index vectors of all buckets, one extra row of zeros."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS + 1, DIM), np.float32)
    for row in out[:BUCKETS]:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def shape(word: bytes) -> bytes:
    """Runs of one class of character, up to two of each."""
    kinds, out = word.translate(_CLASS), bytearray()
    for c in kinds:
        if len(out) < 2 or out[-1] != c or out[-2] != c:
            out.append(c)
    return bytes(out[:16])


class _Buckets(dict):
    """Word -> word bucket and shape bucket in one number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        a = xxhash.xxh3_64_intdigest(word.lower()) % _WORDS
        b = _WORDS + xxhash.xxh3_64_intdigest(shape(word)) % (BUCKETS - _WORDS)
        value = self[word] = a << 16 | b
        return value


def _streams(text: bytes, known: _Buckets) -> np.ndarray:
    """2 x n buckets: words, shapes."""
    both = np.array(list(map(known.__getitem__, text.split())), np.int64)
    return np.stack([both >> 16, both & 0xFFFF])


def _chunks(batches: Iterator[pa.RecordBatch], known: _Buckets) -> Iterator[tuple[list, list[bytes], np.ndarray, np.ndarray]]:
    """ids, texts, lengths and the documents' streams laid end to end, about 100,000 words at a time."""
    ids, texts, parts, n = [], [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("id"), batch.column("text"), strict=True):
            text = (t.as_py() or "").encode()
            own = _streams(text, known)
            ids.append(i.as_py())
            texts.append(text)
            parts.append(own)
            n += own.shape[1]
            if n > 100_000:
                yield ids, texts, np.array([x.shape[1] for x in parts]), np.concatenate(parts, axis=1)
                ids, texts, parts, n = [], [], [], 0
    if ids:
        yield ids, texts, np.array([x.shape[1] for x in parts]), np.concatenate(parts, axis=1)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors by bucket."""
    index, known = index_vectors(), _Buckets()
    at = np.array([np.flatnonzero(r) for r in index[:BUCKETS]])
    sign = np.take_along_axis(index[:BUCKETS], at, axis=1)
    total = np.zeros(BUCKETS * DIM)
    for _, _, lengths, streams in _chunks(batches, known):
        doc = np.repeat(np.arange(len(lengths)), lengths)
        for units in streams:
            for step in range(1, REACH + 1):
                same = doc[step:] == doc[:-step]
                a, b = units[:-step][same], units[step:][same]
                for here, there in ((a, b), (b, a)):
                    for k in range(NONZERO):
                        total += np.bincount(here * DIM + at[there, k], sign[there, k], BUCKETS * DIM)
    rows = total.reshape(BUCKETS, DIM)
    used = np.flatnonzero(rows.any(axis=1))
    if len(used):
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(list(rows[used]), pa.list_(pa.float64()))], names=["bucket", "sums"])


def word_vectors(rows: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets over the whole corpus: BUCKETS rows reach the driver, whatever its size."""
    parts = rows.mapInArrow(tidied(_count_pairs), "bucket int, sums array<double>").select("bucket", F.posexplode("sums").alias("d", "x"))
    sums = parts.groupBy("bucket", "d").agg(F.sum(F.col("x").cast("decimal(28,0)")).alias("x"))  # whole numbers: any order gives the same sum
    vectors = np.zeros((BUCKETS, DIM), np.float32)
    found = sums.select("bucket", "d", F.col("x").cast("double").alias("x")).toArrow()
    vectors[found["bucket"].to_numpy(), found["d"].to_numpy()] = found["x"].to_numpy()
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def _ratios(text: bytes, words: int) -> list[float]:
    n = max(1, len(text))
    kinds = np.bincount(np.frombuffer(text.translate(_CLASS), np.uint8), minlength=128) if text else np.zeros(128)
    signs = kinds[33:].sum() - kinds[65] - kinds[97] - kinds[48:49].sum()
    return [kinds[65] / n, kinds[48] / n, signs / n, kinds[10] / n, min(1.0, n / max(1, words) / 20), float(np.log1p(words)) / 10]


def features(vectors: np.ndarray, lengths: np.ndarray, streams: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """One row per document."""
    out = np.zeros((len(lengths), 2 * DIM + 6), np.float32)
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        for i, units in enumerate(streams):
            out[full, i * DIM : (i + 1) * DIM] = np.add.reduceat(vectors[units], starts, axis=0) / lengths[full, None]
    out[:, 2 * DIM :] = [_ratios(t, int(n)) for t, n in zip(texts, lengths, strict=True)]
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    a: np.ndarray
    a0: np.ndarray
    b: np.ndarray
    b0: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -10, 10)
        return np.maximum(x @ self.a + self.a0, 0) @ self.b + self.b0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Adam on the log loss, then the temperature of the rows left out."""
    dim = x.shape[1]
    if len(y) < 10 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Network(np.zeros(dim), np.ones(dim), np.zeros((dim, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside, train = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    p = [rng.normal(0, (2 / dim) ** 0.5, (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    z = np.clip((x - mean) / scale, -10, 10).astype(np.float64)
    best, kept = np.inf, None
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), 64):
            i = train[at : at + 64]
            h = np.maximum(z[i] @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[i]) / len(i)
            dh = np.outer(d, p[2]) * (h > 0)
            t += 1
            for k, g in enumerate((z[i].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        loss = _loss(np.maximum(z[aside] @ p[0] + p[1], 0) @ p[2] + p[3], y[aside])
        if loss < best:
            best, kept = loss, [q.copy() for q in p]
    net = Network(mean, scale, kept[0], kept[1], kept[2], float(kept[3][0]), 1.0)
    logits = net.logits(x[aside])
    net.temperature = float(min(np.geomspace(0.5, 5, 60), key=lambda q: _loss(logits / q, y[aside])))
    return net


def _vectors_of(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for ids, texts, lengths, streams in _chunks(batches, known):
            x = features(vectors, lengths, streams, texts)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "x"])

    return run


def _scores_of(vectors: np.ndarray, net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for ids, texts, lengths, streams in _chunks(batches, known):
            score = net.scores(features(vectors, lengths, streams, texts).astype(np.float64))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(score)], names=["id", "score"])

    return run


def held_out(id_: F.Column) -> F.Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Model:
    vectors: np.ndarray
    net: Network


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    known = pick(labels, id=id_col, y=label_col).filter("id IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("id")))
    known = known.groupBy(F.col("id").cast("long").alias("id")).agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(MAX_TRAIN)
    vectors = word_vectors(rows)
    own = rows.join(F.broadcast(chosen.select("id")), "id", "left_semi")  # at most MAX_TRAIN rows
    found = own.mapInArrow(tidied(_vectors_of(vectors)), "id long, x array<float>").groupBy("id").agg(F.min("x").alias("x"))
    y_of = {r["id"]: r["y"] for r in chosen.collect()}
    fitted = sorted((r["id"], r["x"]) for r in found.collect())  # at most MAX_TRAIN rows
    x = np.array([v for _, v in fitted], np.float32).reshape(len(fitted), 2 * DIM + 6)
    return Model(vectors, fit(x, np.array([y_of[i] for i, _ in fitted], np.float64)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(tidied(_scores_of(model.vectors, model.net)), "id long, score double").withColumnRenamed("id", "doc_id")


def accepted_rows(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` scored at ``threshold`` or more, with all their columns."""
    model = train(docs, labels, id_col, text_col)
    target = docs.select(*[F.col(f"`{c}`") for c in docs.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for batch in batches:
            ids = pa.array(range(batch.num_rows), pa.int64())
            read = pa.record_batch([ids, batch.column(batch.schema.get_field_index(text_col))], names=["id", "text"])
            keep = np.zeros(batch.num_rows, bool)
            for at, texts, lengths, streams in _chunks(iter([read]), known):
                keep[at] = model.net.scores(features(model.vectors, lengths, streams, texts).astype(np.float64)) >= threshold
            yield batch.filter(pa.array(keep))

    return target.mapInArrow(tidied(run), target.schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
