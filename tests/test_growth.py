"""What queries hold must not grow faster than their input."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as driver
from chunkwright.operators import chunkers


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def vectors(tables, labels):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist(), label) for i, label in enumerate(labels)]
    return tables(embeddings=(rows, "vec_id long, embedding array<float>, label int"))


@pytest.mark.parametrize("name", ["e5_query_metrics", "e10_macro_average"])
def test_metrics_list_no_pairs_of_a_label(spark, tables, name):
    """100 queries and 2,000 passages of one label are 200,000 pairs; 20 results a query are enough."""
    d = vectors(tables, [7] * 2000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = driver.queries()[name](spark, d)
        df.collect()
        joined = [x.metrics().apply("numOutputRows").value() for x in nodes(df._jdf.queryExecution().executedPlan()) if "Join" in x.nodeName()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert joined and max(joined) <= 20 * 100


@pytest.mark.parametrize("name", ["e5_query_metrics", "e10_macro_average"])
def test_metrics_of_labels_equal_sql(spark, tables, name):
    """A query whose label is its own alone, or null, has nothing to find and no row."""
    d = vectors(tables, [99 if i == 40 else None if i % 50 == 20 else i % 7 for i in range(300)])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{d}/embeddings.parquet/*.parquet')")
    got = driver.queries()[name](spark, d)
    wanted = con.execute(f"SELECT {', '.join(got.columns)} FROM ({driver.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(wanted) and wanted


class Scan:
    """Stands for documents, and keeps the function that the workers would run."""

    dtypes = [("doc_id", "bigint"), ("text", "string")]

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def withColumn(self, *_):
        return self


def test_chunks_leave_in_small_pieces(spark):
    """A batch of 3,000 documents is not held as chunks at once, and a long document's chunks are not either."""
    split = []
    scan = Scan()
    chunkers.kernel_chunks(scan, lambda t: split.append(t) or [{"text": x} for x in t.split()], "mark int")
    texts = [f"a{i} b{i} c{i}" for i in range(3000)] + [" ".join(["w" * 1000] * 5000)]
    given = iter([pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"]), pa.record_batch([pa.array([-1, -2]), pa.array(["x y", None])], names=["doc_id", "text"])])
    out = scan.run(given)
    first = next(out)
    assert len(split) < 1000
    pieces = [first, *out]
    assert max(p.num_rows for p in pieces) <= 1024 and max(p.nbytes for p in pieces) < 2e6
    rows = [(r["doc_id"], r["chunk_index"], r["text"]) for p in pieces for r in p.to_pylist()]
    assert rows == [(d, i, x) for d, t in [*enumerate(texts), (-1, "x y")] for i, x in enumerate(t.split())]
