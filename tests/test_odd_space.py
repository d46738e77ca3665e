"""Queries over texts with odd white space against their SQL."""

import duckdb
import pytest

import __spark_entry__ as driver

ODD = ["", " ", "\n", "\t \n", " ", " \n", "src1", "plain text", " led by a space", "ended by one ", "a line end at the end\n", "\na line end at the start", "tab\tand\x0bfeed\x0cand more words than forty characters hold\n", "x" * 39 + "\n", "x" * 40 + " ", "　wide　"]
DOCS = ([(i, t, "en", "src1") for i, t in enumerate(ODD)] + [(100, "a text", "de", " src2 "), (101, "a text", "de", "\n")], "doc_id long, text string, lang string, source string")


def differing(spark, d, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{d}/{table}.parquet/*.parquet')")
    got = driver.queries()[name](spark, d)
    wanted = con.execute(f"SELECT {', '.join(got.columns)} FROM ({driver.oracle_sql()[name]})").fetchall()
    return sorted(map(repr, {*map(tuple, got.collect())} ^ {*wanted})), len(wanted)


@pytest.mark.parametrize("name", ["d12_crud_documents", "d12_crud_queries", "p12_previews"])
def test_documents_of_odd_space(spark, tables, name):
    found, rows = differing(spark, tables(documents=DOCS), name, "documents")
    assert found == [] and rows > 5


@pytest.mark.parametrize("name", ["d8_qasper_documents", "d8_qasper_queries"])
def test_turns_of_odd_space(spark, tables, name):
    turns = [(i, 0, "user", t) for i, t in enumerate(ODD)] + [(i, 1, "assistant", t[::-1]) for i, t in enumerate(ODD)] + [(90, 0, "user", "Nineteen characters\nand more")]
    found, rows = differing(spark, tables(conversations=(turns, "conv_id long, turn long, role string, text string")), name, "conversations")
    assert found == [] and rows == len(ODD) + 1
