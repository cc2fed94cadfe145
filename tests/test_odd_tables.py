"""Queries against their SQL on tables whose texts are missing, empty or without a letter."""

import duckdb
import pytest

from colloquy.plans import catalogue

TEXTS = ["'Some words'", "null", "''", "'123 ☃'", "'\"quoted\" text'"]


@pytest.mark.parametrize("name", ["parse_delimited_records", "parse_relations_semi"])
def test_odd_documents(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("create table documents as select * from (values " + ", ".join(f"({i}::bigint, {t}, 'en', 'src{i}', 1::bigint)" for i, t in enumerate(TEXTS)) + ") as t(doc_id, text, lang, source, n_chars)")
    con.execute(f"copy documents to '{tmp_path}/documents.parquet'")
    rel = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    want = sorted(rel.fetchall(), key=str)
    assert sorted((tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).select(*columns).collect()), key=str) == want and want
