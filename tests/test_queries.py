"""Queries on small tables of odd shape, against their SQL."""

import duckdb
import pytest

from trawl.queries import ORACLE, QUERIES

TABLES = {
    "one line": [(1, "The License\nand more\n"), (5, "The only line, with a License\n"), (7, "x\n")],
    "no such files": [(1, "The License\nand more\n"), (2, "of the land\n")],
}


@pytest.mark.parametrize("name", ["get_chunks", "db_get_chunks", "score_file", "db_score_file", "db_append"])
@pytest.mark.parametrize("table", TABLES)
def test_files_that_are_short_or_missing(spark, tmp_path, name, table):
    spark.createDataFrame(TABLES[table], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        expected = con.execute(f"SELECT {', '.join(f'"{c}"' for c in found.columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(expected)
