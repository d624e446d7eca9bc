"""Each text has its row, as in the SQL: texts of one id, null and empty ones too."""

import duckdb

from glosswork.plans import registry

ODD = [(1, "Ab, c"), (1, "Ab"), (2, None), (3, ""), (4, " \n\t"), (5, "é😀x_1 y z"), (None, "a b"), (6, "x " * 5000)]


def test_a_row_for_each_text(spark, tmp_path):
    spark.createDataFrame(ODD, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in registry.queries()["sentence_rebuild"](spark, str(tmp_path)).collect()]
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(registry.oracle_sql()["sentence_rebuild"]).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == len(ODD)
