"""What SQL can express of the operators' results, on whole tables and on odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm.in_sql import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
CARD = "4111 1111 1111 1111"
ODD = [
    (1, None, None, None, None, "a"),
    (2, "", "en", "web", 0, None),
    (3, f"a@b.co, ü@x.y.z and 1.2.3.4.5 or 300.1.1.1 {CARD} 😀 +49 (30) 123-4567 +1 2", "en", "web", 0, None),
    (4, "\n\n a b c a b c a b c \n\x0b\n same\nsame\n#$ <|>&*%", "de", "", 0, None),
    (5, "x" * 50_000 + " " + f"{CARD[:-1]}2 me@@host.org 1.2.3.4@x.y 99999999999999999999.1.1.1", "de", None, 0, None),
    (6, "word " * 3_000, "fr", "ämter", 0, None),
    (7, "word " * 3_000, "fr", "books", 0, None),
    (9, "é   one two three", "fr", "books", 0, None),
]


def rows(cursor_or_df, names):
    found = cursor_or_df.collect() if hasattr(cursor_or_df, "collect") else cursor_or_df
    return sorted((tuple(r[n] for n in names) for r in found), key=repr)


def compared(spark, name, folder):
    got = QUERIES[name](spark, folder)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{'' if folder.startswith('/root') else '/*.parquet'}'")
    said = db.execute(ORACLES[name])
    columns = [c[0] for c in said.description]
    assert sorted(columns) == sorted(got.columns)
    want = [dict(zip(columns, r)) for r in said.fetchall()]
    assert rows(got, columns) == rows(want, columns)
    return len(want)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_tables(spark, name):
    assert compared(spark, name, "/root/testdata/sf0.01") == (1000 if name != "mixing_by_source" else spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("source").distinct().count())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows_and_none(spark, tmp_path, name):
    odd = spark.createDataFrame(ODD, SCHEMA)
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    compared(spark, name, f"{tmp_path}/odd")
    if name != "edited_texts":  # repeated rows and ids, told apart by nothing
        odd.union(odd.filter("doc_id > 2")).union(odd.withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/twice/documents.parquet")
        compared(spark, name, f"{tmp_path}/twice")
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    empty = QUERIES[name](spark, f"{tmp_path}/none")
    assert empty.collect() == [] and empty.dtypes == QUERIES[name](spark, f"{tmp_path}/odd").dtypes
