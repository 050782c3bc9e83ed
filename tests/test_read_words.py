import duckdb

from lexloom.plans import registry

from .test_registry import rows


def test_words_are_cut_at_99(spark, tmp_path):
    texts = ["internationalisation of\r\nextraordinary\twords", "a" * 98 + " " + "b" * 99 + " " + "c" * 100, "é" * 120, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["txt27_read_words_99"](spark, str(tmp_path)).toPandas()
    assert dict(zip(got["doc_id"], got["words"], strict=True)) == {0: "internationalisation of extraordinary words", 1: " ".join(["a" * 98, "b" * 99, "c" * 99]), 2: "é" * 99, 3: "", 4: None}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(got) == rows(con.sql(registry.ORACLES["txt27_read_words_99"]).df())
