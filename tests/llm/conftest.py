import pytest
from pyspark.sql import types as T

#: Names that the operators use inside; inputs may have them too.
CLASHING = ["node", "root", "_id", "kept", "_kept", "n_words", "n_lines", "_n_removed", "rep", "at", "component_id", "similarity", "_node", "g"]


@pytest.fixture
def corpus(spark, tmp_path):
    """Writes (doc_id, text) rows, with columns whose names clash, as documents.parquet; more tables by name."""

    def write(rows, benchmark=(), pages=()):
        extra = [T.StructField(c, T.StringType()) for c in CLASHING]
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), *extra])
        data = [(i, t, len(t or ""), *["x"] * len(CLASHING)) for i, t in rows]
        spark.createDataFrame(data, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(benchmark), "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(2).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
        return str(tmp_path)

    return write
