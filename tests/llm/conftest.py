import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text) rows, with further columns whose names the operators use themselves."""
    def make(rows, extra=()):
        from pyspark.sql import functions as F
        df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOC)
        for name in extra:
            df = df.withColumn(name, F.lit("clash"))
        return df
    return make


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="session")
def real_docs(table):
    return {r.doc_id: r.text for r in table("documents").select("doc_id", "text").collect()}
