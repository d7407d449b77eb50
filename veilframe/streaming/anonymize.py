"""Techniques on Structured Streaming DataFrames.

Every technique is row-local, so ``anonymize_stream`` applies the same
projection as the batch path to a ``readStream`` DataFrame, Fake Data included.
``pseudonymize_stream`` also writes the key: each micro-batch adds the
distinct (original, fake) pairs it holds as a part of its own,
``stream=<query id>/batch=<batch id>``.  A retried batch overwrites only its own
part; no batch reads the key, and other streams on the same key add parts
beside it.  Equal originals have equal fakes in all of them, and ``read_key`` merges
the parts.

With ``audit_path`` each micro-batch also writes its counts (S3, A1, A5), observed while its rows are written, as a part of its own.  They are
written before the batch is committed and a batch that is run again overwrites them, so a restarted stream counts every batch
once; a listener's events would come after the commit and be lost with the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.functions.fakes import DEFAULT_LOCALE
from veilframe.operators import audit as A
from veilframe.operators.config import as_rules
from veilframe.operators.transform import anonymize


def anonymize_stream(stream: DataFrame, config, unicode: bool = False, salt: Column | str | None = None,
                     locale: str = DEFAULT_LOCALE) -> DataFrame:
    return anonymize(stream, config, unicode=unicode, salt=salt, locale=locale).df


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def pseudonymize_stream(stream: DataFrame, config, output_path: str, key_path: str,
                        checkpoint_location: str, trigger: dict | None = None, extend: bool = False,
                        locale: str = DEFAULT_LOCALE, audit_path: str | None = None) -> StreamingQuery:
    """Write the protected rows to ``output_path``, the key parts to ``key_path`` and, where it is given, the counts to ``audit_path``.

    A key path that exists already is refused, unless this stream goes on from its
    checkpoint or ``extend`` says that several streams share the key.
    """
    rules = [r for r in as_rules(config) if r.include]
    spark = stream.sparkSession
    if not extend and _exists(spark, key_path) and not _exists(spark, checkpoint_location):
        raise ValueError(f"{key_path} holds a key already: pass extend=True to add to it")

    def process(batch: DataFrame, batch_id: int) -> None:
        part = f"stream={batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}/batch={batch_id}"
        seen = Observation("batch")
        res = A.observed(batch, rules, seen, spread_input=False, locale=locale) if audit_path else anonymize(batch, rules, spread_input=False, locale=locale)
        if res.fake_columns:
            res.mapping.write.mode("overwrite").parquet(f"{key_path}/mapping/{part}")
        res.df.write.mode("overwrite").parquet(f"{output_path}/{part}")
        if audit_path:
            A.observed_counts(batch.sparkSession, seen, res).coalesce(1).write.mode("overwrite").json(f"{audit_path}/{part}")

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()


def stream_counts(spark: SparkSession, audit_path: str) -> DataFrame:
    """A5 of a stream so far: ``column, rows, unchanged, changed, blank`` over all its batches."""
    parts = _audit_parts(spark, audit_path).where(F.col("column").isNotNull())
    return parts.groupBy("column").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("rows", "unchanged", "changed", "blank")])


def stream_rows(spark: SparkSession, audit_path: str) -> DataFrame:
    """S3 of a stream so far, one row: ``rows``, as ``audit_summary`` takes it (0 where no batch ran)."""
    parts = _audit_parts(spark, audit_path).where(F.col("column").isNull())
    return parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows"))


def _audit_parts(spark: SparkSession, audit_path: str) -> DataFrame:
    if not _exists(spark, audit_path):
        return spark.createDataFrame([], A.COUNTS)
    return spark.read.schema(A.COUNTS).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(audit_path)


def wait(query: StreamingQuery, seconds: int | None = None) -> StreamingQuery:
    """Wait for the end of a query; one that has not ended in time is stopped and raises."""
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream had not ended after {seconds} s; its output is incomplete")
    return query


def table_stream(spark, folder: str, file_glob: str, schema=None) -> DataFrame:
    """A parquet file stream over the files of ``folder`` matching ``file_glob``
    (new files are picked up as they land)."""
    if schema is None:
        schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(folder)


def write_stream_files(stream: DataFrame, output_path: str, checkpoint_location: str,
                       trigger: dict | None = None, wait_seconds: int | None = None) -> StreamingQuery:
    """Append the stream to parquet files (exactly-once file sink with a
    checkpoint).  With the default ``availableNow`` trigger, waits until
    everything available has been processed, and raises if that takes longer than ``wait_seconds``."""
    q = (stream.writeStream.format("parquet").option("path", output_path)
         .option("checkpointLocation", checkpoint_location)
         .trigger(**(trigger or {"availableNow": True})).start())
    return wait(q, wait_seconds) if trigger is None else q
