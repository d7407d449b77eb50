"""A key on disk that grows, and its compaction.

A key's folder holds parts: ``mapping`` as a run writes it, ``mapping/stream=<id>/batch=<id>`` as streams add them.  ``compact_key``
merges all parts into one version, one row per entry, bucketed and sorted by fake, under ``compact/<version>``; a manifest that names
the parts it covers is written last.  Until then readers see the parts and the version before, so a compaction that is lost at any
point leaves a readable key.  Parts that come after a version are merged with it at each read, until the next compaction.
"""

from __future__ import annotations

from dataclasses import dataclass, field
import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators import privacy

ENTRY = "original string, fake string, pii_type string, n bigint"
MANIFEST = "number int, folder string, buckets int, parts array<string>"
BUCKET_BYTES = 64 * 1024 * 1024


@dataclass
class Version:
    number: int
    folder: str
    buckets: int
    parts: list[str] = field(default_factory=list)


def merged(keys: DataFrame) -> DataFrame:
    """One row per entry of several keys, or of one key written in several parts."""
    return keys.groupBy("original", "fake", "pii_type").agg(F.sum("n").cast("bigint").alias("n"))


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(f.getPath().toString() for f in found or [])


def _drop(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def parts(spark: SparkSession, path: str) -> dict[str, str]:
    """The whole parts of a key, name -> folder: "" for a run's, "stream=<id>/batch=<id>" for a batch's.  A part counts once its job is committed."""
    home = f"{path}/mapping"
    found = {"": home} if _glob(spark, f"{home}/_SUCCESS") else {}
    for done in _glob(spark, f"{home}/stream=*/batch=*/_SUCCESS"):
        folder = done.rsplit("/", 1)[0]
        found["/".join(folder.rsplit("/", 2)[1:])] = folder
    return found


def current(spark: SparkSession, path: str) -> Version | None:
    """The newest version with a committed manifest."""
    done = [f.rsplit("/", 1)[0] for f in _glob(spark, f"{path}/compact/manifest_*/_SUCCESS")]
    if not done:
        return None
    r = spark.read.schema(MANIFEST).json(done).orderBy(F.desc("number")).first()      # a row a version
    return Version(r["number"], r["folder"], r["buckets"], list(r["parts"]))


def _bucketed(spark: SparkSession, path: str, version: Version) -> DataFrame:
    """A version as a bucketed table: the session's catalogue names its folder, nothing is copied."""
    folder = f"{path}/compact/{version.folder}"
    name = "veilframe_key_" + hashlib.sha256(folder.encode()).hexdigest()[:24]
    if not spark.catalog.tableExists(name):
        at = folder.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({ENTRY}) USING parquet CLUSTERED BY (fake) SORTED BY (fake) INTO {version.buckets} BUCKETS LOCATION '{at}'")
    return spark.table(name)


def _entries(spark: SparkSession, path: str, version: Version | None, found: dict[str, str]) -> tuple[DataFrame, bool]:
    """(the rows of a version and of the parts that it doesn't cover, whether the version holds all of them)"""
    if version is None and not found:
        raise FileNotFoundError(f"{path} holds no key")
    later = {name: folder for name, folder in found.items() if version is None or name not in version.parts}
    files = [folder if name else f"{folder}/*.parquet" for name, folder in later.items()]      # streams' folders lie in a run's
    files = [f for f in files if not f.endswith("*.parquet") or _glob(spark, f)]
    rows = None if version is None else _bucketed(spark, path, version)
    if files:
        added = spark.read.schema(ENTRY).parquet(*files)
        rows = added if rows is None else rows.unionByName(added)
    return (spark.createDataFrame([], ENTRY) if rows is None else rows), version is not None and not files


def read_key(spark: SparkSession, path: str, secret: Column | None = None) -> DataFrame:
    """A key written by a run or by streams, one row per entry.

    Of a compacted key without later parts this is the bucketed version itself: no shuffle, and a join on ``fake`` takes its buckets as they are.
    Otherwise the parts are merged, a shuffle of the key."""
    rows, whole = _entries(spark, path, current(spark, path), parts(spark, path))
    rows = rows if secret is None else privacy.decrypt_key(rows, secret)
    return rows if whole else merged(rows)


def compact_key(spark: SparkSession, path: str, secret: Column | None = None, buckets: int | None = None) -> Version:
    """Merge a key's parts into a version of ``buckets`` buckets (as many as the session's shuffle partitions, more where a bucket would
    hold over 64 MiB of text); returns the version before where nothing was added since.

    An encrypted key needs its ``secret``: equal originals differ in their encrypted text.  The parts stay until ``drop_covered``."""
    version, found = current(spark, path), parts(spark, path)
    rows, whole = _entries(spark, path, version, found)
    if whole:
        return version
    plain = rows if secret is None else privacy.decrypt_key(rows, secret)
    if buckets is None:
        size = plain.agg(F.sum(F.octet_length("original") + F.octet_length("fake") + 48)).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // BUCKET_BYTES))
    numbers = [int(f.rsplit("/v", 1)[1].split("_")[0]) for f in _glob(spark, f"{path}/compact/v*")]
    made = Version(max(numbers, default=0) + 1, "", buckets, sorted({*found, *(version.parts if version else [])}))
    made.folder = f"v{made.number}_{uuid.uuid4().hex[:12]}"
    out = merged(plain.repartition(buckets, "fake"))      # one shuffle: rows of a fake meet in its bucket and are merged there
    out = out if secret is None else privacy.encrypt_key(out, secret)
    name = f"veilframe_compact_{uuid.uuid4().hex}"
    try:
        out.write.bucketBy(buckets, "fake").sortBy("fake").option("path", f"{path}/compact/{made.folder}").saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")      # a table outside the warehouse: its files stay
    commit(spark, path, made)
    return made


def commit(spark: SparkSession, path: str, version: Version) -> None:
    row = [(version.number, version.folder, version.buckets, version.parts)]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.json(f"{path}/compact/manifest_{version.number:06d}")


def drop_covered(spark: SparkSession, path: str) -> int:
    """Delete the parts that the current version covers and the versions and manifests before it; returns how many folders went.

    Not while the key is compacted or read by plans made earlier.  A run's part goes file by file, as streams' folders lie in its folder."""
    version = current(spark, path)
    if version is None:
        return 0
    gone = []
    for name, folder in parts(spark, path).items():
        if name in version.parts:
            gone += [folder] if name else [f"{folder}/_SUCCESS", *_glob(spark, f"{folder}/*.parquet")]
    gone += [f for f in _glob(spark, f"{path}/compact/v*") if not f.endswith("/" + version.folder)]
    gone += [f for f in _glob(spark, f"{path}/compact/manifest_*") if not f.endswith(f"/manifest_{version.number:06d}")]
    for folder in gone:
        _drop(spark, folder)
    return len(gone)


def drop_versions(spark: SparkSession, path: str) -> None:
    """Forget all versions: the key's run part is about to be written anew."""
    _drop(spark, f"{path}/compact")
