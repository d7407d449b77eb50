"""Shared helpers: shared-folder tables, word hashing, connected components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

_OWN: list[str] = []
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a folder of our own only where it is unset on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="llm-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


BATCH_CONF, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "500"


def prepare(spark: SparkSession) -> None:
    """What the queries and the pipeline need of a session.

    Batches to Python of 500 rows instead of Spark's 10,000, unless set otherwise: a batch of whole texts is held several times over,
    by the JVM, outside its heap, and by Python.  And this package on the executors, once a session, so that tasks find it wherever it is
    installed.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="llm-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(path := os.path.realpath(f"{folder}/{root.name}.zip"), "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)


class Tables:
    """Parquet tables of one run under the shared folder.  They cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no returned DataFrame reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def map_texts(df: DataFrame, work, schema: str, rows: int = 256) -> DataFrame:
    """``work`` over pandas frames of at most ``rows`` rows.

    Spark's batches hold 10,000 rows; of long texts that is much to keep as Python strings at once.
    Whole numbers stay whole beside nulls.
    """
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        def parts():
            for batch in batches:
                for lo in range(0, batch.num_rows, rows):
                    yield batch.slice(lo, rows).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

        for out in work(parts()):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


# ---- word hashing ---------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64, for k < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for b in (_BASE, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = made
    return _powers[0], _powers[1]


def _pieces(texts: list[bytes]):
    """(document index, bytes) of at most about PIECE bytes, cut at white space."""
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > PIECE:
            cut = at + PIECE
            while cut < len(t) and not _SPACE[t[cut]]:
                cut += 1
            yield i, at, t[at:cut]
            at = cut
        yield i, at, t[at:]


LONG = 128         # bytes of a word that are hashed by blocks; longer words are hashed whole
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _hashed(data: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of words in ``data``, which ends in 8 spare bytes.

    Blocks of 8 bytes go through a bijection one after the other, for all words at once, so words of up to 8 bytes that are equally long never share a hash,
    and others do by chance alone (2**-64 a pair), however they are built.
    """
    blocks = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = mix(length.astype(np.uint64) * np.uint64(_BASE))
    own = np.arange(len(start))
    for k in range(0, LONG, 8):
        own = own[length[own] > k]
        if not len(own):
            break
        block = blocks[start[own] + k] & _MASK[np.minimum(length[own] - k, 8)]
        h[own] = mix(h[own] ^ block) + np.uint64(_BASE)
    for i in np.flatnonzero(length > LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i]:start[i] + length[i]])
    return h


def word_hashes(texts: list[str | None], lower: bool, spans: bool = False):
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+``, and each document's first word (n + 1 offsets).

    With ``spans`` also the byte positions (start, end) of each word in its text's UTF-8.
    """
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    counts = np.zeros(len(data) + 1, np.int64)
    found, starts_of, ends_of = [], [], []
    batch: list[tuple[int, int, bytes]] = []
    held = 0

    def flush():
        if not batch:
            return
        whole = b"\n".join(p for _, _, p in batch) + b"\n" + bytes(8)
        whole = whole.lower() if lower else whole       # of ASCII only
        space = _SPACE[np.frombuffer(whole, np.uint8)[:-8]]
        edge = np.diff(space.view(np.int8), prepend=np.int8(1))
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        at = np.cumsum([0] + [len(p) + 1 for _, _, p in batch])
        own = np.searchsorted(s, at)
        for k, (i, shift, _) in enumerate(batch):
            counts[i + 1] += own[k + 1] - own[k]
            if spans:
                starts_of.append(s[own[k]:own[k + 1]] - at[k] + shift)
                ends_of.append(e[own[k]:own[k + 1]] - at[k] + shift)
        found.append(_hashed(whole, s, e - s))
        batch.clear()

    for piece in _pieces(data):
        if held + len(piece[2]) > PIECE:
            flush()
            held = 0
        batch.append(piece)
        held += len(piece[2]) + 1
    flush()
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    hashes, offsets = join(found, np.uint64), np.cumsum(counts)
    if not spans:
        return hashes, offsets
    return hashes, offsets, join(starts_of, np.int64), join(ends_of, np.int64), data


EDGES = 200_000

# ---- connected components -------------------------------------------------------------------


def components(tables: Tables, edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every node with an edge.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until
    the edges are stars.  Every step is written to the shared folder.  A task is given about
    ``EDGES`` edges, so few edges are not dealt out over many tasks.
    """
    def dealt(df: DataFrame, n: int) -> DataFrame:
        return df.coalesce(1) if n <= EDGES else df

    def stamp(df: DataFrame):
        h = F.xxhash64("a", "b")
        return tuple(df.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())

    now = tables.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    step, before = 0, stamp(now)
    while True:
        now = dealt(now, before[0])
        both = dealt(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), before[0])
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step += 1
        now = tables.save(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), f"{name}-{step}")
        tables.drop(f"{name}-{step - 1}")
        after = stamp(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after
