"""Parts of a key, versions, what a lost compaction leaves, restoring from buckets."""

import os

import pytest
from pyspark.sql import functions as F

from veilframe.functions import fixed as FX
from veilframe.operators import key_store as KS
from veilframe.operators import privacy as X
from veilframe.operators import pseudo as K


def key_of(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "name string")
    return K.build_mapping(df, [("name", FX.FULL_NAME)])


def add_batch(spark, path, batch, values):
    key_of(spark, values).write.mode("overwrite").parquet(f"{path}/mapping/stream=s1/batch={batch}")


def entries(df):
    return sorted(map(tuple, df.select("original", "fake", "pii_type", "n").collect()))


def test_a_key_grows_and_is_compacted(spark, tmp_out):
    path = f"{tmp_out}/it's a key"
    K.write_key(key_of(spark, ["a", "a", "b"]), path)
    add_batch(spark, path, 0, ["b", "c"])
    whole = entries(key_of(spark, ["a", "a", "b", "b", "c"]))
    assert entries(K.read_key(spark, path)) == whole
    v = KS.compact_key(spark, path, buckets=4)
    assert (v.number, v.parts) == (1, ["", "stream=s1/batch=0"]) and entries(K.read_key(spark, path)) == whole
    assert KS.compact_key(spark, path).number == 1                       # nothing was added
    add_batch(spark, path, 0, ["b", "c"])                                # a batch that is run again counts once
    assert entries(K.read_key(spark, path)) == whole
    add_batch(spark, path, 1, ["c", "d"])
    more = entries(key_of(spark, ["a", "a", "b", "b", "c", "c", "d"]))
    assert entries(K.read_key(spark, path)) == more
    assert KS.compact_key(spark, path, buckets=3).number == 2
    assert KS.drop_covered(spark, path) > 0
    assert KS.parts(spark, path) == {} and len(os.listdir(f"{path}/compact")) == 2
    assert entries(K.read_key(spark, path)) == more
    add_batch(spark, path, 2, ["e"])
    assert KS.compact_key(spark, path).number == 3 and len(entries(K.read_key(spark, path))) == 5
    K.write_key(key_of(spark, ["z"]), path)                              # a new run's key in its place
    assert "z" in [r[0] for r in entries(K.read_key(spark, path))] and "a" not in [r[0] for r in entries(K.read_key(spark, path))]


@pytest.mark.parametrize("step", ["write", "commit"])
def test_a_lost_compaction_leaves_a_readable_key(spark, tmp_out, monkeypatch, step):
    path = f"{tmp_out}/key"
    add_batch(spark, path, 0, ["a", "b"])
    KS.compact_key(spark, path, buckets=2)
    add_batch(spark, path, 1, ["b", "c"])
    whole = entries(key_of(spark, ["a", "b", "b", "c"]))
    with monkeypatch.context() as m:
        if step == "commit":
            m.setattr(KS, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        else:
            m.setattr(KS, "merged", lambda rows: rows.select(F.raise_error(F.lit("lost")).alias("original"), "fake", "pii_type", "n"))
        with pytest.raises(Exception):
            KS.compact_key(spark, path, buckets=2)
    assert entries(K.read_key(spark, path)) == whole
    assert KS.compact_key(spark, path, buckets=2).number >= 2 and entries(K.read_key(spark, path)) == whole
    KS.drop_covered(spark, path)
    assert entries(K.read_key(spark, path)) == whole and len([f for f in os.listdir(f"{path}/compact") if f.startswith("v")]) == 1


def test_an_encrypted_key_is_compacted_with_its_secret(spark, tmp_out):
    path, secret = f"{tmp_out}/key", F.lit("0123456789abcdef")
    for k in range(2):
        X.encrypt_key(key_of(spark, ["a", "b"]), secret).write.parquet(f"{path}/mapping/stream=s/batch={k}")
    KS.compact_key(spark, path, secret, buckets=2)
    assert entries(K.read_key(spark, path, secret)) == entries(key_of(spark, ["a", "a", "b", "b"]))
    assert not {"a", "b"} & {r[0] for r in entries(K.read_key(spark, path))}


def test_a_folder_without_a_key(spark, tmp_out):
    with pytest.raises(FileNotFoundError):
        K.read_key(spark, f"{tmp_out}/none")


def test_restore_joins_the_buckets_and_spreads_hot_values(spark, tmp_out):
    path = f"{tmp_out}/key"
    values = [f"v{k}" for k in range(3000)]
    add_batch(spark, path, 0, values)
    KS.compact_key(spark, path, buckets=5)
    fake = {o: f for o, f, _t, _n in entries(K.read_key(spark, path))}
    cells = [fake["v7"]] * 4000 + ["not in the key"] * 4000 + [None] * 4000 + [fake[v] for v in values] + ["\0" + "1"]
    df = spark.createDataFrame([(k, c, cells[-1 - k]) for k, c in enumerate(cells)], "k int, name string, other string").repartition(8)
    back = K.restore_from(df, path, ["name", "other"], broadcast_bytes=0)
    original = {f: o for o, f in fake.items()}
    want = [original.get(c, c) for c in cells]
    got = sorted(map(tuple, back.collect()), key=lambda r: r[0])
    assert got == [(k, want[k], want[-1 - k]) for k in range(len(cells))]
    assert sorted(map(tuple, K.restore_from(df, path, ["name", "other"]).collect()), key=lambda r: r[0]) == got      # broadcast

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = K.restore_from(df.select("k", "name"), path, ["name"], broadcast_bytes=0)
        plan = one._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        scans = [k for k, line in enumerate(lines) if "veilframe_key_" in line]
        assert scans and all("Bucketed: true" in lines[k] for k in scans)
        for at in scans:                                                        # up to its join nothing shuffles the key
            depth = lines[at].index("FileScan")
            for line in reversed(lines[:at]):
                here = next(k for k, ch in enumerate(line) if ch.isalpha())
                if here < depth:
                    depth = here
                    assert "Exchange" not in line
                    if "Join" in line:
                        break
        sizes = [r["count"] for r in one.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(sizes) < 0.6 * len(cells)                                    # 4,000 equal cells thrice would be one task's
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
