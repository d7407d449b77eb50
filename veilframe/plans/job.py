"""The whole processing run as Spark jobs (load -> detect -> resolve ->
anonymize -> write -> key -> audit).

Jobs: (1) detection, one aggregation over the input; (2) the main write, one
row-local projection, with the row count taken by an ``Observation`` in the
same pass; (3) in Pseudonymization mode the key, one distinct aggregation;
(4) small audit writes.  Nothing else is written: an Anonymization run leaves no
original behind.

The outputs are published together: they are written to staged folders that Spark's readers skip, moved to their names when all of
them are whole, and named by a manifest that is written last.  A run that fails takes its folders away; one whose driver is lost leaves
no manifest.  Readers go by ``published``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import fixed as FX
from veilframe.functions.fakes import DEFAULT_LOCALE
from veilframe.operators import audit as A
from veilframe.operators import config as CF
from veilframe.operators import detect as D
from veilframe.operators import privacy as X
from veilframe.operators import pseudo as K
from veilframe.operators.transform import anonymize
from veilframe.operators.value_key import drop_folder
from veilframe.sources import files as S


@dataclass
class RunResult:
    run_id: str
    output: str
    key: str | None
    audit: str
    rows: int
    config: DataFrame


MANIFEST = "run_id string, output string, format string, key string, audit string, rows bigint"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _folder(spark, path)
    return files.exists(at)


def move_folder(spark: SparkSession, held: str, path: str) -> None:
    """``held`` under the name ``path``; what an unpublished run left there goes."""
    drop_folder(spark, path)
    files, at = _folder(spark, path)
    if not files.rename(_folder(spark, held)[1], at):
        raise OSError(f"{held} could not be moved to {path}")


def published(spark: SparkSession, output_dir: str) -> DataFrame:
    """The whole runs under ``output_dir``, one row each: run_id, output, format, key (null without one), audit, rows.

    A run counts from the moment its manifest's job was committed."""
    at = f"{output_dir.rstrip('/')}/manifest_*/_SUCCESS"
    files, pattern = _folder(spark, at)
    done = [str(f.getPath().getParent()) for f in files.globStatus(pattern) or []]      # a path a run
    return spark.read.schema(MANIFEST).json(done) if done else spark.createDataFrame([], MANIFEST)


def load(spark: SparkSession, path: str, fmt: str | None = None, multiline: bool = False) -> DataFrame:
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    return S.read_csv(spark, path, multiline=multiline) if fmt == "csv" else S.read_parquet(spark, path)


def run(spark: SparkSession, input_path: str, output_dir: str, profile: str | None = None,
        mode: str = FX.MODE_ANONYMIZATION, config=None, manual: DataFrame | None = None,
        overrides: DataFrame | None = None, out_format: str = "parquet",
        key_dir: str | None = None, exclude: tuple[str, ...] = (), sample_rows: int | None = None,
        key_column: str | None = None, now: datetime | None = None,
        in_format: str | None = None, multiline: bool = False, chosen: dict[str, str] | None = None,
        drop: tuple[str, ...] = (), unicode: bool = False, locale: str = DEFAULT_LOCALE,
        salt_file: str | None = None, key_secret_file: str | None = None, consistent: str = "type") -> RunResult:
    """Process one table.  ``config`` (column rules) skips detection; else
    detection (+ manual columns and overrides) and ``profile`` decide, and
    ``chosen`` techniques win over both.  ``in_format`` ('csv' / 'parquet')
    defaults to the path's suffix; ``multiline`` reads CSV cells that hold newlines.
    ``drop`` removes columns (X3).  ``salt_file`` and ``key_secret_file`` name files whose first
    line salts hashes (X1) and encrypts the key's originals (X5).
    ``consistent="value"`` gives a value one fake in all columns ; the key that this needs is
    deleted from spark.checkpoint.dir when the run's tables are written."""
    now = now or datetime.now()
    stamp = S.run_stamp(now)
    df = X.drop_columns(load(spark, input_path, in_format, multiline), list(drop))
    if config is None:
        det = D.detect(df, sample_rows=sample_rows, key=key_column, exclude=exclude, unicode=unicode)
        if manual is not None:
            det = CF.add_manual(det, manual)
        if overrides is not None:
            det = CF.apply_overrides(det, overrides)
        config = CF.resolve(det, profile, chosen)
    rules = CF.as_rules(config)
    salt = X.secret_column(spark, salt_file) if salt_file else None
    res = anonymize(df, rules, mode=mode, unicode=unicode, salt=salt, locale=locale, consistent=consistent)
    base = os.path.splitext(os.path.basename(input_path.rstrip("/")))[0]
    home, key_home = output_dir.rstrip("/"), (key_dir or output_dir).rstrip("/")
    if exists(spark, f"{home}/manifest_{stamp}"):
        raise FileExistsError(f"{home} has a run {stamp} already")
    run_id = f"run-{stamp}"
    out_path, audit_path = f"{home}/anonymized_{base}_{stamp}", f"{home}/audit_{stamp}"
    key_path = f"{key_home}/pseudo_key_{stamp}" if mode == FX.MODE_PSEUDONYMIZATION else None      # K5: also where no column got Fake Data
    staged = {p: f"{os.path.dirname(p)}/_staged_{stamp}/{os.path.basename(p)}" for p in (out_path, key_path, audit_path) if p}
    try:
        obs = Observation("rows")
        out = res.df.observe(obs, F.count(F.lit(1)).alias("rows"))
        (S.write_csv if out_format == "csv" else S.write_parquet)(out, staged[out_path])
        rows = int(obs.get["rows"])
        if key_path:
            secret = X.secret_column(spark, key_secret_file) if key_secret_file else None
            K.write_key(res.mapping, staged[key_path], input_path, [r.column for r in rules if r.include], res.fake_columns, now, secret)
        counted = spark.createDataFrame([(rows,)], "rows bigint")
        S.write_audit({
            "summary": A.audit_summary(counted, run_id, input_path, out_path, mode, profile, rules,
                                       key_path, now),
            "columns": A.audit_columns(spark, run_id, rules),
            "compliance": A.compliance_matrix(spark, rules),
        }, staged[audit_path])
        for path, held in staged.items():
            move_folder(spark, held, path)
        spark.createDataFrame([(run_id, out_path, out_format, key_path, audit_path, rows)], MANIFEST) \
            .coalesce(1).write.json(f"{home}/manifest_{stamp}")
    except BaseException:
        for path in [f"{home}/manifest_{stamp}", *staged]:
            drop_folder(spark, path)
        raise
    finally:
        for held in staged.values():
            drop_folder(spark, os.path.dirname(held))
        if res.key_folder:
            drop_folder(spark, res.key_folder)
    return RunResult(run_id, out_path, key_path, audit_path, rows, CF.config_df(spark, rules))
