"""Command line for the whole run (the batch counterpart of the wizard):

    python -m veilframe run INPUT OUTPUT_DIR [--profile NAME] [--mode Pseudonymization]
        [--exclude col ...] [--config col=technique[:type] ...] [--format parquet|csv]
        [--chosen col=technique ...] [--drop col ...] [--multiline] [--unicode] [--locale NAME]
        [--salt-file FILE] [--key-secret-file FILE]
    python -m veilframe detect INPUT [--sample-rows N [--key COL]]

Uses the active Spark configuration (spark-submit / SPARK_CONF); on a
cluster ``spark.checkpoint.dir`` must name a shared folder.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from veilframe.functions import fixed as FX
from veilframe.functions.fakes import DEFAULT_LOCALE, LOCALES
from veilframe.operators import detect as D
from veilframe.plans import job


def _config(items: list[str]):
    rules = []
    for item in items:
        col, _, spec = item.partition("=")
        tech, _, pii_type = spec.partition(":")
        rules.append((col, pii_type or None, tech, True))
    return rules


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="veilframe")
    sub = ap.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run", help="detect, resolve, anonymize, write output, key and audit")
    r.add_argument("input")
    r.add_argument("output_dir")
    r.add_argument("--profile", choices=FX.profile_names())
    r.add_argument("--mode", default=FX.MODE_ANONYMIZATION,
                   choices=[FX.MODE_ANONYMIZATION, FX.MODE_PSEUDONYMIZATION])
    r.add_argument("--exclude", nargs="*", default=[])
    r.add_argument("--config", nargs="*", help="col=Technique[:PII type]; skips detection")
    r.add_argument("--format", default="parquet", choices=["parquet", "csv"], help="output format")
    r.add_argument("--input-format", choices=["parquet", "csv"], help="default: from the suffix")
    r.add_argument("--key-dir")
    r.add_argument("--chosen", nargs="*", default=[], help="col=Technique kept over the profile's")
    r.add_argument("--drop", nargs="*", default=[], help="columns left out of the output")
    r.add_argument("--multiline", action="store_true", help="CSV cells may hold newlines (one task per file)")
    r.add_argument("--unicode", action="store_true", help="Unicode digits and letters in the rules")
    r.add_argument("--locale", default=DEFAULT_LOCALE, choices=sorted(LOCALES))
    r.add_argument("--salt-file", help="file whose first line salts the hashes")
    r.add_argument("--key-secret-file", help="file whose first line (16, 24 or 32 bytes) encrypts the key's originals")
    d = sub.add_parser("detect", help="print the detection table as JSON lines")
    d.add_argument("input")
    d.add_argument("--sample-rows", type=int)
    d.add_argument("--key")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("veilframe").getOrCreate()
    if args.cmd == "run":
        res = job.run(spark, args.input, args.output_dir, profile=args.profile, mode=args.mode,
                      config=_config(args.config) if args.config else None,
                      out_format=args.format, key_dir=args.key_dir, exclude=tuple(args.exclude),
                      in_format=args.input_format, multiline=args.multiline, drop=tuple(args.drop),
                      chosen=dict(x.split("=", 1) for x in args.chosen), unicode=args.unicode,
                      locale=args.locale, salt_file=args.salt_file, key_secret_file=args.key_secret_file)
        print(json.dumps({"run_id": res.run_id, "output": res.output, "key": res.key,
                          "audit": res.audit, "rows": res.rows}))
    else:
        det = D.detect(job.load(spark, args.input), sample_rows=args.sample_rows, key=args.key)
        for row in det.collect():          # one row per column
            print(json.dumps(row.asDict()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
