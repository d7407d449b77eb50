"""veilframe: Spark-native PII detection and de-identification.

Public API (all DataFrame in, DataFrame out):

    detect(df, rules=None, sample_rows=None, key=None)   -> detection table
    resolve(detected, profile)                          -> column config
    anonymize(df, config, mode)                         -> Anonymized(df, mapping, ...)
    restore(df, mapping, columns)                       -> df with originals back
    audit_summary / audit_columns / compliance_matrix   -> audit tables
    run(spark, input_path, output_dir, ...)             -> the whole processing run
    anonymize_stream / pseudonymize_stream              -> the same on readStream DataFrames
"""

from veilframe.operators.audit import (audit_columns, audit_summary, change_counts,  # noqa: F401
                                       compliance_matrix)
from veilframe.operators.config import (ColumnRule, add_manual, apply_overrides,  # noqa: F401
                                        build_config, resolve, technique_for)
from veilframe.operators.detect import detect, detect_headers, detect_values, span_counts  # noqa: F401
from veilframe.operators.joins import skew_join  # noqa: F401
from veilframe.operators.key_store import compact_key, drop_covered  # noqa: F401
from veilframe.operators.pseudo import (build_mapping, collisions, hash_link, read_key,  # noqa: F401
                                        restore, restore_from, write_key)
from veilframe.operators.spans import protect_spans, span_mapping, span_table  # noqa: F401
from veilframe.operators.transform import anonymize, config_errors, preview  # noqa: F401
from veilframe.operators.value_key import domain_use, value_mapping  # noqa: F401
from veilframe.plans.job import run  # noqa: F401
from veilframe.streaming.anonymize import (anonymize_stream, pseudonymize_stream,  # noqa: F401
                                           stream_counts, stream_rows, table_stream, write_stream_files)
