"""Registered queries: one Spark DataFrame builder and (where SQL can say
it) one DuckDB oracle per key.  Every query reads the given tables (or
tables Spark derives from them) in full."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import fakes as FK
from veilframe.functions import fixed as FX
from veilframe.functions.techniques import age_band, dob_year
from veilframe.functions.text import as_text
from veilframe.operators import audit as A
from veilframe.operators import config as CF
from veilframe.operators import detect as D
from veilframe.operators import privacy as X
from veilframe.operators import key_store as KS
from veilframe.operators import pseudo as K
from veilframe.operators.transform import anonymize, preview
from veilframe.plans import job as J
from veilframe.plans import oracle as O
from veilframe.plans.people import (OPAQUE_NAMES, PEOPLE_COLUMNS, people_df, people_ip_header_df,
                                    people_opaque_df, people_opaque_sql, people_sql)
from veilframe.plans.registry import QUERIES, SQL, register  # noqa: F401
from veilframe.session import read_table, scratch_path, spread
from veilframe.sources import files as S
from veilframe.streaming.anonymize import (anonymize_stream, pseudonymize_stream, stream_counts, stream_rows, table_stream,
                                           wait, write_stream_files)



# ---------------------------------------------------------------------------
# One technique per column over people
# ---------------------------------------------------------------------------

# (query, {column: (pii_type, technique)})
SINGLE_TECHNIQUE = [
    ("mask_email", {"email": (FX.EMAIL, FX.MASKING)}),
    ("mask_phone", {"phone": (FX.PHONE, FX.MASKING)}),
    ("mask_card", {"credit_card": (FX.CREDIT_CARD, FX.MASKING)}),
    ("mask_generic", {"full_name": (FX.FULL_NAME, FX.MASKING),
                      "emp_id": (FX.STUDENT_ID, FX.MASKING)}),
    ("hash_sha256", {"cnic": (FX.CNIC, FX.HASHING), "emp_id": (FX.STUDENT_ID, FX.HASHING)}),
    ("generalize_age", {"age": (FX.AGE, FX.GENERALIZATION)}),
    ("generalize_dob", {"dob": (FX.DOB, FX.GENERALIZATION)}),
    ("generalize_ip", {"client_ip": (FX.IP_ADDRESS, FX.GENERALIZATION)}),
    ("generalize_address", {"address": (FX.ADDRESS, FX.GENERALIZATION)}),
    ("generalize_other", {"cnic": (FX.CNIC, FX.GENERALIZATION),
                          "segment": (None, FX.GENERALIZATION)}),
    ("delete_null", {"phone": (FX.PHONE, FX.NULL_DELETION),
                     "credit_card": (FX.CREDIT_CARD, FX.NULL_DELETION)}),
    ("redact", {"full_name": (FX.FULL_NAME, FX.REDACTION), "email": (FX.EMAIL, FX.REDACTION)}),
]
NUMERIC_PEOPLE = {"k", "age"}


def _single(spec):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        people = people_df(spark, sf_dir)
        cfg = [(c, t, tech) for c, (t, tech) in spec.items()]
        return anonymize(people, cfg).df.select("k", *spec)
    return run


def _single_sql(spec) -> str:
    sel = ["k"]
    for c, (t, tech) in spec.items():
        sel.append(f"{O.technique(c, tech, t, numeric=c in NUMERIC_PEOPLE)} AS {c}")
    return f"SELECT {', '.join(sel)} FROM ({people_sql()}) p"


for _name, _spec in SINGLE_TECHNIQUE:
    register(_name, _single_sql(_spec))(_single(_spec))


# ---------------------------------------------------------------------------
# Detection and configuration
# ---------------------------------------------------------------------------


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
OPAQUE_COLUMNS = [OPAQUE_NAMES.get(c, c) for c in PEOPLE_COLUMNS]


def _catalog_sql() -> str:
    names = ", ".join(O.q(t) for t in TABLES)
    return ("SELECT DISTINCT table_name, column_name FROM information_schema.columns "
            f"WHERE table_name IN ({names})")


@register("detect_headers",
          f"SELECT c.table_name, c.column_name, h.pii_type FROM ({_catalog_sql()}) c LEFT JOIN "
          f"({O.header_hits(_catalog_sql(), 'column_name', ['table_name', 'column_name'])}) h "
          f"USING (table_name, column_name)")
def detect_headers(spark, sf_dir):
    cat = D.catalog(spark, {t: read_table(spark, sf_dir, t) for t in TABLES})
    return D.detect_headers(cat).select("table_name", "column_name", "pii_type")


@register("detect_values", O.value_types(people_opaque_sql(), OPAQUE_COLUMNS))
def detect_values(spark, sf_dir):
    return D.detect_values(people_opaque_df(spark, sf_dir))


@register("detect_values_sampled",
          O.value_types(people_opaque_sql(), [c for c in OPAQUE_COLUMNS if c != "k"], key="k",
                        sample_rows=FX.DEFAULT_SAMPLE_ROWS))
def detect_values_sampled(spark, sf_dir):
    return D.detect_values(people_opaque_df(spark, sf_dir), key="k",
                           sample_rows=FX.DEFAULT_SAMPLE_ROWS)


def _ip_header_columns():
    return [("ip_address" if c == "client_ip" else c) for c in PEOPLE_COLUMNS]


def _ip_header_sql():
    return (f"SELECT * RENAME (client_ip AS ip_address) FROM ({people_sql()}) p")


@register("detect_pii",
          f"SELECT 'people' AS table_name, * FROM ({O.detection(people_sql(), PEOPLE_COLUMNS)}) a "
          f"UNION ALL SELECT 'people_ip_header' AS table_name, * FROM "
          f"({O.detection(_ip_header_sql(), _ip_header_columns())}) b")
def detect_pii(spark, sf_dir):
    a = D.detect(people_df(spark, sf_dir)).select(F.lit("people").alias("table_name"), "*")
    b = D.detect(people_ip_header_df(spark, sf_dir)) \
        .select(F.lit("people_ip_header").alias("table_name"), "*")
    return a.unionByName(b)


# manual additions (D9) and overrides (D10) used by detect_overridden
MANUAL = [("segment", FX.ADDRESS), ("email", FX.IP_ADDRESS)]
OVERRIDES = [("cnic", FX.FULL_NAME, None), ("dob", FX.OVERRIDE_NONE, None),
             ("age", None, False), ("phone", "", True)]


def _overridden_sql() -> str:
    det = O.detection(people_sql(), PEOPLE_COLUMNS)
    man = " UNION ALL ".join(f"SELECT {O.q(c)} AS \"column\", {O.q(t)} AS pii_type, 'manual' AS method, "
                             f"{O.q(FX.FALLBACK_TECHNIQUE)} AS default_tech, TRUE AS include"
                             for c, t in MANUAL)
    manual_cols = ", ".join(O.q(c) for c, _ in MANUAL)
    merged = f"SELECT * FROM ({det}) d WHERE \"column\" NOT IN ({manual_cols}) UNION ALL {man}"
    ov_rows = ", ".join(f"({O.q(c)}, {O.q(t) if t is not None else 'NULL'}, "
                        f"{('TRUE' if i else 'FALSE') if i is not None else 'NULL'})"
                        for c, t, i in OVERRIDES)
    ov = f"SELECT * FROM (VALUES {ov_rows}) o(\"column\", o_type, o_inc)"
    return (f"SELECT m.\"column\", CASE WHEN o.o_type IS NULL OR o.o_type IN ('', '(none)') "
            f"THEN m.pii_type ELSE o.o_type END AS pii_type, m.method, m.default_tech, "
            f"coalesce(o.o_inc, m.include) AS include FROM ({merged}) m "
            f"LEFT JOIN ({ov}) o ON o.\"column\" = m.\"column\" WHERE coalesce(o.o_inc, m.include)")


@register("detect_overridden", _overridden_sql())
def detect_overridden(spark, sf_dir):
    det = D.detect(people_df(spark, sf_dir))
    det = CF.add_manual(det, spark.createDataFrame(MANUAL, "column string, pii_type string"))
    det = CF.apply_overrides(det, spark.createDataFrame(
        OVERRIDES, "column string, pii_type string, include boolean"))
    return CF.included(det)


def _resolve_sql() -> str:
    det = O.detection(people_sql(), PEOPLE_COLUMNS, exclude=("k",))
    prof = O.profiles_values()
    names = ", ".join(f"({O.q(p[0])})" for p in FX.PROFILES)
    return (f"SELECT n.profile, d.\"column\", d.pii_type, "
            f"coalesce(p.technique, d.default_tech) AS technique, coalesce(p.priority, FALSE) AS priority "
            f"FROM ({det}) d CROSS JOIN (SELECT * FROM (VALUES {names}) x(profile)) n "
            f"LEFT JOIN ({prof}) p ON p.profile = n.profile AND p.pii_type = d.pii_type")


@register("resolve_techniques", _resolve_sql())
def resolve_techniques(spark, sf_dir):
    det = D.detect(people_df(spark, sf_dir), exclude=("k",))
    parts = [CF.technique_for(spark, det, p).select(F.lit(p).alias("profile"), "column", "pii_type",
                                                     "technique", "priority")
             for p in FX.profile_names()]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------------------
# Profiles end to end (C3-C5, P13-P14, K1) and pseudonyms (K1-K8)
# ---------------------------------------------------------------------------


def profile_config(spark, people, profile: str):
    det = D.detect(people, exclude=("k",))
    return CF.resolve(det, profile)


def _profile_run(profile: str):
    def run(spark, sf_dir):
        people = people_df(spark, sf_dir)
        return anonymize(people, profile_config(spark, people, profile)).df
    return run


#: Types that the names of people's columns stand for, written out for the oracles.
PEOPLE_TYPES = {"full_name": FX.FULL_NAME, "email": FX.EMAIL, "phone": FX.PHONE, "cnic": FX.CNIC, "dob": FX.DOB, "address": FX.ADDRESS,
                "client_ip": FX.IP_ADDRESS, "credit_card": FX.CREDIT_CARD, "emp_id": FX.STUDENT_ID, "age": FX.AGE}


def _expected_config(profile: str) -> dict[str, tuple[str, str]]:
    """People's columns -> (type, the profile's technique)."""
    techs = FX.get_profile(profile)[2]
    return {c: (t, techs[t]) for c, t in PEOPLE_TYPES.items()}


def _mapping_sql(table_sql: str, fake_cols: list[tuple[str, str | None]], locale: str = FK.DEFAULT_LOCALE) -> str:
    cells = " UNION ALL ".join(f"SELECT {O.strip(c)} AS original, {O.fake_value(t, O.strip(c), locale)} AS fake, "
                               f"{O.q(t) if t else 'CAST(NULL AS VARCHAR)'} AS pii_type FROM ({table_sql}) t WHERE NOT {O.blank(c)}"
                               for c, t in fake_cols)
    return f"SELECT original, fake, pii_type, count(*) AS n FROM ({cells}) c GROUP BY ALL"


def _apply_sql(table_sql: str, columns: list[str], config: dict[str, tuple[str, str]], locale: str = FK.DEFAULT_LOCALE) -> str:
    sel = []
    for c in columns:
        if c not in config:
            sel.append(f"p.{c}")
            continue
        t, tech = config[c]
        v = f"p.{c}"
        if tech == FX.FAKE_DATA:
            sel.append(f"CASE WHEN {O.blank(v)} THEN {v} ELSE {O.fake_value(t, O.strip(v), locale)} END AS {c}")
        else:
            sel.append(f"{O.technique(v, tech, t, numeric=c in NUMERIC_PEOPLE)} AS {c}")
    return f"SELECT {', '.join(sel)} FROM ({table_sql}) p"


for _p, _key in [("Academic/Research", "anonymize_academic"), ("Corporate/HR", "anonymize_corporate"),
                 ("Healthcare", "anonymize_healthcare")]:
    register(_key, _apply_sql(people_sql(), PEOPLE_COLUMNS, _expected_config(_p)))(_profile_run(_p))


def flagship(spark, sf_dir):
    """people -> detect -> resolve(Healthcare) -> anonymize."""
    return _profile_run("Healthcare")(spark, sf_dir)


NAME_EMAIL = [("full_name", FX.FULL_NAME), ("email", FX.EMAIL)]
TWO_NAMES = [("full_name", FX.FULL_NAME), ("manager_name", FX.FULL_NAME)]


@register("pseudonym_mapping", _mapping_sql(people_sql(), NAME_EMAIL))
def pseudonym_mapping(spark, sf_dir):
    return K.build_mapping(people_df(spark, sf_dir), NAME_EMAIL)


@register("pseudonymize", _apply_sql(people_sql(), ["k", "full_name", "email"],
                                     {c: (t, FX.FAKE_DATA) for c, t in NAME_EMAIL}))
def pseudonymize(spark, sf_dir):
    cfg = [(c, t, FX.FAKE_DATA) for c, t in NAME_EMAIL]
    return anonymize(people_df(spark, sf_dir), cfg).df.select("k", "full_name", "email")


@register("pseudonymize_two_columns",
          _apply_sql(people_sql(blanks=False, two_names=True), ["k", "full_name", "manager_name"],
                     {c: (t, FX.FAKE_DATA) for c, t in TWO_NAMES}))
def pseudonymize_two_columns(spark, sf_dir):
    cfg = [(c, t, FX.FAKE_DATA) for c, t in TWO_NAMES]
    src = people_df(spark, sf_dir, blanks=False, two_names=True)
    return anonymize(src, cfg).df.select("k", "full_name", "manager_name")


@register("restore_round_trip", f"SELECT k, full_name, email FROM ({people_sql()}) p")
def restore_round_trip(spark, sf_dir):
    people = people_df(spark, sf_dir)
    res = anonymize(people, [(c, t, FX.FAKE_DATA) for c, t in NAME_EMAIL])
    back = K.restore(res.df, res.mapping, ["full_name", "email"])
    return back.select("k", "full_name", "email")


@register("mapping_collisions",
          f"WITH m AS ({_mapping_sql(people_sql(), NAME_EMAIL)}) "
          f"SELECT (SELECT count(*) FROM m) AS mappings, "
          f"(SELECT count(*) FROM (SELECT fake FROM m GROUP BY fake HAVING count(*) > 1) x) AS colliding_fakes")
def mapping_collisions(spark, sf_dir):
    m = K.build_mapping(people_df(spark, sf_dir), NAME_EMAIL)
    colliding = K.collisions(m).agg(F.count(F.lit(1)).alias("colliding_fakes"))
    # two one-row tables
    return m.agg(F.count(F.lit(1)).alias("mappings")).join(F.broadcast(colliding))


ALL_TYPES = [(c, t) for c, t in PEOPLE_TYPES.items() if c != "age"] + [("segment", None)]


@register("fakes_all_types", _apply_sql(people_sql(), ["k", *[c for c, _ in ALL_TYPES]], {c: (t, FX.FAKE_DATA) for c, t in ALL_TYPES}))
def fakes_all_types(spark, sf_dir):
    cfg = [(c, t, FX.FAKE_DATA) for c, t in ALL_TYPES]
    return anonymize(people_df(spark, sf_dir), cfg).df.select("k", *[c for c, _ in ALL_TYPES])


@register("fakes_locale", _apply_sql(people_sql(), ["k", *[c for c, _ in ALL_TYPES]], {c: (t, FX.FAKE_DATA) for c, t in ALL_TYPES}, "de_DE"))
def fakes_locale(spark, sf_dir):
    cfg = [(c, t, FX.FAKE_DATA) for c, t in ALL_TYPES]
    return anonymize(people_df(spark, sf_dir), cfg, locale="de_DE").df.select("k", *[c for c, _ in ALL_TYPES])


@register("restore_from_key", f"SELECT k, full_name, email FROM ({people_sql()}) p")
def restore_from_key(spark, sf_dir):
    """The key is written, read back from disk and undoes the run."""
    path = scratch_path(spark, "key")
    res = anonymize(people_df(spark, sf_dir), [(c, t, FX.FAKE_DATA) for c, t in NAME_EMAIL])
    K.write_key(res.mapping, path, "customer.parquet", ["full_name", "email"], res.fake_columns)
    return K.restore(res.df, K.read_key(spark, path), ["full_name", "email"]).select("k", "full_name", "email")


KEY_CLOCK = "2026-01-01 00:00:00"


def _academic_cfg_cols():
    return [c for c in PEOPLE_COLUMNS if c in _expected_config("Academic/Research")]


@register("key_metadata",
          f"SELECT {O.q(KEY_CLOCK)} AS generated_at, 'customer.parquet' AS source_file, "
          f"{O.q(','.join(_academic_cfg_cols()))} AS pseudonymized_cols, 'full_name' AS fake_cols, "
          f"CAST(count(DISTINCT {O.strip('full_name')}) FILTER (WHERE NOT {O.blank('full_name')}) AS BIGINT) "
          f"AS total_mappings, {O.q(FX.KEY_TOOL)} AS tool FROM ({people_sql()}) p")
def key_metadata(spark, sf_dir):
    import datetime as _dt
    people = people_df(spark, sf_dir)
    cfg = profile_config(spark, people, "Academic/Research")
    res = anonymize(people, cfg, mode=FX.MODE_PSEUDONYMIZATION)
    meta = K.key_metadata(res.mapping, f"{sf_dir}/customer.parquet",
                          [r.column for r in res.applied], res.fake_columns,
                          _dt.datetime(2026, 1, 1))
    return meta.select(F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss").alias("generated_at"),
                       "source_file", F.array_join("pseudonymized_cols", ",").alias("pseudonymized_cols"),
                       F.array_join("fake_cols", ",").alias("fake_cols"), "total_mappings", "tool")


@register("hash_link_join",
          f"SELECT o.o_orderkey, sha256(CAST(o.o_custkey AS VARCHAR)) AS link_hash, p.segment "
          f"FROM orders o JOIN ({people_sql()}) p ON sha256(CAST(o.o_custkey AS VARCHAR)) = sha256(CAST(p.k AS VARCHAR))")
def hash_link_join(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    people = people_df(spark, sf_dir).select("k", "segment")
    return K.hash_link(orders, "o_custkey", people, "k").select("o_orderkey", "link_hash", "segment")


@register("hash_link_semi",
          f"SELECT sha256(CAST(p.k AS VARCHAR)) AS link_hash, p.segment FROM ({people_sql()}) p "
          f"WHERE sha256(CAST(p.k AS VARCHAR)) IN (SELECT sha256(CAST(o_custkey AS VARCHAR)) FROM orders)")
def hash_link_semi(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_custkey")
    people = people_df(spark, sf_dir).select("k", "segment")
    return K.hash_link(people, "k", orders, "o_custkey", how="left_semi").select("link_hash", "segment")


# ---------------------------------------------------------------------------
# A1-A5: audit tables; S4/P15 preview; P13 pass-through
# ---------------------------------------------------------------------------


RUN_ID = "run-20260101_000000"
ACADEMIC = "Academic/Research"
EXTRA_RULES = [("segment", None, "Shuffle", True), ("phone_2", FX.PHONE, FX.MASKING, False)]


def _academic_rules(spark, people):
    return CF.as_rules(profile_config(spark, people, ACADEMIC)) + CF.as_rules(EXTRA_RULES)


def _expected_rules():
    cfg = _expected_config(ACADEMIC)
    return [(c, t, tech, True) for c, (t, tech) in cfg.items()] + EXTRA_RULES


@register("audit_summary",
          f"SELECT {O.q(RUN_ID)} AS run_id, {O.q(KEY_CLOCK)} AS run_at, 'customer.parquet' AS input, "
          f"'people_anonymized.parquet' AS output, {O.q(FX.MODE_ANONYMIZATION)} AS mode, {O.q(ACADEMIC)} AS profile, "
          f"CAST(count(*) AS BIGINT) AS rows, CAST({len(_expected_rules())} AS BIGINT) AS cols_analysed, "
          f"CAST({sum(1 for r in _expected_rules() if r[3])} AS BIGINT) AS cols_modified, "
          f"CAST({sum(1 for r in _expected_rules() if not r[3])} AS BIGINT) AS cols_skipped, "
          f"CAST(NULL AS VARCHAR) AS key, FALSE AS reversible, {O.q(A.IRREVERSIBLE_NOTE)} AS note "
          f"FROM ({people_sql()}) p")
def audit_summary(spark, sf_dir):
    import datetime as _dt
    people = people_df(spark, sf_dir)
    rules = _academic_rules(spark, people)
    out = anonymize(people, rules).df
    s = A.audit_summary(out, RUN_ID, f"{sf_dir}/customer.parquet", "people_anonymized.parquet",
                        FX.MODE_ANONYMIZATION, ACADEMIC, rules, run_at=_dt.datetime(2026, 1, 1))
    return s.withColumn("run_at", F.date_format("run_at", "yyyy-MM-dd HH:mm:ss"))


def _opaque_rules_sql(profile: str) -> str:
    """Columns of people_opaque that their values give away, with the profile's technique; the oracle finds the types in the data."""
    return (f"SELECT d.\"column\", d.pii_type, p.technique FROM ({O.detection(people_opaque_sql(), OPAQUE_COLUMNS, exclude=('k',))}) d "
            f"JOIN ({O.profiles_values()}) p ON p.profile = {O.q(profile)} AND p.pii_type = d.pii_type")


def _opaque_run(spark, sf_dir, profile: str):
    people = people_opaque_df(spark, sf_dir)
    return anonymize(people, CF.resolve(D.detect(people, exclude=("k",)), profile))


@register("audit_columns", f"SELECT {O.q(RUN_ID)} AS run_id, \"column\", pii_type, technique, 'PROCESSED' AS status FROM ({_opaque_rules_sql(ACADEMIC)}) r")
def audit_columns(spark, sf_dir):
    """A2 from the rules that a run applied."""
    return A.audit_columns(spark, RUN_ID, _opaque_run(spark, sf_dir, ACADEMIC).applied)


def _compliance_sql():
    comp = ("SELECT * FROM (VALUES " + ", ".join(
        f"({O.q(a)}, {O.q(b)}, {c}, {O.q(d)})" for a, b, c, d in FX.COMPLIANCE) +
        ") c(technique, framework, seq, provision)")
    return (f"SELECT c.* FROM ({comp}) c WHERE c.technique IN (SELECT technique FROM ({_opaque_rules_sql('Healthcare')}) r)")


@register("compliance_matrix", _compliance_sql())
def compliance_matrix(spark, sf_dir):
    """A3 from the techniques that a run applied."""
    return A.compliance_matrix(spark, _opaque_run(spark, sf_dir, "Healthcare").applied)


@register("type_summary",
          f"SELECT t.pii_type, t.default_tech, CAST(coalesce(d.n, 0) AS BIGINT) AS columns FROM (SELECT * FROM (VALUES "
          + ", ".join(f"({O.q(r[1])}, {O.q(r[4])})" for r in FX.PII_RULES)
          + f") v(pii_type, default_tech)) t LEFT JOIN (SELECT pii_type, count(*) AS n FROM ({O.detection(people_opaque_sql(), OPAQUE_COLUMNS)}) x "
          f"GROUP BY pii_type) d ON d.pii_type = t.pii_type")
def type_summary(spark, sf_dir):
    """The list of types, with the columns of people_opaque detected as each."""
    return D.type_summary(D.detect(people_opaque_df(spark, sf_dir)))


CHOSEN = {"email": FX.REDACTION, "cnic": FX.NULL_DELETION}


@register("resolve_chosen",
          f"SELECT d.\"column\", d.pii_type, CASE d.\"column\" {' '.join(f'WHEN {O.q(c)} THEN {O.q(t)}' for c, t in CHOSEN.items())} ELSE p.technique END AS technique, "
          f"TRUE AS include FROM ({O.detection(people_sql(), PEOPLE_COLUMNS, exclude=('k',))}) d JOIN ({O.profiles_values()}) p "
          f"ON p.profile = 'Corporate/HR' AND p.pii_type = d.pii_type")
def resolve_chosen(spark, sf_dir):
    """Techniques chosen before win over the profile's."""
    return CF.resolve(D.detect(people_df(spark, sf_dir), exclude=("k",)), "Corporate/HR", CHOSEN)


def _change_counts_sql():
    cfg = _expected_config(ACADEMIC)
    after = _apply_sql(people_sql(), PEOPLE_COLUMNS, cfg)
    parts = []
    for c in cfg:
        b = f"CAST(p.{c} AS VARCHAR)"
        parts.append(
            f"SELECT {O.q(c)} AS \"column\", CAST(count(*) AS BIGINT) AS rows, "
            f"CAST(sum(CASE WHEN {b} IS NOT DISTINCT FROM a.{c} THEN 1 ELSE 0 END) AS BIGINT) AS unchanged, "
            f"CAST(sum(CASE WHEN {b} IS NOT DISTINCT FROM a.{c} THEN 0 ELSE 1 END) AS BIGINT) AS changed, "
            f"CAST(sum(CASE WHEN {O.blank(b)} THEN 1 ELSE 0 END) AS BIGINT) AS blank "
            f"FROM ({people_sql()}) p JOIN ({after}) a ON a.k = p.k")
    return " UNION ALL ".join(parts)


@register("change_counts", _change_counts_sql())
def change_counts(spark, sf_dir):
    people = people_df(spark, sf_dir)
    return A.change_counts(people, profile_config(spark, people, ACADEMIC))


def _preview_sql():
    cfg = _expected_config("Healthcare")
    cols = [c for c in PEOPLE_COLUMNS if c in cfg]
    after = _apply_sql(people_sql(), PEOPLE_COLUMNS, cfg)
    sel = ["p.k"] + [f"CAST(p.{c} AS VARCHAR) AS {c}_before, a.{c} AS {c}_after" for c in cols]
    return (f"SELECT {', '.join(sel)} FROM (SELECT * FROM ({people_sql()}) x ORDER BY k LIMIT "
            f"{FX.PREVIEW_ROWS}) p JOIN ({after}) a ON a.k = p.k")


@register("preview_before_after", _preview_sql())
def preview_before_after(spark, sf_dir):
    people = people_df(spark, sf_dir)
    return preview(people, profile_config(spark, people, "Healthcare"), key="k")


PASSTHROUGH_RULES = [("segment", None, "Shuffle"), ("missing_col", FX.EMAIL, FX.MASKING),
                     ("email", FX.EMAIL, FX.MASKING)]


@register("passthrough_unknown_technique",
          _apply_sql(people_sql(), PEOPLE_COLUMNS, {"email": (FX.EMAIL, FX.MASKING)}))
def passthrough_unknown_technique(spark, sf_dir):
    import warnings
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return anonymize(people_df(spark, sf_dir), PASSTHROUGH_RULES).df


# ---------------------------------------------------------------------------
# Personal data inside long text (whole texts)
# ---------------------------------------------------------------------------

def _span_sql(table: str, text: str, by: list[str]) -> str:
    parts = []
    g = ", ".join(by)
    for r in FX.PII_RULES:
        cnt = f"len(regexp_extract_all({text}, {O.q(r[3])}))"
        sel = (f"{g}, " if by else "")
        parts.append(
            f"SELECT {sel}{O.q(r[1])} AS pii_type, CAST(sum(CASE WHEN {cnt} > 0 THEN 1 ELSE 0 END) AS BIGINT) "
            f"AS rows_with_hit, CAST(sum({cnt}) AS BIGINT) AS spans FROM {table} WHERE {text} IS NOT NULL"
            + (f" GROUP BY {g}" if by else ""))
    return " UNION ALL ".join(parts)


@register("text_span_counts", _span_sql("documents", "text", ["lang"]))
def text_span_counts(spark, sf_dir):
    return D.span_counts(read_table(spark, sf_dir, "documents"), "text", ["lang"])


@register("text_span_counts_conversations", _span_sql("conversations", "text", ["role"]))
def text_span_counts_conversations(spark, sf_dir):
    return D.span_counts(read_table(spark, sf_dir, "conversations"), "text", ["role"])


@register("text_span_counts_pages", _span_sql("pages", "html", []))
def text_span_counts_pages(spark, sf_dir):
    return D.span_counts(read_table(spark, sf_dir, "pages"), "html", [])


def _redact_sql(v: str) -> str:
    out = v
    for r in FX.PII_RULES:
        out = f"regexp_replace({out}, {O.q(r[3])}, {O.q(FX.REDACTED)}, 'g')"
    return out


@register("text_redacted", f"SELECT doc_id, {_redact_sql('text')} AS text_redacted FROM documents")
def text_redacted(spark, sf_dir):
    docs = spread(read_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", D.redact_spans(F.col("text")).alias("text_redacted"))


# ---------------------------------------------------------------------------
# CSV round trip: every column comes back as text, '' and NA tokens as null, blanks as they were
# ---------------------------------------------------------------------------

_NA = ", ".join(O.q(t) for t in S.NA_TOKENS)


@register("csv_round_trip", "SELECT " + ", ".join(
    f"CASE WHEN CAST({c} AS VARCHAR) IN ({_NA}) THEN NULL ELSE CAST({c} AS VARCHAR) END AS {c}" for c in PEOPLE_COLUMNS) + f" FROM ({people_sql()}) p")
def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv-round-trip")
    S.write_csv(people_df(spark, sf_dir), path)
    return S.read_csv(spark, path)


@register("csv_quoted_newlines", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, NULLIF(lang, '') AS lang, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS text_sha256
FROM (SELECT doc_id, lang, NULLIF(text, '') AS text FROM documents) d""")
def csv_quoted_newlines(spark, sf_dir):
    path = scratch_path(spark, "csv-newlines")
    S.write_csv(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path)
    back = S.read_csv(spark, path, multiline=True, na_tokens=False)
    return back.select("doc_id", "lang", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


ORDER_CELLS = ["CAST(o_orderkey AS STRING) AS orderkey", "CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS STRING) ELSE 'n/a' END AS custkey",
               "CASE WHEN o_custkey % 2 = 0 THEN 'TRUE' ELSE 'false' END AS even", "concat('00', o_custkey) AS padded",
               "CASE WHEN o_orderkey % 5 = 0 THEN '0.25' ELSE concat(o_custkey, 'e1') END AS ratio", "CASE WHEN o_orderkey % 3 = 0 THEN '12' ELSE o_orderpriority END AS mixed",
               "concat('1000000000', lpad(CAST(o_custkey AS STRING), 10, '0')) AS serial"]


@register("csv_column_types", """SELECT o_orderkey AS orderkey, CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS VARCHAR) || '.0' AS custkey,
 CASE WHEN o_custkey % 2 = 0 THEN 'True' ELSE 'False' END AS even, o_custkey AS padded,
 CASE WHEN o_orderkey % 5 = 0 THEN '0.25' ELSE CAST(o_custkey * 10 AS VARCHAR) || '.0' END AS ratio,
 CASE WHEN o_orderkey % 3 = 0 THEN '12' ELSE o_orderpriority END AS mixed,
 '1000000000' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS serial FROM orders""")
def csv_column_types(spark, sf_dir):
    path = scratch_path(spark, "csv-types")
    S.write_csv(read_table(spark, sf_dir, "orders").selectExpr(*ORDER_CELLS), path)
    back = S.read_csv(spark, path, types="pandas")
    floats = {f.name for f in back.schema.fields if f.dataType.typeName() == "double"}
    return back.select(*[as_text(F.col(c), back.schema[c].dataType).alias(c) if c in floats else
                         F.col(c).cast("string").alias(c) if c == "serial" else F.col(c) for c in back.columns])


# ---------------------------------------------------------------------------
# extensions
# ---------------------------------------------------------------------------


SALT = "pepper|"


@register("salted_hash",
          f"SELECT k, CASE WHEN {O.blank('cnic')} THEN cnic ELSE sha256({O.q(SALT)} || cnic) END AS cnic "
          f"FROM ({people_sql()}) p")
def salted_hash(spark, sf_dir):
    cfg = [("cnic", FX.CNIC, FX.HASHING)]
    return anonymize(people_df(spark, sf_dir), cfg, salt=SALT).df.select("k", "cnic")


def _qi_sql():
    return (f"SELECT {O.age_band_int('age')} AS age_band, "
            f"CASE WHEN {O.blank('dob')} THEN dob ELSE {O.dob_year('dob')} END AS dob_year, segment "
            f"FROM ({people_sql()}) p")


@register("k_anonymity",
          f"SELECT age_band, dob_year, segment, count(*) AS k FROM ({_qi_sql()}) q GROUP BY ALL")
def k_anonymity(spark, sf_dir):
    p = people_df(spark, sf_dir)
    q = p.select(age_band(F.col("age").cast("string")).alias("age_band"),
                 F.when(F.col("dob").isNull() | F.col("dob").rlike(r"\A\s*\z"), F.col("dob"))
                 .otherwise(dob_year(F.col("dob"))).alias("dob_year"), "segment")
    return X.k_anonymity(q, ["age_band", "dob_year", "segment"])


@register("k_anonymity_summary",
          f"SELECT min(k) AS k, count(*) AS classes, CAST(sum(CASE WHEN k < 3 THEN k ELSE 0 END) AS BIGINT) AS rows_below_k "
          f"FROM (SELECT count(*) AS k FROM ({_qi_sql()}) q GROUP BY age_band, dob_year, segment) c")
def k_anonymity_summary(spark, sf_dir):
    p = people_df(spark, sf_dir)
    cfg = [("age", FX.AGE, FX.GENERALIZATION), ("dob", FX.DOB, FX.GENERALIZATION)]
    return X.k_anonymity_summary(anonymize(p, cfg).df, ["age", "dob", "segment"], 3)


@register("drop_columns", f"SELECT * EXCLUDE (cnic, credit_card) FROM ({people_sql()}) p")
def drop_columns(spark, sf_dir):
    return X.drop_columns(people_df(spark, sf_dir), ["cnic", "credit_card"])


@register("age_top_coded",
          f"SELECT k, CASE WHEN age >= {X.TOP_CODE_AGE} THEN '{X.TOP_CODE_AGE}+' ELSE {O.age_band_int('age')} END "
          f"AS age FROM ({people_sql()}) p")
def age_top_coded(spark, sf_dir):
    p = people_df(spark, sf_dir)
    return p.select("k", X.age_top_coded(F.col("age"), p.schema["age"].dataType).alias("age"))


@register("encrypted_key_round_trip",
          f"SELECT original, fake, pii_type FROM ({_mapping_sql(people_sql(), NAME_EMAIL)}) m")
def encrypted_key_round_trip(spark, sf_dir):
    """The key is written with its originals encrypted and read back; the secret stays in a file."""
    path = scratch_path(spark, "encrypted-key")
    spark.createDataFrame([("0123456789abcdef0123456789abcdef",)], "value string").coalesce(1).write.text(f"{path}/secret")
    secret = X.secret_column(spark, f"{path}/secret")
    K.write_key(K.build_mapping(people_df(spark, sf_dir), NAME_EMAIL), f"{path}/key", secret=secret)
    return K.read_key(spark, f"{path}/key", secret).select("original", "fake", "pii_type")


# ---------------------------------------------------------------------------
# D3 over every atomic column of every provided table (full-column mode)
# ---------------------------------------------------------------------------

#: Columns of the given tables that hold plain values.
TABLE_COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


def _detect_tables_sql() -> str:
    parts = [f"SELECT {O.q(t)} AS table_name, * FROM ({O.value_types(t, TABLE_COLUMNS[t].split())}) x{i}"
             for i, t in enumerate(TABLES)]
    return " UNION ALL ".join(parts)


@register("detect_tables", _detect_tables_sql())
def detect_tables(spark, sf_dir):
    parts = [D.detect_values(read_table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "*")
             for t in TABLES]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------------------
# Larger given tables: the whole run on customer, projections over lineitem,
# fake ids over orders
# ---------------------------------------------------------------------------


def _run_customer_sql() -> str:
    return (f"SELECT c.c_custkey, CASE WHEN {O.blank('c.c_name')} THEN c.c_name ELSE {O.fake_value(FX.FULL_NAME, O.strip('c.c_name'))} END AS c_name, "
            f"{O.technique('c.c_nationkey', FX.GENERALIZATION, FX.AGE, numeric=True)} AS c_nationkey, "
            f"CASE WHEN c.c_acctbal IS NULL OR isnan(c.c_acctbal) THEN NULL ELSE '' END AS c_acctbal, "
            f"c.c_mktsegment FROM customer c")


@register("run_customer", _run_customer_sql())
def run_customer(spark, sf_dir):
    """The whole run (detect, Academic profile, pseudonyms, key, audit) on customer."""
    out = scratch_path(spark, "run-customer")
    res = J.run(spark, f"{sf_dir}/customer.parquet", out, profile=ACADEMIC,
                mode=FX.MODE_PSEUDONYMIZATION, exclude=("c_custkey",))
    return spark.read.parquet(res.output)


LINEITEM_RULES = [("l_orderkey", FX.STUDENT_ID, FX.HASHING), ("l_partkey", FX.STUDENT_ID, FX.HASHING),
                  ("l_suppkey", FX.STUDENT_ID, FX.HASHING), ("l_shipdate", FX.DOB, FX.GENERALIZATION),
                  ("l_extendedprice", FX.CREDIT_CARD, FX.MASKING), ("l_linenumber", FX.PHONE, FX.MASKING),
                  ("l_returnflag", None, FX.REDACTION)]


def _lineitem_sql() -> str:
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    cfg = {c: (t, tech) for c, t, tech in LINEITEM_RULES}
    sel = []
    for c in cols:
        if c in cfg:
            t, tech = cfg[c]
            sel.append(f"{O.technique(f'CAST({c} AS VARCHAR)', tech, t)} AS {c}")
        else:
            sel.append(c)
    return f"SELECT {', '.join(sel)} FROM lineitem"


@register("anonymize_lineitem", _lineitem_sql())
def anonymize_lineitem(spark, sf_dir):
    return anonymize(read_table(spark, sf_dir, "lineitem"), LINEITEM_RULES).df


@register("pseudonymize_orders",
          f"SELECT o_orderkey, {O.fake_value(FX.STUDENT_ID, 'CAST(o_custkey AS VARCHAR)')} AS o_custkey FROM orders")
def pseudonymize_orders(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return anonymize(orders, [("o_custkey", FX.STUDENT_ID, FX.FAKE_DATA)]).df


# numbers above 1e7 and below 1e-3, which Spark and Python print differently
_BIG, _SMALL = "o_totalprice * 1000000", "1 / (o_totalprice * 3)"


@register("number_cells",
          f"SELECT o_orderkey, {O.technique(f'CAST({_BIG} AS VARCHAR)', FX.MASKING, FX.PHONE)} AS phone, "
          f"{O.technique(f'CAST({_BIG} AS VARCHAR)', FX.MASKING, FX.CREDIT_CARD)} AS card, {O.technique(f'CAST({_BIG} AS VARCHAR)', FX.MASKING, None)} AS other, "
          f"{O.technique(f'CAST({_BIG} AS VARCHAR)', FX.HASHING, None)} AS hashed, {O.technique(f'CAST({_SMALL} AS VARCHAR)', FX.HASHING, None)} AS small FROM orders")
def number_cells(spark, sf_dir):
    """P2-P5 over double columns: the text is that of ``str(v)``."""
    orders = read_table(spark, sf_dir, "orders")
    big = F.expr(_BIG)
    wide = orders.select("o_orderkey", *[big.alias(c) for c in ("phone", "card", "other", "hashed")], F.expr(_SMALL).alias("small"))
    return anonymize(wide, [("phone", FX.PHONE, FX.MASKING), ("card", FX.CREDIT_CARD, FX.MASKING), ("other", None, FX.MASKING),
                            ("hashed", None, FX.HASHING), ("small", None, FX.HASHING)]).df


@register("restore_orders", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def restore_orders(spark, sf_dir):
    """K6 over the whole orders table: fake ids back to customer keys."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    res = anonymize(orders, [("o_custkey", FX.STUDENT_ID, FX.FAKE_DATA)])
    return K.restore(res.df, res.mapping, ["o_custkey"])


# ---------------------------------------------------------------------------
# Structured Streaming: row-local techniques over the events table as a stream
# ---------------------------------------------------------------------------


STREAM_RULES = [("user_id", FX.STUDENT_ID, FX.HASHING), ("ts", FX.DOB, FX.GENERALIZATION),
                ("props", None, FX.REDACTION)]


def _stream_events_sql() -> str:
    sel = ["event_id",
           f"{O.technique('CAST(user_id AS VARCHAR)', FX.HASHING, FX.STUDENT_ID)} AS user_id",
           f"{O.technique('CAST(ts AS VARCHAR)', FX.GENERALIZATION, FX.DOB)} AS ts",
           "event_type", "value",
           f"{O.technique('props', FX.REDACTION, None)} AS props"]
    return f"SELECT {', '.join(sel)} FROM events"


@register("stream_events", _stream_events_sql())
def stream_events(spark, sf_dir):
    """events read as a file stream, protected per micro-batch, written to a
    checkpointed parquet sink in the shared folder, read back as a table."""
    stream = table_stream(spark, sf_dir, "events.parquet")
    out = scratch_path(spark, "stream-events")
    write_stream_files(anonymize_stream(stream, STREAM_RULES), out, scratch_path(spark, "stream-events-ck"))
    return spark.read.parquet(out)


@register("stream_pseudonymize",
          f"SELECT event_id, {O.fake_value(FX.STUDENT_ID, 'CAST(user_id AS VARCHAR)')} AS user_id, CAST(user_id AS VARCHAR) AS restored FROM events")
def stream_pseudonymize(spark, sf_dir):
    """K1, K4, K6 on a stream: events with fake user ids, and the ids again by the key that the stream wrote."""
    base = scratch_path(spark, "stream-pseudonymize")
    wait(pseudonymize_stream(table_stream(spark, sf_dir, "events.parquet"), [("user_id", FX.STUDENT_ID, FX.FAKE_DATA)],
                             f"{base}/out", f"{base}/key", f"{base}/checkpoint"))
    out = spark.read.parquet(f"{base}/out").select("event_id", "user_id", F.col("user_id").alias("restored"))
    return K.restore(out, K.read_key(spark, f"{base}/key"), ["restored"])


AUDITED = [*STREAM_RULES[1:], ("user_id", FX.STUDENT_ID, FX.FAKE_DATA)]


def _stream_audit_sql() -> str:
    after = {"ts": O.technique("CAST(ts AS VARCHAR)", FX.GENERALIZATION, FX.DOB), "props": O.technique("props", FX.REDACTION, None),
             "user_id": f"CASE WHEN {O.blank('CAST(user_id AS VARCHAR)')} THEN CAST(user_id AS VARCHAR) ELSE {O.fake_value(FX.STUDENT_ID, 'CAST(user_id AS VARCHAR)')} END"}
    parts = []
    for c, _t, _tech in AUDITED:
        b = f"CAST({c} AS VARCHAR)"
        parts.append(f"SELECT {O.q(c)} AS \"column\", CAST(count(*) AS BIGINT) AS rows, "
                     f"CAST(count(*) FILTER ({b} IS NOT DISTINCT FROM {after[c]}) AS BIGINT) AS unchanged, "
                     f"CAST(count(*) FILTER ({b} IS DISTINCT FROM {after[c]}) AS BIGINT) AS changed, "
                     f"CAST(count(*) FILTER ({O.blank(b)}) AS BIGINT) AS blank, (SELECT CAST(count(*) AS BIGINT) FROM events) AS all_rows FROM events")
    return " UNION ALL ".join(parts)


@register("stream_audit", _stream_audit_sql())
def stream_audit(spark, sf_dir):
    """S3, A1, A5 of a stream: the counts that its batches wrote beside their rows."""
    base = scratch_path(spark, "stream-audit")
    wait(pseudonymize_stream(table_stream(spark, sf_dir, "events.parquet"), AUDITED, f"{base}/out", f"{base}/key", f"{base}/checkpoint",
                             audit_path=f"{base}/audit"))
    total = stream_rows(spark, f"{base}/audit").select(F.col("rows").alias("all_rows"))
    return stream_counts(spark, f"{base}/audit").crossJoin(F.broadcast(total))      # one row


@register("restore_compacted", "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id FROM events")
def restore_compacted(spark, sf_dir):
    """A key of a stream's parts is compacted, and the buckets undo the stream's output."""
    base = scratch_path(spark, "restore-compacted")
    wait(pseudonymize_stream(table_stream(spark, sf_dir, "events.parquet"), [("user_id", FX.STUDENT_ID, FX.FAKE_DATA)],
                             f"{base}/out", f"{base}/key", f"{base}/checkpoint"))
    KS.compact_key(spark, f"{base}/key")
    KS.drop_covered(spark, f"{base}/key")
    out = spark.read.parquet(f"{base}/out").select("event_id", "user_id")
    return K.restore_from(out, f"{base}/key", ["user_id"], broadcast_bytes=0)


IN_FILE_ORDER = "SELECT *, row_number() OVER () AS file_row FROM {}"
CUSTOMER_CELLS = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]


@register("detect_values_file_order", O.value_types(IN_FILE_ORDER.format("customer"), CUSTOMER_CELLS, key="file_row", sample_rows=FX.DEFAULT_SAMPLE_ROWS))
def detect_values_file_order(spark, sf_dir):
    """D5 without a key: the first cells as they lie in the files."""
    return D.detect_values(read_table(spark, sf_dir, "customer"), CUSTOMER_CELLS, sample_rows=FX.DEFAULT_SAMPLE_ROWS)


@register("preview_file_order",
          "SELECT file_row AS row, " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}_before, {O.technique(f'CAST({c} AS VARCHAR)', tech, t)} AS {c}_after"
                                                 for c, t, tech in STREAM_RULES)
          + f" FROM ({IN_FILE_ORDER.format('events')}) e WHERE file_row <= {FX.PREVIEW_ROWS}")
def preview_file_order(spark, sf_dir):
    """S4, P15 without a key."""
    return preview(read_table(spark, sf_dir, "events"), STREAM_RULES)


from veilframe.plans import catalog_protect  # noqa: E402, F401 - registers its queries beside these
