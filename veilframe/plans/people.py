"""Derived test tables.

No provided table holds personal data, so the ``people`` family is computed
from ``customer`` (one row per ``k = c_custkey``) with the same arithmetic in
Spark (``people_df``) and in DuckDB SQL (``people_sql``).  Everything is a
projection of the scan plus one broadcast join to ``nation`` (25 rows), so
the derived table grows with ``customer``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.session import read_table, spread

# --- name pools and blank injection of the fixture ----------------------------
FIRST = ["Ali", "Sana", "Omar", "Hina", "Bilal", "Zara", "Usman", "Nida", "Imran", "Maria"]
LAST = ["Hassan", "Malik", "Khan", "Raza", "Shah", "Iqbal", "Butt", "Mirza", "Ahmed", "Qureshi"]
NULL_EVERY, EMPTY_EVERY, SPACES_EVERY = 17, 19, 23
PII_STRING_COLUMNS = ["full_name", "email", "phone", "cnic", "dob", "address", "client_ip",
                      "credit_card", "emp_id"]
PEOPLE_COLUMNS = ["k"] + PII_STRING_COLUMNS + ["age", "segment"]
OPAQUE_NAMES = {c: f"c{i + 1}" for i, c in enumerate(PII_STRING_COLUMNS + ["age"])}


def _s(c: Column) -> Column:
    return c.cast("string")


def _lpad(c: Column, n: int) -> Column:
    return F.lpad(_s(c), n, "0")


def _pool(pool: list[str], pos: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in pool]), (pos + 1).cast("int"))


def _name_of(k: Column) -> Column:
    return F.concat(_pool(FIRST, k % 10), F.lit(" "), _pool(LAST, F.floor(k / 10) % 10))


def _blank_injected(k: Column, v: Column) -> Column:
    return (F.when(k % NULL_EVERY == 0, F.lit(None).cast("string"))
            .when(k % EMPTY_EVERY == 0, F.lit(""))
            .when(k % SPACES_EVERY == 0, F.lit("  "))
            .otherwise(v))


def people_df(spark: SparkSession, sf_dir: str, blanks: bool = True,
              two_names: bool = False) -> DataFrame:
    cust = spread(read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"))     # three narrow columns
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # nation is a fixed 25-row dimension: broadcast is size-bounded by definition.
    j = cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey, "left")
    k = F.col("c_custkey").cast("bigint")
    dob = F.date_format(F.date_add(F.lit("1940-01-01").cast("date"), ((k * 37) % 23000).cast("int")),
                        "dd/MM/yyyy")
    cols = {
        "full_name": _name_of(k),
        "email": F.concat(F.lit("user."), _s(k), F.lit("@"), F.lower("c_mktsegment"),
                          F.lit(".example.com")),
        "phone": F.concat(F.lit("03"), _lpad(k % 100, 2), F.lit("-"), _lpad(k, 7)),
        "cnic": F.concat(_lpad(35000 + k % 1000, 5), F.lit("-"), _lpad(k, 7), F.lit("-"), _s(k % 10)),
        "dob": dob,
        "address": F.concat(_s(k % 999 + 1), F.lit(" Main Street, "), F.col("n_name")),
        "client_ip": F.concat(F.lit("10."), _s(k % 256), F.lit("."), _s((k * 7) % 256), F.lit("."),
                              _s(k % 200)),
        "credit_card": F.concat(F.lit("4111"), _lpad(k, 12)),
        "emp_id": F.concat(F.lit("EMP"), _lpad(k, 5)),
    }
    out = [k.alias("k")]
    for name in PII_STRING_COLUMNS:
        v = cols[name]
        out.append((_blank_injected(k, v) if blanks else v).alias(name))
    out.append((F.lit(18) + (k % 75)).cast("int").alias("age"))
    out.append(F.col("c_mktsegment").alias("segment"))
    if two_names:
        out.append(_name_of(F.floor(k / 2)).alias("manager_name"))
    return j.select(*out)


def people_opaque_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = people_df(spark, sf_dir)
    return df.select(*[F.col(c).alias(OPAQUE_NAMES.get(c, c)) for c in df.columns])


def people_ip_header_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people_df(spark, sf_dir).withColumnRenamed("client_ip", "ip_address")


# ---------------------------------------------------------------------------
# DuckDB SQL of the same tables (used by the oracle)
# ---------------------------------------------------------------------------

def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _sql_name(k: str) -> str:
    return (f"({_sql_list(FIRST)})[({k}) % 10 + 1] || ' ' || "
            f"({_sql_list(LAST)})[(({k}) // 10) % 10 + 1]")


def _sql_blank(v: str) -> str:
    return (f"CASE WHEN k % {NULL_EVERY} = 0 THEN NULL WHEN k % {EMPTY_EVERY} = 0 THEN '' "
            f"WHEN k % {SPACES_EVERY} = 0 THEN '  ' ELSE {v} END")


def people_sql(blanks: bool = True, two_names: bool = False) -> str:
    """A SELECT producing ``people`` from DuckDB views ``customer`` and ``nation``."""
    exprs = {
        "full_name": _sql_name("k"),
        "email": "'user.' || CAST(k AS VARCHAR) || '@' || lower(c_mktsegment) || '.example.com'",
        "phone": "'03' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(k AS VARCHAR), 7, '0')",
        "cnic": ("lpad(CAST(35000 + k % 1000 AS VARCHAR), 5, '0') || '-' || lpad(CAST(k AS VARCHAR), 7, '0')"
                 " || '-' || CAST(k % 10 AS VARCHAR)"),
        "dob": "strftime(DATE '1940-01-01' + CAST((k * 37) % 23000 AS INTEGER), '%d/%m/%Y')",
        "address": "CAST(k % 999 + 1 AS VARCHAR) || ' Main Street, ' || n_name",
        "client_ip": ("'10.' || CAST(k % 256 AS VARCHAR) || '.' || CAST((k * 7) % 256 AS VARCHAR) || '.' "
                      "|| CAST(k % 200 AS VARCHAR)"),
        "credit_card": "'4111' || lpad(CAST(k AS VARCHAR), 12, '0')",
        "emp_id": "'EMP' || lpad(CAST(k AS VARCHAR), 5, '0')",
    }
    sel = ["k"]
    for name in PII_STRING_COLUMNS:
        sel.append(f"{_sql_blank(exprs[name]) if blanks else exprs[name]} AS {name}")
    sel.append("CAST(18 + k % 75 AS INTEGER) AS age")
    sel.append("c_mktsegment AS segment")
    if two_names:
        sel.append(f"{_sql_name('k // 2')} AS manager_name")
    return ("SELECT " + ", ".join(sel) +
            " FROM (SELECT CAST(c_custkey AS BIGINT) AS k, c_mktsegment, n_name FROM customer "
            "LEFT JOIN nation ON c_nationkey = n_nationkey) base")


def people_opaque_sql() -> str:
    sel = [f"{c} AS {OPAQUE_NAMES.get(c, c)}" for c in PEOPLE_COLUMNS]
    return f"SELECT {', '.join(sel)} FROM ({people_sql()}) p"
