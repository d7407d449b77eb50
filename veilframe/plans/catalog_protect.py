"""Registered queries of the keys by value (K1, K2), of spans in texts (P16) and of k-anonymity's histogram and cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import fixed as FX
from veilframe.functions import formats as FM
from veilframe.operators import boxes as B
from veilframe.operators import privacy as X
from veilframe.operators import pseudo as K
from veilframe.operators import spans as P
from veilframe.operators import value_key as V
from veilframe.operators.transform import anonymize
from veilframe.plans import oracle as O
from veilframe.plans.people import people_df, people_sql
from veilframe.plans.registry import register
from veilframe.session import read_table

# ---------------------------------------------------------------------------
# K1 / K2 by value
# ---------------------------------------------------------------------------

#: In order: a name that also stands in the contact column is a Full Name there too.
CONTACTS = [("full_name", FX.FULL_NAME), ("contact", FX.EMAIL), ("manager_name", FX.FULL_NAME)]
CONTACTS_SQL = f"SELECT *, CASE WHEN k % 3 = 0 THEN full_name ELSE email END AS contact FROM ({people_sql(two_names=True)}) c"
TYPED = [("full_name", FX.FULL_NAME), ("email", FX.EMAIL), ("phone", FX.PHONE), ("cnic", FX.CNIC), ("dob", FX.DOB), ("address", FX.ADDRESS),
         ("client_ip", FX.IP_ADDRESS), ("credit_card", FX.CREDIT_CARD), ("emp_id", FX.STUDENT_ID), ("segment", None)]


def contacts_df(spark, sf_dir) -> DataFrame:
    people = people_df(spark, sf_dir, two_names=True)
    return people.withColumn("contact", F.when(F.col("k") % 3 == 0, F.col("full_name")).otherwise(F.col("email")))


def by_value(df: DataFrame, columns, **kw):
    return anonymize(df, [(c, t, FX.FAKE_DATA) for c, t in columns], consistent="value", **kw)


@register("value_mapping", O.value_mapping(CONTACTS_SQL, CONTACTS))
def value_mapping(spark, sf_dir):
    return V.value_mapping(contacts_df(spark, sf_dir), CONTACTS)


@register("pseudonymize_by_value", O.value_apply(CONTACTS_SQL, ["k"], CONTACTS))
def pseudonymize_by_value(spark, sf_dir):
    return by_value(contacts_df(spark, sf_dir), CONTACTS).df.select("k", *[c for c, _t in CONTACTS])


@register("fakes_in_format", O.value_apply(people_sql(), ["k"], TYPED))
def fakes_in_format(spark, sf_dir):
    return by_value(people_df(spark, sf_dir), TYPED).df.select("k", *[c for c, _t in TYPED])


@register("fakes_in_format_de", O.value_apply(people_sql(), ["k"], TYPED, "de_DE"))
def fakes_in_format_de(spark, sf_dir):
    return by_value(people_df(spark, sf_dir), TYPED, locale="de_DE").df.select("k", *[c for c, _t in TYPED])


_DOMAINS = " ".join(f"WHEN {O.q(t)} THEN {FM.format_of(t).domain}" for t in FX.pii_type_names())
_ACCEPTED = " ".join(f"WHEN {O.q(r[1])} THEN regexp_matches(fake, {O.q(r[3])})" for r in FX.PII_RULES)


@register("fakes_accepted",
          f"SELECT pii_type, count(*) AS entries, count(DISTINCT fake) AS fakes, "
          f"CAST(sum(CASE WHEN CASE pii_type {_ACCEPTED} ELSE TRUE END THEN 1 ELSE 0 END) AS BIGINT) AS accepted, "
          f"CASE pii_type {_DOMAINS} ELSE {FM.format_of(None).domain} END AS domain, CAST(sum(CASE WHEN regexp_matches(fake, '~[0-9]+$') THEN 1 ELSE 0 END) AS BIGINT) AS widened "
          f"FROM ({O.value_mapping(people_sql(), TYPED)}) m GROUP BY pii_type")
def fakes_accepted(spark, sf_dir):
    """Per type: entries, different fakes, those that the type's own rule accepts, the format's domain and the fakes beyond it."""
    key = V.value_mapping(people_df(spark, sf_dir), TYPED)
    own = F.lit(True)
    for r in FX.PII_RULES:
        own = F.when(F.col("pii_type") == r[1], F.col("fake").rlike(r[3])).otherwise(own)
    counts = key.groupBy("pii_type").agg(F.countDistinct("fake").alias("fakes"), F.sum(own.cast("bigint")).alias("accepted"))
    use = V.domain_use(key).withColumnRenamed("pii_type", "type")
    return counts.join(F.broadcast(use), F.col("pii_type").eqNullSafe(F.col("type"))).select("pii_type", "entries", "fakes", "accepted", "domain", "widened")  # a row a type


_ORDERS = "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders"
ORDER_COLUMNS = [("o_custkey", FX.STUDENT_ID), ("o_orderdate", FX.DOB)]


@register("pseudonymize_orders_by_value", O.value_apply(_ORDERS, ["o_orderkey"], ORDER_COLUMNS))
def pseudonymize_orders_by_value(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("string").alias("o_orderdate"))
    return by_value(orders, ORDER_COLUMNS).df


@register("restore_by_value", f"SELECT k, full_name, contact, manager_name FROM ({CONTACTS_SQL}) p")
def restore_by_value(spark, sf_dir):
    res = by_value(contacts_df(spark, sf_dir), CONTACTS)
    return K.restore(res.df, res.mapping, [c for c, _t in CONTACTS]).select("k", *[c for c, _t in CONTACTS])


# ---------------------------------------------------------------------------
# A technique per span
# ---------------------------------------------------------------------------

TYPE_NAMES = [r[1] for r in FX.PII_RULES]
SPAN_CONFIG = {FX.EMAIL: FX.MASKING, FX.PHONE: FX.MASKING, FX.CNIC: FX.HASHING, FX.FULL_NAME: FX.FAKE_DATA, FX.DOB: FX.GENERALIZATION,
               FX.ADDRESS: FX.GENERALIZATION, FX.IP_ADDRESS: FX.GENERALIZATION, FX.CREDIT_CARD: FX.MASKING, FX.STUDENT_ID: FX.HASHING, FX.AGE: FX.REDACTION}
#: Without phone numbers, which shadow card numbers.
CARD_CONFIG = {FX.EMAIL: FX.FAKE_DATA, FX.CREDIT_CARD: FX.MASKING, FX.IP_ADDRESS: FX.FAKE_DATA, FX.DOB: FX.NULL_DELETION}


@register("text_spans", f"{O.taken_spans('documents', 'doc_id', 'text', TYPE_NAMES)} "
                        f'SELECT doc_id, first AS start, CAST(last AS INTEGER) AS "end", pii_type, value FROM taken')
def text_spans(spark, sf_dir):
    return P.span_table(read_table(spark, sf_dir, "documents"), ["doc_id"], "text")


@register("text_protected", O.protected_text("documents", "doc_id", "text", SPAN_CONFIG))
def text_protected(spark, sf_dir):
    return P.protect_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", SPAN_CONFIG)


@register("text_protected_pages", O.protected_text("pages", "page_id", "html", CARD_CONFIG))
def text_protected_pages(spark, sf_dir):
    return P.protect_spans(read_table(spark, sf_dir, "pages").select("page_id", "html"), "html", CARD_CONFIG)


@register("text_span_key", f"{O.taken_spans('documents', 'doc_id', 'text', TYPE_NAMES)} "
                           f"SELECT original, {O.fake_value(FX.FULL_NAME, 'original')} AS fake, pii_type, count(*) AS n "
                           f"FROM (SELECT {O.strip('value')} AS original, pii_type FROM taken WHERE pii_type = {O.q(FX.FULL_NAME)}) x GROUP BY ALL")
def text_span_key(spark, sf_dir):
    return P.span_mapping(read_table(spark, sf_dir, "documents"), "text", SPAN_CONFIG)


# ---------------------------------------------------------------------------
# Sizes of classes, and reaching k
# ---------------------------------------------------------------------------

@register("k_histogram", "SELECT k, count(*) AS classes, CAST(k * count(*) AS BIGINT) AS rows FROM "
                         "(SELECT count(*) AS k FROM lineitem GROUP BY l_quantity, l_returnflag, l_linestatus, l_tax) c GROUP BY k")
def k_histogram(spark, sf_dir):
    return X.k_histogram(read_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_returnflag", "l_linestatus", "l_tax"])


@register("generalized_to_k")      # recursive cuts: held against brute force in the tests
def generalized_to_k(spark, sf_dir):
    return B.generalize_to_k(read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey", "c_acctbal"], 5)
