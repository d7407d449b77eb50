"""Rule, profile and compliance tables.

Everything in this module is data that must equal the behaviour being
reproduced (keyword lists, value patterns, default techniques, profile
choices, compliance provisions).  It is kept together, in its natural
order, and is turned into small DataFrames by the functions at the bottom.
Order is semantic in ``PII_RULES``: the first matching type wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values: technique names -----------------------------------------
MASKING = "Masking"
HASHING = "Hashing"
GENERALIZATION = "Generalization"
FAKE_DATA = "Fake Data"
NULL_DELETION = "Null/Deletion"
REDACTION = "Redaction"
TECHNIQUE_NAMES = [MASKING, HASHING, GENERALIZATION, FAKE_DATA, NULL_DELETION, REDACTION]

# --- fixed values: PII types (rank order) ----------------------------------
EMAIL = "Email"
PHONE = "Phone"
CNIC = "CNIC"
FULL_NAME = "Full Name"
DOB = "Date of Birth"
ADDRESS = "Address"
IP_ADDRESS = "IP Address"
CREDIT_CARD = "Credit Card"
STUDENT_ID = "Student/Employee ID"
AGE = "Age"

# --- fixed values: rule table (rank, type, header keywords, value pattern, default technique)
PII_RULES = [
    (1, EMAIL, ["email", "e-mail", "mail", "contact_email"],
     r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", MASKING),
    (2, PHONE, ["phone", "mobile", "cell", "contact", "tel", "number"],
     r"(\+?\d{1,3}[\s\-]?)?\(?\d{2,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{4,7}", MASKING),
    (3, CNIC, ["cnic", "nic", "national_id", "id_card", "identity"],
     r"\d{5}-\d{7}-\d{1}", HASHING),
    (4, FULL_NAME, ["name", "full_name", "firstname", "lastname", "first_name", "last_name",
                    "student_name", "employee_name", "patient_name"],
     r"[A-Z][a-z]+(\s[A-Z][a-z]+)+", FAKE_DATA),
    (5, DOB, ["dob", "date_of_birth", "birthdate", "birth_date", "birthday", "born"],
     r"\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}|\d{4}[\/\-]\d{1,2}[\/\-]\d{1,2}", GENERALIZATION),
    (6, ADDRESS, ["address", "addr", "street", "location", "residence", "city", "zip", "postal"],
     r"\d+\s+[A-Za-z\s,\.]+", GENERALIZATION),
    (7, IP_ADDRESS, ["ip", "ip_address", "ipaddress", "host", "client_ip"],
     r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", GENERALIZATION),
    (8, CREDIT_CARD, ["card", "credit", "cc", "credit_card", "card_number", "payment"],
     r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", MASKING),
    (9, STUDENT_ID, ["id", "student_id", "employee_id", "emp_id", "reg_no", "registration",
                     "roll_no", "staff_id"],
     r"[A-Z]{2,4}[\-]?\d{3,8}", HASHING),
    (10, AGE, ["age", "years_old", "patient_age"],
     r"\b(1[0-2]\d|[1-9]\d|\d)\b", GENERALIZATION),
]

# --- fixed values: value-pass constants -------------------------------------
MATCH_THRESHOLD = 0.5            # matched / non-empty >= threshold flags the column
DEFAULT_SAMPLE_ROWS = 10         # first n non-null cells in sampled mode
NOT_EMPTY_EXCLUDED = ["", "nan", "NaN", "None"]   # stripped text treated as empty
FALLBACK_TECHNIQUE = MASKING     # technique of unknown types and manual additions
OVERRIDE_NONE = "(none)"         # override value that keeps the detected type
PREVIEW_ROWS = 5

# --- fixed values: output markers -------------------------------------------
REDACTED = "[REDACTED]"
GENERALIZED = "[GENERALIZED]"
LOCATION_GENERALIZED = "[Location Generalized]"
DOB_YEAR_PATTERN = r"\b(19|20)\d{2}\b"
KEY_TOOL = "veilframe"
MODE_ANONYMIZATION = "Anonymization"
MODE_PSEUDONYMIZATION = "Pseudonymization"

# --- fixed values: profiles (name, compliance tags, type -> technique, priority types)
PROFILES = [
    ("Academic/Research",
     ["GDPR", "HEC Guidelines", "Data Minimisation (Art. 5)"],
     {FULL_NAME: FAKE_DATA, EMAIL: MASKING, DOB: GENERALIZATION, STUDENT_ID: HASHING,
      PHONE: MASKING, ADDRESS: GENERALIZATION, CNIC: HASHING, AGE: GENERALIZATION,
      CREDIT_CARD: NULL_DELETION, IP_ADDRESS: GENERALIZATION},
     [FULL_NAME, STUDENT_ID, EMAIL, DOB, CNIC]),
    ("Corporate/HR",
     ["PECA 2016 (S.3 & S.4)", "GDPR", "Employment Privacy"],
     {FULL_NAME: FAKE_DATA, EMAIL: MASKING, CNIC: HASHING, PHONE: MASKING,
      ADDRESS: GENERALIZATION, STUDENT_ID: HASHING, DOB: GENERALIZATION,
      AGE: GENERALIZATION, CREDIT_CARD: NULL_DELETION, IP_ADDRESS: GENERALIZATION},
     [FULL_NAME, CNIC, PHONE, EMAIL, STUDENT_ID]),
    ("Healthcare",
     ["HIPAA Security Rule", "GDPR Art. 9 (Special Categories)", "Data Minimisation"],
     {FULL_NAME: REDACTION, DOB: GENERALIZATION, PHONE: NULL_DELETION,
      ADDRESS: GENERALIZATION, EMAIL: NULL_DELETION, STUDENT_ID: HASHING, CNIC: HASHING,
      AGE: GENERALIZATION, IP_ADDRESS: NULL_DELETION, CREDIT_CARD: NULL_DELETION},
     [FULL_NAME, DOB, PHONE, ADDRESS, STUDENT_ID, CNIC]),
]

# --- provisions per technique, as short codes of our own -----------------------
# (technique, framework, seq, provision)
COMPLIANCE = [
    (MASKING, "GDPR", 1, "Art. 5(1)(c)"),
    (MASKING, "GDPR", 2, "Art. 25"),
    (MASKING, "PECA 2016", 1, "S. 3"),
    (MASKING, "HIPAA", 1, "164.514 Safe Harbor"),
    (MASKING, "CIA", 1, "Confidentiality"),
    (HASHING, "GDPR", 1, "Recital 26"),
    (HASHING, "GDPR", 2, "Art. 5(1)(f)"),
    (HASHING, "GDPR", 3, "Art. 17"),
    (HASHING, "PECA 2016", 1, "S. 4"),
    (HASHING, "HIPAA", 1, "164.514(b) Expert Determination"),
    (HASHING, "CIA", 1, "Confidentiality + Integrity"),
    (GENERALIZATION, "GDPR", 1, "Art. 5(1)(c)"),
    (GENERALIZATION, "GDPR", 2, "Recital 26"),
    (GENERALIZATION, "PECA 2016", 1, "S. 3"),
    (GENERALIZATION, "HIPAA", 1, "164.514 Safe Harbor"),
    (GENERALIZATION, "CIA", 1, "Confidentiality"),
    (FAKE_DATA, "GDPR", 1, "Recital 26"),
    (FAKE_DATA, "GDPR", 2, "Art. 5(1)(b)"),
    (FAKE_DATA, "PECA 2016", 1, "S. 4"),
    (FAKE_DATA, "HIPAA", 1, "164.514 Safe Harbor"),
    (FAKE_DATA, "CIA", 1, "Confidentiality"),
    (NULL_DELETION, "GDPR", 1, "Art. 5(1)(c)"),
    (NULL_DELETION, "GDPR", 2, "Art. 17"),
    (NULL_DELETION, "PECA 2016", 1, "S. 4"),
    (NULL_DELETION, "HIPAA", 1, "164.514 Safe Harbor"),
    (NULL_DELETION, "CIA", 1, "Confidentiality"),
    (REDACTION, "GDPR", 1, "Art. 5(1)(c)"),
    (REDACTION, "GDPR", 2, "Art. 17"),
    (REDACTION, "PECA 2016", 1, "S. 4"),
    (REDACTION, "HIPAA", 1, "164.514 Safe Harbor"),
    (REDACTION, "CIA", 1, "Confidentiality"),
]
NO_COMPLIANCE_FRAMEWORK = "none"
NO_COMPLIANCE_PROVISION = "no mapping for this technique"


# ---------------------------------------------------------------------------
# Lookups (driver-side, over the fixed lists above)
# ---------------------------------------------------------------------------

def rule_for(pii_type: str):
    for rule in PII_RULES:
        if rule[1] == pii_type:
            return rule
    return None


def default_technique(pii_type: str | None) -> str:
    """Default technique of a type, else Masking."""
    rule = rule_for(pii_type) if pii_type is not None else None
    return rule[4] if rule else FALLBACK_TECHNIQUE


def pii_type_names() -> list[str]:
    """Sorted type names."""
    return sorted(r[1] for r in PII_RULES)


def profile_names() -> list[str]:
    """Profile keys in definition order."""
    return [p[0] for p in PROFILES]


def get_profile(name: str):
    """(name, compliance, techniques, priority) or None."""
    for p in PROFILES:
        if p[0] == name:
            return p
    return None


# ---------------------------------------------------------------------------
# The same tables as (tiny, fixed-size) DataFrames
# ---------------------------------------------------------------------------

def profiles_df(spark: SparkSession) -> DataFrame:
    """One row per (profile, pii_type) with the profile's technique and priority flag."""
    rows = []
    for name, _tags, techniques, priority in PROFILES:
        for pii_type, tech in techniques.items():
            rows.append((name, pii_type, tech, pii_type in priority))
    return spark.createDataFrame(
        rows, "profile string, pii_type string, technique string, priority boolean")


def compliance_df(spark: SparkSession) -> DataFrame:
    """Compliance lookup (technique, framework, seq, provision)."""
    return spark.createDataFrame(
        COMPLIANCE, "technique string, framework string, seq int, provision string")
