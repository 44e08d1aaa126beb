"""Tags read from free text, and the taxonomy that maps raw subcategories to service categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import any_match, any_of, clean, labels, let

#: What tells intake methods, documents and eligibility in free text.
INTAKE = {
    "call": (r"\bcall\b", r"\bphone\b"),
    "walk_in": (r"\bwalk[ -]?in\b",),
    "online": (r"\bonline\b", r"\bwebsite\b", r"\bweb site\b", r"\bwww\.", r"\bweb portal\b"),
    "appointment": (r"\bappointment\b", r"\bschedule\b"),
    "email": (r"\be-?mail\b",),
    "text": (r"\btext(?:ing)?\b", r"\bsms\b"),
    "mail": (r"(?<!e-)\bmail\b", r"\bpostal\b", r"\bfax\b"),
}
NO_DOCUMENTS = (r"\bnothing needed\b", r"\bnothing required\b", r"\bno documentation is required\b", r"\bno documents? (?:needed|required)\b", "^none$", "^n/a$")
UNCLEAR_DOCUMENTS = (r"\bvar(?:y|ies)\b", r"\bcall for\b", r"\bcall .*information\b", r"\bcall .*details\b", r"\bmay be requested\b", r"\bif applicable\b", r"\bif available\b", r"\bencouraged\b", r"\badditional documents?\b")
DOCUMENTS = {
    "photo_id": ("photo id", "identification"),
    "proof_of_income": ("proof of income", "pay stub", "income documentation"),
    "proof_of_address": ("proof of address", "current address", "residency"),
    "lease": ("lease",),
    "insurance_card": ("insurance card",),
    "social_security": ("social security",),
    "birth_certificate": ("birth certificate",),
    "utility_bill": ("utility bill",),
}
ELIGIBILITY = {
    "low_income": ("low income", "income eligible", "poverty", "financial need"),
    "resident": ("resident", "reside", "live in", "lives in"),
    "homeless": ("homeless", "unstably housed", "without housing"),
    "veteran": ("veteran", "military", "service member", "servicemember"),
    "senior": ("senior", "older adult", "elderly", "age 60", "60+", "55+"),
    "youth": ("youth", "child", "children", "teen", "student", "minor"),
    "family": ("family", "families", "parent", "guardian", "household"),
    "pregnant": ("pregnant", "pregnancy", "prenatal"),
    "disability": ("disability", "disabled", "developmental delay", "impairment"),
    "uninsured": ("uninsured", "no insurance", "underinsured"),
    "medicaid": ("medicaid",),
}
#: Raw subcategories by service category, and those that are dropped on purpose.
TAXONOMY = {
    "Community and Recreation": ("Arts and Culture", "Community Facilities/Centers", "Leisure Activities/Recreation"),
    "Disability and Rehabilitation": ("Rehabilitation/Habilitation Services",),
    "Disaster and Environmental Services": ("Disaster Services", "Environmental Protection and Improvement"),
    "Education and Youth Programs": ("Educational Institutions/Schools", "Educational Programs", "Educational Support Services", "Social Development and Enrichment"),
    "Employment and Job Training": ("Employment",),
    "Family and Caregiver Services": ("Individual and Family Support Services",),
    "Financial Assistance and Benefits": ("Money Management", "Public Assistance Programs", "Social Insurance Programs", "Temporary Financial Assistance"),
    "Food Assistance": ("Food",),
    "Health Care": ("Emergency Medical Care", "Health Screening/Diagnostic Services", "Inpatient Health Facilities", "Outpatient Health Facilities", "Public Health", "Specialty Medicine"),
    "Housing and Shelter": ("Housing/Shelter",),
    "Legal and Court Help": ("Courts", "Judicial Services", "Legal Services"),
    "Material Goods": ("Material Goods",),
    "Medical Support Services": ("Health Supportive Services", "Specialized Treatment and Prevention"),
    "Mental Health Care": ("Mental Health Assessment and Treatment", "Mental Health Care Facilities", "Mental Health Support Services", "Mutual Support"),
    "Pet and Animal Services": ("Domestic Animal Services",),
    "Pregnancy and Reproductive Health": ("Human Reproduction",),
    "Public Safety": ("Law Enforcement Agencies", "Law Enforcement Services", "Public Safety"),
    "Substance Use Services": ("Substance Use Disorder Services",),
    "Tax Help": ("Tax Organizations and Services",),
    "Transportation": ("Transportation",),
    "Utility Assistance": ("Utilities",),
}
DROPPED = (
    "Community Economic Development and Finance", "Community Groups and Government/Administrative Offices", "Community Planning and Public Works", "Consumer Assistance and Protection",
    "Consumer Regulation", "Criminal Correctional System", "Death Certification/Burial Arrangements", "Information Services", "Military Service", "Political Organization and Participation",
)


def intake_methods(c: Column) -> Column:
    return let(F.lower(clean(c)), lambda raw: labels([(k, any_match(raw, v)) for k, v in INTAKE.items()], "empty"))


def document_requirements(c: Column) -> Column:
    return let(F.lower(clean(c)), _documents)


def _documents(raw: Column) -> Column:
    stated = [("none", (raw != "") & any_match(raw, NO_DOCUMENTS)), ("varies", any_match(raw, UNCLEAR_DOCUMENTS))]
    return labels([*stated, *((k, any_of(raw, v)) for k, v in DOCUMENTS.items())], "none")


def eligibility_tags(c: Column) -> Column:
    return let(F.lower(clean(c)), lambda raw: labels([(k, any_of(raw, v)) for k, v in ELIGIBILITY.items()], "none"))


def taxonomy(spark: SparkSession) -> DataFrame:
    """(subcategory, category): the fixed dimension; dropped subcategories have a NULL category."""
    rows = [(sub, cat) for cat, subs in TAXONOMY.items() for sub in subs] + [(sub, None) for sub in DROPPED]
    return spark.createDataFrame(rows, "subcategory string, category string")


def service_categories(subcategories: Column) -> Column:
    """Categories of the known subcategories, in order, without repeats."""
    known = F.create_map(*(F.lit(x) for cat, subs in TAXONOMY.items() for sub in subs for x in (sub, cat)))
    return F.array_distinct(F.filter(F.transform(subcategories, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull()))


def unknown_subcategories(df: DataFrame, column: str = "subcategories") -> DataFrame:
    """Distinct raw subcategories that the taxonomy neither maps nor drops."""
    seen = df.select(F.explode(column).alias("subcategory")).distinct()
    return seen.join(taxonomy(df.sparkSession).select("subcategory"), "subcategory", "left_anti")


def validate_coverage(df: DataFrame, column: str = "subcategories") -> None:
    missing = [r[0] for r in unknown_subcategories(df, column).orderBy("subcategory").limit(100).collect()]
    if missing:
        raise ValueError(f"subcategories without a mapping: {missing}")


def documents_usable(c: Column, tags: Column | None = None) -> Column:
    """Whether a document text is blank, states that none is needed, or names one without being unclear."""
    raw = clean(c)
    tags = document_requirements(c) if tags is None else tags
    concrete = F.size(F.array_except(tags, F.array(*map(F.lit, ("empty", "none", "varies"))))) > 0
    return let(F.struct(raw.alias("raw"), concrete.alias("concrete")), lambda x: _usable(x["raw"], x["concrete"]))


def _usable(raw: Column, concrete: Column) -> Column:
    return F.when(raw == "", True).when(any_match(raw, NO_DOCUMENTS), True).when(any_match(raw, UNCLEAR_DOCUMENTS), False).otherwise(concrete)
