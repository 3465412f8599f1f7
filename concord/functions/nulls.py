"""Absence predicates (F-01..F-05). They differ on purpose and are never merged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies of absence
NULL_SYNONYMS = ["", "nr", "n/r", "not reported", "not_found", "none", "n/a"]
ABSENCE_SENTINELS = ["NR", "N/A", "NA", "NOT_FOUND", "NOT FOUND", "NOT REPORTED"]
AUDIT_ABSENCE = ["NOT_FOUND", "Not discussed", "NR", "No comparison reported"]
UNPOPULATED = ["NOT_FOUND", "Not discussed", "NR", "No comparison reported", "Not assessable"]


def is_null_synonym(v: Column) -> Column:
    """F-01: null, or a null synonym in any case."""
    return v.isNull() | F.lower(F.trim(v)).isin(NULL_SYNONYMS)


def is_absence_claim(v: Column) -> Column:
    """F-02: null, blank or an absence sentinel, trimmed and upper-cased."""
    t = F.upper(F.trim(v))
    return v.isNull() | (t == "") | t.isin(ABSENCE_SENTINELS)


def is_audit_absence(v: Column) -> Column:
    """F-03: exact and case-sensitive."""
    return F.coalesce(v.isin(AUDIT_ABSENCE), F.lit(False))


def is_populated(v: Column) -> Column:
    """A-38 / A-39: neither null, blank nor an absence value, trimmed and case-sensitive."""
    t = F.trim(v)
    return v.isNotNull() & (t != "") & ~t.isin(UNPOPULATED)


def human_value(v: Column) -> Column:
    """F-04: blank or NR becomes null."""
    t = F.trim(v)
    return F.when((t != "") & (F.upper(t) != "NR"), t)


def csv_value(v: Column) -> Column:
    """F-05: blank, none or null becomes null."""
    t = F.trim(v)
    return F.when(~F.lower(t).isin("", "none", "null"), t)
