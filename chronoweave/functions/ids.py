"""Scalar functions of identifiers and values: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values, on which results depend: the delimiter of versioned ids, the spellings of a missing value (exact, as they
# stand), what stands for one, the prefix of synonyms' nodes, and the pattern of a trailing number.
DELIMITER = "."
MISSING = [
    "na", "NA", "Na", "n/a", "N/A", "n.a.", "N.A.", "na.", "Na.", "NA.", "n-a", "N-A", "Na-", "NA-", "n_a", "N_A",
    "Na_", "NA_", "none", "None", "NONE", "non", "Non", "NON", "void", "Void", "VOID", "blank", "Blank", "BLANK",
    "omitted", "Omitted", "OMITTED", "NaN", "nan", "Nan", "NAN", "-", "_", "--", "__", "---", "___", "null", "Null",
    "NULL", "nil", "Nil", "NIL", "undefined", "Undefined", "UnDefined", "UNDEFINED", "unassigned", "Unassigned",
    "UnAssigned", "UNASSIGNED", "unspecified", "Unspecified", "UNSPECIFIED", "", " ", "  ", "   ", "    ", ".", "..",
    "...", "....", "?", "??", "???", "????", "missing", "Missing", "MISSING", "absent", "Absent", "ABSENT", "EMPTY",
    "empty", "Empty", "not available", "Not Available", "NOT AVAILABLE", "notavailable", "NotAvailable",
    "NOTAVAILABLE", "unknown", "Unknown", "UnKnown", "UNKNOWN", "not known", "Not Known", "NOT KNOWN", "notknown",
    "NotKnown", "NOTKNOWN", "undisclosed", "Undisclosed", "UNDISCLOSED", "not disclosed", "Not Disclosed",
    "NOT DISCLOSED", "notdisclosed", "NotDisclosed", "NOTDISCLOSED", "not applicable", "Not Applicable",
    "NOT APPLICABLE", "notapplicable", "NotApplicable", "NOTAPPLICABLE", "to be filled", "To Be Filled",
    "TO BE FILLED", "to be determined", "To Be Determined", "TO BE DETERMINED", "tbd", "TBD", "tba", "TBA", "n.k.",
    "N.K.", "n.k", "N.K", "n/k", "N/K", "n/k/a", "N/K/A", "n.d.", "N.D.", "n.d", "N.D", "n/d", "N/D", "n/d/a",
    "N/D/A", "n.a.p.", "N.A.P.", "n.a.p", "N.A.P", "n/a/p", "N/A/P", "n/a/p/a", "N/A/P/A", "xx", "XX", "x", "X",
    "xxx", "XXX", "xxxx", "XXXX", "N/M", "n/m", "N.M.", "n.m.", "n.m", "N.M", "N/C", "n/c", "N.C.", "n.c.", "n.c",
    "N.C", "n.s.", "N.S.", "n.s", "N.S", "n/s", "N/S", "n/s/a", "N/S/A",
]
PLACEHOLDER = "_PLACEHOLDER_NA_"
SYNONYM = "synonym_id::"
#: Nodes before an id's birth and after its end.
SENTINEL = r"\.(Void|Retired)$"
SUFFIX = r"^(.+)(_|-|\.)[0-9]+$"


def versioned(stable_id: Column, version: Column) -> Column:
    """id.version; the bare id where the version is null or 0."""
    return F.when(version.isNull() | (version.cast("string") == "0"), stable_id).otherwise(F.concat(stable_id, F.lit(DELIMITER), version.cast("string")))


def split_id(node: Column) -> tuple[Column, Column]:
    """(id, version) at the last delimiter; the version is null where there is none."""
    at = F.length(node) - F.instr(F.reverse(node), DELIMITER)
    has = F.instr(node, DELIMITER) > 0
    return F.when(has, F.substring(node, F.lit(1), at)).otherwise(node), F.when(has, F.substring(node, at + 2, F.length(node)))


def missing_to(value: Column, to: str | None = PLACEHOLDER) -> Column:
    """The value, or `to` where it is null or a spelling of a missing value, letter by letter."""
    return F.when(value.isNull() | value.isin(MISSING), F.lit(to)).otherwise(value)


def zero_to_null(score: Column) -> Column:
    return F.nullif(score, F.lit(0.0))


def is_numeric(value: Column) -> Column:
    return value.isNotNull() & value.try_cast("double").isNotNull()


def uppercase_count(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^A-Z]", ""))


def without_suffix(name: Column) -> Column:
    """What precedes a trailing [-_.]digits; null where there is none."""
    return F.nullif(F.regexp_extract(name, SUFFIX, 1), F.lit(""))


def separators_unified(name: Column) -> Column:
    return F.translate(name, "_", "-")


def variant_order(variant: Column) -> tuple[Column, Column]:
    """Sort keys of the order in which - and _ variants of a name are tried: fewest _ first, then those with _ earlier."""
    marks = F.regexp_replace(variant, "[^-_]", "")
    return F.length(F.replace(marks, F.lit("-"), F.lit(""))), F.translate(marks, "_-", "01")


def first_hit(candidates: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return candidates.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def with_delimiter(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value holds the delimiter of versioned ids, which no id may."""
    return df.filter(F.instr(column, DELIMITER) > 0)
