"""Cell cleaning and scalar extraction as native column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv

BLANKS = " \t\n\r\f\x0b"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def nullif_blank(c: Column) -> Column:
    return F.when(c != "", c)


def to_number(c: Column) -> Column:
    """Plain decimal text to double, anything else (also inf and nan) to NULL."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def clean_number_cell(c: Column) -> Column:
    """First line of a report cell, up to the first hyphen, as a number.

    A leading minus therefore gives NULL: report cells write '762.75 -'.
    """
    first_line = F.split_part(strip(F.replace(c, F.lit(","))), F.lit("\n"), F.lit(1))
    return to_number(strip(F.split_part(first_line, F.lit("-"), F.lit(1))))


def clean_number_compact(c: Column) -> Column:
    """As ``clean_number_cell``, but blanks go first and the hyphen cut precedes the line cut."""
    squeezed = strip(F.replace(F.replace(c, F.lit(",")), F.lit(" ")))
    before_dash = strip(F.split_part(squeezed, F.lit("-"), F.lit(1)))
    return to_number(strip(F.split_part(before_dash, F.lit("\n"), F.lit(1))))


def clean_number_na(c: Column) -> Column:
    """First line as a number; the usual 'not available' marks are NULL; no hyphen cut."""
    first_line = strip(F.split_part(strip(F.replace(c, F.lit(","))), F.lit("\n"), F.lit(1)))
    return F.when(~F.upper(first_line).isin(*fv.MISSING_NUMBER_MARKS), to_number(first_line))


def clean_number_token(c: Column) -> Column:
    """First blank-separated token, up to its first hyphen, as a number."""
    token = F.regexp_extract(F.replace(c, F.lit(",")), r"^\s*(\S+)", 1)
    return to_number(F.split_part(token, F.lit("-"), F.lit(1)))


def clean_number_default(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(clean_number_token(c), F.lit(float(default)))


def split_original_revised(c: Column) -> Column:
    """Two-line cost cell: struct(original, revised); no second line means no revision."""
    lines = F.split(F.replace(c, F.lit(",")), "\n")
    return F.struct(
        clean_number_cell(F.get(lines, F.lit(0))).alias("original"),
        clean_number_cell(F.get(lines, F.lit(1))).alias("revised"),
    )


def month_index(year: Column, month: Column) -> Column:
    return year * 12 + month


def parse_month_year(c: Column) -> Column:
    """'MM/YYYY', 'MM-YYYY' or an inner '(Mon YYYY)': struct(year, month, month_index), else NULL."""
    line = strip(F.split_part(F.btrim(strip(c), F.lit("(){}")), F.lit("\n"), F.lit(1)))
    numeric = r"([0-9]{1,2})[/-]([0-9]{4})"
    named = r"(?i)\((" + "|".join(fv.MONTHS) + r")[a-z]*[-\s/]([0-9]{4})\)"
    name = F.lower(F.regexp_extract(line, named, 1))
    named_month = F.array_position(F.array(*[F.lit(m) for m in fv.MONTHS]), name).cast("int")
    year = F.when(line.rlike(numeric), F.regexp_extract(line, numeric, 2)).when(
        line.rlike(named), F.regexp_extract(line, named, 2)
    )
    month = F.when(line.rlike(numeric), F.regexp_extract(line, numeric, 1).try_cast("int")).when(
        line.rlike(named), named_month
    )
    year = year.try_cast("int")
    return F.when(
        year.isNotNull(),
        F.struct(year.alias("year"), month.alias("month"), month_index(year, month).alias("month_index")),
    )


def parse_year_token(c: Column) -> Column:
    """Year of the first blank-separated token with one slash and four characters after it."""
    found = F.regexp_extract(F.replace(c, F.lit("\n"), F.lit(" ")), r"(?:^|\s)[^/\s]*/([^/\s]{4})(?:\s|$)", 1)
    return F.when(found.rlike("^[0-9]{4}$"), found.try_cast("int"))


def bracket_date_fields(c: Column) -> Column:
    """'original (revised) {anticipated}' dates: struct of three month-year structs."""
    first = F.regexp_extract(c, r"([0-9]{1,2}[/-][0-9]{4}|\([A-Z][a-z]+[-\s/][0-9]{4}\))", 1)
    return F.struct(
        parse_month_year(nullif_blank(first)).alias("original"),
        parse_month_year(nullif_blank(F.regexp_extract(c, r"\(([^)]+)\)", 1))).alias("revised"),
        parse_month_year(nullif_blank(F.regexp_extract(c, r"\{([^}]+)\}", 1))).alias("anticipated"),
    )


def bracket_cost_fields(c: Column) -> Column:
    """'original (revised) {anticipated}' costs: struct of three numbers."""
    return F.struct(
        clean_number_na(F.regexp_extract(c, r"^\s*([0-9,]+\.?[0-9]*)", 1)).alias("original"),
        clean_number_na(F.regexp_extract(c, r"\(([^)]+)\)", 1)).alias("revised"),
        clean_number_na(F.regexp_extract(c, r"\{([^}]+)\}", 1)).alias("anticipated"),
    )


def parse_int_range(c: Column) -> Column:
    """'a - b' with optional signs: struct(low, high)."""
    line = F.replace(c, F.lit("\n"), F.lit(" "))
    pattern = r"(-?[0-9]+)\s*-\s*(-?[0-9]+)"
    return F.struct(
        F.regexp_extract(line, pattern, 1).try_cast("int").alias("low"),
        F.regexp_extract(line, pattern, 2).try_cast("int").alias("high"),
    )


def norm_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def norm_label(c: Column) -> Column:
    return F.rtrim(F.upper(strip(F.regexp_replace(c, r"\s+", " "))), F.lit(":"))


def snap_label(c: Column, known: Sequence[str] = fv.KNOWN_SECTORS) -> Column:
    """Map a fragmented label to the canonical list.

    A known label fits by containment either way (ignoring blanks), by equal
    leading words, or by at least two equal trailing words. Exact fits win, then
    the longest label, then alphabetical order; a label that fits nothing stays.
    """
    v = norm_label(c)
    flat = F.replace(v, F.lit(" "))
    table = F.array(
        *[
            F.struct(F.lit(-len(k)).alias("size"), F.lit(k).alias("label"), F.lit(k.replace(" ", "")).alias("flat"))
            for k in known
        ]
    )

    def fits(k: Column) -> Column:
        padded = F.concat(F.lit(" "), k.getField("label"), F.lit(" "))
        return (
            F.contains(k.getField("flat"), flat)
            | F.contains(flat, k.getField("flat"))
            | F.startswith(padded, F.concat(F.lit(" "), v, F.lit(" ")))
            | (F.contains(v, F.lit(" ")) & F.endswith(padded, F.concat(F.lit(" "), v, F.lit(" "))))
        )

    ranked = F.array_sort(
        F.transform(
            F.filter(table, fits),
            lambda k: F.struct((k.getField("label") != v).alias("inexact"), k.getField("size"), k.getField("label")),
        )
    )
    return F.when(v == "", c).otherwise(F.coalesce(F.get(ranked, F.lit(0)).getField("label"), c))


def alias_label(c: Column, aliases: Mapping[str, str] = fv.TRUNCATED_STATES) -> Column:
    """Truncated label to its canonical form (upper case, one line)."""
    label = F.upper(strip(F.replace(c, F.lit("\n"), F.lit(" "))))
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, label), label)


def first_per_label(df: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """First row per label in ``order``; a map-side max_by, so no window over a hot label."""
    rest = [c for c in df.columns if c != label]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(label).agg(first.alias("r")).select(label, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)


def extract_agency(name: Column) -> Column:
    """Implementing agency from the ']AGENCY,STATE' tail of a project name, upper case."""
    return nullif_blank(F.upper(strip(F.regexp_extract(name, fv.AGENCY_PATTERN, 1))))


def extract_base_name(name: Column) -> Column:
    """Upper-case text before the first '[' or '('; NULL under four characters."""
    base = F.upper(strip(F.regexp_extract(name, r"^([^\[(]*)", 1)))
    return F.when(F.length(base) >= 4, base)
