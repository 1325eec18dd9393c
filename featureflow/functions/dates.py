"""Free-text dates → year intervals (X11), by patterns and arithmetic inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featureflow.functions.hashing import _col

ERA = r"(b\.?\s?c\.?(?:\s?e\.?)?|a\.?\s?d\.?|c\.?\s?e\.?)?"
PART = r"(early|mid|late)?[\s-]*"
NTH = r"(\d{1,2})(?:st|nd|rd|th)"
CENTURY_PAIR = PART + NTH + r"(?:\s+century)?\s*" + ERA + r"\s*-\s*" + PART + NTH + r"\s+centur(?:y|ies)\s*" + ERA
CENTURY = PART + NTH + r"\s+century\s*" + ERA
YEAR_RANGE = r"\b(\d{1,4})\s*" + ERA + r"\s*-\s*(\d{1,4})\b\s*" + ERA
DECADE = r"\b(\d{2,3}0)s\b"
YEAR = r"\b(\d{1,4})\b\s*" + ERA

CONVENTIONS = ("ordinal", "zero_based")


def clean_date(c) -> Column:
    """Lower case, one kind of dash, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[–—−]", "-"), r"\s+", " "))


def _int(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def _is_bce(era: Column) -> Column:
    return era.startswith("b")


def _groups(t: Column, pattern: str, n: int) -> Column:
    """The n groups of the first match as an array, NULL without a match."""
    picked = F.regexp_replace(t, f"(?s)^.*?{pattern}.*$", "|".join(f"${i}" for i in range(1, n + 1)))
    return F.when(t.rlike(pattern), F.split(picked, r"\|", -1))


def date_groups(c) -> Column:
    """Array of match groups: pair of centuries, century, year range, decade, year."""
    t = clean_date(c)
    return F.array(
        _groups(t, CENTURY_PAIR, 6), _groups(t, CENTURY, 3), _groups(t, YEAR_RANGE, 4), _groups(t, DECADE, 1),
        _groups(t, YEAR, 2),
    )


def _century_ends(n: Column, part: Column, bce: Column, convention: str) -> tuple[Column, Column]:
    """First and last year of the (part of a) century, in time order."""
    shift = 1 if convention == "ordinal" else 0
    lo = F.when(part == "mid", 33).when(part == "late", 66).otherwise(0)
    hi = F.when(part == "early", 32).when(part == "mid", 65).otherwise(99)
    ce = (n - 1) * 100 + shift
    bc = n * 100 - 1 + shift
    return F.when(bce, bc - lo).otherwise(ce + lo), F.when(bce, bc - hi).otherwise(ce + hi)


def interval_of(g: Column, century: str) -> Column:
    """Interval struct from the match groups."""
    if century not in CONVENTIONS:
        raise ValueError(f"century must be one of {CONVENTIONS}")
    pair, cent, span, decade, year = g[0], g[1], g[2], g[3], g[4]
    p_e2 = _is_bce(pair[5])
    p_e1 = F.when(pair[2] == "", p_e2).otherwise(_is_bce(pair[2]))
    p_start, _ = _century_ends(_int(pair[1]), pair[0], p_e1, century)
    _, p_end = _century_ends(_int(pair[4]), pair[3], p_e2, century)
    c_e = _is_bce(cent[2])
    c_start, c_end = _century_ends(_int(cent[1]), cent[0], c_e, century)
    # a short second year takes the leading digits of the first
    r_a, r_b = _int(span[0]), _int(span[2])
    r_e2 = _is_bce(span[3])
    r_e1 = F.when(span[1] == "", r_e2).otherwise(_is_bce(span[1]))
    missing = F.length(span[0]) - F.length(span[2])
    lead = F.when((missing > 0) & ~r_e1 & ~r_e2, F.concat(F.substr(span[0], F.lit(1), missing), span[2]))
    r_end = F.coalesce(lead.cast("int"), r_b)
    d_a, y_a = _int(decade[0]), _int(year[0])

    def interval(a, a_bce, b, b_bce) -> Column:
        return F.struct(
            a.cast("int").alias("year_start"), a_bce.cast("boolean").alias("start_is_bce"),
            b.cast("int").alias("year_end"), b_bce.cast("boolean").alias("end_is_bce"),
        )

    none = F.lit(None)
    return (
        F.when(pair.isNotNull(), interval(p_start, p_e1, p_end, p_e2))
        .when(cent.isNotNull(), interval(c_start, c_e, c_end, c_e))
        .when(span.isNotNull(), interval(r_a, r_e1, r_end, r_e2))
        .when(decade.isNotNull(), interval(d_a, F.lit(False), d_a + 9, F.lit(False)))
        .when(year.isNotNull(), interval(y_a, _is_bce(year[1]), none, none))
        .otherwise(interval(none, none, none, none))
    )


def parse_date_interval(c, century: str = "ordinal") -> Column:
    """Struct (year_start, start_is_bce, year_end, end_is_bce); all NULL when nothing is readable.

    `ordinal` counts the 5th century as 401-500, `zero_based` as 400-499. A part
    (early, mid, late) is a third of the century. A range with one era mark at its end
    takes that era for both ends.
    """
    return F.transform(F.array(date_groups(c)), lambda g: interval_of(g, century))[0]


def with_date_interval(df: DataFrame, c: str, cols: dict[str, str], century: str = "ordinal") -> DataFrame:
    """The same as columns, matched once and computed in generated code."""
    parsed = df.withColumn("_groups", date_groups(c)).withColumn("_date", interval_of(F.col("_groups"), century))
    return parsed.withColumns({n: F.col(f"_date.{f}") for f, n in cols.items()}).drop("_groups", "_date")
