"""Column expressions that reproduce pandas null, rounding and parsing rules.

All of these are built-in Spark expressions, so they stay inside
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Texts that the CSV reader of the original tool reads as
# missing (pandas ``read_csv`` default NA tokens).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

DATE_FORMATS = ["yyyy-MM-dd", "M/d/yyyy", "yyyy/MM/dd", "d-MMM-yyyy", "yyyy-MM-dd HH:mm:ss"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: str | Column) -> Column:
    """Trimmed text, NULL for the reader's missing-value tokens."""
    s = F.trim(col(c).cast("string"))
    return F.when(s.isin(NULL_TOKENS), F.lit(None).cast("string")).otherwise(s)


def to_double(c: str | Column) -> Column:
    """Number or NULL; never NaN (N19, 1.2)."""
    v = clean_text(c).try_cast("double")
    return F.nanvl(v, F.lit(None).cast("double"))


def to_long(c: str | Column) -> Column:
    """Integral identifier or NULL.  '12.0' -> 12; '12.5' and text -> NULL.

    Integer text is cast as it is, so ids above 2^53 stay apart; only other
    forms go through a double.
    """
    s = clean_text(c)
    v = to_double(c)
    return F.coalesce(F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint")), F.when(v == F.floor(v), v.try_cast("bigint")))


_SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: (\d{1,2}):(\d{2})(?::(\d{2}))?(?: ([AaPp])[Mm])?)?$"


def parse_timestamp(c: str | Column) -> Column:
    """Crawler time stamp -> timestamp_ntz; U+202F becomes a space; bad -> NULL.

    ISO forms are cast to timestamp_ntz directly; m/d/y and d/m/y forms are
    rewritten as ISO text first.  No step passes through the session's time
    zone, so a local time that a clock change skips keeps its value.
    """
    s = F.replace(clean_text(c), F.lit("\u202f"), F.lit(" "))
    first, second, year, hour, minute, sec, half = (F.regexp_extract(s, _SLASHED, i) for i in range(1, 8))
    clock = F.coalesce(hour.try_cast("int"), F.lit(0))
    clock = F.when(half == "", clock).when(clock.between(1, 12), clock % 12 + F.when(F.lower(half) == "p", 12).otherwise(0))
    rest = F.concat_ws(":", F.lpad(clock.cast("string"), 2, "0"), F.when(minute == "", "00").otherwise(minute), F.when(sec == "", "00").otherwise(sec))

    def iso(month: Column, day: Column) -> Column:
        text = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "), rest)
        return F.when(s.rlike(_SLASHED) & clock.isNotNull(), text.try_cast("timestamp_ntz"))

    day_first = F.when((hour != "") & (sec == "") & (half == ""), iso(second, first))
    return F.coalesce(s.try_cast("timestamp_ntz"), iso(first, second), day_first)


def parse_date(c: str | Column, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """Date text (or a time stamp text) -> date; bad -> NULL (normalised day)."""
    s = clean_text(c)
    tried = [F.to_date(F.try_to_timestamp(s, F.lit(fmt))) for fmt in formats]
    return F.coalesce(*tried, F.to_date(s.try_cast("timestamp_ntz")), s.try_cast("date"))


def sum0(c: str | Column) -> Column:
    """pandas ``sum``: all-null group -> 0."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def min_strict(a: str | Column, b: str | Column) -> Column:
    """numpy ``minimum``: NULL if either side is NULL."""
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def ratio_if_positive(n: str | Column, d: str | Column) -> Column:
    """``n / d`` where ``d > 0`` else NULL."""
    n, d = col(n), col(d)
    return F.when(d > 0, n / d)


def guarded_div(n: str | Column, d: str | Column) -> Column:
    """Unguarded pandas division: NULL instead of an ANSI error or inf."""
    n, d = col(n), col(d)
    return F.when(d != 0, n / d)


def rint2(c: str | Column) -> Column:
    """pandas ``.round(2)``: half-even on the scaled double."""
    return F.rint(col(c) * 100) / 100


def rint1(c: str | Column) -> Column:
    return F.rint(col(c) * 10) / 10


def half_up_int(c: str | Column) -> Column:
    """``floor(x + 0.5)`` display rounding of counts."""
    return F.floor(col(c) + 0.5)


def flag(cond: Column) -> Column:
    """A stored / negated / OR-ed predicate: NULL comparison counts as False."""
    return F.coalesce(cond, F.lit(False))


def clip_floor0(c: str | Column) -> Column:
    """``clip(lower=0)`` that keeps NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def clip01(c: str | Column) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def normalise_status(c: str | Column) -> Column:
    """Partner status text: null/'nan'/'null'/'' -> 'Unknown'; trim, lower, title (PRJ4).

    ``initcap`` upper-cases only after spaces, where pandas' ``title`` also
    does after '-' and '_' (N17); every status that carries a score has
    neither character.
    """
    s = F.lower(F.trim(col(c).cast("string")))
    s = F.when(s.isNull() | s.isin("nan", "null", ""), F.lit("unknown")).otherwise(s)
    return F.initcap(s)


def demand_status(c: str | Column) -> Column:
    """Crawler ``check_status``: lower/trim, NULL -> 'unknown'."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))), F.lit("unknown"))


def round_doubles(df, digits: int = 9):
    """Round every double column (comparison hygiene for float sums)."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def pct_signal(pct: str | Column, missing_label: str | None = None) -> Column:
    """Change-percentage thresholds shared by every signal."""
    p = col(pct)
    chain = F.when(p >= 0.25, "Critical surge").when(p >= 0.10, "High increase").when(
        p <= -0.10, "Declining"
    )
    if missing_label is not None:
        return F.when(p.isNull(), missing_label).otherwise(chain.otherwise("Stable"))
    return chain.otherwise("Stable")


def _dtype(df, name: str) -> str:
    return df.schema[name].dataType.typeName()


def as_date(df, name: str) -> Column:
    """``name`` as a date: typed dates pass through, time stamps are truncated, text is parsed."""
    t, c = _dtype(df, name), F.col(f"`{name}`")
    if t == "date":
        return c
    if t in ("timestamp", "timestamp_ntz"):
        return F.to_date(c)
    return parse_date(c)


def as_timestamp(df, name: str) -> Column:
    t, c = _dtype(df, name), F.col(f"`{name}`")
    if t == "timestamp_ntz":
        return c
    if t in ("timestamp", "date"):
        return c.cast("timestamp_ntz")
    return parse_timestamp(c)


def as_long(df, name: str) -> Column:
    """Integral id: integer types pass through; fractional or text values are checked."""
    t, c = _dtype(df, name), F.col(f"`{name}`")
    if t in ("long", "integer", "short", "byte"):
        return c.cast("bigint")
    return to_long(c)


def as_double(df, name: str) -> Column:
    t, c = _dtype(df, name), F.col(f"`{name}`")
    if t in ("double", "float", "long", "integer", "short", "byte", "decimal"):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    return to_double(c)
