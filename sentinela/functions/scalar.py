"""Scalar building blocks, all as Spark ``Column`` expressions.

They stay inside whole-stage codegen: no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentinela import constants as K

__all__ = [
    "col_of", "parse_ts", "to_number", "iso_weekday", "weekday_name", "time_period",
    "is_weekend", "is_night", "cut", "cut_ordinal", "lookup", "round_half_up",
    "percent_text", "parse_percent", "anonymize_col", "month_key", "in_box", "box_pred",
    "victim_gender", "safe_ratio", "pct",
]


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(c, fmt: str | None = None) -> Column:
    """Text → timestamp; unparseable text → NULL (also in ANSI mode)."""
    c = col_of(c)
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def to_number(c) -> Column:
    """Coerce text/number to double; bad text → NULL."""
    return col_of(c).try_cast("double")


def iso_weekday(ts) -> Column:
    """ISO weekday 1 = Monday … 7 = Sunday (locale independent key, D6)."""
    return (F.weekday(col_of(ts)) + F.lit(1)).cast("int")


def weekday_name(ts, names: Sequence[str] = K.WEEKDAYS_LOWER) -> Column:
    """Weekday name in the given spelling, Monday first."""
    arr = F.array(*[F.lit(n) for n in names])
    return F.element_at(arr, iso_weekday(ts))


def time_period(hour) -> Column:
    """6–11 Manhã, 12–17 Tarde, 18–23 Noite, else Madrugada (also NULL)."""
    h = col_of(hour)
    expr = None
    for lo, hi, label in K.PERIODS:
        cond = (h >= lo) & (h < hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(K.PERIOD_ELSE)


def is_weekend(ts) -> Column:
    """P5: Saturday or Sunday."""
    return F.weekday(col_of(ts)) >= 5


def is_night(hour, start: int = K.NIGHT_FROM, end: int = K.NIGHT_TO) -> Column:
    """wrap-around night test (start ≤ h or h ≤ end)."""
    h = col_of(hour)
    return (h >= start) | (h <= end)


def cut(c, bins: Sequence[float], labels: Sequence[str]) -> Column:
    """P10: right-closed bins (lo, hi]; outside or NULL → NULL (like ``pd.cut``)."""
    x = col_of(c)
    expr = None
    for lo, hi, lab in zip(bins[:-1], bins[1:], labels):
        cond = (x > lo) & (x <= hi)
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr


def cut_ordinal(c, bins: Sequence[float]) -> Column:
    """Bin number 0.. for ordering the labels of ``cut``; NULL outside."""
    x = col_of(c)
    expr = None
    for i, (lo, hi) in enumerate(zip(bins[:-1], bins[1:])):
        cond = (x > lo) & (x <= hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def lookup(c, mapping: Mapping, default=None) -> Column:
    """Map a small fixed dictionary over a column (compiled into the plan)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    v = F.try_element_at(m, col_of(c))
    return v if default is None else F.coalesce(v, F.lit(default))


def round_half_up(c, digits: int = 1) -> Column:
    """Round half up with one IEEE formula (floor(x·10^d + 0.5) / 10^d).

    Used for non-negative shares and means; the formula is written the same
    way in the SQL oracle so both engines produce the same doubles.
    """
    p = float(10 ** digits)
    return F.floor(col_of(c) * F.lit(p) + F.lit(0.5)) / F.lit(p)


def percent_text(c, digits: int = 1) -> Column:
    """Number → '12.5%'."""
    return F.format_string(f"%.{digits}f%%", round_half_up(c, digits))


def parse_percent(c) -> Column:
    """P19: '12.5%' → 12.5."""
    return F.regexp_replace(F.trim(col_of(c)), "%+$", "").try_cast("double")


def anonymize_col(c, n: int = 8) -> Column:
    """P20: first ``n`` hex digits of MD5 of the value as text; NULL stays NULL."""
    x = col_of(c)
    return F.when(x.isNotNull(), F.substring(F.md5(x.cast("string")), 1, n))


def month_key(ts) -> Column:
    """Year-month period as 'yyyy-MM'."""
    return F.date_format(col_of(ts), "yyyy-MM")


def box_pred(lat, lon, lat_range=K.CITY_LAT, lon_range=K.CITY_LON) -> Column:
    """F5 as a filter predicate (NULL for NULL coordinates, which ``where``
    drops); kept free of wrappers so Parquet receives it as pushed filters."""
    la, lo = col_of(lat), col_of(lon)
    return la.between(F.lit(float(lat_range[0])), F.lit(float(lat_range[1]))) & \
        lo.between(F.lit(float(lon_range[0])), F.lit(float(lon_range[1])))


def in_box(lat, lon, lat_range=K.CITY_LAT, lon_range=K.CITY_LON) -> Column:
    """F5 as a flag: inclusive box test, NULL coordinates → false."""
    return F.coalesce(box_pred(lat, lon, lat_range, lon_range), F.lit(False))


def victim_gender(sex) -> Column:
    """Inverse of the suspect's sex; NULL → 'Feminino'."""
    return F.when(col_of(sex) == "Feminino", "Masculino").otherwise("Feminino")


def safe_ratio(num, den) -> Column:
    """num / den as double, 0 when den is 0 or NULL."""
    n, d = col_of(num), col_of(den)
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def pct(num, den, digits: int | None = None) -> Column:
    """100·num/den, 0 for an empty denominator, optionally rounded half up."""
    v = safe_ratio(num, den) * F.lit(100.0)
    return round_half_up(v, digits) if digits is not None else v
