"""Column expressions (JVM built-ins only; all stay inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketlens.functions.fixed import *  # noqa: F401,F403 - the fixed values, re-exported
from basketlens.functions.fixed import (CONFIDENCE, DAY_NAMES, DAYS_BUCKETS, FREQUENCY_BINS, HASH_MODULUS,
                                        HASH_MULTIPLIER, HOUR_BUCKETS, JOURNEY, ORDER_GROUP_BINS, PEAK_DAYS,
                                        PEAK_HOURS, RECENCY_BANDS, SYNTHETIC_EPOCH, TIERS, UNKNOWN_PRODUCT,
                                        WEEKEND_DAYS)


def is_weekend(dow: Column) -> Column:
    return dow.isin(*WEEKEND_DAYS).cast("int")


def hour_bucket(hour: Column) -> Column:
    expr = None
    for hi, label in HOUR_BUCKETS:
        cond = (hour >= 0) & (hour <= hi) if expr is None else (hour <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def days_bucket(gap: Column) -> Column:
    expr = F.when((gap >= -1) & (gap <= 0), F.lit(DAYS_BUCKETS[0][1]))
    for hi, label in DAYS_BUCKETS[1:]:
        expr = expr.when(gap <= hi, F.lit(label))
    return expr.when(gap > DAYS_BUCKETS[-1][0], F.lit("long_time"))


def day_name(dow: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), (dow + 1).cast("int"))


def peak_hour(hour: Column) -> Column:
    return hour.between(*PEAK_HOURS)


def peak_day(dow: Column) -> Column:
    return dow.isin(*PEAK_DAYS)


def order_group(order_number: Column) -> Column:
    """(0,5] (5,10] (10,20] (20,100]; outside -> null (no otherwise)."""
    expr = None
    for lo, hi, label in ORDER_GROUP_BINS:
        cond = (order_number > lo) & (order_number <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def frequency_bin(n: Column) -> Column:
    """[1,5) [5,10) [10,20) [20,50) [50,100); >= 100 -> null."""
    expr = None
    for lo, hi, label in FREQUENCY_BINS:
        cond = (n >= lo) & (n < hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def customer_tier(n_orders: Column) -> Column:
    return F.when(n_orders <= TIERS[0][0], TIERS[0][1]).when(n_orders <= TIERS[1][0], TIERS[1][1]) \
        .otherwise("Heavy Users")


def journey_stage(max_order_number: Column) -> Column:
    expr = F.when(max_order_number == JOURNEY[0][0], JOURNEY[0][1])
    for bound, label in JOURNEY[1:]:
        expr = expr.when(max_order_number <= bound, label)
    return expr.otherwise("Loyal Customer")


def confidence_band(p: Column) -> Column:
    return F.when(p > CONFIDENCE[0][0], CONFIDENCE[0][1]).when(p > CONFIDENCE[1][0], CONFIDENCE[1][1]) \
        .otherwise("low")


def recency_band(days: Column) -> Column:
    expr = F.when(days <= RECENCY_BANDS[0][0], RECENCY_BANDS[0][1])
    for bound, label in RECENCY_BANDS[1:]:
        expr = expr.when(days <= bound, label)
    return expr.otherwise(">365")


def synthetic_order_date(order_id: Column) -> Column:
    return F.date_add(F.to_date(F.lit(SYNTHETIC_EPOCH)), (order_id % 365).cast("int"))


def clean_name(c: Column, default: str = UNKNOWN_PRODUCT) -> Column:
    return F.coalesce(F.trim(c), F.lit(default))


def title_case(c: Column) -> Column:
    """Strip + capitalise words (whitespace-delimited, like ``initcap``)."""
    return F.initcap(F.trim(c))


def key_hash(key: Column, seed: int) -> Column:
    """Deterministic 32-bit multiplicative hash ``((key + seed) * M) mod 2^32``
    of an integer key, identical in every SQL engine (integer arithmetic,
    no engine hash function).  M is split into 16-bit halves so no
    intermediate exceeds 2^49: safe for any 64-bit key under ANSI overflow
    checks."""
    k = F.pmod(key + F.lit(seed), F.lit(HASH_MODULUS))
    hi, lo = HASH_MULTIPLIER >> 16, HASH_MULTIPLIER & 0xFFFF
    return F.pmod(k * F.lit(lo) + F.pmod(k * F.lit(hi), F.lit(65536)) * F.lit(65536), F.lit(HASH_MODULUS))


def key_hash_sql(expr: str, seed: int) -> str:
    """The same hash as SQL text (for the DuckDB oracle)."""
    hi, lo = HASH_MULTIPLIER >> 16, HASH_MULTIPLIER & 0xFFFF
    k = f"(({expr}) + {seed}) % {HASH_MODULUS}"
    return f"(({k}) * {lo} + ((({k}) * {hi}) % 65536) * 65536) % {HASH_MODULUS}"


def unit_hash(key: Column, seed: int) -> Column:
    """``key_hash`` scaled to [0, 1)."""
    return key_hash(key, seed) / F.lit(float(HASH_MODULUS))


def safe_div(num: Column, den: Column) -> Column:
    """x / 0 -> null instead of an ANSI error."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def first_present(df_columns, names, default: str) -> Column:
    """The first of ``names`` that exists in the frame (coalesced in
    that order), else ``default``."""
    present = [F.col(n) for n in names if n in df_columns]
    return F.coalesce(*present, F.lit(default)) if present else F.lit(default)
