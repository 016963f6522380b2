"""Price lookup (J2) and cost (F1) as pure Column expressions.

The price table is a bounded parameter (a handful of rows), so the lookup is
compiled into one CASE expression: no join, no shuffle, whole-stage codegen.
Rates are held as integers in units of 1e-4 USD per million tokens, so a
token count times a rate is an exact integer in units of 1e-10 USD; sums stay
exact (DECIMAL(38,0)) and are divided once at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlog.functions.fixed_values import FALLBACK_MODEL, PRICE_TABLE

USD_UNITS = 10_000_000_000  # 1e10 cost units per USD
RATE_SCALE = 10_000         # rate units per USD/MTok


def rate_units(usd_per_mtok: float) -> int:
    return int(round(usd_per_mtok * RATE_SCALE))


def _table(prices):
    prices = list(prices or PRICE_TABLE)
    return [(k, *[rate_units(r) for r in rates]) for k, *rates in prices]


def price_index(model: Column, prices=None, fallback: str = FALLBACK_MODEL) -> Column:
    """1-based row of the price table that applies to ``model``.

    null/empty -> fallback; exact key; else the first row (table order) whose key
    is contained in lower(model) or contains lower(model); else fallback.
    """
    table = _table(prices)
    keys = [t[0] for t in table]
    fb = keys.index(fallback) + 1 if fallback in keys else 1
    m = model
    lm = F.lower(m)
    expr = F.when(m.isNull() | (m == F.lit("")), F.lit(fb))
    for i, k in enumerate(keys, 1):
        expr = expr.when(m == F.lit(k), F.lit(i))
    for i, k in enumerate(keys, 1):
        expr = expr.when(F.contains(lm, F.lit(k)) | F.contains(F.lit(k), lm), F.lit(i))
    return expr.otherwise(F.lit(fb))


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def price_index_sql(m: str, prices=None, fallback: str = FALLBACK_MODEL) -> str:
    """``price_index`` as a SQL expression over the SQL expression ``m``."""
    keys = [t[0] for t in _table(prices)]
    fb = keys.index(fallback) + 1 if fallback in keys else 1
    parts = [f"WHEN {m} IS NULL OR {m} = '' THEN {fb}"]
    parts += [f"WHEN {m} = {_lit(k)} THEN {i}" for i, k in enumerate(keys, 1)]
    parts += [f"WHEN contains(lower({m}), {_lit(k)}) OR contains({_lit(k)}, lower({m})) THEN {i}" for i, k in enumerate(keys, 1)]
    return "CASE " + " ".join(parts) + f" ELSE {fb} END"


def cost_units_sql(m: str, i: str, o: str, cw: str, cr: str, prices=None) -> str:
    """F1 in 1e-10 USD as one SQL expression: rates picked by the price index."""
    table = _table(prices)
    idx = price_index_sql(m, prices)

    def rate(j):
        return "element_at(array(" + ", ".join(f"CAST({t[j]} AS BIGINT)" for t in table) + f"), {idx})"
    return (f"CAST(coalesce({i}, 0) * {rate(1)} + coalesce({o}, 0) * {rate(2)} "
            f"+ coalesce({cw}, 0) * {rate(3)} + coalesce({cr}, 0) * {rate(4)} AS BIGINT)")


def price_rates(model: Column, prices=None, fallback: str = FALLBACK_MODEL) -> Column:
    """Struct(input, output, cache_write, cache_read) of integer rate units."""
    table = _table(prices)
    arr = F.array(*[
        F.struct(F.lit(t[0]).alias("model_key"), F.lit(t[1]).cast("bigint").alias("r_in"),
                 F.lit(t[2]).cast("bigint").alias("r_out"), F.lit(t[3]).cast("bigint").alias("r_cw"),
                 F.lit(t[4]).cast("bigint").alias("r_cr"))
        for t in table
    ])
    return F.element_at(arr, price_index(model, prices, fallback))


def cost_units(model: Column, input_tokens: Column, output_tokens: Column,
               cache_write_tokens: Column, cache_read_tokens: Column, prices=None) -> Column:
    """Exact cost of one usage record in 1e-10 USD (BIGINT)."""
    r = price_rates(model, prices)
    return (F.coalesce(input_tokens, F.lit(0)) * r["r_in"]
            + F.coalesce(output_tokens, F.lit(0)) * r["r_out"]
            + F.coalesce(cache_write_tokens, F.lit(0)) * r["r_cw"]
            + F.coalesce(cache_read_tokens, F.lit(0)) * r["r_cr"]).cast("bigint")


def sum_units(units: Column) -> Column:
    """Overflow-safe exact sum of cost units."""
    return F.sum(units.cast("decimal(38,0)"))


def usd_text(units: Column, decimals: int) -> Column:
    """Exact cost units (1e-10 USD, not negative) as 'd.dd' with ``decimals`` places, rounded half-even.
    Decimal arithmetic only; every quotient is an exact integer, so nothing is rounded twice."""
    def whole(x, k):  # x div 10^k
        unit = F.lit(10 ** k).cast("decimal(20,0)")
        return ((x - x % unit) / unit).cast("decimal(38,0)")
    drop = 10 - decimals
    u, half = units.cast("decimal(38,0)"), F.lit(5 * 10 ** (drop - 1)).cast("decimal(20,0)")
    q, r = whole(u, drop), u % F.lit(10 ** drop).cast("decimal(20,0)")
    q = F.when((r > half) | ((r == half) & (q % 2 == 1)), q + 1).otherwise(q).cast("decimal(38,0)")
    return F.concat(whole(q, decimals).cast("string"), F.lit("."),
                    F.lpad((q % F.lit(10 ** decimals).cast("decimal(20,0)")).cast("string"), decimals, "0"))


def units_to_usd(units: Column) -> Column:
    return F.coalesce(units, F.lit(0)).cast("double") / F.lit(float(USD_UNITS))


def compute_cost_usd(model: Column, i: Column, o: Column, cw: Column, cr: Column, prices=None) -> Column:
    """F1 for a single record, in USD (DOUBLE)."""
    return units_to_usd(cost_units(model, i, o, cw, cr, prices))

