"""Token usage and equivalent cost.

Shuffles: one by (session, chunk) for the carry-forward model, one by session
for the per-session aggregate (map-side partial aggregation), one by group key.
The per-session result is tiny compared to ``messages``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.pricing import cost_units_sql, sum_units, units_to_usd
from lumenlog.functions.timefmt import day_string, iso_week_label, week_range
from lumenlog.operators.sequence import carry_forward, chunk_bits

TOKEN_COLS = ["input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens"]


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def priced_messages(messages: DataFrame, key: str = "session_id", prices=None, carry: bool = True) -> DataFrame:
    """Adds ``eff_model`` and ``cost_units`` (1e-10 USD) to every message.

    ``carry=True`` (A1): a usage record without a model is priced with the last
    model seen before it in the session (W2). ``carry=False`` (A12): own model
    only, missing -> fallback row of the price table.
    """
    m = messages.withColumn("_model_nz", _nonempty(F.col("model")))
    if carry:
        m = carry_forward(m, [key], "line_no", "_model_nz", "eff_model")
    else:
        m = m.withColumn("eff_model", F.col("_model_nz"))
    units = F.expr(f"CASE WHEN has_usage THEN {cost_units_sql('eff_model', *TOKEN_COLS, prices=prices)} END")
    return m.withColumn("cost_units", units).drop("_model_nz")


def session_usage(sessions: DataFrame, messages: DataFrame, key: str = "session_id", prices=None) -> DataFrame:
    """A1: per session, sums of the four counters, message count (user, assistant
    and system rows), last non-empty model, cost priced with carry-forward.
    Sessions without messages appear with zeros and a null model."""
    # one pass over narrow rows. Inside a chunk of lines a window carries the model; usage before a chunk's first model is
    # kept as token sums and priced once per chunk, when the model that comes in from earlier chunks is known
    is_a = F.col("msg_type") == "assistant"
    m = messages.select(key, F.col("line_no").alias("_ln"), F.shiftright(F.col("line_no").cast("bigint"), chunk_bits()).alias("_chunk"),
                        F.when(is_a, _nonempty(F.col("model"))).alias("_m"), _nonempty(F.col("model")).alias("_any"),
                        "has_usage", *TOKEN_COLS)
    inside = Window.partitionBy(key, "_chunk").orderBy("_ln").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("_eff", F.last("_m", ignorenulls=True).over(inside))
    early = F.col("has_usage") & F.col("_eff").isNull()
    known = F.expr(f"CASE WHEN has_usage AND _eff IS NOT NULL THEN {cost_units_sql('_eff', *TOKEN_COLS, prices=prices)} END")
    chunks = m.groupBy(key, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in TOKEN_COLS], sum_units(known).alias("_units"),
        *[F.sum(F.when(early, F.col(c))).alias(f"_early_{c}") for c in TOKEN_COLS],
        F.max_by("_m", F.when(F.col("_m").isNotNull(), F.col("_ln"))).alias("_last"),
        F.max_by("_any", F.when(F.col("_any").isNotNull(), F.col("_ln"))).alias("_last_any"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_in", F.last("_last", ignorenulls=True).over(before))
    rest = F.expr(cost_units_sql("_in", *[f"_early_{c}" for c in TOKEN_COLS], prices=prices))
    per = chunks.groupBy(key).agg(
        F.sum("_n").alias("msg_count"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in TOKEN_COLS],
        (F.coalesce(F.sum("_units"), F.lit(0)) + F.coalesce(sum_units(rest), F.lit(0))).cast("decimal(38,0)").alias("cost_units"),
        F.max_by("_last_any", F.when(F.col("_last_any").isNotNull(), F.col("_chunk"))).alias("model"),
    )
    out = sessions.join(per, key, "left")
    filled = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ["msg_count", *TOKEN_COLS]}
    filled["cost_units"] = F.coalesce(F.col("cost_units"), F.lit(0).cast("decimal(38,0)"))
    return out.withColumns(filled).withColumn("cost_usd", units_to_usd(F.col("cost_units")))


def group_label(by: str) -> Column:
    """A2 grouping key of a session_usage row."""
    if by == "model":
        return F.coalesce(F.col("model"), F.lit("unknown"))
    if by == "date":
        return day_string(F.col("modified_time"))
    if by == "week":
        return F.coalesce(iso_week_label(F.col("modified_time")), F.lit("unknown"))
    if by == "project":
        return F.col("project_name")
    raise ValueError(f"unknown grouping {by!r}; use project, model, date or week")


def _usage_aggs():
    return [
        F.count(F.lit(1)).cast("bigint").alias("sessions"),
        F.sum("msg_count").cast("bigint").alias("messages"),
        *[F.sum(c).cast("bigint").alias(c) for c in TOKEN_COLS],
        F.sum("cost_units").alias("cost_units"),
    ]


def _finish(df: DataFrame) -> DataFrame:
    return (df.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
              .withColumn("cost_usd", units_to_usd(F.col("cost_units"))))


def usage_by(su: DataFrame, by: str = "project") -> DataFrame:
    """A2: sessions, messages, token sums and cost per group."""
    return _finish(su.groupBy(group_label(by).alias("label")).agg(*_usage_aggs()))


def usage_totals(su: DataFrame) -> DataFrame:
    """A3: the grand total over all sessions (also those cut by top-n)."""
    return _finish(su.agg(*_usage_aggs()).withColumn("label", F.lit("TOTAL")))


def usage_rollup(su: DataFrame, by: str = "project") -> DataFrame:
    """A2 + A3 in one aggregation: per-group rows plus the TOTAL row (grouping id 1)."""
    g = su.withColumn("label", group_label(by)).rollup("label").agg(*_usage_aggs(), F.grouping_id().alias("gid"))
    return _finish(g.withColumn("label", F.when(F.col("gid") == 1, F.lit("TOTAL")).otherwise(F.col("label")))
                    .drop("gid"))


def top_groups(groups: DataFrame, n: int) -> DataFrame:
    """A4: first n groups by cost (descending), label as tie-break."""
    return groups.orderBy(F.desc("cost_units"), F.asc("label")).limit(n)


def usage_share(groups: DataFrame, subscription_usd: float = 100.0) -> DataFrame:
    """A5: share of total cost, fraction of the largest group, subscription multiple.

    Total and maximum are scalar subqueries over the groups.
    """
    total = groups.select(F.sum("cost_units")).scalar()
    mx = groups.select(F.max("cost_units")).scalar()
    return (groups
            .withColumn("share", F.when(total > 0, F.col("cost_units").cast("double") / total.cast("double"))
                        .otherwise(F.lit(0.0)))
            .withColumn("bar_fraction", F.when(mx > 0, F.col("cost_units").cast("double") / mx.cast("double"))
                        .otherwise(F.lit(0.0)))
            .withColumn("total_cost_usd", units_to_usd(total))
            .withColumn("subscription_multiple",
                        F.when(F.lit(subscription_usd) > 0, units_to_usd(total) / F.lit(float(subscription_usd)))
                        .otherwise(F.lit(0.0))))


def tier(model: Column) -> Column:
    """opus / sonnet / other by substring of the lower-cased model."""
    lm = F.lower(F.coalesce(model, F.lit("")))
    return F.when(F.contains(lm, F.lit("opus")), "opus").when(F.contains(lm, F.lit("sonnet")), "sonnet") \
        .otherwise("other")


_TIERS = ("opus", "sonnet", "other")


def _tier_aggs():
    out = []
    for t in _TIERS:
        is_t = F.col("tier") == t
        out += [F.sum(F.when(is_t, 1).otherwise(0)).cast("bigint").alias(f"{t}_sessions"),
                F.sum(F.when(is_t, F.col("output_tokens")).otherwise(0)).cast("bigint").alias(f"{t}_output"),
                F.coalesce(F.sum(F.when(is_t, F.col("cost_units"))), F.lit(0).cast("decimal(38,0)"))
                .alias(f"{t}_units")]
    return out


def _tier_finish(df: DataFrame) -> DataFrame:
    for t in _TIERS:
        df = df.withColumn(f"{t}_cost", units_to_usd(F.col(f"{t}_units")))
    df = (df.withColumn("total_sessions", F.col("opus_sessions") + F.col("sonnet_sessions") + F.col("other_sessions"))
            .withColumn("total_output", F.col("opus_output") + F.col("sonnet_output") + F.col("other_output"))
            .withColumn("total_units", F.col("opus_units") + F.col("sonnet_units") + F.col("other_units"))
            .withColumn("total_cost", units_to_usd(F.col("total_units"))))
    # true per-tier shares (Q13: no "100 - opus" derived value)
    shares = {}
    for t in _TIERS:
        shares[f"{t}_output_pct"] = F.when(F.col("total_output") != 0,
                                           F.col(f"{t}_output") / F.col("total_output") * 100).otherwise(F.lit(0.0))
        shares[f"{t}_cost_pct"] = F.when(F.col("total_units") != 0,
                                         F.col(f"{t}_cost") / F.col("total_cost") * 100).otherwise(F.lit(0.0))
    return df.withColumns(shares).drop(*[f"{t}_units" for t in _TIERS], "total_units")


def weekly_tiers(su: DataFrame) -> DataFrame:
    """Per ISO week of the file time, sessions/output/cost per model tier."""
    base = su.where(F.col("modified_time").isNotNull()).withColumn("tier", tier(F.col("model")))
    g = base.groupBy(iso_week_label(F.col("modified_time")).alias("week"),
                     week_range(F.col("modified_time")).alias("date_range")).agg(*_tier_aggs())
    return _tier_finish(g)


def weekly_total(su: DataFrame) -> DataFrame:
    """The TOTAL row of the weekly report."""
    base = su.where(F.col("modified_time").isNotNull()).withColumn("tier", tier(F.col("model")))
    g = base.agg(*_tier_aggs()).withColumn("week", F.lit("TOTAL")).withColumn("date_range", F.lit(""))
    return _tier_finish(g)


def session_cost_own_model(messages: DataFrame, key: str = "session_id", prices=None) -> DataFrame:
    """Cost with each assistant message's own model (missing -> fallback), no carry-forward."""
    a = messages.where(F.col("msg_type") == "assistant").select(key, "line_no", "model", "has_usage", *TOKEN_COLS)
    pm = priced_messages(a, key, prices, carry=False)
    return (pm.groupBy(key).agg(F.coalesce(sum_units(F.col("cost_units")), F.lit(0).cast("decimal(38,0)"))
                                .alias("cost_units"))
              .withColumn("cost_usd", units_to_usd(F.col("cost_units"))))


def models_used(messages: DataFrame, key: str = "session_id") -> DataFrame:
    """Sorted distinct non-empty models of assistant rows (bounded by the model count)."""
    a = messages.where((F.col("msg_type") == "assistant") & (F.col("model") != ""))
    return a.groupBy(key).agg(F.sort_array(F.collect_set("model")).alias("models"))


def overview(sessions: DataFrame) -> DataFrame:
    """Session count, bytes, distinct projects, first and last file date."""
    return sessions.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_sessions"),
        F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("total_size"),
        F.count_distinct("project_name").cast("bigint").alias("projects"),
        F.date_format(F.min("modified_time"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("modified_time"), "yyyy-MM-dd").alias("last_date"),
    )


def latest_session(sessions: DataFrame) -> DataFrame:
    """O3: the session with the newest file time (session_id breaks ties)."""
    return sessions.orderBy(F.desc("modified_time"), F.desc("session_id")).limit(1)


def find_session(sessions: DataFrame, prefix: str) -> DataFrame:
    """First non-agent session (discovery order) whose id starts with ``prefix`` (any case)."""
    return (sessions.where(~F.col("is_agent") & F.startswith(F.lower(F.col("session_id")), F.lit(prefix.lower())))
                    .orderBy("project_dir", "session_id").limit(1))
