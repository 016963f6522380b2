"""Daily roll-ups and the concept index.

"Input order" is the compile order (O4): ascending file time, given as a
sortable ``session_ord`` column on the compiled sessions. All list unions keep
first-seen order via per-value minima (partial aggregates); per-concept
session lists are kept as an edge table, with only the bounded head collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions.fixed_values import STATUS_GROWING_MIN, STATUS_MATURE_MIN, WEIGHT_VALUES
from lumenlog.functions.pricing import sum_units, units_to_usd
from lumenlog.functions.text import tag
from lumenlog.operators.sequence import first_n, ordered_distinct

LEVELS = ["strategy", "dev", "ops"]


def _exploded(compiled: DataFrame, col: str, out: str) -> DataFrame:
    return compiled.select("date", "session_ord", F.posexplode(col).alias("pos", out))


def merge_by_day(compiled: DataFrame, key_point_cap: int = 15) -> DataFrame:
    """One row per date (ascending) merging that day's compiled sessions."""
    base = compiled.groupBy("date").agg(
        F.count(F.lit(1)).cast("bigint").alias("session_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("session_ord", "session_id"))), lambda s: s["session_id"])
        .alias("session_ids"),
        F.sum("user_message_count").cast("bigint").alias("total_user_messages"),
        F.sum("assistant_message_count").cast("bigint").alias("total_assistant_messages"),
        sum_units(F.col("cost_units")).alias("cost_units"),
        F.max("weight_value").alias("weight_value"),
    )
    ents = ordered_distinct(_exploded(compiled, "entities", "entity"), ["date"], "entity",
                            ["session_ord", "pos"], "entities")
    kps = ordered_distinct(_exploded(compiled, "key_points", "point"), ["date"], "point",
                           ["session_ord", "pos"], "key_points", limit=key_point_cap)
    mods = compiled.select("date", F.explode("models").alias("m")).groupBy("date").agg(
        F.sort_array(F.collect_set("m")).alias("models"))
    fc = compiled.select("date", "session_ord", F.posexplode("file_changes").alias("pos", "fc")).select(
        "date", "session_ord", "pos", F.col("fc.path").alias("path"), F.col("fc.action").alias("action"))
    fcp = fc.groupBy("date", "path").agg(F.min(F.struct("session_ord", "pos")).alias("first"),
                                         F.max_by(F.col("action"), F.struct("session_ord", "pos")).alias("action"))
    fcl = fcp.groupBy("date").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("first", "path", "action"))),
        lambda s: F.struct(s["path"].alias("path"), s["action"].alias("action"))).alias("file_changes"))
    empty_s = F.array().cast("array<string>")
    out = base
    for part in (ents, kps, mods, fcl):
        out = out.join(part, "date", "left")
    wv = None
    for k, v in WEIGHT_VALUES.items():
        wv = F.when(F.col("weight_value") == v, F.lit(k)) if wv is None else wv.when(F.col("weight_value") == v, k)
    return out.select(
        "date", "session_count", "session_ids", "total_user_messages", "total_assistant_messages",
        "cost_units", units_to_usd(F.col("cost_units")).alias("total_cost"), wv.alias("weight"), "weight_value",
        F.coalesce("entities", empty_s).alias("entities"), F.coalesce("key_points", empty_s).alias("key_points"),
        F.coalesce("file_changes", F.array().cast("array<struct<path:string,action:string>>")).alias("file_changes"),
        F.transform(F.coalesce("entities", empty_s), lambda e: tag(e)).alias("tags"),
        F.coalesce("models", empty_s).alias("models"))


def concept_edges(compiled: DataFrame) -> DataFrame:
    """The entity-session relation (concept, session_id, date, session_ord)."""
    return compiled.select(F.explode("entities").alias("concept"), "session_id", "date", "session_ord")


def status(count_col) -> F.Column:
    return (F.when(count_col >= STATUS_MATURE_MIN, "mature").when(count_col >= STATUS_GROWING_MIN, "growing")
            .otherwise("stub"))


def concept_index(compiled: DataFrame, head: int = 20) -> DataFrame:
    """Per concept: mention count, first_seen (date of the first session in
    input order), status, the first ``head`` session ids and the distinct dates
    in first-seen order."""
    e = concept_edges(compiled)
    agg = e.groupBy("concept").agg(F.count(F.lit(1)).cast("bigint").alias("mention_count"),
                                   F.min_by(F.col("date"), F.col("session_ord")).alias("first_seen"))
    ids = first_n(e, ["concept"], ["session_ord"], head, "_rk").groupBy("concept").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("session_ord", "session_id"))), lambda s: s["session_id"])
        .alias("sessions_head"))
    dates = ordered_distinct(e, ["concept"], "date", ["session_ord"], "dates")
    return (agg.join(ids, "concept", "left").join(dates, "concept", "left")
               .withColumn("status", status(F.col("mention_count"))))


def _levels(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"level_ord int, {name} string")


def weight_distribution(compiled: DataFrame) -> DataFrame:
    """Sessions per weight level (all three shown, zeros included) with percent."""
    counts = compiled.groupBy("weight").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    total = compiled.select(F.count(F.lit(1)).cast("bigint")).scalar()
    lv = _levels(compiled.sparkSession, "weight", LEVELS)
    j = lv.join(counts, "weight", "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("bigint"))
    return j.withColumn("pct", F.when(total > 0, F.col("count") * 100 / total).otherwise(F.lit(0.0)))


def status_counts(concepts: DataFrame) -> DataFrame:
    """Concepts per status (mature, growing, stub; zeros included)."""
    counts = concepts.groupBy("status").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    lv = _levels(concepts.sparkSession, "status", ["mature", "growing", "stub"])
    return lv.join(counts, "status", "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("bigint"))
