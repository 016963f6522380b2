"""One call per report of the original command set, composed from the operators.

Each returns DataFrames (nothing is collected); ``messages``/``sessions`` are the
canonical tables (``sources.jsonl.load_session_logs`` or a binding), ``key`` is
the session key (``file_path`` for ingested logs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.operators import focus as FO
from lumenlog.operators import search as S
from lumenlog.operators import sessions as SS
from lumenlog.operators import usage as U
from lumenlog.sources.jsonl import filter_project, materialize


def stats_report(sessions: DataFrame, messages: DataFrame, by: str = "project", top_n: int | None = 10,
                 subscription_usd: float = 100.0, key: str = "session_id") -> DataFrame:
    """Usage by group (top n by cost) with share / bar fraction / subscription
    multiple over ALL groups, followed by the TOTAL row (``is_total``)."""
    su = U.session_usage(sessions, messages, key)
    groups = U.usage_share(U.usage_by(su, by), subscription_usd)
    top = U.top_groups(groups, top_n) if top_n else groups
    total = U.usage_totals(su).withColumn("share", F.lit(1.0)).withColumn("bar_fraction", F.lit(None).cast("double"))
    total = total.withColumn("total_cost_usd", F.col("cost_usd")).withColumn(
        "subscription_multiple", F.when(F.lit(subscription_usd) > 0, F.col("cost_usd") / F.lit(float(subscription_usd)))
        .otherwise(F.lit(0.0)))
    cols = ["label", "sessions", "messages", *U.TOKEN_COLS, "total_tokens", "cost_usd", "share", "bar_fraction",
            "total_cost_usd", "subscription_multiple"]
    return (top.select(*cols).withColumn("is_total", F.lit(False))
               .unionByName(total.select(*cols).withColumn("is_total", F.lit(True))))


def weekly_report(sessions: DataFrame, messages: DataFrame, key: str = "session_id") -> DataFrame:
    """Per ISO week opus / sonnet / other sessions, output and cost, then the TOTAL row."""
    su = U.session_usage(sessions, messages, key)
    return U.weekly_tiers(su).unionByName(U.weekly_total(su))


def focus_reports(sessions: DataFrame, messages: DataFrame, as_of: str, hours: int = 24, top_n: int = 20,
                  user_only: bool = True, key: str = "session_id", **stops) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recent top terms, baseline top terms, spikes) -- the three focus tables."""
    counts = materialize(FO.focus_counts(sessions, messages, as_of, hours, user_only, key, **stops), "terms")
    recent = FO.focus_report(counts.select("term", F.col("recent_count").alias("count")), top_n)
    baseline = FO.focus_report(counts.select("term", "count"), top_n)
    spikes = FO.spikes_of(counts, sessions, as_of, hours, top_n, key)
    return recent, baseline, spikes


def list_report(sessions: DataFrame, lines: DataFrame, limit: int = 20, sort: str = "date", model: str | None = None,
                home: str | None = None, key: str = "session_id") -> DataFrame:
    """The session list: first ``limit`` rows by the sort key plus the untrimmed total."""
    return SS.top_sessions(SS.list_sessions(sessions, lines, key, home, model, sort), limit, key)


def search_report(sessions: DataFrame, messages: DataFrame, terms: list[str], limit: int = 50, key: str = "session_id",
                  **kw) -> DataFrame:
    """Matches in stream order (first ``limit``), with snippets."""
    return S.limit_in_stream_order(S.search(messages, terms, **kw), sessions, limit, key)


def show_report(sessions: DataFrame, messages: DataFrame, prefix: str, first: int | None = None, grep: str | None = None,
                context: int = 1, key: str = "session_id") -> DataFrame:
    """One session by id prefix (P6): its messages in order; only the ``first`` ones (O7), or those round the matches of
    ``grep`` (W8, with ``is_match``)."""
    one = U.find_session(sessions, prefix).select(key)
    m = messages.join(one, key, "left_semi")
    if grep:
        m = S.grep_context(m, grep, context, key)
    if first:
        m = SS.first_messages(m, first, key)
    return m.orderBy("line_no")


def resume_report(sessions: DataFrame, messages: DataFrame, project: str, n: int = 3, key: str = "session_id") -> DataFrame:
    """The latest session of a project (O3) with its last ``n`` user and assistant messages."""
    from lumenlog.operators.sequence import first_n

    one = U.latest_session(filter_project(sessions, project)).select(key)
    m = messages.where(F.col("msg_type").isin("user", "assistant")).join(one, key, "left_semi")
    return first_n(m, [key], [F.desc("line_no")], n, "rank_from_end").orderBy("line_no")


def export_report(sessions: DataFrame, lines: DataFrame, prefix: str, fmt: str = "markdown", key: str = "session_id",
                  prices=None) -> DataFrame:
    """The export blocks of one session, found by id prefix."""
    from lumenlog.plans.export import export_blocks

    one = U.find_session(sessions, prefix)
    return export_blocks(one, lines.join(one.select(key), key, "left_semi"), fmt, key, prices)


def info_report(sessions: DataFrame) -> DataFrame:
    """Overview: sessions, bytes, projects, first and last file date."""
    return U.overview(sessions)
