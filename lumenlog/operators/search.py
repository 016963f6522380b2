"""Multi-term search with context snippets.

The whole search is one narrow scan: role/model conjuncts first (cheap), then
one ``rlike`` per term, then the snippet from capture groups. The ordered limit
is a TakeOrderedAndProject (per-task top-k, no global sort).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.text import java_regex, regex_escape, snippet_from_parts, snippet_parts
from lumenlog.operators.sequence import dense_position

DEFAULT_ROLES = ("user", "assistant")


def term_regex(term: str, regex: bool = False, case_sensitive: bool = False, groups_before: int = 0) -> str:
    """One term as a Java regex; literal unless ``regex`` (Python syntax, see ``java_regex``); Unicode case folding.
    ``groups_before``: capture groups that stand before it where it is built into a larger pattern."""
    # d: '.' stops at '\n' only; U: \w, \d, \s, \b are Unicode - both as in Python
    body = f"(?dU:{java_regex(term, groups_before)})" if regex else regex_escape(term)
    return body if case_sensitive else f"(?iu:{body})"


def filter_role(messages: DataFrame, roles: Sequence[str] | None = None) -> DataFrame:
    """Message types to search (default user + assistant; system never by default)."""
    return messages.where(F.col("msg_type").isin(list(roles or DEFAULT_ROLES)))


def filter_model_search(messages: DataFrame, model: str | None) -> DataFrame:
    """Drop only rows that *have* a model not containing ``model``."""
    if not model:
        return messages
    m = F.col("model")
    return messages.where(m.isNull() | (m == "") | F.contains(F.lower(m), F.lit(model.lower())))


def match_all(messages: DataFrame, terms: Sequence[str], regex: bool = False,
              case_sensitive: bool = False) -> DataFrame:
    """Every term occurs somewhere in the (non-empty) text."""
    cond = F.col("content_text") != ""
    for t in terms:
        cond = cond & F.col("content_text").rlike(term_regex(t, regex, case_sensitive))
    return messages.where(cond)


def search(messages: DataFrame, terms: Sequence[str], regex: bool = False, case_sensitive: bool = False,
           roles: Sequence[str] | None = None, model: str | None = None, context_chars: int = 80) -> DataFrame:
    """All matching messages with (context_before, match_text, context_after) of the first term."""
    if not terms:
        raise ValueError("at least one search term is required")
    m = match_all(filter_model_search(filter_role(messages, roles), model), terms, regex, case_sensitive)
    pre, hit = snippet_parts(F.col("content_text"), term_regex(terms[0], regex, case_sensitive, 2))
    m = m.withColumns({"_pre": pre, "_hit": hit})  # each regex once per row
    s = snippet_from_parts(F.col("content_text"), F.col("_pre"), F.col("_hit"), context_chars)
    return m.withColumn("_snip", s).select("*", "_snip.*").drop("_snip", "_pre", "_hit")


def limit_in_stream_order(results: DataFrame, sessions: DataFrame, limit: int, key: str = "session_id") -> DataFrame:
    """The first ``limit`` matches in discovery order (project dir, session, line); ``key`` is unique per session."""
    order = sessions.select(key, "project_dir", "project_name")
    return (results.join(order, key, "inner")
                   .orderBy("project_dir", key, "line_no").limit(limit))


def search_summary(results: DataFrame, key: str = "session_id") -> DataFrame:
    """Matches per session plus the overall totals, both sums over the per-session rows."""
    per = results.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("matches"),
                                   F.min("line_no").alias("first_line"))
    return (per.withColumn("total_matches", F.coalesce(per.select(F.sum("matches").cast("bigint")).scalar(), F.lit(0)))
               .withColumn("matched_sessions", per.select(F.count(F.lit(1)).cast("bigint")).scalar()))


def grep_context(messages: DataFrame, term: str, context: int = 1, key: str = "session_id") -> DataFrame:
    """Messages (all types) within +-``context`` positions of a message containing
    ``term`` (literal, case-insensitive); overlapping windows merge.

    Positions come from the skew-safe dense rank over narrow rows; each hit emits its 2C+1
    neighbour positions, and the messages at those positions are joined back by line.
    """
    hit = F.coalesce(F.col("content_text").rlike(term_regex(term)), F.lit(False))
    # only (key, line, hit) is ranked; texts are looked up for the rows that stay
    pos = dense_position(messages.select(key, "line_no", hit.alias("is_match")), [key], "line_no", "pos")
    near = pos.where("is_match").select(
        key, F.explode(F.sequence(F.col("pos") - context, F.col("pos") + context)).alias("pos")).distinct()
    kept = pos.join(near, [key, "pos"], "left_semi")
    return messages.join(kept, [key, "line_no"])


PREFILTER_SAFE = r"^[A-Za-z0-9 ]+$"


def candidate_files(raw_lines: DataFrame, term: str, case_sensitive: bool = False) -> DataFrame | None:
    """Files whose raw JSON text contains ``term`` (a semi-join key set).

    Only safe for terms of plain ASCII letters, digits and spaces: JSON escaping
    (quotes, ``\\n``, ``\\u`` escapes) can hide other text in the raw line. Returns
    None when the term is not safe -- then no prefilter applies. The filter runs
    on the raw lines before any JSON decoding.
    """
    import re

    if not re.match(PREFILTER_SAFE, term):
        return None
    v = F.col("value") if case_sensitive else F.lower(F.col("value"))
    t = term if case_sensitive else term.lower()
    return raw_lines.where(F.contains(v, F.lit(t))).select("file_path").distinct()


def prefiltered_lines(raw_lines: DataFrame, term: str, case_sensitive: bool = False) -> DataFrame:
    """J11 in one scan: the raw lines that contain a safe ``term``, to be decoded and searched; all lines when the term is
    unsafe. The search result is that of all lines, since a matching message's own line contains the term."""
    import re

    # a blank can join two blocks, and "[tool: unknown]" is not in the raw line
    if not re.match(PREFILTER_SAFE, term) or " " in term or term.lower() in "tool unknown":
        return raw_lines
    v = F.col("value") if case_sensitive else F.translate(F.lower(F.col("value")), "ſ", "s")
    return raw_lines.where(F.contains(v, F.lit(term if case_sensitive else term.lower())))


def prefiltered(messages: DataFrame, raw_lines: DataFrame, term: str, case_sensitive: bool = False) -> DataFrame:
    """Messages of candidate files only (left semi join); unchanged when the term is unsafe."""
    c = candidate_files(raw_lines, term, case_sensitive)
    return messages if c is None else messages.join(c, "file_path", "left_semi")
