"""Knowledge-vault documents (K4-K12) as Spark columns, and the protected publish.

Each per-entity document (a day, a session, a concept, a digest) is one string
column built from an already aggregated row (bounded lists are sliced, as in
the rendered output). Documents whose length grows with the whole data set
(the index, the focus report) are produced as ordered block rows instead.
Front-matter keys and the protection markers are fixed values (published
documents are detected by them); the stub marker, trail heading and all other
headings and labels are this library's own (parameters in ``fixed_values``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.fixed_values import PROTECTED_DAY_MARKERS, STUB_MARKER, TRAIL_HEADING
from lumenlog.functions.pricing import usd_text
from lumenlog.functions.text import contains_any, safe_file_name
from lumenlog.functions.timefmt import fixed
from lumenlog.plans.export import FOOTER, HEADER

WEIGHT_ICON = {"ops": "○", "dev": "●", "strategy": "★"}
STATUS_ICON = {"mature": "●", "growing": "◐", "stub": "○"}


def usd2(units: Column) -> Column:
    """Exact cost units as 'd.dd' (half-even)."""
    return usd_text(units, 2)


def _icon(col: Column, icons: dict) -> Column:
    e = None
    for k, v in icons.items():
        e = F.when(col == k, F.lit(v)) if e is None else e.when(col == k, F.lit(v))
    return e


def _home(c: Column, home: str | None) -> Column:
    return F.replace(c, F.lit(home), F.lit("~")) if home else c


def _bullets(arr: Column, fn) -> Column:
    return F.array_join(F.transform(arr, fn), "\n")


def _section(title: str, arr: Column, fn) -> Column:
    """'## title' + one line per element, or null when the array is empty."""
    return F.when(F.size(arr) > 0, F.concat(F.lit(f"## {title}\n"), _bullets(arr, fn), F.lit("\n")))


def _tools_line(tools: Column, n: int = 8) -> Column:
    return F.array_join(F.transform(F.slice(tools, 1, n), lambda t: F.concat(
        F.lit("`"), t["tool_name"], F.lit("×"), t["count"].cast("string"), F.lit("`"))), " · ")


def render_daily(days: DataFrame, home: str | None = None) -> DataFrame:
    """K4: (date, path, content) per merged day (``merge_by_day`` output, optionally
    with the day's ``tools_used``/``files_touched``/``commands_run``/``web_fetched``)."""
    has_obs = "tools_used" in days.columns
    models = F.array_join("models", ", ")
    ids = F.array_join("session_ids", ", ")
    cost = usd2(F.col("cost_units"))
    front = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("date: "), F.col("date")),
        F.concat(F.lit("sessions: "), F.col("session_count").cast("string")),
        F.concat(F.lit("session_ids: ["), ids, F.lit("]")), F.concat(F.lit("models: ["), models, F.lit("]")),
        F.concat(F.lit("user_messages: "), F.col("total_user_messages").cast("string")),
        F.concat(F.lit("cost: $"), cost), F.concat(F.lit("tags: ["), F.array_join(F.slice("tags", 1, 8), ", "),
                                                   F.lit("]")),
        F.concat(F.lit("weight: "), F.col("weight")), F.concat(F.lit("weight_value: "),
                                                              F.col("weight_value").cast("string")),
        F.lit("type: daily-digest"), F.lit("---"), F.lit(""))
    icon = _icon(F.col("weight"), WEIGHT_ICON)
    title = F.concat(F.lit("# "), icon, F.lit(" "), F.col("date"), F.lit(" · "), F.col("session_count").cast("string"),
                     F.lit(" sessions · "), F.col("total_user_messages").cast("string"), F.lit(" messages\n"))
    weight = F.concat(F.lit("Weight: "), icon, F.lit(" "), F.col("weight"), F.lit(" · cost $"), cost, F.lit("\n"))
    links = F.when(F.size("entities") > 0, F.concat(F.lit("Topics: "), F.array_join(
        F.transform("entities", lambda e: F.concat(F.lit("[["), e, F.lit("]]"))), " · "), F.lit("\n")))
    kps = _section("Key points", F.col("key_points"), lambda k: F.concat(F.lit("- "), k))
    fcs = _section("File changes", F.col("file_changes"), lambda f: F.concat(
        F.lit("- `"), _home(f["path"], home), F.lit("` — "), f["action"]))
    obs = F.lit(None).cast("string")
    if has_obs:
        obs = F.when(F.col("tools_used").isNotNull(), F.concat_ws(
            "\n", F.lit("## Tool activity"),
            F.when(F.size("tools_used") > 0, F.concat(F.lit("- tools: "), _tools_line(F.col("tools_used")))),
            F.nullif(_bullets(F.slice("files_touched", 1, 20),
                              lambda p: F.concat(F.lit("- file: `"), _home(p, home), F.lit("`"))), F.lit("")),
            F.nullif(_bullets(F.slice("commands_run", 1, 10), lambda c: F.concat(F.lit("- command: `"), c, F.lit("`"))),
                     F.lit("")),
            F.nullif(_bullets(F.slice("web_fetched", 1, 5), lambda w: F.concat(F.lit("- lookup: "), w)), F.lit("")),
            F.lit("")))
    meta = F.concat_ws(
        "\n", F.lit("## Metadata"),
        F.concat(F.lit("- Sessions: "), F.col("session_count").cast("string"), F.lit(" (`"), ids, F.lit("`)")),
        F.concat(F.lit("- Messages: "), F.col("total_user_messages").cast("string"), F.lit(" (user) + "),
                 F.col("total_assistant_messages").cast("string"), F.lit(" (assistant)")),
        F.concat(F.lit("- Models: "), models), F.concat(F.lit("- Equivalent cost: $"), cost), F.lit(""))
    content = F.concat_ws("\n", front, title, weight, links, kps, fcs, obs, meta)
    return days.select("date", F.concat(F.lit("sessions/"), F.col("date"), F.lit(".md")).alias("path"),
                       content.alias("content"))


def render_session(compiled: DataFrame, home: str | None = None) -> DataFrame:
    """K5: (session_id, content) per compiled session; title = first 60 characters of the topic."""
    models = F.array_join("models", ", ")
    cost = usd2(F.col("cost_units"))
    icon = _icon(F.col("weight"), WEIGHT_ICON)
    front = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("session_id: "), F.col("session_id")),
        F.concat(F.lit("date: "), F.col("date")), F.concat(F.lit('time_range: "'), F.col("time_range"), F.lit('"')),
        F.concat(F.lit("project: "), _home(F.col("project"), home)), F.concat(F.lit("models: ["), models, F.lit("]")),
        F.concat(F.lit("user_messages: "), F.col("user_message_count").cast("string")),
        F.concat(F.lit("cost: $"), cost),
        F.concat(F.lit("tags: ["), F.array_join(F.slice("tags", 1, 8), ", "), F.lit("]")),
        F.concat(F.lit("weight: "), F.col("weight")),
        F.concat(F.lit("weight_value: "), F.col("weight_value").cast("string")), F.lit("status: compiled"),
        F.lit("---"), F.lit(""))
    title = F.coalesce(F.nullif(F.substring("topic_sentence", 1, 60), F.lit("")), F.col("date"))
    head = F.concat(F.lit("# "), icon, F.lit(" Session: "), title, F.lit("\n"))
    line = F.concat(F.lit("Weight: "), icon, F.lit(" "), F.col("weight"), F.lit(" · messages "),
                    F.col("user_message_count").cast("string"), F.lit(" · cost $"), cost, F.lit("\n"))
    links = F.when(F.size("entities") > 0, F.concat(F.lit("Topics: "), F.array_join(
        F.transform("entities", lambda e: F.concat(F.lit("[["), e, F.lit("]]"))), " · "), F.lit("\n")))
    content = F.concat_ws(
        "\n", front, head, line, links,
        _section("Key points", F.col("key_points"), lambda k: F.concat(F.lit("- "), k)),
        _section("Closing context", F.col("tail_context"), lambda t: F.concat(F.lit("> "), t)),
        _section("File changes", F.col("file_changes"), lambda f: F.concat(
            F.lit("- `"), _home(f["path"], home), F.lit("` — "), f["action"])),
        F.concat_ws("\n", F.lit("## Metadata"), F.concat(F.lit("- Session: `"), F.col("session_id"), F.lit("`")),
                    F.concat(F.lit("- Time: "), F.col("time_range")),
                    F.concat(F.lit("- Messages: "), F.col("user_message_count").cast("string"), F.lit(" (user) + "),
                             F.col("assistant_message_count").cast("string"), F.lit(" (assistant)")),
                    F.concat(F.lit("- Models: "), models), F.concat(F.lit("- Equivalent cost: $"), cost), F.lit("")))
    return compiled.select("session_id", content.alias("content"))


def concept_front_matter(name: Column, first_seen: Column, sessions_head: Column, count: Column,
                         status: Column) -> Column:
    return F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("name: "), name), F.lit("type: concept"),
        F.concat(F.lit("first_seen: "), first_seen),
        F.concat(F.lit("sessions: ["), F.array_join(F.slice(sessions_head, 1, 20), ", "), F.lit("]")),
        F.concat(F.lit("mention_count: "), count.cast("string")), F.concat(F.lit("status: "), status),
        F.lit("---"), F.lit(""))


def render_concept(concepts: DataFrame, stub_marker: str = STUB_MARKER, heading: str = TRAIL_HEADING) -> DataFrame:
    """K6: (concept, path, content): front matter (first 20 sessions), stub marker line,
    trail of distinct dates in first-seen order."""
    fm = concept_front_matter(F.col("concept"), F.col("first_seen"), F.col("sessions_head"),
                              F.col("mention_count"), F.col("status"))
    trail = _bullets(F.col("dates"), lambda d: F.concat(F.lit("- **"), d, F.lit("** [["), d, F.lit("]]")))
    content = F.concat_ws(
        "\n", fm, F.concat(F.lit("# "), F.col("concept")), F.lit(""), F.lit("## Definition"),
        F.concat(F.lit(f"*{stub_marker} (mentioned in "), F.col("mention_count").cast("string"),
                 F.lit(" sessions)*")), F.lit(""),
        F.lit(f"## {heading}"), trail, F.lit(""))
    path = F.concat(F.lit("concepts/"), safe_file_name(F.concat(F.col("concept"), F.lit(".md"))))
    return concepts.select("concept", path.alias("path"), content.alias("content"))


def render_index(compiled: DataFrame, days: DataFrame, concepts: DataFrame, weights: DataFrame,
                 status_counts: DataFrame, updated: str) -> DataFrame:
    """K7: the index as ordered blocks (doc='INDEX', ord): totals, weight distribution
    with 20-cell bars, days newest first (4 topics each), concepts by count.

    ``updated`` is an explicit date string (deterministic output)."""
    totals = compiled.agg(F.count(F.lit(1)).alias("n"), F.sum("user_message_count").alias("u"),
                          F.sum("cost_units").alias("c"))

    def n_status(name):
        return F.coalesce(status_counts.where(F.col("status") == name).select(F.max("count")).scalar(), F.lit(0))

    mature, growing, stub = n_status("mature"), n_status("growing"), n_status("stub")
    head = totals.select(
        F.lit("INDEX").alias("doc"), F.lit(HEADER).cast("bigint").alias("ord"), F.concat_ws(
            "\n", F.lit("---"), F.lit("title: Session vault"), F.lit("type: index"),
            F.lit(f"updated: {updated}"), F.lit("---"), F.lit(""), F.lit("# Session vault"), F.lit(""),
            F.lit("## Totals"), F.lit(""), F.lit("| metric | value |"), F.lit("|---|---|"),
            F.concat(F.lit("| compiled sessions | "), F.col("n").cast("string"), F.lit(" |")),
            F.concat(F.lit("| user messages | "), F.coalesce(F.col("u"), F.lit(0)).cast("string"), F.lit(" |")),
            F.concat(F.lit("| equivalent cost | $"), usd2(F.coalesce(F.col("c"), F.lit(0))), F.lit(" |")),
            F.concat(F.lit("| concepts | "), (mature + growing + stub).cast("string"), F.lit(" (mature "),
                     mature.cast("string"), F.lit(", growing "), growing.cast("string"), F.lit(", stub "),
                     stub.cast("string"), F.lit(") |")),
            F.lit(""), F.lit("## Weight distribution"), F.lit(""), F.lit("| level | sessions | share | bar |"),
            F.lit("|---|---|---|---|")).alias("block"))
    cells = F.floor(F.col("pct") / 5).cast("int")
    wrows = weights.select(
        F.lit("INDEX").alias("doc"), (F.col("level_ord") + 1).cast("bigint").alias("ord"),
        F.concat(F.lit("| "), _icon(F.col("weight"), WEIGHT_ICON), F.lit(" "), F.col("weight"), F.lit(" | "),
                 F.col("count").cast("string"), F.lit(" | "), F.bround("pct", 0).cast("bigint").cast("string"),
                 F.lit("% | "), F.repeat(F.lit("█"), cells), F.repeat(F.lit("░"), F.lit(20) - cells),
                 F.lit(" |")).alias("block"))
    day_key = F.unix_date(F.to_date("date"))
    drows = days.where(F.col("date") != "unknown").select(
        F.lit("INDEX").alias("doc"), (F.lit(1 << 40) - day_key).cast("bigint").alias("ord"),
        F.concat(F.lit("- "), _icon(F.col("weight"), WEIGHT_ICON), F.lit(" [["), F.col("date"), F.lit("]] · "),
                 F.col("session_count").cast("string"), F.lit("s · "), F.col("total_user_messages").cast("string"),
                 F.lit("m · "), F.array_join(F.slice("entities", 1, 4), ", ")).alias("block"))
    mid = compiled.sparkSession.createDataFrame(
        [("INDEX", 100, "\n## Days\n"), ("INDEX", 1 << 41, "\n## Concepts\n")], "doc string, ord bigint, block string")
    # concepts are bounded by the dictionary: a global rank over them is cheap
    rank = F.row_number().over(Window.orderBy(F.desc("mention_count"), F.asc("concept")))
    crows = concepts.select(
        F.lit("INDEX").alias("doc"), (F.lit(1 << 42) + rank).cast("bigint").alias("ord"),
        F.concat(F.lit("- "), _icon(F.col("status"), STATUS_ICON), F.lit(" [["), F.col("concept"), F.lit("]] — "),
                 F.col("mention_count").cast("string"), F.lit(" sessions · "), F.col("status")).alias("block"))
    return head.unionByName(wrows).unionByName(mid).unionByName(drows).unionByName(crows)


def render_digest(digests: DataFrame, keep: tuple | list = ()) -> DataFrame:
    """K8: (session_id, content) Markdown block per session digest; duration '?' when
    unknown; id cut to 16 characters in the marker comment."""
    dur = F.when(F.col("duration_min").isNotNull() & (F.col("duration_min") != 0),
                 F.concat(fixed(F.col("duration_min"), 0), F.lit("min"))).otherwise(F.lit("?"))
    head = F.concat(F.lit("### "), F.col("date"), F.lit(" · `"), F.col("project"), F.lit("` · "), dur, F.lit(" · "),
                    F.col("message_count").cast("string"), F.lit(" messages\n<!-- session: "),
                    F.substring("session_id", 1, 16), F.lit(" -->\n"))
    topic = F.when(F.col("topic") != "", F.concat(F.lit("**Topic**: "), F.col("topic"), F.lit("\n")))
    keys = F.when(F.size("key_exchanges") > 0, F.concat(F.lit("**Key exchanges**:\n\n"), F.array_join(F.transform(
        "key_exchanges", lambda e: F.concat(F.lit("- **Q**: "), e["user_text"], F.lit("\n  **A**: "),
                                            e["assistant_text"], F.lit("\n"))), "\n")))
    tail = F.when(F.size("tail_exchanges") > 0, F.concat(F.lit("**Closing context**:\n\n"), F.array_join(F.transform(
        "tail_exchanges", lambda e: F.concat(F.lit("> Q: "), e["user_text"], F.lit("\n> A: "),
                                             e["assistant_text"], F.lit("\n"))), "\n")))
    content = F.concat_ws("\n", head, topic, keys, tail, F.lit("---\n"))
    return digests.select("session_id", content.alias("content"), *keep)


def render_focus(recent: DataFrame, baseline: DataFrame, spikes: DataFrame, stats: DataFrame, hours: int,
                 generated: str) -> DataFrame:
    """Three ranked tables (spikes limited to 15, bar = min(uplift / 5, 1)) as
    ordered blocks. ``stats``: one row (recent_sessions, recent_messages,
    all_sessions, all_messages)."""
    from lumenlog.functions.timefmt import bar

    def s(c):
        return F.col(c).cast("string")

    heads = stats.select(F.explode(F.array(
        F.struct(F.lit(HEADER).cast("bigint").alias("ord"), F.lit(
            f"## Focus\n> generated {generated}\n\n### Spikes (last {hours}h vs baseline)\n\n"
            "| # | term | uplift |\n|---|---|---|").alias("block")),
        F.struct(F.lit(1000).cast("bigint").alias("ord"), F.concat(
            F.lit(f"\n### Recent ({hours}h · "), s("recent_sessions"), F.lit(" sessions · "), s("recent_messages"),
            F.lit(" messages)\n\n| # | term | share | count |\n|---|---|---|---|")).alias("block")),
        F.struct(F.lit(2000).cast("bigint").alias("ord"), F.concat(
            F.lit("\n### Baseline ("), s("all_sessions"), F.lit(" sessions · "), s("all_messages"),
            F.lit(" messages)\n\n| # | term | weight | count |\n|---|---|---|---|")).alias("block")),
        F.struct(F.lit(FOOTER).cast("bigint").alias("ord"), F.lit("").alias("block")))).alias("h")).select(
        F.lit("FOCUS").alias("doc"), "h.ord", "h.block")
    sp = spikes.where(F.col("rank") <= 15).select(
        F.lit("FOCUS").alias("doc"), F.col("rank").cast("bigint").alias("ord"),
        F.concat(F.lit("| "), F.lpad(F.col("rank").cast("string"), 2, " "), F.lit(" | "), F.col("term"),
                 F.lit(" | "), bar(F.least(F.col("uplift") / 5, F.lit(1.0)), 16), F.lit(" ×"),
                 fixed(F.col("uplift"), 1), F.lit(" |")).alias("block"))

    def table(df, base):
        return df.select(F.lit("FOCUS").alias("doc"), (F.col("rank") + base).cast("bigint").alias("ord"), F.concat(
            F.lit("| "), F.lpad(F.col("rank").cast("string"), 2, " "), F.lit(" | "), F.col("term"), F.lit(" | "),
            bar(F.col("pct"), 16), F.lit(" | "), F.col("count").cast("string"), F.lit(" |")).alias("block"))

    return heads.unionByName(sp).unionByName(table(recent, 1000)).unionByName(table(baseline, 2000))


def _replace_first_line(doc: Column, key_regex: str, new_line: Column) -> Column:
    """Replace the first line matching ``^key_regex$`` (multiline) with ``new_line``."""
    pat = r"(?m)\A((?s:.*?))^" + key_regex + r"$"
    safe = F.replace(F.replace(new_line, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    has = doc.rlike(r"(?m)^" + key_regex + r"$")
    return F.when(has, F.regexp_replace(doc, F.lit(pat), F.concat(F.lit("$1"), safe))).otherwise(doc)


def update_front_matter(doc: Column, sessions_head: Column, count: Column, status: Column) -> Column:
    """First 'sessions: [...]', 'mention_count: n' and 'status: w' lines updated."""
    out = _replace_first_line(doc, r"sessions: \[[^\n]*?\]",
                              F.concat(F.lit("sessions: ["), F.array_join(F.slice(sessions_head, 1, 20), ", "),
                                       F.lit("]")))
    out = _replace_first_line(out, r"(?U)mention_count: \d+", F.concat(F.lit("mention_count: "), count.cast("string")))
    return _replace_first_line(out, r"(?U)status: \w+", F.concat(F.lit("status: "), status))


def publish_documents(day_docs: DataFrame, concept_docs: DataFrame, concepts: DataFrame, existing: DataFrame,
                      protected: list[str] = PROTECTED_DAY_MARKERS, stub_marker: str = STUB_MARKER) -> DataFrame:
    """K9: protected upsert against the already published documents (path, content).

    Day documents whose existing text carries one of the ``protected`` markers are kept;
    concept documents whose existing text no longer has the ``stub_marker`` keep
    their body and only get K10; everything else is (over)written.
    Returns (path, kind, action, content) with action in written / kept / front_matter.
    """
    ex = existing.select("path", F.col("content").alias("_old"))
    days = day_docs.select("path", "content").join(ex, "path", "left").select(
        "path", F.lit("day").alias("kind"),
        F.when(contains_any(F.col("_old"), protected), F.lit("kept")).otherwise(F.lit("written"))
         .alias("action"),
        F.when(contains_any(F.col("_old"), protected), F.col("_old")).otherwise(F.col("content"))
         .alias("content"))
    c = concept_docs.select("concept", "path", "content").join(
        concepts.select("concept", "sessions_head", "mention_count", "status"), "concept").join(ex, "path", "left")
    enriched = F.col("_old").isNotNull() & ~F.contains(F.col("_old"), F.lit(stub_marker))
    cons = c.select(
        "path", F.lit("concept").alias("kind"),
        F.when(enriched, F.lit("front_matter")).otherwise(F.lit("written")).alias("action"),
        F.when(enriched, update_front_matter(F.col("_old"), F.col("sessions_head"), F.col("mention_count"),
                                             F.col("status"))).otherwise(F.col("content")).alias("content"))
    return days.unionByName(cons)


def write_documents(docs: DataFrame, out_dir: str) -> None:
    """Write (path, content) documents as files under ``out_dir``, by the writer of ``sources.documents``: staged by tasks, moved by
    tasks when all are staged. Of several rows with the same path the last one moved stays."""
    from lumenlog.sources.documents import save_documents

    save_documents(docs, out_dir)


def read_documents(spark, out_dir: str) -> DataFrame:
    """SC15: already published documents (path relative to ``out_dir``, content)."""
    from lumenlog.operators.notes import loose_glob, read_whole_texts

    base = out_dir.rstrip("/")
    d = read_whole_texts(spark, [], [f"{loose_glob(base)}/{kind}/*.md" for kind in ("sessions", "concepts")])
    d = d.where(F.startswith("path", F.regexp_replace(F.lit(base + "/"), "^file:(//)?(?=/)", "")))
    return d.select(F.regexp_replace("path", "^.*/(sessions|concepts)/", "$1/").alias("path"), "content")


def append_log(blocks: DataFrame, table_path: str, batch: str | None = None) -> str:
    """Add rendered digest blocks to a log table (Parquet, partitioned by batch); returns the batch.

    Adding a batch again replaces it and keeps its time, so a repeated run adds nothing. Without a name the batch is named by
    its content: the same blocks are the same batch."""
    spark = blocks.sparkSession
    rows = blocks.select("session_id", "content")
    if batch is None:
        n, digest = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("session_id", "content").cast("decimal(38,0)"))).first()
        batch = f"{n}-{digest}"
    try:
        since = spark.read.parquet(table_path).where(F.col("batch") == batch).agg(F.min("appended_at")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        since = None
    at = F.current_timestamp() if since is None else F.lit(since)
    rows.select("session_id", "content", at.alias("appended_at"), F.lit(batch).alias("batch")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table_path)
    return batch


def write_vault(compiled: DataFrame, out_dir: str, events: DataFrame | None = None, home: str | None = None,
                updated: str = "") -> DataFrame:
    """The whole vault write: day documents (with the day's tool activity when
    ``events`` are given), concept documents, the protected publish against the
    documents already under ``out_dir``, the files, and the index.

    ``compiled``: ``compile_sessions`` output with a sortable ``session_ord``
    (compile order). Returns (kind, action, documents) counts; kept documents
    count too. The index is written as ordered blocks under ``out_dir/index``.
    """
    from lumenlog.operators import daily as DY
    from lumenlog.operators import tools as TL

    from lumenlog.sources.jsonl import materialize

    spark = compiled.sparkSession
    days = DY.merge_by_day(compiled)
    if events is not None:
        obs = TL.merge_observations_by_day(events, compiled.select(
            F.col("full_session_id").alias("session_id"), "date", "session_ord"), limits=TL.DISPLAY_LIMITS)
        days = days.join(obs, "date", "left")
    concepts = DY.concept_index(compiled)
    existing = read_documents(spark, out_dir)
    published = publish_documents(render_daily(days, home), render_concept(concepts), concepts, existing)
    # the publish reads the files it is about to overwrite: write it to a table first
    published = materialize(published, "published")
    write_documents(published.where(F.col("action") != "kept"), out_dir)
    from lumenlog.plans.export import write_blocks
    index = render_index(compiled, days, concepts, DY.weight_distribution(compiled), DY.status_counts(concepts),
                         updated)
    write_blocks(index, f"{out_dir.rstrip('/')}/index")
    return published.groupBy("kind", "action").agg(F.count(F.lit(1)).cast("bigint").alias("documents"))


def append_digests(sessions: DataFrame, lines: DataFrame, table_path: str, tail_n: int = 3, max_key: int = 8,
                   key: str = "session_id", signals=None, batch: str | None = None) -> DataFrame:
    """Digest a batch of sessions (A29), render each (K8) and append the blocks to
    the log table (K11, by ``batch``); returns the rendered blocks, newest file time first (O5)."""
    from lumenlog.operators.digest import digest_batch_order, digest_sessions
    from lumenlog.sources.jsonl import materialize

    d = digest_sessions(sessions, lines, tail_n, max_key, key, signals)
    blocks = materialize(render_digest(d, keep=["modified_time"]), "digests")  # appended and returned: computed once
    append_log(blocks, table_path, batch)
    return digest_batch_order(blocks).drop("modified_time")


LOG_HEADER = "# Session log\n\nDigests of finished sessions, newest last.\n\n---\n"


def render_log(log: DataFrame, header: str = LOG_HEADER) -> DataFrame:
    """K11, the rendered view: the log table as ordered blocks (doc='LOG'), header first, then every digest in the
    order it was appended."""
    body = log.select(F.lit("LOG").alias("doc"), (F.unix_micros("appended_at") + F.lit(1)).cast("bigint").alias("ord"), "session_id",
                      F.col("content").alias("block"))
    head = log.sparkSession.createDataFrame([("LOG", HEADER, "", header)], "doc string, ord bigint, session_id string, block string")
    return head.unionByName(body)
