"""Enrichment of feed items: planning, cache, source text, canonical summary."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import first_native_text, py_strip, sanitize, summary_rejection
from newsloom.operators.joins import propagate_to_duplicates
from newsloom.operators.metrics import tier_outcomes
from newsloom.operators.ranking import budget_reason, dedup_by_url, tier_stats, tiered_budget, top_per_group
from newsloom.session import cut

# Strategies a feed can name, and budgets per health tier.
STRATEGIES = ["auto", "rss_only", "fetch", "fetch_with_cookies", "browser_fetch", "skip"]
UNCAPPED = 9999

# Origins of text that came with the feed.
NATIVE_ORIGINS = ["rss_body", "content", "content_encoded", "summary", "description"]
BODY_ORIGINS = ["rss_body", "content", "content_encoded"]

# Versions that a cache entry must carry.
CACHE_VERSION = 4
EXTRACTOR_VERSION = 1
BROWSER_VERSION = 1
GUARD_VERSION = 3

# Columns of a candidate that planning and records need; texts are apart.
PLANNED = [
    *["run_date", "pos", "url", "source", "native_origin", "native_length", "tier", "strategy", "http_needed"],
    *["browser_needed", "p0", "p1", "p2", "priority_reason"],
]

CACHE_DDL = (
    "url string, url_sha1 string, fetched_at timestamp, status string, http_status int, raw_length bigint,"
    " summary_length bigint, canonical_summary string, source_text_origin string, source_name string,"
    " error string, fallback_reason string, rejected_summary_preview string, cache_version int,"
    " component_version int"
)


def default_caps(fetches: int = 40, browser: int = 0) -> tuple[dict[str, int], dict[str, int]]:
    """(HTTP, browser) budgets per tier when none are configured."""
    closed = {"headline_radar": 0, "degraded": 0, "broken": 0}
    http = {"active": fetches, "low_frequency": fetches, "enrichment_required": UNCAPPED, **closed}
    page = {"active": browser, "low_frequency": browser, "enrichment_required": UNCAPPED, **closed}
    return http, page


def enrich_strategy(enrich: Column) -> Column:
    """Skip switch, then a valid named strategy, then the older switches."""
    cookies = F.coalesce(enrich["cookies_file"], F.lit("")) != ""
    return (
        F.when(enrich["skip"], "skip")
        .when(enrich["strategy"].isin(STRATEGIES), enrich["strategy"])
        .when(enrich["fetch_article"] & cookies, "fetch_with_cookies")
        .when(enrich["fetch_article"], "fetch")
        .otherwise("auto")
    )


def needs_fetch(length: Column, strategy: Column, least: int) -> Column:
    return (
        F.when(strategy.isin("skip", "rss_only", "browser_fetch"), False)
        .when(strategy.isin("fetch", "fetch_with_cookies"), True)
        .otherwise(length < least)
    )


def native_candidates(items: DataFrame) -> list[tuple[str, Column]]:
    """Body-like fields of the items at hand, best first."""
    names = [("rss_body", "rss_body"), ("content", "content"), ("content_encoded", "content_encoded")]
    names += [("summary", "summary"), ("description", "description")]
    out = []
    for origin, name in names:
        if name not in items.columns:
            continue
        c = F.col(name)
        if items.schema[name].dataType.typeName() == "array":
            # Parts stay in order: the first one with text between its tags counts.
            bare = lambda p: py_strip(F.regexp_replace(F.coalesce(p, F.lit("")), "<[^>]*>", ""))
            c = F.get(F.filter(c, lambda p: bare(p) != ""), F.lit(0))
        out.append((origin, F.coalesce(c, F.lit(""))))
    return out


def candidates(items: DataFrame, feeds: DataFrame, least_chars: int = 200, browser: bool = False) -> DataFrame:
    """One row per kept URL with native text, strategy, needs and priority."""
    kept = dedup_by_url(items)
    dims = feeds.select(
        F.col("name").alias("source"),
        F.coalesce("health", F.lit("active")).alias("_tier"),
        F.when(F.coalesce("priority", F.lit(0)) == 0, 5).otherwise(F.col("priority")).alias("_priority"),
        enrich_strategy(F.col("enrich")).alias("_strategy"),
    )
    rows = kept.join(dims, "source", "left")
    native = rows.withColumn("_native", first_native_text(native_candidates(items)))
    text = F.col("native_text")
    out = native.select(
        *[c for c in items.columns],
        F.col("_native.text").alias("native_text"),
        F.col("_native.origin").alias("native_origin"),
        F.length("_native.text").cast("bigint").alias("native_length"),
        F.coalesce("_tier", F.lit("active")).alias("tier"),
        F.coalesce("_strategy", F.lit("auto")).alias("strategy"),
        F.coalesce("_priority", F.lit(5)).alias("feed_priority"),
    )
    s, n, p = F.col("strategy"), F.col("native_length"), F.col("feed_priority")
    explicit = s.isin("fetch", "fetch_with_cookies", "browser_fetch")
    return out.withColumns(
        {
            "http_needed": needs_fetch(n, s, least_chars),
            "browser_needed": F.lit(browser) & ((s == "browser_fetch") | ((s == "auto") & (text == ""))),
            "p0": F.when(s == "skip", 5).when(text == "", 0).when(explicit, 1).when(p <= 2, 2).otherwise(3),
            "p1": F.when(s == "skip", 1).when((text == "") | explicit, 0).otherwise(p),
            "p2": F.when((s != "skip") & (text == ""), 0).otherwise(n),
            "priority_reason": F.when(s == "skip", "skip")
            .when(text == "", "empty_native_text")
            .when(explicit, F.concat(F.lit("explicit_"), s))
            .when(p <= 2, "high_priority_feed")
            .otherwise("short_native_text"),
        }
    )


def record(
    status: Column,
    error: Column | str = "",
    origin: Column | str = "",
    fetched: Column | int = 0,
    summary: Column | int = 0,
    http: Column | None = None,
    reason: Column | str = "",
    preview: Column | str = "",
) -> list[Column]:
    """Columns of an enrichment record; the row brings url, source and tier."""

    def c(x):
        return x if isinstance(x, Column) else F.lit(x)

    return [
        F.col("run_date"),
        F.col("url"),
        F.col("source"),
        F.col("tier"),
        status.alias("status"),
        c(origin).alias("source_text_origin"),
        F.col("native_length").cast("bigint").alias("native_length"),
        c(fetched).cast("bigint").alias("fetched_length"),
        c(summary).cast("bigint").alias("summary_length"),
        (F.lit(None) if http is None else http).cast("int").alias("http_status"),
        c(error).alias("error"),
        c(reason).alias("fallback_reason"),
        c(preview).alias("rejected_summary_preview"),
    ]


def budgets(
    cands: DataFrame, http_caps: Mapping[str, int], browser_caps: Mapping[str, int]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates with what they may fetch, records of skipped, tier stats)."""
    http = tiered_budget(cands, F.col("http_needed"), http_caps, "skipped_fetch_cap")
    page = tiered_budget(cands, F.col("browser_needed"), browser_caps, "skipped_browser_fetch_cap")
    key = ["run_date", "url"]
    out = (
        cands.join(http.select(*key, F.col("allowed").alias("http_allowed")), key, "left")
        .join(page.select(*key, F.col("allowed").alias("browser_allowed")), key, "left")
        .fillna(False, subset=["http_allowed", "browser_allowed"])
    )
    over = http.where("not allowed").unionByName(page.where("not allowed"))
    skipped = over.select(*record(F.col("budget_status"), budget_reason()))
    stats = tier_stats(http).withColumn("kind", F.lit("http_fetch")).unionByName(
        tier_stats(page).withColumn("kind", F.lit("browser_fetch"))
    )
    return out, skipped, stats


def component_version(origin: Column) -> Column:
    return (
        F.when(origin == "fetched_html", EXTRACTOR_VERSION)
        .when(origin == "browser_markdown", BROWSER_VERSION)
        .otherwise(GUARD_VERSION)
    )


def newest_entries(cache: DataFrame) -> DataFrame:
    """One cache entry per URL, the newest."""
    return top_per_group(cache, ["url"], [F.desc("fetched_at")], 1)


def valid_entries(cache: DataFrame, now: Column, ttl_days: int = 30, backoff_hours: int = 24) -> DataFrame:
    """Newest entries of the right versions which are still fresh."""
    age_limit = F.when(
        F.col("status") == "ok", now - F.expr(f"INTERVAL {int(ttl_days)} DAYS")
    ).otherwise(now - F.expr(f"INTERVAL {int(backoff_hours)} HOURS"))
    return newest_entries(cache).where(
        (F.col("cache_version") == CACHE_VERSION)
        & (F.col("component_version") == component_version(F.col("source_text_origin")))
        & (F.col("fetched_at") >= age_limit)
    )


def cache_lookup(
    cands: DataFrame, cache: DataFrame, now: Column, native_above: int | None = None, **fresh
) -> DataFrame:
    """Candidates with their valid cache entry (struct ``cached``, or null).

    Entries made from native text are passed over when that text is now short
    enough to be used as it is.
    """
    entry = valid_entries(cache, now, **fresh)
    packed = entry.select("url", F.struct(*[c for c in entry.columns if c != "url"]).alias("cached"))
    out = cands.join(packed, "url", "left")
    if not native_above:
        return out
    stale = F.col("cached.source_text_origin").isin(NATIVE_ORIGINS) & (F.col("native_length") < native_above)
    return out.withColumn("cached", F.when(~F.coalesce(stale, F.lit(False)), F.col("cached")))


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache with the newest entry per URL."""
    return newest_entries(cache.unionByName(fresh))


def cache_prune(cache: DataFrame, now: Column, ttl_days: int = 30) -> DataFrame:
    return cache.where(F.col("fetched_at") >= now - F.expr(f"INTERVAL {int(ttl_days)} DAYS"))


def asked_results(landed: DataFrame, asked: DataFrame) -> DataFrame:
    """Landed results of the URLs that were asked for."""
    return landed.join(asked.select("url"), "url", "left_semi")


def decide_source(cands: DataFrame, http: DataFrame, browser: DataFrame) -> DataFrame:
    """Where the source text of each candidate comes from.

    ``http`` and ``browser`` hold landed results by URL: text, status,
    http_status, length, error; they count for candidates that may fetch them.
    A browser-first feed takes its page; then HTTP; then the browser as a second
    try; then body text that came with the feed, of which the length is enough
    here. Adds origin, fetched_length, http_status, fetch_error, terminal, when
    terminal terminal_status, and landed_text where ``from_web`` says so.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "url",
            F.struct("text", "status", F.col("http_status").cast("int").alias("http"), "length", "error").alias(name),
        )

    rows = cands.join(packed(http, "_h"), "url", "left").join(packed(browser, "_b"), "url", "left")
    missing = F.struct(
        F.lit("").alias("text"),
        F.lit("http_error").alias("status"),
        F.lit(None).cast("int").alias("http"),
        F.lit(0).cast("bigint").alias("length"),
        F.lit("no landed result").alias("error"),
    )
    rows = rows.withColumns({"_h": F.coalesce("_h", missing), "_b": F.coalesce("_b", missing)})
    h, b = F.col("_h"), F.col("_b")
    may_http, may_page = F.col("http_allowed"), F.col("browser_allowed")
    native = F.col("native_length") > 0
    usable = native & F.col("native_origin").isin(BODY_ORIGINS)
    first = may_page & (F.col("strategy") == "browser_fetch")

    def note(kind: str, r: Column) -> Column:
        return F.trim(F.format_string(f"{kind} %s: %s", r["status"], r["error"]))

    http_note, page_note = note("fetch", h), note("browser", b)
    before = F.when(first & (b["status"] != "ok"), page_note).otherwise("")
    # Fixed order of outcomes; the first that applies is the answer.
    outcome = (
        F.when(first & (b["status"] == "ok"), "page_first")
        .when(first & ~native, "page_first_failed")
        .when(may_http & (h["status"] == "ok"), "http")
        .when(may_http & may_page & (b["status"] == "ok"), "page_second")
        .when(may_http & may_page & usable, "native_after_both")
        .when(may_http & may_page, "page_second_failed")
        .when(may_http & usable, "native_after_http")
        .when(may_http, "http_failed")
        .otherwise("native")
    )
    rows = rows.withColumn("_outcome", outcome)
    o = F.col("_outcome")
    page = o.isin("page_first", "page_second", "page_first_failed", "page_second_failed")
    web = o.isin("http", "http_failed")
    terminal = o.isin("page_first_failed", "page_second_failed", "http_failed")
    taken = F.when(page, b).when(web, h)
    return rows.withColumns(
        {
            "from_web": page | web,
            "landed_text": F.when(terminal, "").otherwise(taken["text"]),
            "origin": F.when(page, "browser_markdown").when(web, "fetched_html").otherwise(F.col("native_origin")),
            "fetched_length": F.coalesce(taken["length"], F.lit(0)).cast("bigint"),
            "http_status": taken["http"],
            "fetch_error": F.when(o == "page_second", http_note)
            .when(o == "native_after_both", F.concat_ws("; ", http_note, page_note))
            .when(o == "native_after_http", http_note)
            .when(o.isin("http", "native"), before)
            .when(terminal, taken["error"])
            .otherwise(""),
            "terminal": terminal,
            "terminal_status": F.when(terminal, taken["status"]),
        }
    ).drop("_h", "_b", "_outcome")


def take_text(decided: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Rows of ``decide_source`` with their text.

    ``texts`` holds native texts, one per run and URL, for rows that come without:
    the steps before then carry no texts, and each crosses the network once.
    """
    rows = decided
    if texts is not None:
        native = texts.select(F.col("run_date").alias("_run"), F.col("url").alias("_url"), "native_text")
        on = F.col("run_date").eqNullSafe(F.col("_run")) & (F.col("url") == F.col("_url"))
        rows = decided.join(native, on, "left").drop("_run", "_url")
    text = F.when(F.col("from_web"), F.col("landed_text")).otherwise(F.col("native_text"))
    return rows.withColumn("text", text).drop("from_web", "landed_text")


def resolve_text(cands: DataFrame, http: DataFrame, browser: DataFrame) -> DataFrame:
    """Source text of each candidate from what was fetched (see ``decide_source``)."""
    return take_text(decide_source(cands, http, browser))


ModelFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def truncating_model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stand-in for a text model: the opening of the text."""
    for b in batches:
        text = b["text"].fillna("")
        yield pd.DataFrame(
            {
                "key": b["key"],
                "summary": text.str.slice(0, 600),
                "model": "opening",
                "tokens_in": (text.str.len() // 4).astype("int64"),
                "tokens_out": (text.str.len().clip(upper=600) // 4).astype("int64"),
                "tokens_cached": 0,
                "error": "",
            }
        )


MODEL_DDL = (
    "key string, summary string, model string, tokens_in bigint, tokens_out bigint, tokens_cached bigint, error string"
)


def summarize(texts: DataFrame, model: ModelFn = truncating_model) -> DataFrame:
    """Model answers for (key, text) rows, batch by batch, with usage."""
    return texts.select("key", "text").mapInPandas(model, MODEL_DDL)


def canonical_summary(
    resolved: DataFrame,
    model: ModelFn | None = None,
    most: int = 700,
    above: int = 800,
    native_above: int | None = None,
    markers: list[str] | None = None,
) -> DataFrame:
    """Digest summary of each source text.

    Short text passes through cleaned. Long text takes the model's answer when
    that is usable, else the cleaned opening of the text, with the reason.
    Rows need run_date, url, text, origin.
    """
    limit = F.lit(above)
    if native_above:
        limit = F.when(F.col("origin").isin(NATIVE_ORIGINS), native_above).otherwise(above)
    rows = resolved.withColumn("_long", F.length("text") >= limit)
    rows = rows.withColumn("_own", sanitize(F.col("text"), most))
    if model is None:
        rows = rows.withColumns({"_answer": F.lit(""), "_failed": F.lit("")})
        reason = F.when(F.col("_long"), "no_model_config").otherwise("")
        usage = []
    else:
        # Only long texts go to the model, keyed by run and URL.
        key = F.concat_ws("|", F.col("run_date").cast("string"), "url")
        answers = summarize(rows.where("_long").select(key.alias("key"), "text"), model)
        answers = answers.withColumnRenamed("error", "_failed")
        answers = answers.withColumn("_clean", sanitize(py_strip(F.coalesce("summary", F.lit(""))), most)).drop("summary")
        rows = rows.withColumn("_key", key).join(answers, F.col("_key") == F.col("key"), "left")
        rows = rows.withColumn("_answer", F.coalesce("_clean", F.lit("")))
        bad = summary_rejection(F.col("_answer"), F.col("text"), markers)
        reason = (
            F.when(~F.col("_long"), "")
            .when(F.coalesce("_failed", F.lit("")) != "", "llm_error")
            .when(F.col("_answer") == "", "empty_response")
            .otherwise(bad)
        )
        usage = ["model", "tokens_in", "tokens_out", "tokens_cached"]
    rows = rows.withColumn("fallback_reason", reason)
    why = F.col("fallback_reason")
    fell = why != ""
    guarded = fell & ~why.isin("llm_error", "empty_response", "no_model_config")
    # Without a model no answer is rejected. A column apart: beside a Python function of its
    # own the last step would clean each text once per use of ``_own``.
    preview = F.lit("") if model is None else F.when(guarded, sanitize(F.col("_answer"), 300)).otherwise("")
    rows = rows.withColumn("_preview", preview)
    failed = F.when(F.col("_failed") != "", F.col("_failed"))
    return rows.select(
        *resolved.columns,
        *usage,
        F.when(~F.col("_long") | fell, F.col("_own")).otherwise(F.col("_answer")).alias("canonical"),
        F.when(~fell, "ok").when(F.col("_own") != "", "normalizer_fallback").otherwise("llm_failed").alias("status"),
        F.when(~fell, "")
        .otherwise(
            F.coalesce(
                failed,
                F.concat(F.when(F.col("_own") != "", "normalizer fallback: ").otherwise("normalizer failed: "), why),
            )
        )
        .alias("canonical_error"),
        why.alias("fallback_reason"),
        F.col("_preview").alias("rejected_summary_preview"),
    )


def enrich_run(
    items: DataFrame,
    feeds: DataFrame,
    cache: DataFrame,
    http: DataFrame,
    browser: DataFrame,
    now: Column,
    caps: tuple[Mapping[str, int], Mapping[str, int]] | None = None,
    model: ModelFn | None = None,
    least_chars: int = 200,
    use_browser: bool = False,
    above: int = 800,
    native_above: int | None = None,
    most: int = 700,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items with new summaries, records, tier outcomes, new cache entries).

    Every kept URL ends in exactly one of: skipped, cache hit, terminal fetch
    failure, no text, summarised. Duplicates take over the kept summary.
    """
    http_caps, browser_caps = caps or default_caps()
    # Later steps start from tables that are written once. Native texts stay in the first
    # of them until it is known which are summarised.
    cands = cut(candidates(items, feeds, least_chars, use_browser).select(*PLANNED, "native_text"))
    planned, over, _ = budgets(cands.select(*PLANNED), http_caps, browser_caps)
    looked = cut(cache_lookup(planned, cache.drop("url_sha1", "source_name"), now, native_above))
    skipped = looked.where("strategy = 'skip'")
    hits = looked.where("strategy <> 'skip' and cached is not null")
    rest = looked.where("strategy <> 'skip' and cached is null").drop("cached")
    # Budgets keep these few, and a written table tells Spark so.
    asked = cut(rest.where("http_allowed or browser_allowed").select("url", "http_allowed", "browser_allowed"))
    http = asked_results(http, asked.where("http_allowed"))
    browser = asked_results(browser, asked.where("browser_allowed"))
    resolved = cut(decide_source(rest, http, browser))
    blank = F.when(F.col("from_web"), F.col("landed_text") == "").otherwise(F.col("native_length") == 0)
    dead = resolved.where("terminal")
    empty = resolved.where(~F.col("terminal") & blank)
    live = take_text(resolved.where(~F.col("terminal") & ~blank), cands.where("native_text <> '' and strategy <> 'skip'"))
    slim = live.select("run_date", "url", "source", "tier", "native_length", "text", "origin", "fetched_length", "http_status", "fetch_error")
    # A model answers once per text, however often its answer is read.
    answered = canonical_summary(slim, model, most, above, native_above)
    done = cut(answered.withColumn("raw_length", F.length("text")).drop("text"))

    remote = F.col("cached.source_text_origin").isin("fetched_html", "browser_markdown")
    error = F.concat_ws(
        "; ",
        F.when(F.col("fetch_error") != "", F.col("fetch_error")),
        F.when(F.col("canonical_error") != "", F.col("canonical_error")),
    )
    records = over
    for part in (
        skipped.select(*record(F.lit("skipped"), origin=F.col("native_origin"))),
        hits.select(
            *record(
                F.concat(F.lit("cache_hit:"), F.col("cached.status")),
                F.col("cached.error"),
                F.col("cached.source_text_origin"),
                F.when(remote, F.col("cached.raw_length")).otherwise(0),
                F.col("cached.summary_length"),
                F.col("cached.http_status"),
                F.col("cached.fallback_reason"),
                F.col("cached.rejected_summary_preview"),
            )
        ),
        dead.select(
            *record(F.col("terminal_status"), F.col("fetch_error"), F.col("origin"), F.col("fetched_length"), http=F.col("http_status"))
        ),
        empty.select(*record(F.lit("no_source_text"), origin=F.col("origin"), http=F.col("http_status"))),
        done.select(
            *record(
                F.col("status"),
                error,
                F.col("origin"),
                F.col("fetched_length"),
                F.length("canonical"),
                F.col("http_status"),
                F.col("fallback_reason"),
                F.col("rejected_summary_preview"),
            )
        ),
    ):
        records = records.unionByName(part)

    usable_hit = F.col("cached.status").isin("ok", "normalizer_fallback", "llm_failed")
    better = hits.where(usable_hit & (F.coalesce("cached.canonical_summary", F.lit("")) != "")).select(
        "run_date", "url", F.col("cached.canonical_summary").alias("summary")
    )
    better = better.unionByName(done.where("canonical <> ''").select("run_date", "url", F.col("canonical").alias("summary")))
    out = propagate_to_duplicates(items, better, "summary", ["run_date", "url"])

    def entry(df: DataFrame, status: Column, summary: Column, length: Column, err: Column, why: Column, preview: Column) -> DataFrame:
        return df.select(
            "url",
            F.sha1("url").alias("url_sha1"),
            now.alias("fetched_at"),
            status.alias("status"),
            F.col("http_status"),
            length.cast("bigint").alias("raw_length"),
            F.length(summary).cast("bigint").alias("summary_length"),
            summary.alias("canonical_summary"),
            F.col("origin").alias("source_text_origin"),
            F.col("source").alias("source_name"),
            err.alias("error"),
            why.alias("fallback_reason"),
            preview.alias("rejected_summary_preview"),
            F.lit(CACHE_VERSION).alias("cache_version"),
            component_version(F.col("origin")).alias("component_version"),
        )

    none = F.lit("")
    fresh = entry(
        dead, F.col("terminal_status"), none, F.col("fetched_length"), F.col("fetch_error"), none, none
    ).unionByName(
        entry(
            done.where("canonical <> ''"),
            F.col("status"),
            F.col("canonical"),
            F.col("raw_length"),
            error,
            F.col("fallback_reason"),
            F.col("rejected_summary_preview"),
        )
    )
    return out, records, tier_outcomes(records), fresh
