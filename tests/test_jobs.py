"""Plans on small literal tables."""

import datetime as dt
import json
import random
import time
import tracemalloc

from pyspark.sql import functions as F

from newsloom.operators import contracts as C
from newsloom.operators import routing as D
from newsloom.operators import weather as W
from newsloom.operators.validation import validate_dives, validate_seams
from newsloom.plans import collect, edition, enrich, week
from newsloom.plans import health as H
from newsloom.sources import api, feeds, markup, tables

NOW = "2024-01-10 12:00:00"
LINKS = "array<struct<url:string,label:string>>"


def now():
    return F.lit(NOW).cast("timestamp")


def test_health_rules(spark):
    rows = [
        ("a", "active", 0, 500, None, None),
        ("b", "active", 3, 500, None, None),
        ("c", "active", 9, 50, None, None),
        ("d", "active", 9, 500, 0.5, None),
        ("e", "active", 9, 50, 0.9, 0.5),
        ("f", "broken", 1, 500, None, 0.9),
        ("g", "headline_radar", 9, 10, 0.9, 0.9),
        ("h", "low_frequency", 0, 0, None, None),
    ]
    df = spark.createDataFrame(rows, "n string, h string, i int, m int, f double, e double")
    c = {x: F.col(x) for x in "himfe"}
    out = df.select("n", "h", H.computed_health(c["h"], c["i"], c["m"], c["f"], c["e"]).alias("x"))
    got = {r.n: (r.x, r.t) for r in out.withColumn("t", H.status_transition(F.col("h"), F.col("x"))).collect()}
    assert got == {
        "a": ("degraded", "worse"),
        "b": ("low_frequency", "worse"),
        "c": ("enrichment_required", "worse"),
        "d": ("enrichment_required", "worse"),
        "e": ("degraded", "worse"),
        "f": ("degraded", "better"),
        "g": ("headline_radar", "unchanged"),
        "h": ("low_frequency", "unchanged"),
    }


def test_health_of_feed_without_items(spark):
    feed = spark.createDataFrame([("quiet", "active")], "name string, health string")
    items = spark.createDataFrame([], "run_date date, source string, summary string")
    records = spark.createDataFrame([], "run_date date, source string, status string, native_length bigint")
    r = H.source_health(feed, items, records, "2024-01-10", 14).first()
    assert (r["items"], r.median_chars, r.empty_rate, r.enrichment_success_rate) == (0, 0, 0.0, None)
    assert r.computed_health == "degraded" and r.observations == ["Zero items in 14-day window"]


ITEM = "run_date string, pos int, source string, url string, rss_body string, summary string"
FEED = (
    "name string, health string, priority int, enrich struct<strategy:string,skip:boolean,fetch_article:boolean,"
    "cookies_file:string,skip_reason:string,title_only_ok:boolean>"
)
LANDED = "url string, text string, status string, http_status int, length bigint, error string"


def feed(name, strategy=None, health="active", skip=False):
    return (name, health, 0, (strategy, skip, False, "", "", False))


def test_enrich_run(spark):
    long = "word " * 100
    items = spark.createDataFrame(
        [
            ("r", 0, "skip", "u0", "native", ""),
            ("r", 1, "auto", "u1", "", "x"),
            ("r", 2, "auto", "u1", "", "copy"),
            ("r", 3, "auto", "u3", long, ""),
            ("r", 4, "fetch", "u4", "", "old"),
            ("r", 5, "fetch", "u5", long, "old"),
            ("r", 6, "auto", "u6", "", "cached before"),
            ("r", 7, "auto", "", "", "no url"),
            ("r", 8, "big", "u8", "b" * 900, ""),
        ],
        ITEM,
    )
    dims = spark.createDataFrame([feed("skip", skip=True), feed("auto"), feed("fetch", "fetch"), feed("big")], FEED)
    http = spark.createDataFrame(
        [("u1", "fetched one", "ok", 200, 11, ""), ("u4", "", "paywall", 200, 50, ""), ("u5", "", "http_error", 503, 0, "down")],
        LANDED,
    )
    cache = spark.createDataFrame(
        [("u6", "k", dt.datetime(2024, 1, 9), "ok", 200, 9, 4, "kept", "fetched_html", "auto", "", "", "", 4, 1)],
        enrich.CACHE_DDL,
    )
    out, records, outcomes, fresh = enrich.enrich_run(items, dims, cache, http, http.limit(0), now())
    status = {r.url: (r.status, r.source_text_origin, r.error) for r in records.collect()}
    assert status == {
        "u0": ("skipped", "rss_body", ""),
        "u1": ("ok", "fetched_html", ""),
        "u3": ("ok", "rss_body", ""),
        "u4": ("paywall", "fetched_html", ""),
        "u5": ("ok", "rss_body", "fetch http_error: down"),
        "u6": ("cache_hit:ok", "fetched_html", ""),
        "u8": ("normalizer_fallback", "rss_body", "normalizer fallback: no_model_config"),
    }
    summary = {r.pos: r.summary for r in out.collect()}
    assert summary[1] == summary[2] == "fetched one" and summary[6] == "kept" and summary[4] == "old"
    assert summary[7] == "no url" and summary[8].endswith("…") and len(summary[8]) == 700
    assert {r.url for r in fresh.collect()} == {"u1", "u3", "u4", "u5", "u8"}
    row = outcomes.where("tier = 'active'").first()
    assert (row.records, row.attempted, row.succeeded, row.fallback) == (7, 6, 4, 1)


def test_fetch_budget_skips_are_recorded(spark):
    items = spark.createDataFrame([("r", i, "auto", f"u{i}", "", "s" * (9 - i)) for i in range(4)], ITEM)
    dims = spark.createDataFrame([feed("auto")], FEED)
    none = spark.createDataFrame([], LANDED)
    cache = spark.createDataFrame([], enrich.CACHE_DDL)
    _, records, _, _ = enrich.enrich_run(items, dims, cache, none, none, now(), ({"active": 1}, {}))
    skipped = [r for r in records.collect() if r.status == "skipped_fetch_cap"]
    assert {r.url for r in skipped} == {"u0", "u1", "u2"}
    assert "rank_reason=short_native_text; candidates=4; cap=1" in skipped[0].error


def test_enrichment_carries_texts_once(spark):
    """Texts are written once, cleaned once, and landed results count only where they were asked for."""
    from pathlib import Path

    from newsloom.session import checkpoint_dir

    def written():
        root = Path(checkpoint_dir(spark).removeprefix("file:"), "tables")
        return {str(p) for p in root.iterdir()} if root.exists() else set()

    long = "word " * 100
    items = spark.createDataFrame(
        [
            ("r", 0, "auto", "u0", long, ""),
            (None, 1, "auto", "u0", long + "other", ""),
            ("r", 2, "fetch", "u2", "", ""),
            ("r", 3, "fetch", "u3", long, ""),
            ("r", 4, "auto", "u4", "", ""),
        ],
        ITEM,
    )
    dims = spark.createDataFrame([feed("auto"), feed("fetch", "fetch")], FEED)
    http = spark.createDataFrame(
        [("u0", "unasked", "ok", 200, 7, ""), ("u2", "fetched", "ok", 200, 7, ""), ("u3", "beyond", "ok", 200, 6, ""), ("u4", "", "ok", 200, 0, "")], LANDED
    )
    before = written()
    caps = ({"active": 2}, {})
    _, records, _, fresh = enrich.enrich_run(items, dims, spark.createDataFrame([], enrich.CACHE_DDL), http, http.limit(0), now(), caps)
    got = {(r.run_date, r.url, r.status, r.source_text_origin, r.summary_length) for r in records.collect()}
    assert got == {
        ("r", "u0", "ok", "rss_body", 499),
        (None, "u0", "ok", "rss_body", 505),
        ("r", "u2", "ok", "fetched_html", 7),
        ("r", "u3", "ok", "rss_body", 499),
        ("r", "u3", "skipped_fetch_cap", "", 0),
        ("r", "u4", "no_source_text", "fetched_html", 0),
    }
    assert {(r.url, r.raw_length, r.canonical_summary[-5:]) for r in fresh.collect()} == {
        ("u0", 499, " word"), ("u0", 505, "other"), ("u2", 7, "tched"), ("u3", 499, " word"),
    }
    tables = [set(spark.read.parquet(p).columns) for p in written() - before]
    assert len([t for t in tables if t & {"rss_body", "native_text", "text"}]) == 1

    rows = spark.createDataFrame([("r", "u", "t" * 900, "rss_body")], "run_date string, url string, text string, origin string")
    for model, most in ((None, 2), (enrich.truncating_model, 6)):
        plan = enrich.canonical_summary(rows, model)._jdf.queryExecution().executedPlan().toString()
        assert 1 <= plan.count("pretend you are") <= most


def test_model_answers_are_guarded(spark):
    def model(batches):
        for b in batches:
            answer = {"r|a": "The user wants a summary", "r|b": "", "r|c": "fine " * 30, "r|d": "tiny"}
            yield b.assign(
                summary=b["key"].map(answer), model="m", tokens_in=1, tokens_out=1, tokens_cached=0, error=""
            )[["key", "summary", "model", "tokens_in", "tokens_out", "tokens_cached", "error"]]

    rows = [("r", u, "t" * 900, "fetched_html") for u in "abcd"] + [("r", "e", "short", "summary")]
    df = spark.createDataFrame(rows, "run_date string, url string, text string, origin string")
    got = {r.url: (r.status, r.fallback_reason) for r in enrich.canonical_summary(df, model).collect()}
    assert got == {
        "a": ("normalizer_fallback", "meta_response:the user wants"),
        "b": ("normalizer_fallback", "empty_response"),
        "c": ("ok", ""),
        "d": ("normalizer_fallback", "too_short"),
        "e": ("ok", ""),
    }


def test_cache_freshness(spark):
    day = dt.datetime(2024, 1, 10, 12)
    rows = []
    for url, status, age, version in (
        ("ok", "ok", 29 * 24, 4),
        ("old", "ok", 31 * 24, 4),
        ("fail", "paywall", 23, 4),
        ("failold", "paywall", 25, 4),
        ("version", "ok", 1, 3),
    ):
        at = day - dt.timedelta(hours=age)
        rows.append((url, "k", at, status, 200, 1, 1, "s", "fetched_html", "n", "", "", "", version, 1))
    cache = spark.createDataFrame(rows, enrich.CACHE_DDL)
    assert {r.url for r in enrich.valid_entries(cache, now()).collect()} == {"ok", "fail"}
    assert {r.url for r in enrich.cache_prune(cache, now()).collect()} == {"ok", "fail", "failold", "version"}


DESK = (
    f"run_date string, desk string, desk_pos int, pos int, item_id string, tag string, headline string, facts string,"
    f" analysis string, source_depth string, links {LINKS}, connection_hooks array<struct<entity:string>>,"
    f" deep_dive_candidate boolean, deep_dive_rationale string"
)


def test_edition_build(spark):
    words = " ".join(f"w{i}" for i in range(14))

    def item(desk, at, pos, i, tag, links, dive=False, facts="f"):
        return ("r", desk, at, pos, i, tag, f"head {i}", facts, "a", "widely-reported", links, [], dive, None)

    desk = spark.createDataFrame(
        [
            item("geopolitics_events", 0, 0, "g", "war", [("http://a.com/1", "A: x"), ("http://b.com/2?utm_source=q", "B")]),
            item("ai_tech", 1, 0, "t", "ai", [("http://a.com/3", "A"), ("http://www.a.com/4", "A")], facts=words),
            item("defense_space", 2, 0, "d", "defense", [], dive=True),
            item("defense_space", 2, 1, "e", "defense", [("http://c.com/5", "C")]),
        ],
        DESK,
    )
    picks = spark.createDataFrame(
        [("r", 0, "t", "note"), ("r", 1, "ghost", None), ("r", 2, "g", "")],
        "run_date string, pos int, item_id string, cross_domain_note string",
    )
    dives = spark.createDataFrame(
        [("r", 0, "Dive", f"<p>{words}</p>", "", [("http://b.com/2", "B"), ("http://a.com/1/", "A"), ("http://zz.org", "Z")], "widely-reported")],
        f"run_date string, pos int, headline string, body string, why_it_matters string, further_reading {LINKS}, source_depth string",
    )
    reading = spark.createDataFrame([("r", 0, "t", "http://evil.org")], "run_date string, pos int, title string, url string")
    known = spark.createDataFrame(
        [("r", u) for u in ("http://a.com/1", "http://b.com/2", "http://a.com/3", "http://www.a.com/4", "http://c.com/5")],
        "run_date string, url string",
    )
    out = edition.build_edition(picks, desk, dives, reading, known)
    glance = [(r.item_id, r.tag_label, r.source_depth, r.cross_domain_note) for r in out.glance.orderBy("rank").collect()]
    assert glance == [
        ("t", "AI", "single-source", "note"),
        ("g", "Conflict", "corroborated", None),
        ("e", "Defense", "single-source", None),
    ]
    dive = out.dives.first()
    assert [x.url for x in dive.further_reading] == ["http://b.com/2", "http://a.com/1/"]
    # Exact URLs of desk items decide the desks; only the canonical twin matches here.
    assert dive.domains_bridged == []
    assert dive.source_depth == "single-source"  # corroborated by outlets, lowered by wording
    assert out.reading.first().url == ""
    assert {(r.override, r["count"]) for r in out.overrides.collect()} == {
        ("recompute_source_depth", 4),
        ("overlap_downgrade", 1),
        ("ensure_primary_glance_coverage", 1),
    }
    reasons = {r.reason for r in out.downgrades.collect()}
    assert reasons == {None, "phrase_overlap_with_at_a_glance"}


def test_assembly(spark):
    rows = [("r", i, f"i{i}", "ai", "", f"h{i}", "f", "a", None, [("http://www.x.com/1", "X")]) for i in range(3)]
    glance = spark.createDataFrame(
        rows,
        f"run_date string, pos int, item_id string, tag string, tag_label string, headline string, facts string, analysis string, cross_domain_note string, links {LINKS}",
    )
    dives = spark.createDataFrame([("r", 0, "d", [])], f"run_date string, pos int, headline string, further_reading {LINKS}")
    notes = spark.createDataFrame(
        [("r", 0, "i0", "low", "first", "x"), ("r", 1, "i0", "HIGH", "best", "x"), ("r", 2, "i0", "high", "later", "x"), ("r", 3, "i1", "high", " ", "x")],
        "run_date string, pos int, item_id string, confidence string, one_line string, seam_type string",
    )
    short, long, found = edition.assemble_edition(glance, dives, notes)
    got = {r.item_id: (r.context, r.seam_annotation and r.seam_annotation.one_line) for r in short.collect()}
    assert got == {"i0": ("f a", "best"), "i1": ("f a", None)}
    assert long.count() == 1 and found.first().headline == "h2"


def test_validation_paths(spark):
    known = spark.createDataFrame([("r", "http://ok.org/a")], "run_date string, url string")
    dives = spark.createDataFrame(
        [("r", 2, "h", "<div><p>x</p></div>", None, [("http://ok.org/a", "a"), ("http://ok.org/b", "b"), ("", "c"), ("http://no.org", "d")])],
        f"run_date string, pos int, headline string, body string, why_it_matters string, further_reading {LINKS}",
    )
    clean, issues = validate_dives(dives, known)
    assert clean.first().body == "<p>x</p>" and [x.label for x in clean.first().further_reading] == ["a"]
    assert {(r.path, r.reason) for r in issues.collect()} == {
        ("deep_dives[2].further_reading[1].url", "known_domain_unknown_path"),
        ("deep_dives[2].further_reading[3].url", "unknown_domain"),
    }
    seams = spark.createDataFrame(
        [("r", 0, "t", None, "x", "y", [("http://no.org", "d")])],
        f"run_date string, pos int, topic string, description string, sources_a string, sources_b string, links {LINKS}",
    )
    clean, issues = validate_seams(seams, known, "contested")
    assert clean.first().description == "" and issues.first().path == "contested.links[0].url"


def test_contract_shapes(spark):
    docs = [
        ("r", "a", 0, '[{"headline":"bare"}]'),
        ("r", "b", 1, '"text"'),
        ("r", "c", 2, '{"items":{"no":"list"}}'),
        ("r", "econ", 3, '{"items":[{"deep_dive_candidate":"Yes","deep_dive_rationale":null,"x":{"y":1}}],"market_context":7}'),
        ("r", "d", 4, "{broken"),
    ]
    raw = spark.createDataFrame(docs, "run_date string, desk string, desk_pos int, raw string")
    good, issues = C.desk_results(raw)
    rows = {r.desk: r for r in good.collect()}
    assert set(rows) == {"a", "econ"} and rows["a"].headline == "bare"
    assert rows["econ"].deep_dive_candidate and rows["econ"].deep_dive_rationale is None
    assert rows["econ"].extra == {"x": '{"y":1}'}
    assert {(r.path, r.message) for r in issues.collect()} == {
        ("domain_analysis.b", "domain result is not an object"),
        ("domain_analysis.c.items", "items is not a list"),
        ("domain_analysis.d", "domain result is not an object"),
    }
    assert C.market_context(raw).first().market_context == "7"


def test_evidence_gate(spark):
    ev = "array<struct<source:string,excerpt:string,framing:string>>"
    rows = [
        (0, [("a", "q", ""), ("A ", "r", "")]),
        (1, [("a", "q", ""), ("b", " ", "")]),
        (2, [("a", "q", ""), ("b", "r", "")]),
        (3, [("a", "q", "")]),
    ]
    df = spark.createDataFrame(rows, f"i int, e {ev}")
    assert [r.i for r in df.where(C.passes_evidence_gate(F.col("e"))).collect()] == [2]


def test_seam_ids_unchecked_without_desk_items(spark):
    raw = spark.createDataFrame(
        [("r", json.dumps({"per_item": [{"item_id": "x", "evidence": "no"}, 3], "cross_domain": None}))],
        "run_date string, raw string",
    )
    desk = spark.createDataFrame([], f"run_date string, item_id string, links {LINKS}, desk_pos int, pos int")
    own, cross, issues = C.seam_annotations(raw, desk)
    assert own.first().confidence == "medium" and cross.count() == 0
    assert {r.path for r in issues.collect()} == {
        "seam_annotations.cross_domain",
        "seam_annotations.per_item[0].evidence",
        "seam_annotations.per_item[1]",
    }


DESKS = {
    "geopolitics_events": {"categories": ["non-western", "maritime"], "channels": ["Perun"]},
    "perspective": {"categories": ["perspective-diversity"]},
    "econ": {"categories": ["econ-trade"], "channels": []},
}


def test_desk_manifest():
    desks = D.resolve_desks(DESKS, [{"name": "geopolitics", "categories": ["x"]}, {"name": "nope"}, {"name": "econ"}, 5])
    assert [(d[0], d[2]) for d in desks] == [("geopolitics_events", ["x"]), ("econ", ["econ-trade"])]
    assert len(D.resolve_desks(DESKS)) == 3 and len(D.resolve_desks(DESKS, [{"name": "nope"}])) == 3


def test_weather_day_limit_and_mirror(spark):
    rows = []
    for i in range(9):
        date = f"2026-01-0{i + 1}"
        temp = None if i == 2 else 10.0 + i
        rows.append(("r", 2 * i, date, True, temp, "Day", "day text", "", "", None))
        if i != 8:
            rows.append(("r", 2 * i + 1, date, False, None if i in (2, 3) else 1.0 + i, "Night", "night text", "", "", 0.0))
    p = spark.createDataFrame(
        rows,
        "run_date string, pos int, date string, is_daytime boolean, temperature double, short_forecast string,"
        " detailed_forecast string, wind_speed string, wind_direction string, precip_chance double",
    )
    got = {r.date[-1]: (r.high_f, r.low_f, r.detailed_forecast, r.short_forecast) for r in W.fold_periods(p).collect()}
    assert set(got) == set("124567") and got["4"][:2] == (13, 13)
    assert got["1"] == (10, 1, "day text night text", "Day")


def test_week_ahead_and_units(spark):
    kinds = "run_date string, pos int, date string, event string"
    a = spark.createDataFrame([("r", 0, "2026-03-05", "h"), ("r", 1, "", "blank")], kinds)
    b = spark.createDataFrame([("r", 0, "2026-03-04T10:00:00Z", "c")], kinds)
    none = spark.createDataFrame([], kinds)
    got = [r.event for r in week.week_ahead(a, b, none, none, 2).orderBy("rank").collect()]
    assert got == ["c", "h"]

    units = spark.createDataFrame(
        [
            ("w", 0, "x", "THEME", "t", "", [" R1 ", ""]),
            ("w", 1, "x", "misuse_correction", "m", "A", ["B"]),
            ("w", 2, "", "key_scripture", "k", "", []),
        ],
        "week_start string, pos int, id string, kind string, title string, anchor_ref string, source_refs array<string>",
    ).withColumns({c: F.lit("") for c in ("core_claim", "supporting_excerpt", "enhancement", "application", "prompt_hint")})
    n = week.normalize_units(units)
    rows = {r.pos: r for r in n.collect()}
    assert [rows[i].id for i in range(3)] == ["x", "focus-2", "focus-3"]
    assert [rows[i].kind for i in range(3)] == ["narrative_unit", "misuse_correction", "key_scripture"]
    assert rows[0].anchor_ref == "R1" and rows[1].source_refs == ["A", "B"]
    misuses = spark.createDataFrame(
        [("w", 0, "m", "", "", ""), ("w", 1, "new", "c", "u", "b"), ("w", 2, "more", "", "", "")],
        "week_start string, pos int, text string, correction string, common_use string, cost_bearer string",
    )
    full = week.top_up_corrections(n, misuses)
    assert [r.title for r in full.orderBy("pos").collect()] == ["t", "m", "k", "new"]
    raw = spark.createDataFrame([("w", "tuesday", "focus-2"), ("w", "friday", "ghost")], "week_start string, day string, unit_id string")
    seq = week.proposed_sequence(full, raw)
    dates = spark.createDataFrame(
        [(dt.date(2026, 3, 3), "w"), (dt.date(2026, 3, 4), "w"), (dt.date(2026, 3, 8), "w")], "date date, week_start string"
    )
    got = {r.date.day: r.unit_id for r in week.unit_of_day(full, seq, dates).collect()}
    assert got == {3: "focus-2", 4: "focus-2", 8: "focus-2"}
    empty = week.proposed_sequence(full, raw.limit(0))
    assert {r.day: r.unit_id for r in empty.collect()}["monday"] == "x"


def test_index_page_items(spark):
    html = """<a href="/a/one">A long enough article title</a><a href="/a/one">A long enough article title</a>
    <a href="/tag/x">Another long enough title here</a><a href="https://other.org/b">Other site has long titles too</a>
    <a href="/b">short</a><a href="https://sub.h.com/c">  Second   long article   title </a><a href="/feed.xml">Some feed with long title text</a>"""
    pages = spark.createDataFrame(
        [("r", "s", "https://h.com/news", html, dt.datetime(2024, 1, 1), "c", "t")],
        "run_date string, source string, url string, html string, fetched_at timestamp, category string, tag string",
    )
    got = [(r.url, r.title, r.freshness) for r in markup.index_items(pages).orderBy("pos").collect()]
    assert got == [
        ("https://h.com/a/one", "A long enough article title", "retrieved_at"),
        ("https://sub.h.com/c", "Second long article title", "retrieved_at"),
    ]


def test_feed_age_before_cap(spark):
    entry = "run_date string, source string, category string, tag string, pos int, " + feeds.ENTRY_DDL
    rows = []
    for i, when in enumerate(["Mon, 01 Jan 2024 00:00:00 GMT", "Wed, 10 Jan 2024 10:00:00 GMT", "", "Wed, 10 Jan 2024 11:00:00 GMT"]):
        rows.append(("r", "s", "c", "t", i, f" T{i} ", f"http://x/{i}", "<p>desc</p>", "", when, None, None, ["", "  "], ""))
    df = spark.createDataFrame(rows, entry)
    got = [(r.title, r.summary, r.rss_body) for r in feeds.feed_items(df, now(), {"s": 2}).orderBy("pos").collect()]
    assert got == [("T1", "desc", "<p>desc</p>"), ("T2", "desc", "<p>desc</p>")]


def test_feed_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        "<rss><channel><item><title>A</title><link>http://a</link><pubDate>x</pubDate></item>"
        "<item><title>B</title><description>d</description></item></channel></rss>"
    )
    got = sorted(r.title for r in feeds.read_feed_xml(spark, str(tmp_path / "f.xml")).collect())
    assert got == ["A", "B"]


def test_collect_diagnostics(spark):
    rows = []
    for i, (health, skipped, payload) in enumerate(
        [("active", False, "p"), ("broken", False, "p"), ("active", True, None)] + [("active", False, None)] * 3 + [("active", False, "p")]
    ):
        rows.append(("r", i, f"s{i}", f"http://{i}", "rss", health, skipped, 200, payload, "c", "t"))
    fetches = spark.createDataFrame(
        rows,
        "run_date string, pos int, source string, url string, mode string, health string, skipped boolean,"
        " status_code int, payload string, category string, tag string",
    )
    entry = "run_date string, source string, category string, tag string, pos int, " + feeds.ENTRY_DDL
    entries = spark.createDataFrame(
        [("r", s, "c", "t", 0, "T", "http://x", "d", "", "", None, None, [], "") for s in ("s0", "s1", "s6")], entry
    )
    items, report = collect.collect_items(fetches, entries, now(), limit=3)
    assert [r.source for r in items.collect()] == ["s0"]
    assert {r.source: r.status for r in report.collect()} == {
        "s0": "ok",
        "s1": "skipped_broken",
        "s2": "skipped_cooldown",
        "s3": "http_error",
        "s4": "http_error",
        "s5": "http_error",
    }


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, d), d) for d in (1, 5, 9)], "run_date date, v int")
    base = str(tmp_path)
    tables.save_runs(df, base, "t")
    tables.save_runs(df.where("v = 9").withColumn("v", F.lit(10)), base, "t")
    back = tables.read_table(spark, base, "t")
    assert sorted(r.v for r in back.collect()) == [1, 5, 10]
    assert [r.v for r in tables.latest_run(back).collect()] == [10]
    assert [r.v for r in tables.run_before(back, "2024-01-09").collect()] == [5]
    keep, drop = tables.retention(back, "2024-01-10", 5)
    assert sorted(r.v for r in keep.collect()) == [5, 10] and [r.run_date.day for r in drop.collect()] == [1]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"v": 1}\n{"v": \n')
    from pyspark.sql import types as T

    good, bad = tables.read_landed_json(spark, str(tmp_path / "j"), T.StructType([T.StructField("v", T.IntegerType())]))
    assert [r.v for r in good.collect()] == [1] and bad.count() == 1


def test_api_readers(spark):
    def doc(value):
        return spark.createDataFrame([("r", json.dumps(value))], "run_date string, payload string")

    daily = {"daily": {"time": ["2026-01-01", "2026-01-02"], "temperature_2m_max": [10.5], "temperature_2m_min": [1.5, 2.5], "weather_code": [95, 0]}}
    assert [(r.date, r.high_f, r.low_f, r.condition) for r in api.daily_forecast(doc(daily)).collect()] == [
        ("2026-01-01", 10, 2, "Thunderstorm")
    ]
    air = [{"DateForecast": "2026-01-01 ", "AQI": 40}, {"DateForecast": "2026-01-01", "AQI": None}, {"DateForecast": "", "AQI": 9}]
    assert [(r.date, r.aqi, r.aqi_label) for r in api.air_forecast(doc(air)).collect()] == [("2026-01-01", None, "Moderate")]
    assert api.air_now(doc([{"AQI": 120, "PM2.5": 3.5}])).first().current_aqi_label.startswith("Unhealthy for")
    obs = {"properties": {"temperature": {"value": 10.0}, "windSpeed": {"value": 4.0}, "textDescription": "Fair"}}
    got = api.current_conditions(doc(obs)).first()
    assert (got.temperature_f, got.wind_mph, got.humidity) == (50, 9, None)
    events, notes = api.on_this_day(doc({"selected": [], "events": []}))
    assert events.count() == 0 and notes.first().status == "ok_empty"


def test_runs_in_several_documents(spark):
    def docs(*payloads):
        return spark.createDataFrame([("r", i, p and json.dumps(p)) for i, p in payloads], "run_date string, part int, payload string")

    air = api.air_forecast(docs((1, [{"DateForecast": "2026-01-01", "AQI": 7}]), (0, [{"DateForecast": "x"}, {"DateForecast": "2026-01-01", "AQI": 9}])))
    assert [(r.date, r.aqi) for r in air.orderBy("date").collect()] == [("2026-01-01", 7), ("x", None)]
    one = {"year": "1", "text": "b"}
    events, notes = api.on_this_day(docs((1, {"selected": [one, one, one]}), (0, {"selected": [{"year": "0", "text": "a"}]}), (2, None)), 3)
    assert [(r.pos, r.year) for r in events.orderBy("pos").collect()] == [(0, "0"), (1, "1"), (2, "1")]
    assert notes.count() == 0
    assert api.on_this_day(docs((0, None), (1, {"selected": []})))[1].first().status == "failed"
    items = spark.createDataFrame([(i, json.dumps({"type": "story", "title": "t", "score": i})) for i in range(5)], "id long, payload string")
    assert [(r.id, r["rank"]) for r in api.stories(docs((1, [4, 3]), (0, [1, 2])), items, 3).orderBy("rank").collect()] == [(4, 1), (2, 2), (1, 3)]
    flight = {"net": "2026-01-01T00:00:00Z"}
    parts = docs((1, {"results": [flight | {"name": "c"}]}), (0, {"results": [flight | {"name": "a"}, flight | {"name": "b"}]}))
    listed = api.launches(parts, F.lit("2026-01-01").cast("timestamp"))
    assert [r.name for r in listed.orderBy("rank").collect()] == ["a", "b", "c"]


def test_landed_documents_are_bounded(spark, tmp_path, monkeypatch):
    from newsloom.catalog import desks

    n = 1_300
    spark.range(n).selectExpr(
        "id as event_id", "7L as user_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 3 as int)) as ts",
        "'view' as event_type", "cast(id as double) as value",
    ).write.parquet(f"{tmp_path}/events.parquet")
    seen, read = [], desks.A.air_forecast
    monkeypatch.setattr(desks.A, "air_forecast", lambda docs: seen.append(docs) or read(docs))
    got = {(r.date, r.aqi) for r in desks._air(spark, str(tmp_path)).collect()}
    assert got == {("2024-01-01", 1299), ("2024-01-02", 1297), ("2024-01-03", 1298)}
    sizes = [len(json.loads(r.payload)) for r in seen[0].collect()]
    assert sum(sizes) == n and max(sizes) <= 500


def test_atom_beside_rss(spark, tmp_path):
    rss = "<rss><channel><item><title>A</title><link>http://a</link></item></channel></rss>"
    atom = (
        '<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title><link href="http://feed"/>'
        '<entry><title type="html">B</title><link rel="self" href="http://b/self"/><link rel="alternate" href="http://b"/>'
        "<published>2024-01-10T11:00:00Z</published><summary>s</summary></entry>"
        '<entry><title>C</title><link href="http://c"/><updated>2024-01-10T11:00:00Z</updated><content type="html">body c</content></entry>'
        '<entry><title>D</title><link rel="enclosure" href="http://d"/></entry></feed>'
    )
    rdf = "<rdf><channel><title>x</title></channel><item><title>E</title><link>http://e</link></item></rdf>"
    rows = [("r", str(i), p) for i, p in enumerate([rss, atom, rdf, "<html><body>no feed</body></html>", ""])]
    landed = spark.createDataFrame(rows, "run_date string, source string, payload string")
    got = {(r.source, r.pos, r.title, r.link) for r in feeds.parse_payloads(landed).collect()}
    assert got == {("0", 0, "A", "http://a"), ("1", 0, "B", "http://b"), ("1", 1, "C", "http://c"), ("1", 2, "D", "http://d"), ("2", 0, "E", "http://e")}
    entries = feeds.parse_payloads(landed).withColumns({"category": F.lit("c"), "tag": F.lit("t")})
    items = {r.title: r for r in feeds.feed_items(entries, now()).collect()}
    assert items["C"].summary == "body c" and items["B"].url == "http://b" and items["B"].published is not None
    assert {(r.source, r.issue) for r in feeds.payload_issues(landed).collect()} == {("3", "no entries"), ("4", "empty payload")}
    (tmp_path / "a.xml").write_text(atom)
    files = feeds.read_feed_xml(spark, str(tmp_path / "a.xml"), "entry")
    assert {(r.title, r.link) for r in files.collect()} == {("B", "http://b"), ("C", "http://c"), ("D", "http://d")}
    assert files.columns == feeds.read_feed_xml(spark, str(tmp_path / "a.xml")).columns


def test_unit_ids(spark):
    def ids(*given):
        rows = [("w", i, x) + ("",) * 6 + ([],) for i, x in enumerate(given)]
        names = "kind title anchor_ref core_claim supporting_excerpt enhancement application prompt_hint".split()
        rows = [("w", i, x, *[""] * 8, []) for i, x in enumerate(given)]
        ddl = "week_start string, pos int, id string, " + ", ".join(f"{n} string" for n in names) + ", source_refs array<string>"
        return [r.id for r in week.normalize_units(spark.createDataFrame(rows, ddl)).orderBy("pos").collect()]

    assert ids("A", "A", "focus-2") == ["A", "focus-2", "focus-3"]
    assert ids("", None, " x ", "x") == ["focus-1", "focus-2", "x", "focus-4"]


def test_legacy_foci(spark):
    foci = spark.createDataFrame(
        [("2026-01-05", 0, "focus-1", "Mosiah 2:17", "Serving others."), ("w2", 0, "z", "b", "c")],
        "week_start string, pos int, id string, text_ref string, guide_excerpt string",
    )
    own = week.legacy_units(foci.where("week_start = 'w2'")).withColumn("id", F.lit("own"))
    out = {r.week_start: r for r in week.normalize_units(week.week_units(own, foci)).collect()}
    assert out["w2"].id == "own"
    one = out["2026-01-05"]
    assert (one.id, one.kind, one.anchor_ref, one.source_refs) == ("focus-1", "narrative_unit", "Mosiah 2:17", ["Mosiah 2:17"])
    assert week.reflection(spark.createDataFrame([one])).first().reflection == "Serving others."


def test_page_elements(spark):
    html = (
        '<article class="x Box-row"><h2><a href="http://off">no</a><a href="/o/p"> o /\n <b>p</b></a></h2><p> </p><p>about it</p>'
        '<span itemprop="programmingLanguage">SQL</span><br><span class="d float-sm-right">5 stars</span>'
        '<article class="Box-row"><a href="/in/ner">i</a></article></article>'
        '<article class="other"><a href="/q">q</a></article><article class="Box-row"><a href="/r/s">r / s</a></article>'
        '<a href="/open">never ended'
    )
    pages = spark.createDataFrame([("k", html), ("none", None)], "page_id string, html string")
    got = [(r.pos, r.name, r.url, r.description, r.language, r.stars_today) for r in markup.repository_cards(pages).orderBy("pos").collect()]
    assert got == [(0, "o/p", "https://github.com/o/p", "about it", "SQL", "5 stars"), (1, "r/s", "https://github.com/r/s", "", "", "")]
    nested = '<a href="/1">x<a href="/2">y</a>z</a><a name="n">w</a><a href="">v</a><A HREF="/3">&amp;<i>t</i></A>'
    links = spark.createDataFrame([(nested,)], "html string").select(markup.anchors(F.col("html")).alias("a")).first().a
    assert [(x.href, x.text) for x in links] == [("/2", "y"), ("/3", "&t")]


def test_cards_of_a_long_page(spark):
    """Cards and links of a page with very many: time in proportion, nested and open ones apart."""
    n = 8_000
    card = '<article class="Box-row"><a href="/o/p%d">o / p%d</a><p>t</p><article class="Box-row"><a href="/in">i</a></article></article>'
    html = '<article class="Box-row"><a href="/open">open</a>' + "".join(card % (i, i) for i in range(n))
    pages = spark.createDataFrame([("k", html), ("k", html)], "page_id string, html string")
    began = time.monotonic()
    got = sorted((r.pos, r.name) for r in markup.repository_cards(pages, n).collect())
    assert got == sorted([(i, f"o/p{i}") for i in range(n // 2)] * 2)
    links = pages.limit(1).select(markup.anchors(F.col("html")).alias("a")).first().a
    assert len(links) == 2 * n + 1 and time.monotonic() - began < 60


def plain_cards(page):
    """Place and fields of the cards of a page, from the table of all its elements."""
    parser = markup._Outline(lambda tag, attrs: True)
    parser.feed(page)
    parser.close()
    rows = parser.rows
    tidy = lambda found, at: " ".join(found[at]["text"].split()) if found else ""
    classed = lambda r, name: name in r["attributes"].get("class", "").split()
    ended = [r for r in rows if r["tag"] == "article" and classed(r, "Box-row") and r["end"] is not None]
    out = []
    for r in ended:
        if any(o["begin"] < r["begin"] and r["end"] < o["end"] for o in ended):
            continue
        held = [x for x in rows if r["begin"] < x["begin"] < r["end"]]
        links = [x for x in held if x["tag"] == "a" and x["attributes"].get("href", "").startswith("/")]
        about = [x for x in held if x["tag"] == "p" and x["text"].split()]
        language = [x for x in held if x["attributes"].get("itemprop") == "programmingLanguage"]
        stars = [x for x in held if x["tag"] == "span" and classed(x, "float-sm-right")]
        url = "https://github.com" + links[0]["attributes"]["href"] if links else ""
        out.append((tidy(links, 0).replace(" / ", "/").replace(" ", ""), url, tidy(about, 0)[:200], tidy(language, -1), tidy(stars, -1)))
    return [(i, *card) for i, card in enumerate(out) if card[0]]


def test_cards_of_odd_pages(spark):
    """Elements nested, left open and ended out of turn: the cards are those of the table of elements."""
    rng = random.Random(5)
    parts = ['<article class="Box-row">'] * 4 + ["</article>"] * 5 + ['<article class="x" itemprop="programmingLanguage">', "<div>", "</div>", "<h2>", "</h2>"]
    parts += ['<a href="/%d">', '<a href="/%d" itemprop="programmingLanguage">', '<a href="http://x">', "</a>", "</a>", "<p>", "<p class='n'>", "</p>", "<br>", "<a href='/v'/>"]
    parts += ['<span class="d float-sm-right">', '<span itemprop="programmingLanguage">', "</span>", '<meta itemprop="programmingLanguage">', "t%d", "u %d", " ", "\n", "&amp;", "a / b"]
    pages = ["".join(x % rng.randint(0, 99) if "%d" in x else x for x in rng.choices(parts, k=rng.randint(5, 80))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {}
    for r in markup.repository_cards(df, 1_000).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.pos, r.name, r.url, r.description, r.language, r.stars_today))
    assert got == {i: cards for i, x in enumerate(pages) if (cards := plain_cards(x))} and len(got) > 50


def test_memory_of_a_long_page():
    """What a page's parser holds follows the open cards, not the page."""
    card = '<article class="Box-row"><h2><a href="/o/p%d">o / p%d</a></h2><p>t</p><span itemprop="programmingLanguage">SQL</span></article>'
    page, seen = "".join(card % (i, i) for i in range(20_000)), []
    tracemalloc.start()
    parser = markup._Cards(lambda x: seen.append(x[0]))
    parser.feed(page)
    parser.close()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == list(range(20_000)) and most < len(page)
