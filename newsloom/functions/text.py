"""Text column expressions.

White space is Unicode white space plus the ASCII separators 0x1C-0x1F, and a
word is a run of letters, digits and underscores of any script.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from html.parser import HTMLParser
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space of the Unicode standard and the ASCII separators.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_END = r"(?:\R|[\x1c-\x1e])"
# White space but for the blank and the plain line end.
ODD_WS = r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Line openings and phrases that mark an instruction to a model.
INJECTION_PREFIXES = [
    "system:",
    "assistant:",
    "ignore ",
    "important instruction",
    "new instructions",
    "override:",
    "you are now",
    "forget everything",
    "[system]",
    "[assistant]",
    "<system>",
    "<assistant>",
]
INJECTION_PHRASES = [
    "ignore previous instructions",
    "ignore all previous",
    "disregard the above",
    "you must now",
    "your new role is",
    "act as if you are",
    "pretend you are",
    "disregard your previous",
]

# Answers that talk about the task instead of summarising.
META_MARKERS = [
    "the user wants",
    "the source text is",
    "let me analyze",
    "let me identify",
    "i need to",
    "i'll create",
    "key points from the article",
    "core substance",
    "not article content",
]

# Wording of a subscription wall.
PAYWALL_HINTS = ["subscribe", "sign in", "paywall", "log in to continue"]

# Wire-service wording of syndicated press releases.
WIRE_MARKERS = [
    "PRNewswire",
    "/ PRNewswire/",
    "Business Wire",
    "GlobeNewswire",
    "PR Newswire",
]

# Markup kept in edition bodies.
ALLOWED_TAGS = ["p", "em", "strong", "a", "ul", "li", "ol", "br"]


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """Use a costly value several times, evaluated once per row.

    An expression repeated inside a lambda is evaluated again per element;
    bound to a lambda variable it is not.
    """
    return F.get(F.transform(F.array(c), body), F.lit(0))


def py_strip(c: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """One blank between words, none around the text."""
    return py_strip(F.regexp_replace(c, rf"{WS}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(py_strip(c) != "", c)


def words(c: Column) -> Column:
    """White-space separated tokens; none for blank text."""
    return F.filter(F.split(c, rf"{WS}+"), lambda w: w != "")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def _parts(markup: str) -> list[str]:
    parser = _Text()
    parser.feed(markup)
    # Without this a text that ends in "&" or "<" would lose its last piece.
    parser.close()
    return parser.parts


@F.pandas_udf(T.ArrayType(T.StringType()))
def _text_parts(markup: pd.Series) -> pd.Series:
    return markup.map(lambda m: None if m is None else _parts(m))


def text_parts(c: Column) -> Column:
    """Text pieces between tags. Only rows with markup reach Python."""
    marked = F.contains(c, F.lit("<")) | F.contains(c, F.lit("&"))
    return F.when(marked, _text_parts(F.when(marked, c))).otherwise(F.array(c))


def strip_html(c: Column, joiner: str = "") -> Column:
    return F.array_join(text_parts(F.coalesce(c, F.lit(""))), joiner)


def lines(c: Column) -> Column:
    """Lines of a text; a final line end opens no further line."""

    def closed(p: Column) -> Column:
        open_end = (F.size(p) > 1) & (F.element_at(p, -1) == "")
        return F.when(open_end, F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)

    return let(F.split(c, LINE_END), closed)


def clean_lines(c: Column) -> Column:
    """Each line with single blanks; blank lines dropped."""

    def parts(t: Column) -> Column:
        # Where no blanks stand together there are none to replace, which costs less to see.
        uneven = F.contains(t, F.lit("  ")) | t.rlike(ODD_WS)
        tidy = F.transform(F.split(t, LINE_END), collapse)
        return F.when(uneven, tidy).otherwise(F.transform(F.split(t, "\n"), py_strip))

    return F.array_join(F.filter(let(F.coalesce(c, F.lit("")), parts), lambda x: x != ""), "\n")


def clean_body(c: Column) -> Column:
    """Body text of a feed field: tags removed, every piece on its own line."""
    return clean_lines(F.array_join(text_parts(F.coalesce(c, F.lit(""))), "\n"))


def clean_summary(c: Column, limit: int = 400) -> Column:
    return let(collapse(strip_html(c, " ")), lambda t: ellipsize(t, limit))


def ellipsize(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def clip(c: Column, limit: int) -> Column:
    """Trimmed text, cut with dots when longer than the limit."""

    def cut(t: Column) -> Column:
        short = F.concat(rstrip(F.substring(t, 1, max(0, limit - 3))), F.lit("..."))
        return F.when(F.length(t) > limit, short).otherwise(t)

    return let(py_strip(F.coalesce(c, F.lit(""))), cut)


def _injects(x: Column) -> Column:
    """Whether a trimmed line in lower case is an instruction; plain searches cost less than one pattern."""
    found = [F.startswith(x, F.lit(p)) for p in INJECTION_PREFIXES]
    found += [F.contains(x, F.lit(p)) for p in INJECTION_PHRASES]
    return reduce(Column.__or__, found)


def _harmless(parts: Column) -> Column:
    """Lines without instructions, as one text."""
    return F.array_join(F.filter(parts, lambda x: ~let(F.lower(py_strip(x)), _injects)), "\n")


def drop_injection_lines(c: Column) -> Column:
    return _harmless(lines(c))


def escape_json_ends(c: Column) -> Column:
    """Defuse sequences that close a JSON object, in this fixed order."""
    # Sequence and its harmless spelling.
    for found, harmless in (('"}', '"�'), ("}]", "�]"), ("}}", "��")):
        c = F.replace(c, F.lit(found), F.lit(harmless))
    return c


def sanitize(c: Column, cap: int = 500) -> Column:
    """Untrusted text made safe to quote: no tags, no instruction lines, bounded."""

    def bounded(t: Column) -> Column:
        if cap <= 0:
            cut = F.lit("")
        elif cap == 1:
            cut = F.lit("…")
        else:
            cut = F.concat(rstrip(F.substring(t, 1, cap - 1)), F.lit("…"))
        return py_strip(F.when(F.length(t) > cap, cut).otherwise(t))

    # What the whole lines in the head of a long text leave is what its cleaned form starts
    # with. If that is beyond the cap, by more than an escaped sequence is long, no later
    # line can change the result; else the whole text is cleaned.
    reach = 2 * max(0, cap) + 1_000

    def opening(s: Column) -> Column:
        whole = let(F.split(F.substring(s, 1, reach), LINE_END), lambda p: F.slice(p, F.lit(1), F.size(p) - 1))
        return F.when(F.length(s) > reach, _harmless(whole))

    def cleaned(s: Column) -> Column:
        return let(
            opening(s),
            lambda k: let(escape_json_ends(F.when(F.length(k) > cap + 8, k).otherwise(drop_injection_lines(s))), bounded),
        )

    return let(strip_html(c), cleaned)


def sanitize_title(c: Column, cap: int = 200) -> Column:
    return F.substring(drop_injection_lines(strip_html(c)), 1, cap)


def _last_index(text: Column, marker: str) -> Column:
    """Zero-based index of the last occurrence, -1 when absent."""
    at = F.locate(marker[::-1], F.reverse(text))
    return F.when(at > 0, F.length(text) - at - (len(marker) - 1)).otherwise(-1)


def truncate_sentence(c: Column, limit: int = 220, least: int = 80) -> Column:
    """Cut at a sentence end; markers are tried in a fixed order."""

    def at_marker(t: Column, cut: Column) -> Column:
        out = F.when(F.length(t) <= limit, t)
        for marker in (". ", "? ", "! "):
            at = _last_index(cut, marker)
            out = out.when(at >= least, rstrip(F.substring(cut, F.lit(1), at + 1)))
        return out.otherwise(F.concat(F.regexp_replace(cut, r"[ ,;:]+$", ""), F.lit("...")))

    return let(
        collapse(F.coalesce(c, F.lit(""))),
        lambda t: let(rstrip(F.substring(t, 1, limit)), lambda cut: at_marker(t, cut)),
    )


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"[^\p{{L}}\p{{N}}_{WS[1:-1]}]", "")


def gram_words(c: Column) -> Column:
    """Lower-case words without punctuation."""
    return words(_plain(c))


def _windows(w: Column, window: int, build: Callable[[list[Column]], Column], kind: str) -> Column:
    """One value per distinct window of ``window`` words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0)))
    # Single look-ups: slicing would copy the word list once per window.
    made = F.transform(starts, lambda i: build([F.get(w, i + k) for k in range(window)]))
    return F.when(F.size(w) >= window, F.array_distinct(made)).otherwise(F.array().cast(f"array<{kind}>"))


def word_grams(c: Column, window: int = 10) -> Column:
    """Distinct word windows of a text; none when it has fewer words."""
    return let(gram_words(c), lambda w: _windows(w, window, lambda x: F.concat_ws(" ", *x), "string"))


# Words that a task holds at once as Python strings, one text's at least.
_HELD_WORDS = 1 << 18


def _rolled(lists: list[list[str]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows per text, hash of each window) of texts given as words."""
    counts = np.array([len(x) for x in lists], np.int64)
    flat = np.array(list(chain.from_iterable(lists)), object)
    hashes = pd.util.hash_array(flat) if len(flat) else np.zeros(0, np.uint64)
    sizes = np.maximum(counts - width + 1, 0)
    # Place of each window's first word in the words of all these texts.
    at = np.repeat(np.cumsum(counts) - counts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k]
    return sizes, out.view(np.int64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _window_hashes(plain: pa.Array, window: pa.Array) -> pa.Array:
    width = window[0].as_py() if len(window) else 1
    sizes, made, held, n = [], [], [], 0
    for text in plain:
        # Splits at the characters of WS.
        held.append((text.as_py() or "").split())
        n += len(held[-1])
        if n >= _HELD_WORDS:
            parts, held, n = _rolled(held, width), [], 0
            sizes.append(parts[0])
            made.append(parts[1])
    parts = _rolled(held, width)
    ends = np.cumsum(np.concatenate([[0], *sizes, parts[0]]), dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*made, parts[1]])))


def gram_hashes(c: Column, window: int = 10) -> Column:
    """64-bit hashes of the word windows of a text by place, repeats included.

    Each word is hashed once, and windows from those numbers.
    """
    return _window_hashes(_plain(c), F.lit(window))


def filter_places(h: Column, bits: int) -> list[Column]:
    """The places of a window's hash in a filter of so many bits, a power of two up to 2^32."""
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]


def _hits(lists: list[list[str]], width: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(windows per text, then place, hash and words of each window) that a filter lets through."""
    sizes, hashes = _rolled(lists, width)
    mask = np.uint64(len(bits) * 8 - 1)
    is_set = lambda h: bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1
    number = hashes.view(np.uint64)
    found = np.flatnonzero(is_set(number & mask))
    found = found[is_set(number[found] >> np.uint64(32) & mask) > 0]
    ends = np.cumsum(sizes)
    text = np.searchsorted(ends, found, side="right")
    at = found - (ends - sizes)[text]
    grams = [" ".join(lists[t][i : i + width]) for t, i in zip(text.tolist(), at.tolist(), strict=True)]
    return np.bincount(text, minlength=len(lists)), at, hashes[found], grams


def gram_hits(c: Column, bits: Broadcast, window: int = 10) -> Column:
    """Place, hash and words of the windows of a text that a filter of hashes lets through.

    ``bits`` holds bytes with the ``filter_places`` of hashes set. All else of the
    text stays in its task.
    """
    kind = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("gram", T.StringType())])

    @F.arrow_udf(T.ArrayType(kind))
    def hits(plain: pa.Array) -> pa.Array:
        made, held, n = [], [], 0
        for text in plain:
            held.append((text.as_py() or "").split())
            n += len(held[-1])
            if n >= _HELD_WORDS:
                made.append(_hits(held, window, bits.value))
                held, n = [], 0
        made.append(_hits(held, window, bits.value))
        counts, at, h, grams = zip(*made, strict=True)
        rows = [pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(h), pa.int64()), pa.array(chain.from_iterable(grams), pa.string())]
        ends = np.cumsum(np.concatenate([[0], *counts]), dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(rows, fields=[pa.field(x.name, r.type) for x, r in zip(kind, rows, strict=True)]))

    return hits(_plain(c))


def grams_at(c: Column, places: Column, window: int = 10) -> Column:
    """The word windows that start at some places of a text."""

    def spelled(w: Column) -> Column:
        there = F.filter(places, lambda i: i + window <= F.size(w))
        return F.transform(there, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(window)]))

    return let(gram_words(c), spelled)


def strip_markup_pairs(c: Column) -> Column:
    """Bodies of long reads: each tag becomes a blank."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")


def keep_allowed_tags(c: Column) -> Column:
    """Drop tags outside the allow list, keep their text."""
    keep = "|".join(ALLOWED_TAGS)
    return F.regexp_replace(c, rf"(?iU)</?(?!(?:{keep})\b)\w+[^>]*>", "")


def find_urls(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"https?://[^{WS[1:-1]}]+"), F.lit(0))


def content_id(prefix: Column, links: Column, headline: Column, facts: Column) -> Column:
    """Stable id of an item: from its URLs, else from its words."""
    urls = F.array_sort(
        F.transform(
            F.filter(links, lambda x: F.coalesce(x["url"], F.lit("")) != ""),
            lambda x: F.lower(py_strip(x["url"])),
        )
    )
    prose = F.concat_ws(
        "\n",
        F.lower(py_strip(F.coalesce(headline, F.lit("")))),
        F.lower(py_strip(F.coalesce(facts, F.lit("")))),
    )
    seed = F.when(F.coalesce(F.size(urls), F.lit(0)) > 0, F.array_join(urls, "\n")).otherwise(prose)
    return F.concat(prefix, F.lit("-"), F.substring(F.sha2(seed, 256), 1, 32))


def cache_key(url: Column) -> Column:
    return F.sha1(url)


def first_native_text(candidates: list[tuple[str, Column]]) -> Column:
    """(text, origin) of the first field with text left after cleaning.

    A field may be a string or an array of strings; order is preference.
    """
    pairs = F.array(
        *[
            F.struct(clean_body(c).alias("text"), F.lit(origin).alias("origin"))
            for origin, c in candidates
        ]
    )
    hit = F.get(F.filter(pairs, lambda x: x["text"] != ""), F.lit(0))
    none = F.struct(F.lit("").alias("text"), F.lit("none").alias("origin"))
    return F.coalesce(hit, none)


def paywall_status(text: Column, min_chars: int = 300) -> Column:
    """ok / paywall / extraction_failed for an extracted body."""
    t = py_strip(F.coalesce(text, F.lit("")))
    head = F.lower(F.substring(t, 1, 500))
    hinted = F.lit(False)
    for hint in PAYWALL_HINTS:
        hinted = hinted | F.contains(head, F.lit(hint))
    return F.when(F.length(t) >= min_chars, "ok").when(hinted, "paywall").otherwise("extraction_failed")


def summary_rejection(summary: Column, source: Column, markers: list[str] | None = None) -> Column:
    """Reason not to use a model summary, "" when it is fine."""
    head = F.lower(F.substring(summary, 1, 300))
    out = None
    for m in META_MARKERS if markers is None else markers:
        cond = F.contains(head, F.lit(m))
        label = F.lit(f"meta_response:{m}")
        out = F.when(cond, label) if out is None else out.when(cond, label)
    short = (F.length(source) >= 800) & (F.length(summary) < 80)
    return (F.when(short, "too_short") if out is None else out.when(short, "too_short")).otherwise("")


def target_words(n: Column) -> Column:
    """Length goal of a compressed transcript."""
    return F.greatest(F.lit(300), F.least(F.lit(1200), F.bround(n * F.lit(0.175)).cast("int")))


def first_words(c: Column, n: Column) -> Column:
    return F.array_join(F.slice(words(c), F.lit(1), n), " ")


def token_estimate(c: Column) -> Column:
    """Rough token count: a quarter of the characters, one at least."""
    t = F.coalesce(c, F.lit(""))
    return F.when(t == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(t) / 4))).cast("bigint")


def is_press_release(url: Column, summary: Column) -> Column:
    hit = F.contains(F.coalesce(url, F.lit("")), F.lit("/press_releases/"))
    for m in WIRE_MARKERS:
        hit = hit | F.contains(F.coalesce(summary, F.lit("")), F.lit(m))
    return hit


def has_useful_summary(summary: Column, body: Column, least: int = 40) -> Column:
    empty = F.lit("")
    text = F.when(F.coalesce(summary, empty) != "", summary).otherwise(F.coalesce(body, empty))
    return F.length(py_strip(text)) >= least


def any_contains(c: Column, needles: list[str]) -> Column:
    """Case-blind substring test against a list (a hit inside a word counts)."""
    pattern = "|".join(rf"\Q{n.lower()}\E" for n in needles)
    return F.lower(F.coalesce(c, F.lit(""))).rlike(pattern)


def display_text(facts: Column, analysis: Column, note: Column) -> Column:
    def given(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", c)

    return F.concat_ws(" ", given(facts), given(analysis), F.concat(F.lit("("), given(note), F.lit(")")))


def distinct_paragraphs(paragraphs: Column) -> Column:
    """Keep a paragraph unless it contains, or lies in, one kept before."""
    return F.aggregate(
        paragraphs,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (F.coalesce(p, F.lit("")) == "")
            | F.exists(acc, lambda q: F.contains(q, p) | F.contains(p, q)),
            acc,
        ).otherwise(F.array_append(acc, p)),
    )
