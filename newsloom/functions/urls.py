"""URL column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import py_strip

# Query keys that only track a click.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ["fbclid", "gclid", "igshid", "mc_cid", "mc_eid"]

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[Ww]{3}\.)?([^/?#:]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
# A URL that is its own comparison form, as most are: it needs no other pattern.
_PLAIN = r"^https?://[a-z0-9.:\-]+/[!-~&&[^?#;]]*[!-~&&[^?#;/]]\z"


def netloc(url: Column) -> Column:
    """Authority part as written ("" when there is none)."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _AUTHORITY, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def registered_domain(url: Column) -> Column:
    """Outlet key of a link: authority without port and leading www, lower case."""
    return F.lower(F.regexp_extract(py_strip(url), _HOST, 1))


def _form_quote(raw: Column) -> Column:
    """Decode then encode a query part, so equal values spell the same."""
    plain = F.coalesce(F.try_url_decode(raw), raw)
    quoted = F.url_encode(plain)
    # Java and form encoding differ only in these two characters.
    return F.replace(F.replace(quoted, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Comparison form of a publisher URL; "" when it is not an http(s) URL."""
    u = py_strip(F.coalesce(url, F.lit("")))
    host = netloc(u)
    p = F.regexp_replace(path(u), r";[^/]*$", "")
    p = F.when(p == "", "/").when(p == "/", "/").otherwise(F.regexp_replace(p, r"/+$", ""))
    query = F.regexp_extract(u, _QUERY, 1)
    # One pattern per pair: keys that track, spelled plainly or percent-encoded.
    tracking = f"^(?:{TRACKING_PREFIX}|(?:{'|'.join(TRACKING_KEYS)})(?:=|$))"
    kept = F.filter(
        F.split(query, "&"),
        lambda pair: (pair != "") & ~F.lower(F.coalesce(F.try_url_decode(pair), pair)).rlike(tracking),
    )
    pairs = F.transform(
        kept,
        lambda pair: F.concat(
            _form_quote(F.substring_index(pair, "=", 1)),
            F.lit("="),
            _form_quote(F.regexp_extract(pair, "^[^=]*=(.*)$", 1)),
        ),
    )
    rebuilt = F.array_join(pairs, "&")
    tail = F.when(query == "", "").when(rebuilt == "", "").otherwise(F.concat(F.lit("?"), rebuilt))
    usable = scheme(u).isin("http", "https") & (host != "")
    spelled = F.when(usable, F.concat(scheme(u), F.lit("://"), F.lower(host), p, tail)).otherwise("")
    return F.when(url.rlike(_PLAIN), url).otherwise(spelled)


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve a link against the page it was found on."""
    b_scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.concat(b_scheme, F.lit("://"), netloc(base))
    b_path = path(base)
    folder = F.regexp_replace(b_path, r"[^/]*$", "")
    h_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    h_tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    merged = F.when(h_path.startswith("/"), h_path).otherwise(
        F.concat(F.when(folder == "", "/").otherwise(folder), h_path)
    )
    segments = F.split(F.regexp_replace(merged, r"^/", ""), "/")
    last = F.element_at(segments, -1)
    # Walk the segments: "." is dropped, ".." removes the segment before it.
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    walked = F.when(last.isin(".", ".."), F.array_append(walked, F.lit(""))).otherwise(walked)
    has_dots = merged.rlike(r"(^|/)\.\.?(/|$)")
    clean = F.when(has_dots, F.concat(F.lit("/"), F.array_join(walked, "/"))).otherwise(merged)
    base_query = F.regexp_extract(base, r"^[^#]*?(\?[^#]*)?(?:#.*)?$", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(b_scheme, F.lit(":"), href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(root, b_path, base_query, href))
        .when(href.startswith("?"), F.concat(root, b_path, href))
        .otherwise(F.concat(root, clean, h_tail))
    )
