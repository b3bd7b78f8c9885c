"""Secret scan: fixed patterns and sliding-window entropy.

Base findings are matches of three patterns. The entropy scan adds candidate
strings of which some window of ``WINDOW`` characters has a Shannon entropy above
the limit of its character class. Counts of the window are kept while it slides:
the entering and the leaving character each change one count and one term of the
sum, so the time is linear in the candidate. Candidates on the allow list, and those that touch a base finding, add
nothing. All of it is SQL expressions on the row, so texts are not shuffled and
no key can be hot.

Null texts count as empty and have no findings; repeated rows repeat theirs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in order, with their patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Character classes of candidates with the entropy from which a window is suspicious.
CLASSES = (
    ("hex", r"^[0-9A-Fa-f]+$", 2.9),
    ("lower", r"^[0-9a-z_=-]+$", 3.7),
    ("upper", r"^[0-9A-Z_=-]+$", 3.7),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.8),
)
# Candidates that are no secrets: identifiers, samples, words and paths without digits.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefgh",
    r"^[^0-9]*$",
    r"^[0-9_=+/-]*$",
    r"^([a-z]{2,}[0-9]?[/_-])+[a-z0-9]*$",
)


# Matches whose places are added up at once.
STRETCH = 512


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found(text: Column, pattern: str, kind: int) -> Column:
    """Matches of a pattern as (start, kind, end, value), in code points.

    Places are sums of the lengths before; they are added up stretch by stretch,
    so that long lists are copied once per stretch, not once per match.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    pairs = F.filter(pairs, lambda p: p["hit"].isNotNull())
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["hit"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def stretch(held: Column):
        def add(acc: Column, i: Column) -> Column:
            some = F.slice(held, i * STRETCH + 1, F.lit(STRETCH))
            part = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return let(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], p["out"]).alias("out")))

        count = F.floor((F.size(held) + STRETCH - 1) / STRETCH).cast("int")
        parts = F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])

    return F.when(F.regexp_like(text, F.lit(pattern)), let(pairs, stretch)).otherwise(none)


# Counts of the window's characters: five bits for each of the characters from '+' to
# 'z', twelve to a long. Terms n log2 n are whole numbers, so sums don't drift.
LEAST, EACH, PER_LONG, LONGS = 43, 5, 12, 7
UNIT = 1 << 32
TERMS = [round(n * math.log2(n) * UNIT) if n else 0 for n in range(WINDOW + 1)]


def entropy_range(value: Column, limit: Column) -> Column:
    """(first, end): from the first to the last window above the limit; null if none."""
    none = F.lit(None).cast("int")
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), LONGS).alias("counts"),
        F.lit(0).cast("long").alias("sum"),
        F.lit(0).alias("at"),
        none.alias("first"),
        none.alias("end"),
        F.floor((F.lit(math.log2(WINDOW)) - limit) * WINDOW * UNIT).alias("most"),
    )
    terms = F.array(*[F.lit(t).cast("long") for t in TERMS])

    def bits(c: Column) -> Column:
        return (c % PER_LONG) * EACH

    def held(counts: Column, c: Column) -> Column:
        word = F.get(counts, F.floor(c / PER_LONG).cast("int"))
        return F.call_function("shiftright", word, bits(c)).bitwiseAND(F.lit(31).cast("long")).cast("int")

    def one(c: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), bits(c))

    def slide(acc: Column, p: Column) -> Column:
        enter, leave = p["enter"], p["leave"]
        many, few = held(acc["counts"], enter), held(acc["counts"], leave)
        word = lambda c: F.floor(c / PER_LONG).cast("int")
        grown = F.transform(acc["counts"], lambda n, j: F.when(j == word(enter), n + one(enter)).otherwise(n))
        moved = F.transform(
            acc["counts"],
            lambda n, j: n + F.when(j == word(enter), one(enter)).otherwise(0) - F.when(j == word(leave), one(leave)).otherwise(0),
        )
        more = F.get(terms, many + 1) - F.get(terms, many)
        change = F.when(leave < 0, more).when(enter == leave, F.lit(0).cast("long"))
        change = change.otherwise(more + F.get(terms, few - 1) - F.get(terms, few))
        counts = F.when(leave < 0, grown).when(enter == leave, acc["counts"]).otherwise(moved)

        def ended(total: Column) -> Column:
            at = acc["at"] + 1
            above = (at >= WINDOW) & (total <= acc["most"])
            return F.struct(
                counts.alias("counts"),
                total.alias("sum"),
                at.alias("at"),
                F.when(above, F.coalesce(acc["first"], at - WINDOW)).otherwise(acc["first"]).alias("first"),
                F.when(above, at).otherwise(acc["end"]).alias("end"),
                acc["most"].alias("most"),
            )

        return let(acc["sum"] + change, ended)

    def walk(codes: Column) -> Column:
        left = F.slice(F.concat(F.array_repeat(F.lit(-1), WINDOW), codes), F.lit(1), F.size(codes))
        pairs = F.zip_with(codes, left, lambda e, x: F.struct(e.alias("enter"), x.alias("leave")))
        return F.aggregate(pairs, start, slide, lambda acc: F.struct(acc["first"].alias("first"), acc["end"].alias("end")))

    return let(F.transform(F.split(value, ""), lambda c: F.ascii(c) - LEAST), walk)


def limit_of(value: Column) -> Column:
    """Entropy limit of the narrowest character class that holds the value."""
    out = F.lit(None).cast("double")
    for _, pattern, limit in reversed(CLASSES):
        out = F.when(F.regexp_like(value, F.lit(pattern)), F.lit(limit)).otherwise(out)
    return out


def allowed(value: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOW:
        out = out | F.regexp_like(value, F.lit(pattern))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``base`` and ``added`` findings.

    Both are arrays of (start, kind, end), sorted; ``kind`` is an index of KINDS.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = F.transform(F.col("_base"), lambda x: F.struct(x["start"], x["kind"], x["end"]))
    assign = F.filter(
        found(text, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= 6
    )
    base = docs.withColumn("_base", F.concat(assign, found(text, ACCESS, 1), found(text, HEX, 2)))
    base = base.withColumn("base", F.array_sort(slim)).drop("_base")
    apart = lambda x: ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    candidates = F.filter(found(text, CANDIDATE, 3), lambda x: ~allowed(x["value"]) & apart(x))
    ranges = F.transform(candidates, lambda x: F.struct(x["start"].alias("start"), entropy_range(x["value"], limit_of(x["value"])).alias("r")))
    hits = F.transform(
        F.filter(F.col("_ranges"), lambda x: x["r"]["first"].isNotNull()),
        lambda x: F.struct(
            (x["start"] + x["r"]["first"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + x["r"]["end"]).alias("end")
        ),
    )
    return base.withColumn("_ranges", ranges).withColumn("added", hits).drop("_ranges")


def spelled(findings: Column) -> Column:
    """Findings as kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.concat_ws(",", F.transform(findings, one))


def count_kind(findings: Column, kind: int) -> Column:
    return F.size(F.filter(findings, lambda x: x["kind"] == kind)).cast("long")


def redact(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with each finding replaced; overlapping ones become one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.substr(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        fresh = F.when(x["start"] >= acc["at"], F.lit(mark)).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], kept, fresh).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(findings) > 0, F.aggregate(findings, start, step, rest)).otherwise(text)
