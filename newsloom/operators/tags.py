"""Tag vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags of edition items and their labels.
TAG_LABELS = {
    "war": "Conflict",
    "domestic": "Politics",
    "econ": "Economy",
    "ai": "AI",
    "tech": "Technology",
    "defense": "Defense",
    "space": "Space",
    "cyber": "Cyber",
    "local": "Local",
    "science": "Science",
    "energy": "Energy",
    "biotech": "Biotech",
}

# Tags an edition should cover, and the desk each comes from.
PRIMARY_TAGS = ["war", "ai", "defense"]
PRIMARY_DESKS = {
    "geopolitics_events": "war",
    "geopolitics": "war",
    "ai_tech": "ai",
    "defense_space": "defense",
}
PRIMARY_DOMAINS = ["geopolitics_events", "geopolitics", "defense_space", "ai_tech"]

# Headline words of a primary topic.
PRIMARY_KEYWORDS = [
    "war",
    "iran",
    "israel",
    "ukraine",
    "russia",
    "conflict",
    "combat",
    "attack",
    "military",
    "missile",
    "defense",
    "pentagon",
    "nato",
    "hormuz",
    "ai",
    "artificial intelligence",
    "llm",
    "openai",
    "anthropic",
    "space",
    "satellite",
    "launch",
    "cislunar",
    "orbit",
]


def title_case(text: Column) -> Column:
    """Every run of letters with a capital first, whatever stands between."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def tag_label(tag: Column) -> Column:
    """Label of a tag; unknown tags in title case."""
    known = F.create_map(*[F.lit(x) for kv in TAG_LABELS.items() for x in kv])
    return F.coalesce(known[tag], title_case(tag))


def valid_tag(tag: Column) -> Column:
    """Tags outside the vocabulary become ``domestic``."""
    return F.when(tag.isin(list(TAG_LABELS)), tag).otherwise("domestic")
