"""Bills on games of chance: terms counted, scope, topic, and the fields of their design, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms that are counted; those that make a title direct; topics of which the first that is found counts.
TERMS = [
    r"\bsports bet(?:ting)?\b", r"\bsports wager(?:ing|s)?\b", r"\blawful gambling\b", r"\bcharitable gambling\b", r"\bgambling\b", r"\bwager(?:ing|s|ed)?\b", r"\blottery\b", r"\bcasino(?:s)?\b", r"\bbingo\b", r"\braffle(?:s)?\b",
    r"\bpull[- ]tabs?\b", r"\bhorse racing\b", r"\bhistorical horse racing\b", r"\bpari[- ]mutuel\b", r"\bprediction markets?\b", r"\bsweepstakes\b", r"\bpoker\b", r"\bfantasy sports\b", r"\bbetting on elections?\b",
]
DIRECT = [
    r"\bsports bet(?:ting)?\b", r"\bsports wager(?:ing|s)?\b", r"\blawful gambling\b", r"\bcharitable gambling\b", r"\bgambling\b", r"\bwager(?:ing|s)?\b", r"\blottery\b", r"\bcasino(?:s)?\b", r"\bbingo\b", r"\braffle(?:s)?\b",
    r"\bpull[- ]tabs?\b", r"\bhorse racing\b", r"\bhistorical horse racing\b", r"\bpari[- ]mutuel\b", r"\bprediction markets?\b", r"\bsweepstakes\b", r"\bpoker\b", r"\bfantasy sports\b",
]
ELECTIONS = r"\bbetting on elections?\b"
TOPICS = {
    "prediction_markets": r"\bprediction markets?\b",
    "sweepstakes": r"\bsweepstakes\b",
    "election_betting": r"\bbetting on elections?\b",
    "sports_betting": r"\bsports bet(?:ting)?\b|\bsports wager(?:ing|s)?\b",
    "horse_racing": r"\bhistorical horse racing\b|\bhorse racing\b|\bpari[- ]mutuel\b",
    "lottery": r"\blottery\b",
    "charitable_gambling": r"\bcharitable gambling\b|\blawful gambling\b|\bbingo\b|\braffle(?:s)?\b|\bpull[- ]tabs?\b",
    "casino_gaming": r"\bcasino(?:s)?\b",
    "fantasy_sports": r"\bfantasy sports\b",
}
# Words of a bill's design.  Where an alternative stands outside a group, it counts alone.
TRIBAL = r"\btrib(?:e|al|es|es'|al nation|al nations)\b"
COMMERCIAL = r"\b(?:sports wagering|betting) operator|commercial operator|licensed operator\b"
TRACK = r"\bracetrack|running aces|canterbury park\b"
TRACK_LICENSE = r"racetrack.{0,120}(?:license|operator)|(?:license|operator).{0,120}racetrack"
TRACK_REVENUE = r"racetrack.{0,160}(?:revenue|payment|distribution|allocation)|(?:revenue|payment|distribution|allocation).{0,160}racetrack"
MOBILE = r"\bmobile (?:sports )?(?:betting|wagering)|online (?:sports )?(?:betting|wagering)\b"
NO_MOBILE = r"\b(?:mobile|online) (?:betting|wagering).{0,80}(?:prohibited|not permitted)\b"
RETAIL = r"\bretail (?:sports )?(?:betting|wagering)|in-person (?:sports )?(?:betting|wagering)\b"
NO_RETAIL = r"\bretail (?:betting|wagering).{0,80}(?:prohibited|not permitted)\b"
TAX = [r"(?:tax|rate)[^\d%]{0,40}(\d+(?:\.\d+)?)\s*percent", r"(\d+(?:\.\d+)?)\s*percent[^.\n]{0,40}\btax\b"]
AGE = r"(?:at least|minimum age(?: of)?|under)\s+(18|21)\s+years?\s+of\s+age"
OPERATORS = r"(?:up to|maximum of|not more than)\s+(\d+)\s+(?:mobile\s+)?(?:licenses?|operators?|skins?)"
RECIPIENTS = {"problem_gambling": r"problem gambling|compulsive gambling", "horse_racing": r"horse racing|racetrack|racing commission", "youth_sports": r"youth sports", "tribal_nations": r"(?:tribal|Indian) nation|tribes?", "general_fund": r"general fund"}
FLAGS = {"official_league_data": r"official league data", "in_game_wagering": r"in-game|in game|proposition wager", "geolocation": r"geofenc|geolocat", "constitutional_amendment": r"constitutional amendment", "responsible_gaming_funding": r"problem gambling|compulsive gambling"}
COLLEGE = r"college|collegiate"
COLLEGE_POLICY = [(r"college|collegiate.{0,100}(?:prohibited|may not|not permit)", "prohibited"), (r"college|collegiate.{0,100}(?:restrict|in-state|Minnesota team)", "restricted")]


def has(text: Column, pattern: str, across_lines: bool = False) -> Column:
    return text.rlike(("(?is)" if across_lines else "(?i)") + pattern)


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def term_hits(text: Column) -> Column:
    """Matches of all terms, each term's own."""
    hits = F.lit(0)
    for p in TERMS:
        hits = hits + F.regexp_count(text, F.lit(f"(?i){p}"))
    return hits


def topic(text: Column) -> Column:
    return F.coalesce(*(F.when(has(text, p), name) for name, p in TOPICS.items()), F.lit("other_gambling"))


def scope(title: Column, hits: Column) -> Column:
    """direct, embedded or mention; null where neither title nor terms are about games of chance."""
    elections = has(title, ELECTIONS)
    return F.when(has(title, any_of(DIRECT)), "direct").when(elections | (hits >= 3), "embedded").when(hits > 0, "mention")


def found_names(text: Column, names: dict[str, str]) -> Column:
    return F.filter(F.array(*(F.when(has(text, p), n) for n, p in names.items())), lambda x: x.isNotNull())


def percents(text: Column) -> Column:
    """Tax rates from 0 to 100, ascending, each once."""
    all_of = F.concat(*(F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(1)) for p in TAX))
    return F.array_sort(F.array_distinct(F.filter(F.transform(all_of, lambda x: x.cast("double")), lambda x: x <= 100)))


def design(title: Column, raw: Column) -> Column:
    """A struct of hits, scope, topic and the twelve fields of a bill's design; null where scope is.  A null text counts as empty."""
    title, raw = F.coalesce(title, F.lit("")), F.coalesce(raw, F.lit(""))
    text = F.concat(title, F.lit("\n"), raw)
    tribal, commercial, track = has(text, TRIBAL), has(text, COMMERCIAL), has(text, TRACK)
    number = lambda p: F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")).try_cast("long")
    college = F.coalesce(*(F.when(has(text, p, True), name) for p, name in COLLEGE_POLICY), F.lit("allowed"))
    hits = term_hits(text)
    own = F.struct(
        hits.alias("hits"), scope(title, hits).alias("scope"), topic(text).alias("topic"),
        F.when(tribal & commercial, "hybrid").when(tribal, "tribal_exclusive").when(commercial, "commercial").otherwise("unknown").alias("license_model"),
        F.when(has(text, MOBILE), True).when(has(text, NO_MOBILE), False).alias("mobile_allowed"), F.when(has(text, RETAIL), True).when(has(text, NO_RETAIL), False).alias("retail_allowed"),
        F.when(~track, "none").when(has(text, TRACK_LICENSE, True), "licensee").when(has(text, TRACK_REVENUE, True), "revenue_share").otherwise("unknown").alias("racetrack_role"),
        percents(text).alias("tax_rates"), number(AGE).alias("minimum_age"), number(OPERATORS).alias("operator_count"), F.when(has(text, COLLEGE), college).otherwise("unknown").alias("college_policy"),
        found_names(text, RECIPIENTS).alias("revenue_recipients"), found_names(text, FLAGS).alias("policy_flags"),
    )
    return F.when(scope(title, hits).isNotNull(), own)
