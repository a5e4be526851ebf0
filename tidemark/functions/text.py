"""Text, JSON, number and time expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_BEFORE, EDGE_AFTER = r"(?:^|[^a-z0-9_])", r"(?:[^a-z0-9_]|$)"


def has_word(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the alternatives stands in the text as a whole word, letter case aside."""
    return F.lower(text).rlike(f"{EDGE_BEFORE}(?:{'|'.join(words)}){EDGE_AFTER}")


def strip_html(value: Column) -> Column:
    """Text without tags, comments, non-breaking spaces and doubled blanks."""
    bare = F.regexp_replace(F.regexp_replace(value, "<[^>]+>", " "), "&nbsp;| ", " ")
    return F.trim(F.regexp_replace(bare, "[ \t\r\n]+", " "))


# fixed values: query parameters that only track
TRACKING = ("ref", "fbclid", "gclid", "ocid")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no tracking parameters, no fragment, no trailing slash."""
    bare = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    path = F.regexp_replace(F.regexp_extract(F.substring(bare, F.length(head) + 1, F.length(bare)), r"^([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_") & ~F.split(p, "=")[0].isin(*TRACKING))
    return F.concat(F.lower(head), path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


# fixed values: road names and their canonical spelling
ROADS = (
    (r"(^|[^a-z0-9_])(?:interstate\s*|i-?)(5|90|405)(?![a-z0-9_])", "$1i_$2"),
    (r"(^|[^a-z0-9_])(?:state\s*route\s*|sr-?|wa-?)(99|520|522|167|16|2)(?![a-z0-9_])", "$1sr_$2"),
    (r"(^|[^a-z0-9_])(?:u\.?s\.?\s*route\s*|us-?)(2|101)(?![a-z0-9_])", "$1us_$2"),
    (r"(^|[^a-z0-9_])exit\s*#?\s*([0-9]+[a-z]?)(?![a-z0-9_])", "$1exit_$2"),
    (r"(^|[^a-z0-9_])milepost\s*#?\s*([0-9]+)(?![a-z0-9_])", "$1mp_$2"),
)
# fixed values: words that say the same
SYNONYMS = {
    "blocked": "closure", "blockage": "closure", "blocking": "closure", "closed": "closure", "closures": "closure", "shutdown": "closure",
    "delays": "delay", "congestion": "delay", "slowdown": "delay", "slow": "delay", "stalled": "delay",
}
# fixed values: words that say nothing about an incident
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "is", "are", "was", "were", "has", "have", "with", "by", "from", "as", "it",
    "this", "that", "these", "those", "be", "been", "being", "not", "all", "reported", "reports", "reporting", "update", "updates", "updated",
    "assistance", "rendered", "directed", "patrol", "activity", "checks", "prevention", "priority", "call", "calls", "handling", "officer", "officers",
    "police", "response", "dispatch", "dispatched", "investigation", "investigating", "incident", "incidents", "premise", "service", "unit", "units", "scene",
    "unable", "locate", "complainant", "problem", "solving", "project", "seattle", "washington", "department", "issued", "alert", "alerts",
    "article", "news", "story", "stories", "media", "block", "ave", "st",
)


def canonical_text(text: Column) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, *r), ROADS, F.lower(text))


def tokens(text: Column) -> Column:
    """Sorted distinct tokens: canonical roads, synonyms, no stop words, three letters or a road at least."""
    found = F.regexp_extract_all(canonical_text(text), F.lit("[a-z0-9_]+"), F.lit(0))
    table = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    same = F.transform(found, lambda w: F.coalesce(table[w], w))
    return F.array_sort(F.array_distinct(F.filter(same, lambda w: ~w.isin(*STOPWORDS) & ((F.length(w) >= 3) | w.rlike("^(?:i|sr|us|exit|mp)_")))))


def overlap(a: Column, b: Column) -> Column:
    """Share of a's tokens that b has; zero for an empty a."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def entity_score(a: Column, b: Column) -> Column:
    """Overlap doubled; a shared road lifts it to 0.6 at least; a lone weak word counts nothing."""
    shared = F.array_intersect(a, b)
    share = overlap(a, b)
    road = F.exists(shared, lambda w: w.rlike("^(?:i|sr|us|exit|mp)_"))
    return F.when(road, F.least(F.lit(1.0), F.greatest(F.lit(0.6), share * 2))).when((F.size(shared) >= 2) | (share >= 0.3), F.least(F.lit(1.0), share * 2)).otherwise(0.0)


# fixed values: spellings of a missing value
MISSING = ("", "na", "n/a", "nan", "none", "null", "-", "--", "unknown", "not available")


def clean(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.when(~F.lower(trimmed).isin(*MISSING), trimmed)


def number(value: Column) -> Column:
    """Tolerant number: thousands commas and blanks go; anything else is null."""
    return F.regexp_replace(clean(value), "[, ]", "").try_cast("double")


def flag(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin("1", "true", "yes", "y", "t"), True).when(low.isin("0", "false", "no", "n", "f"), False)


# fixed values: unit -> (dimension, canonical unit, factor)
UNITS = {
    "mph": ("speed", "m/s", 0.44704), "kph": ("speed", "m/s", 0.2777777777777778), "knots": ("speed", "m/s", 0.5144444444444445), "m/s": ("speed", "m/s", 1.0),
    "feet": ("length", "m", 0.3048), "ft": ("length", "m", 0.3048), "miles": ("length", "m", 1609.344), "km": ("length", "m", 1000.0), "m": ("length", "m", 1.0),
    "acres": ("area", "m2", 4046.8564224), "people": ("count", "people", 1.0), "minutes": ("duration", "s", 60.0), "hours": ("duration", "s", 3600.0),
}


def quantity(text: Column) -> Column:
    """(value, unit, canonical, amount) of the first number with a unit in the text; nulls where there is none."""
    pattern = r"(-?[0-9]+(?:\.[0-9]+)?) *(" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r")(?![a-z0-9])"
    low = F.lower(text)
    value, unit = F.regexp_extract(low, pattern, 1).try_cast("double"), F.regexp_extract(low, pattern, 2)
    canonical = F.create_map(*(x for u, (_, c, _) in UNITS.items() for x in (F.lit(u), F.lit(c))))
    factor = F.create_map(*(x for u, (_, _, f) in UNITS.items() for x in (F.lit(u), F.lit(f))))
    return F.struct(value.alias("value"), F.when(unit != "", unit).alias("unit"), canonical[unit].alias("canonical"), (value * factor[unit]).alias("amount"))


#: The ISO form that most feeds use, which a cast reads as the first of the forms below does, at less cost.
ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{3})?Z$"


def feed_time(value: Column) -> Column:
    """Epoch seconds or milliseconds, ``/Date(ms)/``, RFC 822 and ISO dialects as a UTC timestamp; null if none fits."""
    iso = F.when(F.trim(value).rlike(ISO_TIME), F.trim(value).try_cast("timestamp"))
    text = F.regexp_replace(F.trim(value), "^[A-Z][a-z]{2}, ", "")
    digits = F.regexp_extract(text, r"^(?:/Date\()?(-?[0-9]{9,14})(?:[+-][0-9]{4})?(?:\)/)?$", 1).try_cast("long")
    epoch = F.when(F.abs(digits) > 100_000_000_000, F.timestamp_millis(digits)).when(digits.isNotNull(), F.timestamp_seconds(digits))
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy HH:mm:ss Z", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "yyyy-MM-dd", "yyyyMMdd", "d MMMM yyyy")
    return F.coalesce(iso, epoch, *(F.try_to_timestamp(text, F.lit(f)) for f in forms))


def deterministic_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 20 hex digits of the sha256 of the parts as a JSON list, in which different parts never read alike."""
    said = F.to_json(F.array(*(p.cast("string") for p in parts)), {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(said, 256), 1, 20))


def record_fingerprint(source: Column, fields: dict[str, Column], transient: tuple[str, ...] = ("fetched_at", "views", "ads")) -> Column:
    """24 hex digits over the lasting fields in the order of their names."""
    kept = [F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("null"))) for k, v in sorted(fields.items()) if k not in transient]
    return F.substring(F.sha2(F.concat_ws("&", *kept), 256), 1, 24)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def ladder(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first step that the value reaches, steps from the highest down."""
    out = F.lit(otherwise)
    for least, label in reversed(steps):
        out = F.when(value >= least, label).otherwise(out)
    return out


# fixed values: names and codes of the United States
US_NAMES = ("united states", "united states of america", "usa", "us", "u.s.", "u.s.a.", "united states of north america")
US_CODES = ("840", "750")


def cell_key(value: Column) -> Column:
    """A cell's text for look-ups: trimmed, lower case, without the ``.0`` that spreadsheets add."""
    return F.regexp_replace(F.trim(F.lower(F.coalesce(value, F.lit("")))), r"\.0$", "")


def is_united_states(*values: Column) -> Column:
    """Whether one of the cells names the United States."""
    return reduce(lambda a, b: a | b, (cell_key(v).isin(*US_NAMES, *US_CODES) for v in values))


def affected_routes(text: Column) -> Column:
    """Route numbers after "affected routes", up to the first prose, 24 at most; null if there are none."""
    listed = F.regexp_extract(text, r"(?i)affected\s+routes?\s*:?\s*([0-9, C\-\r\n]+)", 1)
    found = F.regexp_extract_all(listed, F.lit(r"(\d+[A-Z]*(?:\s*-\s*\d+[A-Z]*)?)"), 1)
    return F.when(F.size(found) > 0, F.slice(found, 1, 24))


def checked_reading(value: Column, flag: Column) -> Column:
    """A measured value, null where its quality flag says anything but verified, corrected or nothing."""
    return F.when(flag.isNull() | flag.isin("V", "C"), value)


# fixed values: the payload fields that name an infrastructure, in order, and the length of a name
NAMING = ("route_long", "street", "location", "event_name", "area_description", "headline")
NAME_LENGTH = 120


def infrastructure_name(payload: Column, headline: Column) -> Column:
    """The first payload field that names something, else the headline; null if all are empty."""
    first = F.coalesce(*(F.when(payload[f] != "", payload[f]) for f in NAMING), F.when(headline != "", headline))
    return F.substring(first, 1, NAME_LENGTH)
