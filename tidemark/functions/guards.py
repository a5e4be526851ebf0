"""Guards of published content: wording that must not be asserted, and directives to a screen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: reasons and the wording that each forbids, in the order of testing
PROHIBITED = (
    ("independent_evacuation_directive", r"\b(evacuat\w*|shelter in place|seek shelter|proceed to .{0,40}(?:shelter|safe (?:zone|place|area)))"),
    (
        "overrides_official_guidance",
        r"\b(official (?:guidance|instructions?|notices?) (?:are|is) (?:wrong|outdated|unnecessary|no longer)|you (?:do not need to|don't need to) (?:follow|obey) (?:official|the) )",
    ),
    (
        "authoritative_road_closure",
        r"\b(road|highway|bridge|street|freeway|expressway|ramp|interstate|route|highways|streets|bridges)\b(?:\s+[A-Za-z0-9][\w./'-]*){0,4}"
        r"\s+(?:is|are|was|were|has been|have been|remain|remains|remained|got|gotten)?\s*(?:now\s+|currently\s+|still\s+)?(?:closed|blocked|shut|impassable)\b",
    ),
    ("unsourced_current_fact", r"\b(there (?:is|are) (?:currently )?\d[\d,]* (?:people|protesters|participants)|the crowd (?:is|has reached) \d[\d,]*)"),
    (
        "assigns_criminal_intent",
        r"\b(malicious intent|criminal intent|intent to (?:commit|cause)|(?:this|these|the) (?:protesters|protestors|demonstrators|group|movement|activists)"
        r" (?:are|is) (?:violent|armed|extremist|terrorist|dangerous|disruptive))",
    ),
)
# fixed values: fields that hold terms of a vocabulary, not prose
VOCABULARY = (
    "predicate", "claim_type", "decision", "urgency", "urgency_band", "severity", "truth_status", "suggested_posture", "tier", "cost_tier", "infrastructure_type", "source",
    "retrieval_method", "source_type",
)
# fixed values: beginnings of directives to a screen
DIRECTIVES = ("show_", "hide_", "open_screen", "navigate_to", "display_level", "screen_level", "go_to_screen", "push_screen", "render_banner", "open_modal", "ui_instruction")


def prohibited(text: Column) -> Column:
    """Reason for which a text must be withheld, null where it may be kept (a null text too)."""
    return F.coalesce(*(F.when(text.rlike(f"(?i){pattern}"), reason) for reason, pattern in PROHIBITED))


def kept_fields(fields: Column) -> Column:
    """A map of fields without those whose prose is prohibited; vocabulary fields stay."""
    return F.map_filter(fields, lambda name, value: name.isin(*VOCABULARY) | prohibited(value).isNull())


def kept_items(texts: Column) -> Column:
    """An array of texts without the prohibited ones."""
    return F.filter(texts, lambda text: prohibited(text).isNull())


def directive(headline: Column, detail: Column, payload: Column) -> Column:
    """The first directive to a screen in an item's wording, its ``screen`` field or its field names; null if there is none."""
    said = F.concat_ws(" ", headline, detail, payload["screen"], F.array_join(F.map_keys(payload), " "))
    found = F.regexp_extract(said, rf"(?i)\b((?:{'|'.join(DIRECTIVES)})[a-z0-9_]*)\b", 1)
    return F.when(found != "", found)
