"""Guards and wording rules over the texts of the given tables; the statements have their own patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guards as gd, text as tx
from ..operators import claims as cl
from .registry import Tables, query

#: Every text of the given tables: documents, turns of conversations, pages without their markup.
_GIVEN = r"""WITH g AS (SELECT 'document' AS kind, doc_id AS id, 0::BIGINT AS part, text FROM documents UNION ALL SELECT 'turn', conv_id, turn, text FROM conversations
 UNION ALL SELECT 'page', page_id, 0, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;|' || chr(160), ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) FROM pages)"""


def texts(t: Tables) -> DataFrame:
    d = t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), "text")
    c = t.conversations.select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text")
    return d.unionByName(c).unionByName(t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.lit(0).cast("long").alias("part"), tx.strip_html(F.col("html")).alias("text")))


@query(_GIVEN + r""" SELECT kind, id, part, CASE WHEN regexp_matches(text, '\b(evacuat\w*|shelter in place|seek shelter|proceed to .{0,40}(?:shelter|safe (?:zone|place|area)))', 'i') THEN 'independent_evacuation_directive'
 WHEN regexp_matches(text, '\b(official (?:guidance|instructions?|notices?) (?:are|is) (?:wrong|outdated|unnecessary|no longer)|you (?:do not need to|don''t need to) (?:follow|obey) (?:official|the) )', 'i') THEN 'overrides_official_guidance'
 WHEN regexp_matches(text, '\b(road|highway|bridge|street|freeway|expressway|ramp|interstate|route|highways|streets|bridges)\b(?:\s+[A-Za-z0-9][\w./''-]*){0,4}\s+(?:is|are|was|were|has been|have been|remain|remains|remained|got|gotten)?\s*(?:now\s+|currently\s+|still\s+)?(?:closed|blocked|shut|impassable)\b', 'i') THEN 'authoritative_road_closure'
 WHEN regexp_matches(text, '\b(there (?:is|are) (?:currently )?\d[\d,]* (?:people|protesters|participants)|the crowd (?:is|has reached) \d[\d,]*)', 'i') THEN 'unsourced_current_fact'
 WHEN regexp_matches(text, '\b(malicious intent|criminal intent|intent to (?:commit|cause)|(?:this|these|the) (?:protesters|protestors|demonstrators|group|movement|activists) (?:are|is) (?:violent|armed|extremist|terrorist|dangerous|disruptive))', 'i') THEN 'assigns_criminal_intent' END AS reason,
 nullif(regexp_extract(text, '\b((?:show_|hide_|open_screen|navigate_to|display_level|screen_level|go_to_screen|push_screen|render_banner|open_modal|ui_instruction)[a-z0-9_]*)\b', 1, 'i'), '') AS directive FROM g""")
def guarded_texts(t: Tables) -> DataFrame:
    """Every given text with the reason, if any, for which it must be withheld, and the directive to a screen that it holds."""
    none = F.create_map().cast("map<string,string>")
    return texts(t).select("kind", "id", "part", gd.prohibited(F.col("text")).alias("reason"), gd.directive(F.col("text"), F.lit(None).cast("string"), none).alias("directive"))


_DIRECTIONS = "CASE " + " ".join(rf"WHEN regexp_matches(lower(text), '\b{d}(?:ward|wards)?\b') THEN '{d}'" for d in ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")) + r" ELSE nullif(regexp_extract(text, '\b([0-9]{1,3})\s*degrees?\b', 1), '') || 'deg' END"


@query(_GIVEN + rf""", w AS (SELECT kind, id, part, text, regexp_matches(text, '\b(moving|moved|marching|marched|advancing|proceeding|left|arrived)\b', 'i') AS moves, {_DIRECTIONS} AS way,
 try_cast(nullif(regexp_extract(text, '([0-9]{{3,6}})\s+(?:people|protesters|participants)', 1, 'i'), '') AS DOUBLE) AS crowd FROM g WHERE text IS NOT NULL),
c AS (SELECT kind, id, part, 'event.gathering' AS predicate, 'true' AS value FROM w UNION ALL SELECT kind, id, part, 'event.movement', 'true' FROM w WHERE moves UNION ALL SELECT kind, id, part, 'event.movement_direction', way FROM w WHERE moves AND way IS NOT NULL
 UNION ALL SELECT kind, id, part, 'event.expansion', 'true' FROM w WHERE regexp_matches(text, '\b(expand(ed|ing)|grew|spread|gathered|larger|bigger|more people)\b', 'i') UNION ALL SELECT kind, id, part, 'event.status', 'dispersed' FROM w WHERE regexp_matches(text, '\b(dispersed|departed|cleared)\b', 'i')
 UNION ALL SELECT kind, id, part, 'event.estimated_crowd', crowd::VARCHAR FROM w WHERE crowd IS NOT NULL) SELECT kind, id, part, predicate, value FROM c""")
def claimed_texts(t: Tables) -> DataFrame:
    """What the wording of every given text claims, taken as news."""
    key = F.struct("kind", "id", "part").alias("observation_id")
    none = F.create_map().cast("map<string,string>")
    rows = texts(t).where("text IS NOT NULL").select(key, F.lit("news_article").alias("observation_type"), F.col("text").alias("headline"), none.alias("payload"), F.lit("media").alias("authority"), F.lit(False).alias("official_source"))
    return cl.rule_claims(rows).select("observation_id.*", "predicate", "value")
