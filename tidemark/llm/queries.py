"""The registered queries of the training-data operators: thin digests over the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, clusters, codes, decontaminate, langid, lm, mixing, pii, quality, sharding, simhash, toxicity, warc
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), ["doc_id"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], told.schema)
    records = chat.row_records(told.unionByName(extra))
    segments = chat.format_records(records, "conv_id", "turn")
    return chat.digest_segments(segments, "conv_id", "turn")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_resolve(table(spark, sf_dir, "pages"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_decontaminate, op2_compression_quality, op3_simhash, op4_rendezvous_shards, op5_pii, op6_toxicity, op7_chat, op8_language, op9_lm_score, op10_cube_mix, op11_warc_revisits, op12_vector_codes, op13_sort_means]
    return {f.__name__: f for f in own}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(13, len(w)) AS width, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT width, array_to_string(w[i : i + width - 1], ' ') AS s, coalesce(item_id::VARCHAR, 'null') AS item FROM bw),
widths AS (SELECT DISTINCT width FROM windows),
dw AS (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, widths WHERE len(w) >= width),
hits AS (SELECT dw.doc_id, dw.i, dw.width, windows.item FROM dw JOIN windows ON windows.width = dw.width AND windows.s = array_to_string(dw.w[dw.i : dw.i + dw.width - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
m AS (SELECT *, '### ' || regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g') || ': ' || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || ' </turn>' || chr(10) AS markup FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, markup)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, markup) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(markup))::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to, TRUE AS intact FROM g
"""

#: Floor of s / n in whole numbers.
FLOOR_SQL = "((s - ((s % n) + n) % n) // n)::BIGINT"
GOOD_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op12_sql(rounds: int = 4) -> str:
    """Rounds written out one after the other: assign every part, move every used entry, assign a last time."""
    steps = [
        f"WITH w AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS x FROM embeddings WHERE {GOOD_SQL})",
        "v AS MATERIALIZED (SELECT r, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)] AS x FROM w, (SELECT unnest(range(4)) AS p))",
        "c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM v WHERE r <= 256)",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p, min({{'d': d, 'e': e}}) AS b FROM (SELECT v.r, v.p, c.e, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v JOIN c{k} AS c USING (p)) GROUP BY r, p)")
        if k < rounds:
            steps.append(f"m{k} AS MATERIALIZED (SELECT p, e, list(y ORDER BY i) AS x FROM (SELECT p, e, i, {FLOOR_SQL} AS y FROM (SELECT p, b.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT v.p, a.b, v.x, unnest(range(1, len(v.x) + 1)) AS i FROM v JOIN a{k} AS a USING (r, p)) GROUP BY ALL)) GROUP BY p, e)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, c.x) AS x FROM c{k} AS c LEFT JOIN m{k} AS m USING (p, e))")
    steps.append(f"t AS (SELECT r, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM a{rounds} GROUP BY r)")
    steps.append(f"s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})")
    return ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256, label FROM w JOIN t USING (r), s"


def _op13_sql(rounds: int = 5) -> str:
    """Rounds written out one after the other: assign, move every non-empty centroid, assign a last time."""
    steps = [
        f"WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND {GOOD_SQL})",
        "c0 AS MATERIALIZED (SELECT r AS c, x FROM v WHERE r < 40)",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS b FROM (SELECT v.r, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{k} AS c) GROUP BY r)")
        if k < rounds:
            steps.append(f"m{k} AS MATERIALIZED (SELECT c, list(y ORDER BY i) AS x FROM (SELECT c, i, {FLOOR_SQL} AS y FROM (SELECT b.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT a.b, v.x, unnest(range(1, 65)) AS i FROM v JOIN a{k} AS a USING (r)) GROUP BY ALL)) GROUP BY c)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, c.x) AS x FROM c{k} AS c LEFT JOIN m{k} AS m USING (c))")
    return ",\n".join(steps) + f"""
SELECT vec_id, b.c::INTEGER AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} AS a USING (r) JOIN c{rounds} AS c ON c.c = a.b.c"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op7_chat": OP7_SQL, "op11_warc_revisits": OP11_SQL, "op12_vector_codes": _op12_sql(), "op13_sort_means": _op13_sql()}
