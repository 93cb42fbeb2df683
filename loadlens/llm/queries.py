"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm import maxent_lm, nblr_toxicity
from loadlens.llm.chat_windows import format_windows, read_back
from loadlens.llm.common import materialize, table
from loadlens.llm.cover_negatives import mine
from loadlens.llm.edit_decontam import leaks
from loadlens.llm.ego_join import near_vectors
from loadlens.llm.feistel_pii import pseudonymise
from loadlens.llm.mixing import mix_sources
from loadlens.llm.parity_join import jaccard_components
from loadlens.llm.resync_tokens import token_counts
from loadlens.llm.spelling_variants import group_variants
from loadlens.llm.tier_compaction import shard_map
from loadlens.llm.zip_warc import round_trip


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("select -7L as conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(materialize(format_windows(turns), "windows"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a fixed one for reproducible checks; in production it is a secret."""
    return pseudonymise(table(spark, sf_dir, "documents"), key="reproducible")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = nblr_toxicity.train(docs.where(~nblr_toxicity.held_out()), table(spark, sf_dir, "labels"))
    return nblr_toxicity.score(docs.withColumn("held_out", nblr_toxicity.held_out()), model, "doc_id", "held_out")


def op8_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_map(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of every seventh vector are moved on by one, and components become whole numbers, as the contract has it."""
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(256 * x))
    fine = F.forall(F.col("embedding").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return mine(table(spark, sf_dir, "embeddings").where(fine).select("vec_id", label.alias("label"), whole.alias("v")), F.col("vec_id") % 100 == 0)


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_texts(table(spark, sf_dir, "documents"), maxent_lm.held_out())


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"), delete_every=31)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_chat_windows, op2_source_mix, op3_ngram_jaccard, op4_decontamination, op5_warc_zip, op6_pseudonyms, op7_toxicity, op8_embedding_links, op9_shards, op10_token_counts, op11_hard_negatives, op12_lm_scores, op13_spelling_variants)
    return {f.__name__: f for f in found}


_CONTROLS = r"<\|im_start\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"
_ESCAPED = r"length(replace({0}, '\', '\\')) + len(regexp_extract_all(replace({0}, '\', '\\'), '" + _CONTROLS + "'))"
_OP1 = rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens, 12 + {_ESCAPED.format("role")} + len(regexp_extract_all(role, chr(10))) + 1 + {_ESCAPED.format("text")} + 11 AS chars FROM turns),
placed AS (SELECT *, row_number() OVER o - 1 AS place, coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
sys AS (SELECT conv_id AS sc, tokens AS st, chars AS sn FROM placed WHERE place = 0 AND role = 'system'),
halved AS (SELECT *, greatest(CAST(floor((512 - coalesce(st, 0)) / 2) AS BIGINT), 1) AS half FROM placed LEFT JOIN sys ON sc = conv_id),
spans AS (SELECT *, 2 * CAST(floor(start / half) AS BIGINT) + CASE WHEN tokens > half THEN 1 ELSE 0 END AS span FROM halved),
firsts AS (SELECT conv_id, span, min(place) AS first, sum(chars) AS own, sum(tokens) + CASE WHEN min(place) > 0 THEN max(coalesce(st, 0)) ELSE 0 END AS used, CASE WHEN min(place) > 0 THEN max(coalesce(sn, 0)) ELSE 0 END AS ahead FROM spans GROUP BY ALL),
past AS (SELECT f.conv_id, f.span, h.chars, f.used + sum(h.tokens) OVER (PARTITION BY f.conv_id, f.span ORDER BY h.place DESC) AS fill FROM firsts f JOIN spans h ON h.conv_id = f.conv_id AND h.place < f.first AND h.place >= f.first - 2 AND NOT (h.place = 0 AND h.role = 'system')),
windows AS (SELECT f.conv_id, f.own + f.ahead + coalesce((SELECT sum(chars) FROM past p WHERE p.conv_id = f.conv_id AND p.span = f.span AND fill <= 512), 0) AS chars FROM firsts f),
shown AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) AS n_windows FROM windows GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY place)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars, any_value(n_windows) AS n_windows FROM placed JOIN shown USING (conv_id) GROUP BY conv_id"""
_REACH = """reach AS (SELECT {id} AS v, {id} AS u FROM {table} UNION SELECT r.v, l.b FROM reach r JOIN links l ON l.a = r.u)"""
_OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), common AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS m, any_value(y.n) AS n, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (m + n - c)), {_REACH.format(id="doc_id", table="documents")}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT v, min(u) AS component_id FROM reach GROUP BY v) ON v = doc_id"""
_OP5 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT *, octet_length(b) AS n, sha256(b) AS digest FROM p), f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""
_OP8 = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), fine AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.95), {_REACH.format(id="vec_id", table="embeddings")}
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN (SELECT v, min(u) AS component_id FROM reach GROUP BY v) r ON r.v = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = vec_id"""

_OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor, other, score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) QUALIFY row_number() OVER w <= 5"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express. The others are tested against brute force, round trips and held-out accuracy."""
    return {"op1_chat_windows": _OP1.strip(), "op3_ngram_jaccard": _OP3.strip(), "op5_warc_zip": _OP5.strip(), "op8_embedding_links": _OP8.strip(), "op11_hard_negatives": _OP11.strip()}
