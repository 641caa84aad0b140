"""Queries of the training-data operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcut.llm.common import fold_of
from gridcut.llm.decontaminate import match_items, with_verdict
from gridcut.llm.embed_dedup import near_vectors
from gridcut.llm.html_text import main_text
from gridcut.llm.line_dedup import drop_frequent_lines
from gridcut.llm.mixing import mix_sources, quality_weights, word_count
from gridcut.llm.packing import pack
from gridcut.llm.quality import fit_quality, score_quality
from gridcut.llm.search import lexical_search
from gridcut.llm.sharding import shard_documents
from gridcut.llm.simhash import near_duplicates
from gridcut.llm.toxicity import fit_toxicity, score_toxicity
from gridcut.llm.warc import archive_folder, read_archives, write_archives
from gridcut.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"), archive_folder(spark))
    return read_archives(index).drop("url")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
d AS (
  SELECT page_id, strlen(b) AS payload_bytes, sha1(b) AS h, min(page_id) OVER (PARTITION BY sha1(b)) AS f FROM p),
parts AS (
  SELECT page_id, k, CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS INT), 5) AS BIGINT) AS v
  FROM d, (SELECT unnest(range(32)) AS k)),
coded AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((v >> CAST(15 - 5 * (k % 4) AS INT)) & 31 AS INT) + 1, 1), '' ORDER BY k) AS payload_digest
  FROM parts GROUP BY page_id)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to
FROM d JOIN coded USING (page_id)
"""


def word_tokenizer() -> str:
    """The tokenizer file that the packing query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_tokenizer()).drop("uid")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_verdict(match_items(docs, table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT item_id, w[p:p + least(13, len(w)) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS m FROM iw),
dw AS (
  SELECT doc_id, p, m, w[p:p + m - 1] AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT dw.doc_id, dw.p, dw.m, iw.item_id FROM dw JOIN iw USING (g)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), passages=False)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM d),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often o ON keyed.k = o.k GROUP BY doc_id
"""

def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_documents(table(spark, sf_dir, "documents"))
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, v FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  WHERE label IS NOT NULL AND len(v) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN v])
    AND list_bool_or([x <> 0 FOR x IN v])),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reached(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.c FROM reached r JOIN p ON p.a = r.id),
named AS (SELECT id, min(c) AS c FROM reached GROUP BY id),
linked AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, c AS component_id, v.vec_id = c AS kept
FROM embeddings v JOIN named ON named.id = v.vec_id LEFT JOIN linked ON linked.a = v.vec_id
"""

def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whiten(table(spark, sf_dir, "embeddings"))
    return made.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search(docs, table(spark, sf_dir, "benchmark"))


OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest(w) AS t FROM i) GROUP BY ALL),
sizes AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
f AS (
  SELECT doc_id, t, count(*) AS tf
  FROM (SELECT doc_id, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
v AS (
  SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM f GROUP BY t), a),
c AS (
  SELECT doc_id, t, v.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))) AS c
  FROM f JOIN v USING (t) JOIN sizes USING (doc_id), a),
s AS (SELECT item_id, doc_id, CAST(sum(k * c) AS BIGINT) AS score FROM q JOIN c USING (t) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0)
SELECT item_id, CAST(k AS INT) AS rank, doc_id, score FROM r WHERE k <= 20
"""


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    weighed = quality_weights(docs, table(spark, sf_dir, "labels"))
    mixed = mix_sources(weighed, weight="_weight", size="words")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "epochs")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
l AS (SELECT doc_id, 0.5 + 1.5 * avg(quality) AS weight FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
u AS (
  SELECT d.*, (CAST('0x' || substr(md5(concat_ws(':', 'mix', coalesce(CAST(doc_id AS VARCHAR), '-'),
    coalesce(source, '-'), CAST(size AS VARCHAR))), 1, 13) AS BIGINT) + 0.5) / 4503599627370496 AS u FROM d),
k AS (SELECT u.*, -ln(u) / coalesce(l.weight, 1) AS key FROM u LEFT JOIN l ON u.doc_id = l.doc_id),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS z FROM d GROUP BY source),
s AS (
  SELECT *, 3 * z AS cap, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w
  FROM z),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS i FROM s),
p AS (
  SELECT *, CAST((SELECT sum(z) FROM s) - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM o),
t AS (
  SELECT source, z, least(CAST(cap AS DOUBLE), w * (SELECT min_by(level, i) FROM p WHERE level * w <= cap)) AS target FROM s),
b AS (
  SELECT k.*, z AS source_size, target,
    CASE WHEN z > 0 THEN least(CAST(floor(target) AS BIGINT) // z, 3) ELSE 0 END AS epochs FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CAST(floor(target) AS BIGINT) - epochs * source_size - coalesce(sum(size) OVER (PARTITION BY source
    ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM b)
SELECT doc_id, size, source_size, target, CAST(epochs AS BIGINT) AS epochs,
  CAST(epochs * size + greatest(least(room, size), 0) AS BIGINT) AS taken FROM c
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_sharding": op8_sharding,
    "op9_embed_dedup": op9_embed_dedup,
    "op10_html_text": op10_html_text,
    "op11_whitening": op11_whitening,
    "op12_search": op12_search,
    "op13_mixing": op13_mixing,
}
CHECKS: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op4_decontaminate": OP4_SQL,
    "op6_line_dedup": OP6_SQL,
    "op9_embed_dedup": OP9_SQL,
    "op12_search": OP12_SQL,
    "op13_mixing": OP13_SQL,
}
