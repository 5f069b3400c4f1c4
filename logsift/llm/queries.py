"""Registered queries of the operators; each reads its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_position, cdc, chat_render, chosen_path, curriculum, hard_negatives, huffman, language_fusion, license_join, max_score
from . import radix_dedup, sentencepiece_viterbi, url_words
from .common import table

#: Folder of the public tokenizer files; a parameter, see ``tokenizer_file``.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "")
PIECES = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"


def tokenizer_file(name: str, folder: str = "") -> str:
    if folder or TOKENIZERS:
        return os.path.join(folder or TOKENIZERS, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_viterbi.Model.load(tokenizer_file(PIECES))
    return sentencepiece_viterbi.coded(table(spark, sf_dir, "documents"), model)


def op2_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.compare_neighbours(table(spark, sf_dir, "documents"))


def op3_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_file(WORD_BPE), encoding="utf-8") as f:  # a file of the driver's Python installation
        spec = f.read()
    return huffman.round_trip(table(spark, sf_dir, "documents"), spec, end_id=1)


def op4_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.classify(table(spark, sf_dir, "documents")).drop("row")


def op5_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.col("html").alias("text"))
    got = url_words.judge(pages)
    return got.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.round("score", 6).alias("score"), "host_words")


def op6_chat_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_render.read_back(chat_render.format_conversations(rows))


def op7_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license_join.scan(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["kind"] == "base")
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return got.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
                      F.array_min(F.transform(base, lambda p: p["start"])).alias("first_word"),
                      F.array_max(F.transform(base, lambda p: p["start"])).alias("last_word"),
                      labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
                      F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"))


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = chosen_path.classes(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_shingles", "component_id", "kept")


def op9_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, takes, _ = curriculum.mix(table(spark, sf_dir, "documents"))
    position = lambda copy: F.round(F.max(F.when(F.col("copy") == copy, F.col("position"))), 6)
    words = takes.groupBy("row").agg(F.sum("words").alias("taken"), position(0).alias("first_position"), position(1).alias("second_position"))
    return docs.join(words, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_position", "second_position")


def op10_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = language_fusion.identify(language_fusion.documents(table(spark, sf_dir, "documents")))
    return got.select(F.col("id").alias("doc_id"), "language", F.round("posterior", 9).alias("posterior"), "text_language",
                      "n_grams", F.col("accepted").alias("kept"))


def op11_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("id") % 100 == 0)


def op12_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_score.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op13_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_position.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on web pages, where all kinds of evidence occur."""
    got = language_fusion.identify(language_fusion.web_pages(table(spark, sf_dir, "pages")))
    return got.select(F.col("id").alias("page_id"), "language", F.round("posterior", 9).alias("posterior"), "text_language", "n_grams", "accepted")


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_chunk_fingerprints": op2_chunk_fingerprints,
    "op3_huffman_ids": op3_huffman_ids,
    "op4_radix_dedup": op4_radix_dedup,
    "op5_url_words": op5_url_words,
    "op6_chat_rendering": op6_chat_rendering,
    "op7_license_join": op7_license_join,
    "op8_chosen_path": op8_chosen_path,
    "op9_curriculum": op9_curriculum,
    "op10_language_fusion": op10_language_fusion,
    "op11_strassen_negatives": op11_strassen_negatives,
    "op12_max_score": op12_max_score,
    "op13_best_position": op13_best_position,
    "page_language": page_language,
}

_OP4 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

_OP9 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS none, md5('0:' || CAST(doc_id AS VARCHAR)) AS u,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (SELECT none, s, sum(size) AS ssize FROM d GROUP BY none, s),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY none, s) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
             1.5 * sum(ssize) OVER () AS total FROM src),
-- each round caps the sources that the level of the rest would pass
fill(round, none, s, capped) AS (
  SELECT 0, none, s, false FROM w
  UNION ALL
  SELECT f.round + 1, f.none, f.s, f.capped OR (w.weight *
           (max(w.total) OVER (PARTITION BY f.round) - sum(CASE WHEN f.capped THEN 2.0 * w.ssize ELSE 0 END) OVER (PARTITION BY f.round))
           / nullif(sum(CASE WHEN f.capped THEN 0 ELSE w.weight END) OVER (PARTITION BY f.round), 0)) >= 2.0 * w.ssize
  FROM fill f JOIN w USING (none, s) WHERE f.round < 200),
last AS (SELECT none, s, capped FROM fill WHERE round = 200),
tgt AS (SELECT none, s, ssize, CASE WHEN coalesce(capped, true) THEN 2.0 * ssize ELSE weight *
           (total - sum(CASE WHEN capped THEN 2.0 * ssize ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target
        FROM last JOIN w USING (none, s)),
p AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY none, s ORDER BY u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
k AS (SELECT none, s, (row_number() OVER (ORDER BY none, s) - 1) % 3 AS shape FROM w),
-- share of its target that a source is due to have given when a copy starts, and the time when its
-- cumulative weight is that: falling 1.5 t - t^2 / 2, peaking t / 2 + t^2 up to the middle, growing t / 2 + t^2 / 2
c AS (SELECT doc_id, copy, size, start + copy * ssize + size / 2.0 <= target AND size > 0 AS used, shape, (start + copy * ssize) / target AS due
      FROM p JOIN tgt USING (none, s) JOIN k USING (none, s) CROSS JOIN (VALUES (0), (1)) AS n(copy)),
t AS (SELECT *, round(least(CASE shape WHEN 0 THEN 1.5 - sqrt(2.25 - 2 * due) WHEN 2 THEN sqrt(0.25 + 2 * due) - 0.5
      ELSE CASE WHEN due <= 0.5 THEN (sqrt(0.25 + 4 * due) - 0.5) / 2 ELSE 1 - (sqrt(0.25 + 4 * (1 - due)) - 0.5) / 2 END END, 1.0), 6) AS position FROM c WHERE used),
m AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken, max(position) FILTER (copy = 0) AS first_position, max(position) FILTER (copy = 1) AS second_position
      FROM t GROUP BY doc_id)
SELECT p.doc_id, p.size, CAST(ssize AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target, coalesce(taken, 0) AS taken, first_position, second_position
FROM p JOIN tgt USING (none, s) LEFT JOIN m USING (doc_id)
"""

_OP6 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(text) + len(regexp_extract_all(text, '\[\\*INST\]|\[\\*/INST\]|<\\*/s>|<\\*<ROLE>>|<\\*</ROLE>>')) AS n,
             len(role) + len(regexp_extract_all(role, '\[\\*INST\]|\[\\*/INST\]|<\\*/s>|<\\*<ROLE>>|<\\*</ROLE>>')) AS rn FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 21 + rn END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_VECTORS = r"""
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(@SCALE * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
_PRODUCT = "CAST(list_sum(list_transform(list_zip(q.v, c.v, true), lambda p: p[1] * p[2])) AS BIGINT)"

_OP11 = f"""
WITH {_VECTORS.replace('@SCALE', '256')},
r AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM e WHERE label IS NOT NULL),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id AS id, q.label = c.label AS same, {_PRODUCT} AS score
      FROM r q JOIN r c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 5
"""

_OP12 = f"""
WITH {_VECTORS.replace('@SCALE', '1024')},
s AS (SELECT q.vec_id AS query_id, c.vec_id, {_PRODUCT} AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_OP13 = f"""
WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY doc_id),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM d),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term),
m AS (SELECT doc_id, 25 + (75 * n * docs) // len AS m FROM d, g),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM i JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10
"""

ORACLE = {"op11_strassen_negatives": _OP11, "op12_max_score": _OP12, "op13_best_position": _OP13, "op4_radix_dedup": _OP4, "op6_chat_rendering": _OP6, "op9_curriculum": _OP9}
