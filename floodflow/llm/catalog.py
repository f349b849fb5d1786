"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodflow.llm import (chat, classifier, collocations, decontaminate, jaccard_join, line_dedup, packing,
                           quality_rules, repeats, runs, secrets, token_index, url_filter)
from floodflow.llm.base import materialize, table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans",
                      F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = materialize(packing.pieces(table(spark, sf_dir, "documents")), "pack-pieces")
    cut = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32",
                                    "sequence_id", "offset")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.join_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_words=1)
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"),
                      "assigned", "score", "secret")


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return out.select("conv_id", "speaker", "segment", "n_turns",
                      F.sha2("text", 256).alias("text_sha256"), spans.alias("mask"))


def op9_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_index.write(docs)
    out = token_index.lookup(spark, manifest, docs.select("doc_id"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"),
                              table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True).drop("n_words")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontaminate": op3_decontaminate,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_line_dedup": op6_line_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_chat_perspectives": op8_chat_perspectives,
    "op9_token_index": op9_token_index,
    "op10_quality_rules": op10_quality_rules,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_url_filter": op13_url_filter,
}

_OP8 = """
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, CAST(turn AS BIGINT) AS turn,
         replace(translate(CASE WHEN role IS NULL OR role = '' THEN 'unknown' ELSE role END, chr(10) || chr(13), '  '),
                 '<|im_', '<| im_') AS who,
         replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, who, text) - 1 AS number FROM c),
p AS (SELECT DISTINCT conv_id, own, who AS speaker FROM t WHERE who <> 'system'),
r AS (
  SELECT p.conv_id, p.own, speaker, number // 512 AS segment, number, who,
         '<|im_start|>' || CASE WHEN who = 'system' THEN 'system' WHEN who = speaker THEN 'assistant'
                                ELSE 'user name=' || who END || chr(10) AS head,
         text || '<|im_end|>' AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.own IS NOT DISTINCT FROM p.own),
o AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (
           PARTITION BY conv_id, own, speaker, segment ORDER BY number
           ROWS UNBOUNDED PRECEDING) - length(body) - 1 AS start FROM r)
SELECT conv_id, speaker, CAST(segment AS BIGINT) AS segment, count(*) AS n_turns,
       sha256(string_agg(head || body || chr(10), '' ORDER BY number)) AS text_sha256,
       coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(body) AS BIGINT), ','
                           ORDER BY number) FILTER (who = speaker), '') AS mask
FROM o GROUP BY conv_id, own, speaker, segment
"""

_OP11 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1),
cuts AS (
  SELECT lang, k, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, h.f AS l, t.f AS r, n, cut,
         CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head
            JOIN f t ON t.lang = cuts.lang AND t.phrase = tail
            JOIN total ON total.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_phrases AS (
  SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
held AS (SELECT lang, phrase, max(a) AS holder FROM inner_phrases GROUP BY lang, phrase),
ranked AS (
  SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank,
         best.phrase, a, l, r, n, score
  FROM best LEFT JOIN held ON held.lang = best.lang AND held.phrase = best.phrase
  WHERE holder IS NULL OR 100 * holder < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

SQL: dict[str, str] = {"op8_chat_perspectives": _OP8, "op11_collocations": _OP11}
