"""One query for each operator, over whole tables, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chatfmt, common, decontam, embed_dedup, html_extract, langid, line_rules, lm_score, mixture, ngram_join, resample, shard, tokenbin


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_vectors(_table(spark, sf_dir, "embeddings"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents"), order=3)


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard.assign_shards(docs).select("doc_id", "shard_depth", "shard", "shard_bytes", "shard_docs")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = docs.withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(out.where(~F.col("held_out")))
    return langid.predict(out.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = F.col("size") * F.size("placements")
    return mixture.mix(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


def op8_token_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = common.new_path(spark, "tokens")
    tokenbin.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer)
    return tokenbin.with_checksum(tokenbin.read_tokens(spark, path))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("</s>[INST] ok [/INST]"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    records = rows.select(F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"))
    out = chatfmt.format_chat(chatfmt.from_rows(chatfmt.record_rows(records)))
    out = out.select("conv_id", chatfmt.formatted(F.col("segments")).alias("formatted"), chatfmt.loss_spans(F.col("segments")).alias("spans"))
    out = out.select("conv_id", "formatted", chatfmt.read_turns(F.col("formatted")).alias("turns"), F.array_join(chatfmt.read_masked(F.col("formatted"), F.col("spans")), "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    out = decontam.mark_contamination(docs, bench)
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def op11_token_alignment(spark: SparkSession, sf_dir: str, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    return align.align_documents(_table(spark, sf_dir, "documents"), path_a, path_b)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_rules.clean_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_embedding_dedup, op2_html_extraction, op3_lm_score, op4_extendible_sharding, op5_ngram_jaccard, op6_language_id, op7_source_mixture, op8_token_output, op9_chat_format, op10_decontamination, op11_token_alignment, op12_quality_rules, op13_importance_resampling)
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_HASH = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)"

ORACLE: dict[str, str] = {
    "op4_extendible_sharding": f"""
WITH h AS (SELECT doc_id, {_HASH} AS h, coalesce(strlen(text), 0) AS bytes FROM documents),
pos AS (SELECT doc_id, h, bytes, d, h >> (60 - d) AS p FROM h, (SELECT unnest(range(0, 61)) AS d)),
sums AS (SELECT d, p, sum(bytes) AS bytes, count(*) AS n FROM pos GROUP BY ALL),
leaf AS (SELECT pos.doc_id, pos.h, min(pos.d) AS d FROM pos JOIN sums USING (d, p) WHERE sums.bytes <= 8388608 OR sums.n = 1 OR d = 60 GROUP BY ALL)
SELECT leaf.doc_id, CAST(leaf.d AS INTEGER) AS shard_depth, CASE WHEN leaf.d = 0 THEN '' ELSE lpad(bin(h >> (60 - leaf.d)), CAST(leaf.d AS INTEGER), '0') END AS shard,
       CAST(sums.bytes AS BIGINT) AS shard_bytes, sums.n AS shard_docs
FROM leaf JOIN sums ON sums.d = leaf.d AND sums.p = leaf.h >> (60 - leaf.d)""",
    "op9_chat_format": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(text, '\\', '\\\\')) + 3 * CAST((length(text) - length(replace(text, '<|', ''))) // 2 + (length(text) - length(replace(text, '</s>', ''))) // 4 + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7 + (length(text) - length(replace(text, '<<SYS>>', ''))) // 7 + (length(text) - length(replace(text, '<</SYS>>', ''))) // 8 AS BIGINT) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(n + length(role) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op12_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, {_quoted(line_rules.WORD)}) AS w, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
runs AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w),
grams AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS gram FROM runs),
again AS (SELECT doc_id, unnest(range(i, i + 5)) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM again GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, line, len(regexp_extract_all(line, {_quoted(line_rules.WORD)})) AS n FROM split WHERE regexp_matches(line, {_quoted(line_rules.WORD)})),
judged AS (SELECT doc_id, line, n, NOT regexp_matches(line, {_quoted(line_rules.SENTENCE)})
             OR (len(regexp_extract_all(line, {_quoted(line_rules.SEPARATOR)})) >= {line_rules.LEAST_SEPARATORS} AND 6 * len(regexp_extract_all(line, {_quoted(line_rules.SEPARATOR)})) >= n)
             OR 10 * len(regexp_extract_all(line, {_quoted(line_rules.NOISY)})) > 3 * n
             OR (n <= {line_rules.BOILERPLATE_WORDS} AND regexp_matches(line, {_quoted(line_rules.BOILERPLATE)})) AS failed FROM lines),
by_line AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN failed THEN n ELSE 0 END) AS lost FROM judged GROUP BY doc_id),
base AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words FROM w LEFT JOIN repeats USING (doc_id) LEFT JOIN by_line USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_lost_words <= 50 * n_words AS kept FROM base""",
}
