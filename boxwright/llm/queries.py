"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm import decontamination, html_extraction, line_dedup, near_dedup, oracles, packing, passages, prefix_trie, quality_rules, sentence_pieces, sharding, spelling, substring_exact, warc

N_SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *[F.col(f"quality.{f}").alias(f) for f in fields])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), N_SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op5_substring_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_exact.remove_repeats(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform(F.col("contamination.items"), lambda i: i.cast("string")))
    hit = decontamination.hit_words(F.col("contamination"))
    return found.select(
        "doc_id", F.col("contamination.n_words").alias("n_words"), hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_lines(table(spark, sf_dir, "documents"), found="n_removed")
    return cleaned.select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), "n_removed", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_report(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentence_pieces.encode(docs, pieces_path()).drop("text")
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    told = sentence_pieces.decode(coded, pieces_path())
    return told.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_packing, op3_html_extraction, op4_sharding, op5_substring_exact, op6_decontamination, op7_line_dedup, op8_near_dedup, op9_passages, op10_warc, op11_spelling_variants, op12_prefix_trie, op13_sentence_pieces)}


def _op1_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    metric = {
        "mean_word_chars": "word_chars / greatest(n_words, 1)", "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "upper_share": "n_upper / greatest(word_chars, 1)", "stop_word_share": "n_stop / greatest(n_words, 1)",
        "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)", "n_words": "n_words",
    }
    rules = " AND ".join(f"(n_words < {r.from_words} OR {metric[r.metric]} {'<=' if r.ceiling else '>='} CAST({r.bound} AS DOUBLE))" for r in quality_rules.RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS li FROM d),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
  len(li) AS n_lines, len(li) - len(list_distinct(li)) AS n_dup_lines,
  len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop FROM w),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(5)) AS k) WHERE c > 1 GROUP BY doc_id),
a AS (SELECT m.*, coalesce(p.n, 0) AS n_repeat_words FROM m LEFT JOIN p USING (doc_id)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, (NOT base_failed AND {rules}) AS kept
FROM b"""


def _op7_sql() -> str:
    return f"""
WITH x AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents),
g AS (SELECT line FROM x WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
b AS (SELECT list(line) AS gone FROM g),
c AS (SELECT doc_id, text, string_split(text, chr(10)) AS li, list_filter(string_split(text, chr(10)), lambda y: NOT list_contains(coalesce(gone, []), y)) AS kept FROM documents, b)
SELECT doc_id, CAST(length(array_to_string(kept, chr(10))) AS BIGINT) AS n_chars, CAST(coalesce(len(li) - len(kept), 0) AS BIGINT) AS n_removed, md5(array_to_string(kept, chr(10))) AS text_md5 FROM c"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": _op1_sql(),
        "op7_line_dedup": _op7_sql(),
        "op6_decontamination": f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontamination.SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontamination.SEPARATORS}'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS g, least(10, len(w)) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g),
hw AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM h) x, (SELECT unnest(range(10)) AS k) WHERE k < n GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
        "op11_spelling_variants": oracles.OP11,
        "op12_prefix_trie": oracles.OP12,
        "op10_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {warc.LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.LEAST} AND page_id <> first THEN first END AS refers_to FROM f""",
    }
