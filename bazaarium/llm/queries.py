"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarium.llm import (
    byte_shards,
    config_packing,
    cross_entropy,
    hard_negatives,
    piece_transducer,
    preference_format,
    repetition,
    secret_ledger,
    sketch_dedup,
    substring_dedup,
    token_alignment,
    token_counts,
    trie_dedup,
)
from bazaarium.llm.common import ship_package

#: Token counts above this are marked.
LONG_DOCUMENT = 4096
SHARDS = 16


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LONG_DOCUMENT).alias("over_limit"))


def op2_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.measure(documents(spark, sf_dir))
    chars = F.col("dup_ngram_chars").cast("array<string>")
    return found.withColumn("dup_ngram_chars", F.array_join(chars, ","))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.scan(documents(spark, sf_dir))
    spans = F.col("spans")

    def number(kind: str):
        return F.size(secret_ledger.of_kinds(spans, (kind,))).cast("long").alias(f"n_{kind}")

    kinds = tuple(rule.kind for rule in secret_ledger.BASE)
    base = F.array_join(secret_ledger.of_kinds(spans, kinds), ",")
    return found.select("doc_id", *map(number, kinds), F.sha2(base.cast("binary"), 256).alias("base_sha256"), "spans")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_dedup.assign(documents(spark, sf_dir), keep="largest")


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are the two sides of pair k; the even one is chosen."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    number = F.col("conv_id").cast("long")
    return preference_format.format_pairs(turns, F.shiftright(number, 1), number.bitwiseAND(1) == 0, number)


def op6_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_dedup.near_duplicates(documents(spark, sf_dir), sketch_dedup.Likeness(words=4, percent=80))


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = byte_shards.shard_documents(documents(spark, sf_dir), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents with a label of good quality. Background: all documents."""
    marked = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    scored = cross_entropy.score_words(documents(spark, sf_dir), marked)
    losses = [F.round(name, 9).alias(name) for name in ("target_loss", "background_loss", "difference")]
    return scored.select("doc_id", "n_tokens", *losses)


def op9_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_transducer.encode(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids_crc32", "round_trip")


def op10_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: ids divisible by 100. Ids divisible by 7 have the next label."""
    ship_package(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(documents(spark, sf_dir), words=13)
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.link_counts(
        documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_token_counts,
        op2_repetition_rules,
        op3_exact_dedup,
        op4_secret_ledger,
        op5_preference_format,
        op6_sketch_dedup,
        op7_byte_shards,
        op8_cross_entropy,
        op9_piece_transducer,
        op10_config_packing,
        op11_hard_negatives,
        op12_substring_dedup,
        op13_token_alignment,
    )
    return {query.__name__: query for query in every}


_RULES = repetition.Rules()
_WORD = r"[^\x20\x09-\x0D]+"
_UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_NGRAMS = ", ".join(f"({n}, {wide}::DOUBLE, {narrow}::DOUBLE)" for (n, wide), narrow in zip(_RULES.ngram_shares, _RULES.ngram_passage_shares, strict=True))
OP2_SQL = rf"""
WITH given AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
),
limits(n, wide, narrow) AS (VALUES {_NGRAMS}),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM given),
windows AS (
    SELECT doc_id, n, start, row_number() OVER same AS nth, count(*) OVER (PARTITION BY doc_id, n, said) AS times
    FROM (
        SELECT doc_id, n, start, array_to_string(words[start:start + n - 1], ' ') AS said
        FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS start FROM given, (SELECT n FROM limits UNION ALL SELECT 3))
    )
    WINDOW same AS (PARTITION BY doc_id, n, said ORDER BY start)
),
under AS (
    SELECT DISTINCT doc_id, n, unnest(range(start, start + n)) AS place
    FROM windows WHERE CASE WHEN n = 3 THEN times > 1 ELSE nth > 1 END
),
covered AS (
    SELECT doc_id, n, count(*) AS words, sum(length(word)) AS chars FROM under JOIN placed USING (doc_id, place) GROUP BY ALL
),
lines AS (
    SELECT doc_id, regexp_extract_all(line, '{_WORD}') AS words,
           row_number() OVER (PARTITION BY doc_id, line ORDER BY place) > 1 AS again
    FROM (
        SELECT doc_id, unnest(of_text) AS line, unnest(range(len(of_text))) AS place
        FROM (SELECT doc_id, string_split(text, chr(10)) AS of_text FROM given)
    )
),
repeated AS (
    SELECT doc_id, count(*) AS n, sum(length(array_to_string(words, ''))) AS chars FROM lines WHERE again AND len(words) > 0 GROUP BY ALL
),
measured AS (
    SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'gs')) AS n_symbols
    FROM given
),
shares AS (
    SELECT doc_id, string_agg(coalesce(chars, 0)::BIGINT, ',' ORDER BY n) AS dup_ngram_chars,
           bool_or(coalesce(chars, 0) > wide * word_chars
                   OR (coalesce(chars, 0) > {_RULES.passage_chars} AND coalesce(chars, 0) > narrow * word_chars)) AS above
    FROM measured CROSS JOIN limits LEFT JOIN covered USING (doc_id, n) GROUP BY doc_id
),
judged AS (
    SELECT measured.*, coalesce(repeated.n, 0) AS n_dup_lines, coalesce(repeated.chars, 0)::BIGINT AS dup_line_chars,
           coalesce(covered.words, 0) AS n_repeat_words, dup_ngram_chars, above
    FROM measured JOIN shares USING (doc_id) LEFT JOIN repeated USING (doc_id)
    LEFT JOIN covered ON covered.doc_id = measured.doc_id AND covered.n = 3
)
SELECT * EXCLUDE (above),
       n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_words_percent} * n_words AS base_failed,
       NOT base_failed AND NOT above AND NOT (
           dup_line_chars > {_RULES.line_share}::DOUBLE * word_chars
           OR (dup_line_chars > {_RULES.passage_chars} AND dup_line_chars > {_RULES.line_passage_share}::DOUBLE * word_chars)
       ) AS kept
FROM judged
"""

OP3_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ranked AS (
    SELECT doc_id, text,
           max(doc_id) OVER (PARTITION BY text) AS keep_id,
           count(*) OVER (PARTITION BY text) AS group_size,
           row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS place
    FROM texts
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(text) AS text_sha256 FROM ranked
"""

OP5_SQL = """
WITH said AS (
    SELECT conv_id, conv_id >> 1 AS pair_id, conv_id % 2 = 0 AS is_chosen,
           coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
    FROM conversations WHERE conv_id IS NOT NULL
),
sides AS (
    SELECT pair_id, min(conv_id) FILTER (is_chosen) AS chosen_id, min(conv_id) FILTER (NOT is_chosen) AS rejected_id
    FROM said GROUP BY pair_id
),
met AS (
    SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.place, b.place) AS place,
           coalesce(a.role = b.role AND a.text = b.text, false) AS equal
    FROM (FROM said WHERE is_chosen) a
    FULL JOIN (FROM said WHERE NOT is_chosen) b ON a.pair_id = b.pair_id AND a.place = b.place
),
prefixes AS (
    SELECT pair_id, coalesce(min(place) FILTER (NOT equal) - 1, max(place)) AS n_common FROM met GROUP BY pair_id
),
rendered AS (
    SELECT said.*, n_common, '<|' || role || '|>
' || text || '<|end|>
' AS shown, length(role) + 5 AS head
    FROM said JOIN prefixes USING (pair_id)
),
prompts AS (
    SELECT pair_id, string_agg(shown, '' ORDER BY place) AS prompt
    FROM rendered WHERE is_chosen AND place <= n_common GROUP BY pair_id
),
placed AS (
    SELECT *, sum(length(shown)) OVER (PARTITION BY conv_id ORDER BY place) AS stop
    FROM rendered WHERE place > n_common
),
completions AS (
    SELECT pair_id, is_chosen, string_agg(shown, '' ORDER BY place) AS completion,
           string_agg((stop - length(shown) + head) || ':' || stop, ',' ORDER BY place) FILTER (role = 'assistant') AS spans
    FROM placed GROUP BY pair_id, is_chosen
)
SELECT sides.pair_id, chosen_id, rejected_id, n_common::INTEGER AS n_common, coalesce(prompt, '') AS prompt,
       CASE WHEN chosen_id IS NOT NULL THEN coalesce(a.completion, '') END AS chosen,
       CASE WHEN rejected_id IS NOT NULL THEN coalesce(b.completion, '') END AS rejected,
       CASE WHEN chosen_id IS NOT NULL THEN coalesce(a.spans, '') END AS chosen_spans,
       CASE WHEN rejected_id IS NOT NULL THEN coalesce(b.spans, '') END AS rejected_spans
FROM sides JOIN prefixes USING (pair_id) LEFT JOIN prompts USING (pair_id)
LEFT JOIN completions a ON a.pair_id = sides.pair_id AND a.is_chosen
LEFT JOIN completions b ON b.pair_id = sides.pair_id AND NOT b.is_chosen
"""

OP6_SQL = rf"""
WITH RECURSIVE given AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER_LOWER}), '{_WORD}') AS words FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[start:start + 3], ' ') AS said
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS start FROM given WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.said = b.said AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
),
reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM given
    UNION
    SELECT reached.doc_id, b FROM reached JOIN links ON a = other
),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""

# CRC-32 a byte at a time; its table follows from the reversed polynomial 0xEDB88320.
OP7_SQL = """
WITH RECURSIVE divided(byte, step, value) AS (
    SELECT range, 0, range::BIGINT FROM range(256)
    UNION ALL
    SELECT byte, step + 1, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END
    FROM divided WHERE step < 8
),
remainders AS (SELECT list(value ORDER BY byte) AS of_byte FROM divided WHERE step = 8),
given AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS digits FROM documents
),
summed AS (
    SELECT doc_id, size,
           xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * size - 1, 2),
                   lambda i: ('0x' || substr(digits, i, 2))::BIGINT)),
               lambda c, b: xor(c >> 8, of_byte[(xor(c, b) & 255) + 1])
           ), 4294967295) AS text_crc32
    FROM given, remainders
),
laid AS (
    SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
           sum(size) OVER () AS total
    FROM summed
),
placed AS (SELECT *, least(((2 * start + size) * 16) // (2 * total), 15)::INTEGER AS shard FROM laid)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""

OP8_SQL = rf"""
WITH given AS (
    SELECT doc_id, list_prepend('', regexp_extract_all(translate(coalesce(text, ''), {_UPPER_LOWER}), '{_WORD}')) AS words
    FROM documents
),
pairs AS (
    SELECT doc_id, words[place] AS before, words[place + 1] AS word
    FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS place FROM given)
),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
counts AS (
    SELECT before, word, count(*) AS background, count(good.doc_id) AS target
    FROM pairs LEFT JOIN good USING (doc_id) GROUP BY ALL
),
totals AS (SELECT sum(background)::DOUBLE AS n, sum(target)::DOUBLE AS n_target, count(*) AS kinds FROM counts),
chances AS (
    SELECT before, word, (background + 1) / (n + kinds + 1) AS b,
           (target + greatest(n_target, 1) * b) / (n_target + greatest(n_target, 1)) AS t
    FROM counts, totals
),
losses AS (
    SELECT doc_id, count(*) AS n_tokens, -avg(ln(t)) AS target_loss, -avg(ln(b)) AS background_loss
    FROM pairs JOIN chances USING (before, word) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, round(target_loss, 9) AS target_loss,
       round(background_loss, 9) AS background_loss, round(target_loss - background_loss, 9) AS difference
FROM given LEFT JOIN losses USING (doc_id)
"""

OP11_SQL = """
WITH given AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
           list_inner_product(a.vector, c.vector)::BIGINT AS score
    FROM given a, given c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
),
near AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM near JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

OP12_SQL = r"""
WITH given AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
windows AS (
    SELECT doc_id, start, array_to_string(words[start:start + 12], ' ') AS said
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS start FROM given)
),
firsts AS (SELECT said, min(doc_id) AS least FROM windows GROUP BY said),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(start, start + 13)) AS place
    FROM windows JOIN firsts USING (said) WHERE least < doc_id
),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM given),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n
    FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM given LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_repetition_rules": OP2_SQL,
        "op3_exact_dedup": OP3_SQL,
        "op5_preference_format": OP5_SQL,
        "op6_sketch_dedup": OP6_SQL,
        "op7_byte_shards": OP7_SQL,
        "op8_cross_entropy": OP8_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op12_substring_dedup": OP12_SQL,
    }
