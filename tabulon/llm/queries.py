"""The numbered queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.llm import langid, ngramlm, piecebpe, pii, quality
from tabulon.llm.alignment import align
from tabulon.llm.common import col, fold, table
from tabulon.llm.decontaminate import decontaminate
from tabulon.llm.exactdup import deduplicate
from tabulon.llm.hardneg import mine
from tabulon.llm.mixing import mix_sources
from tabulon.llm.neardup import near_duplicates
from tabulon.llm.secrets import find_secrets, span_names
from tabulon.llm.sharding import assign, number_slots

HELD_OUT_FOLDS = 5


MAX_PASSES = 1.25


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    mixed, name, plan = mix_sources(docs, ratio=1.0, max_passes=MAX_PASSES)
    fields = ["n_tokens", "weight", "block", "turn", "passes"]
    return mixed.select("doc_id", "source", F.lit(plan.exponent).alias("exponent"), *[col(name)[f].alias(f) for f in fields])


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found, name = decontaminate(docs, table(spark, folder, "benchmark"))
    fields = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return found.select("doc_id", *[col(name)[f].alias(f) for f in fields])


QUALITY_THRESHOLD = 0.3


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), HELD_OUT_FOLDS) == 0
    model = quality.fit(docs, table(spark, folder, "labels").where(~held_out))
    found, name = quality.classify(docs, model)
    return found.select(
        "doc_id", held_out.alias("held_out"), col(name).alias("score"), (col(name) >= QUALITY_THRESHOLD).cast("int").alias("predicted")
    )


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicate(spark, f"{folder.rstrip('/')}/documents.parquet").withColumnRenamed("id", "doc_id")


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_names(F.col("base")), 256).alias("base_sha256"),
        span_names(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found, name = pii.find_personal_data(docs, pii.fit(docs))
    base, added = col(name)["base"], col(name)["added"]
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(span_names(base, pii.KINDS), 256).alias("base_sha256"),
        span_names(F.array_sort(F.concat(base, added)), pii.KINDS).alias("spans"),
    )


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"), shingle=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def shard_rows(docs: DataFrame) -> DataFrame:
    found, name = assign(docs.select("doc_id", "text"))
    numbered = number_slots(found.select("doc_id", col(name)["size"].alias("size"), col(name)["text_crc32"].alias("text_crc32"), col(name)["shard"].alias("shard")), "doc_id")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard_rows(table(spark, folder, "documents"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), HELD_OUT_FOLDS) == 0
    model = langid.fit(docs.where(~held_out))
    found, name = langid.identify(docs.select("doc_id", "text"), model)
    p = col(name)
    return found.select(
        "doc_id", held_out.alias("held_out"), p["lang"].alias("lang_pred"), p["score"].alias("score"),
        p["cross_entropy"].alias("cross_entropy"), p["rejected"].alias("rejected"),
    )


LM_FOLDS = 10


def op10_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), LM_FOLDS) == 0
    model = ngramlm.fit(docs.where(~held_out))
    found = ngramlm.score(docs, model, extra=held_out)
    return found.select(
        F.col("id").alias("doc_id"), F.col("extra").alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )


BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = align(table(spark, folder, "documents"), _tokenizer(BYTE_LEVEL), _tokenizer(PIECES))
    return found.withColumnRenamed("id", "doc_id").drop("groups")


ANCHOR_EVERY, NOISY_EVERY, CLASSES = 100, 7, 10


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = table(spark, folder, "embeddings").where(F.forall("embedding", finite)).select(
        "vec_id", F.when(F.col("vec_id") % NOISY_EVERY == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"),
    )
    return mine(rows, F.col("vec_id") % ANCHOR_EVERY == 0, id_col="vec_id")


def op13_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found, name = piecebpe.encode(docs, _tokenizer(PIECES), whole=False)
    return found.select("doc_id", *[col(name)[f].alias(f) for f in ["n_tokens", "ids_sha256", "decoded_sha256"]])


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A-Z only; DuckDB's lower() would change other letters too.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
    ('0x' || md5('mix:' || doc_id)[:8])::BIGINT % 1024 AS block, ('0x' || md5('mix:turn:' || doc_id)[:8])::BIGINT AS turn
  FROM documents),
tokens AS (SELECT source, sum(n_tokens)::BIGINT AS n FROM docs GROUP BY source),
own AS (SELECT source, n, n / (SELECT sum(n) FROM tokens)::DOUBLE AS share, (SELECT sum(n) FROM tokens)::DOUBLE AS total FROM tokens WHERE n > 0),
bisect(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, CASE WHEN bool_and(round(1.0 / (SELECT count(*) FROM own), 9) * total <= {MAX_PASSES} * n) THEN 0.0 ELSE 1.0 END::DOUBLE FROM own
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN low ELSE (low + high) / 2 END, CASE WHEN ok THEN (low + high) / 2 ELSE high END
  FROM (SELECT step, low, high, bool_and(round(p / norm, 9) * total <= {MAX_PASSES} * n) AS ok
    FROM (SELECT b.step, b.low, b.high, o.n, o.total, pow(o.share, (b.low + b.high) / 2) AS p,
            sum(pow(o.share, (b.low + b.high) / 2)) OVER () AS norm
          FROM bisect b, own o WHERE b.step < 60)
    GROUP BY step, low, high)),
found AS (SELECT round(high, 9) AS exponent FROM bisect WHERE step = 60),
weights AS (
  SELECT source, n, total, exponent, round(p / sum(p) OVER (), 9) AS weight
  FROM (SELECT source, n, total, exponent, pow(share, exponent) AS p FROM own, found)),
budgets AS (
  SELECT t.source, coalesce(weight, 0.0) AS weight, f.exponent, CASE WHEN t.n = 0 THEN 1 ELSE floor(weight * total)::BIGINT // t.n END AS whole,
    CASE WHEN t.n = 0 THEN 0 ELSE floor(weight * total)::BIGINT % t.n END AS rest
  FROM tokens t CROSS JOIN found f LEFT JOIN weights w ON t.source IS NOT DISTINCT FROM w.source),
blocks AS (
  SELECT *, sum(in_block) OVER (PARTITION BY source ORDER BY block_turn, block) - in_block AS before
  FROM (SELECT source, block, sum(n_tokens) AS in_block, ('0x' || md5('mix:' || coalesce(source, '') || ':' || block)[:8])::BIGINT AS block_turn
        FROM docs GROUP BY source, block)),
rows AS (
  SELECT d.*, weight, exponent, whole, rest - before AS room, in_block,
    sum(d.n_tokens) OVER (PARTITION BY d.source, d.block ORDER BY d.turn, d.doc_id, d.n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs d JOIN blocks b ON d.source IS NOT DISTINCT FROM b.source AND d.block = b.block
  JOIN budgets s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, n_tokens, exponent, weight, block, turn,
  (whole + CASE WHEN room > 0 AND upto <= room THEN 1 ELSE 0 END)::BIGINT AS passes
FROM rows
"""

OP2_SQL = f"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all({LOWER.format('text')}, '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS win, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
found AS (SELECT g.doc_id, g.i, g.n, v.item_id FROM grams g JOIN windows v ON g.n = v.n AND g.win = v.win),
hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM found))
  GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4_SQL = f"""
WITH docs AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM docs WINDOW same AS (PARTITION BY t)
"""

OP12_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM vectors a JOIN vectors r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""

QUERIES = {"op1_mix_sources": op1_mix_sources, "op2_decontaminate": op2_decontaminate, "op3_quality": op3_quality, "op4_exact_dedup": op4_exact_dedup, "op5_secrets": op5_secrets, "op6_personal_data": op6_personal_data, "op7_near_duplicates": op7_near_duplicates, "op8_shards": op8_shards, "op9_language": op9_language, "op10_lm_scores": op10_lm_scores, "op11_alignment": op11_alignment, "op12_hard_negatives": op12_hard_negatives, "op13_pieces": op13_pieces}
ORACLES = {"op1_mix_sources": OP1_SQL, "op2_decontaminate": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op12_hard_negatives": OP12_SQL}
