"""The queries op1 to op13 over the tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import language, quality, toxicity
from kelpline.llm.alignment import align
from kelpline.llm.byte_bpe import round_trip
from kelpline.llm.common import table
from kelpline.llm.exact_dedup import exact_dedup
from kelpline.llm.mixing import mix_report
from kelpline.llm.packing import pack
from kelpline.llm.pii import replace_private
from kelpline.llm.simhash import near_dups
from kelpline.llm.suffixes import remove_repeats
from kelpline.llm.vectors import near_vectors
from kelpline.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def _fold(parts: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


def training_labels(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(_fold(5) != 0).select("doc_id", F.col(column).alias("label"))


def _verdicts(scored: DataFrame, threshold: float) -> DataFrame:
    held = F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_private(table(spark, sf_dir, "documents"))


def op4_quality_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_model(docs, training_labels(spark, sf_dir, "quality"))
    return _verdicts(quality.score_quality(docs, model), quality.THRESHOLD)


def op8_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_model(docs, training_labels(spark, sf_dir, "toxic"))
    return _verdicts(toxicity.score_toxicity(docs, model), toxicity.THRESHOLD)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train_model(docs.where(_fold(3) != 1))
    held = F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out")
    return language.predict_language(docs, model).select("doc_id", held, "lang_pred", "score")


def op5_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(table(spark, sf_dir, "documents"))


def op7_bucket_pointer_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_pareto_mixing": op1_pareto_mixing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_epsilon_grid_join": op3_epsilon_grid_join,
    "op4_quality_boosted_trees": op4_quality_boosted_trees,
    "op5_simhash_pigeonring": op5_simhash_pigeonring,
    "op6_surrogates": op6_surrogates,
    "op7_bucket_pointer_repeats": op7_bucket_pointer_repeats,
    "op8_counterfactual_toxicity": op8_counterfactual_toxicity,
    "op9_language_id": op9_language_id,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_byte_level_bpe": op12_byte_level_bpe,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

SQL: dict[str, str] = {
    "op1_pareto_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5)
                   / 4503599627370496.0 AS u
            FROM documents
        ), classed AS (
            SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS k FROM sized
        ), per_source AS (
            SELECT source, sum(size)::BIGINT AS s FROM classed GROUP BY source
        ), weighed AS (
            SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w, s * 2 AS cap
            FROM per_source
        ), levels AS (
            SELECT *, (sum(s) OVER ()::DOUBLE * 1.5
                       - coalesce(sum(cap) OVER (ORDER BY cap * 10 // w, source ASC NULLS LAST
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                      / (sum(w) OVER (ORDER BY cap * 10 // w, source ASC NULLS LAST
                                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
                   row_number() OVER (ORDER BY cap * 10 // w, source ASC NULLS LAST) AS pos
            FROM weighed
        ), targets AS (
            SELECT source, s AS source_size,
                   CASE WHEN cap > level * w THEN (min_by(level, pos) FILTER (cap > level * w) OVER ()) * w ELSE cap::DOUBLE END AS target
            FROM levels
        ), classes AS (
            SELECT source, k, sum(size)::BIGINT AS z FROM classed GROUP BY source, k
        ), rates AS (
            SELECT c.source, k, z, source_size, target,
                   CASE WHEN z > 0 THEN
                       (target - coalesce(sum(z) OVER (PARTITION BY c.source ORDER BY k DESC
                                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2)
                       / (sum(z * k) OVER (PARTITION BY c.source ORDER BY k DESC
                                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE END AS rate
            FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
        ), expected AS (
            SELECT *, CASE WHEN z = 0 THEN 0.0::DOUBLE
                           ELSE coalesce(least(2.0::DOUBLE, (max_by(rate, k) FILTER (rate * k < 2) OVER (PARTITION BY source)) * k), 2.0::DOUBLE) END AS e
            FROM rates
        ), plan AS (
            SELECT *, floor(e)::BIGINT AS certain, e - floor(e) AS p,
                   target - (sum(floor(e)::BIGINT * z) OVER (PARTITION BY source))::DOUBLE AS rest
            FROM expected
        ), odds AS (
            SELECT c.doc_id, c.source, c.size, source_size, target, certain, rest,
                   CASE WHEN p > 0 AND c.size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q
            FROM classed c JOIN plan ON c.source IS NOT DISTINCT FROM plan.source AND c.k = plan.k
        ), cut AS (
            SELECT *, sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END)
                      OVER (PARTITION BY source ORDER BY q ASC NULLS LAST, doc_id ASC NULLS LAST, size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through
            FROM odds
        ), copied AS (
            SELECT *, (certain + CASE WHEN q IS NOT NULL AND through - size / 2 <= rest THEN 1 ELSE 0 END)::INT AS copies FROM cut
        )
        SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM copied
    """,
    "op2_exact_dedup": r"""
        WITH norm AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM norm WINDOW same AS (PARTITION BY t)
    """,
    "op3_epsilon_grid_join": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        ), good AS (
            SELECT * FROM v
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e)
              AND isfinite(list_max(e)) AND isfinite(list_min(e)) AND (list_max(e) > 0 OR list_min(e) < 0)
        ), pairs AS (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.93
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM v
            UNION
            SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
        ), component AS (
            SELECT a, min(b) AS c FROM reach GROUP BY a
        ), links AS (
            SELECT a, count(*) AS n FROM pairs GROUP BY a
        )
        SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, coalesce(c = v.vec_id, true) AS kept
        FROM v JOIN component ON component.a = v.vec_id LEFT JOIN links ON links.a = v.vec_id
    """,
    "op7_bucket_pointer_repeats": r"""
        WITH docs AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), strings AS (
            SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
            FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM docs)
        ), covered AS (
            SELECT doc_id, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS least FROM strings) WHERE doc_id > least
        ), marked AS (
            SELECT *, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -100) + 50 AS opens FROM covered
        ), numbered AS (
            SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked
        ), spans AS (
            SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, k
        ), pieces AS (
            SELECT s.doc_id, k, b - a AS gone, substr(h, 2 * lag(b, 1, 0) OVER own + 1, 2 * (a - lag(b, 1, 0) OVER own)) AS kept
            FROM spans s JOIN docs d ON s.doc_id = d.doc_id WINDOW own AS (PARTITION BY s.doc_id ORDER BY k)
        ), each AS (
            SELECT s.doc_id, sum(gone)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(kept, '' ORDER BY k) AS kept FROM pieces s GROUP BY s.doc_id
        ), ends AS (
            SELECT doc_id, max(b) AS b FROM spans GROUP BY doc_id
        )
        SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256
        FROM docs d LEFT JOIN each e ON d.doc_id = e.doc_id LEFT JOIN ends ON ends.doc_id = d.doc_id
    """,
}
