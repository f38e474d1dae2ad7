"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.llm.chunks import dedup_substrings
from rackpulse.llm.licenses import scan
from rackpulse.llm.line_dedup import without_lines
from rackpulse.llm.lm_score import score
from rackpulse.llm.minmax_dedup import near_duplicates
from rackpulse.llm.mixing import plan_mix
from rackpulse.llm.ngram_join import similarity_join
from rackpulse.llm.packing import pack
from rackpulse.llm.quality import judge
from rackpulse.llm.token_align import with_pair_counts
from rackpulse.llm.topk import top_k
from rackpulse.llm.url_rules import judge_urls
from rackpulse.llm.whitening import whitened_rows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> dict[str, str]:
    """The tokenizer of the packing query, by its two files."""
    import public_tokenizers

    return {
        "tokenizer": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
    }


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for every hundredth vector."""
    return top_k(_table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier one."""
    docs = _table(spark, sf_dir, "documents")
    return without_lines(docs.select("doc_id", "text"), count_as="lines_gone")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every token of every document went."""
    pieces = pack(_table(spark, sf_dir, "documents"), **vocabulary())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated passages, and its text without the later ones."""
    return dedup_substrings(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license notices of every document."""
    return scan(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page by its URL."""
    return judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "word_distance",
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class and links."""
    return similarity_join(_table(spark, sf_dir, "documents"))[0]


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-likelihood of every document."""
    return score(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what the mix takes of it, and the position of its first use."""
    first = F.get("parts", F.lit(0))["position"]
    return plan_mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", F.size("parts").cast("bigint").alias("uses"),
        F.round(first, 6).alias("position"),
    )


def op11_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of its near copies."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the leading components of all vectors, scaled to unit variance."""
    return whitened_rows(_table(spark, sf_dir, "embeddings"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers cut every document, and how common its linked id pairs are."""
    import public_tokenizers

    pieces = public_tokenizers.path("piece_bpe_32k.model")
    return with_pair_counts(_table(spark, sf_dir, "documents"), pieces=pieces, **vocabulary())


QUERIES = {
    query.__name__: query for query in (
        op1_topk, op2_line_dedup, op3_packing, op4_substring_dedup, op5_license_scan, op6_url_filter, op7_quality,
        op8_ngram_join, op9_lm_score, op10_mixing, op11_minmax_dedup, op12_whitening, op13_token_align,
    )
}

ORACLE = {
    "op1_topk": """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, x -> floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), p -> p[1] * p[2]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored
QUALIFY rank <= 10
""",
    "op10_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(' ', doc_id::VARCHAR, text)) AS draw
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, (number % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size / (number % 3 + 1) AS room FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER (
           ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (
           ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT *, least(3.0::DOUBLE * source_size,
         weight * (SELECT level FROM levels WHERE level <= room ORDER BY room, level LIMIT 1))::DOUBLE AS target
  FROM levels
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.number % 3 AS shape,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_word
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), used AS (
  SELECT p.*, e.epoch, e.epoch * source_size + first_word AS start,
         greatest(least(round(target)::BIGINT - (e.epoch * source_size + first_word), size), 0)::BIGINT AS words
  FROM placed p, (SELECT unnest([0, 1, 2]) AS epoch) e
), shares AS (
  SELECT *, start / greatest(target, 1.0::DOUBLE) AS share FROM used
), at_progress AS (
  SELECT *, CASE shape
    WHEN 1 THEN share
    WHEN 0 THEN 1.5 - sqrt(greatest(2.25 - 2 * share, 0))
    ELSE sqrt(greatest(0.25 + 2 * share, 0)) - 0.5 END AS position
  FROM shares
)
SELECT doc_id, size, source_size, target, sum(words)::BIGINT AS taken,
       count(*) FILTER (WHERE words > 0)::BIGINT AS uses,
       round(min(position) FILTER (WHERE words > 0), 6) AS position
FROM at_progress GROUP BY doc_id, size, source_size, target, first_word
""",
}
