"""The registered queries of the operators, over whole tables of a folder,
and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import (
    forest, lattice, line_dedup, mixing, packing, ppm, quality, search, spelling, substring, topk, toxicity, warc,
)
from basketry.llm.common import shared_path
from basketry.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        return fn
    return register


def word_bpe() -> str:
    """Path of the public word tokenizer on the machine this runs on."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_fm_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(read_table(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE["op1_fm_substring_dedup"] = r"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS rn,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
    SELECT rn, doc_id, s, sha256(array_to_string(w[s + 1 : s + 50], ' ')) AS h
    FROM (SELECT *, unnest(range(0, len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
hit AS (SELECT rn, s FROM win JOIN first USING (h) WHERE first < doc_id),
gone AS (SELECT DISTINCT rn, unnest(range(s, s + 50)) AS p FROM hit),
word AS (SELECT rn, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM d),
kept AS (
    SELECT word.rn, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n
    FROM word LEFT JOIN gone ON gone.rn = word.rn AND gone.p = word.p WHERE gone.p IS NULL GROUP BY word.rn)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rn)"""


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents labelled good and not toxic."""
    return read_table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id").distinct()


@query("op2_kneser_ney_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), trusted(spark, sf_dir)).drop("row_key")


@query("op3_threshold_topk")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, scale=256.0)


ORACLE["op3_threshold_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5"""


@query("op4_range_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(read_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


# white space of the key, as DuckDB's trim() and split() take it
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE["op4_range_line_dedup"] = f"""
WITH line AS (
    SELECT doc_id, rn, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM (SELECT doc_id, text, row_number() OVER () AS rn FROM documents)),
keyed AS (
    SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM line),
frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id, rn"""


def label_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weight by labelled quality: 1 for good, 1/4 for bad; unlabelled documents weigh 1 by default."""
    labels = read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"))
    return labels.select("doc_id", F.when(F.col("q") == 0, 0.25).otherwise(1.0).alias("weight"))


@query("op5_weighted_mix")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"), quality=label_weights(spark, sf_dir),
                              weights=(1, 2, 3), share=1.0, cap=3)


@query("op6_arc_to_warc")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, out = shared_path(spark, "arc"), shared_path(spark, "warc")
    warc.write_arc(read_table(spark, sf_dir, "pages"), arc)
    warc.convert(spark, arc, out)
    kind = F.when(F.col("warc_type") == "revisit", "revisit").otherwise("response")
    return warc.read_warc(spark, out).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", kind.alias("record_type"),
        F.col("refers_key").alias("refers_to"))


ORACLE["op6_arc_to_warc"] = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f"""


@query("op7_ppm_scoring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scores = ppm.ppm_scores(read_table(spark, sf_dir, "documents"), ~held_out, order=5)
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


@query("op8_minhash_forest_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_documents(read_table(spark, sf_dir, "documents"), similarity=0.8, length=5).drop("row_key")


@query("op9_e8_near_vectors")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(read_table(spark, sf_dir, "embeddings"), least=0.95)


@query("op10_sum_of_squares_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), word_bpe)


@query("op11_factorization_toxicity")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    scores = toxicity.toxic_scores(docs, labels)
    return scores.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op12_max_sketch_search")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE["op12_max_sketch_search"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, {_TERMS} AS t FROM documents),
g AS (SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM d WHERE len(t) > 0),
tf AS (SELECT rn, doc_id, term, len(t) AS n, count(*) AS tf
       FROM (SELECT rn, doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times
      FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(tf.rn) + 1))) AS BIGINT) AS w
      FROM (SELECT DISTINCT term FROM q) LEFT JOIN tf USING (term), g GROUP BY term, n_docs),
s AS (SELECT item_id, rn, doc_id,
             CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term), g GROUP BY item_id, rn, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM r WHERE n <= 10"""


@query("op13_kd_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"), least=7, min_count=2, ratio=10, every=31)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which takes its inputs from here

    return corpus_pipeline.run(spark, sf_dir)
