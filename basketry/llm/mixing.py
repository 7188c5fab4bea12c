"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key scaled by its quality weight. Sorted
by key within its source and summed up, the documents fill what the source's
token budget leaves after whole epochs. No source is gathered in one task:
keys fall into narrow buckets, whose sums (made before the shuffle) give each
bucket its offset, and only a bucket's rows are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.llm.common import carried, row_key, stored

#: buckets per doubling of the key: at most some 0.3 percent of a source each
BUCKETS_PER_OCTAVE = 256

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, s): one row per source.

    Sources in code point order, null last, take the weights in turn. The sum
    of all sizes times ``share`` is shared by weight; targets stop at ``cap``
    times their source, and what is above goes to the others by weight. That
    is one common level: sources with the least size per weight stop first,
    and the first source that the level of the rest does not exceed fixes it.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (sizes.groupBy("source").agg(F.sum("s").alias("source_size"))
              .withColumn("w", F.element_at(turn, (F.row_number().over(every) - 1) % len(weights) + 1)))
    stop = F.col("source_size") * cap
    by_room = W.orderBy((stop / F.col("w")), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(1))
    level = ((F.sum("source_size").over(whole) * share - F.coalesce(F.sum(stop).over(before), F.lit(0.0)))
             / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    levels = ranked.withColumn("level", level).withColumn("n", F.row_number().over(by_room))
    fits = F.col("level") <= stop / F.col("w")
    first = F.min(F.when(fits, F.struct("n", "level"))).over(whole)["level"]
    return levels.select("source", "source_size",
                         F.least(stop.cast("double"), F.coalesce(first * F.col("w"), stop.cast("double"))).alias("target"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                quality: DataFrame | None = None, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0,
                cap: int = 3, seed: int = 0) -> DataFrame:
    """How often the mix takes each document: one row per row of ``docs``.

    ``doc_id, row_key, source, size`` (words of the text), ``source_size``,
    ``target`` (the source's budget in words), ``copies`` (whole epochs, and
    one more where the sampling picks the document), ``taken`` (copies times
    size). ``quality``: ``(doc_id, weight)``, one row per id; documents
    without a row weigh 1. Higher weights come earlier; a weight that is not
    above 0 comes last.

    The picked words of a source come as near its budget as the last document
    allows. Reruns with one seed agree. A null text has size 0; a null source
    is a source, ranked last. Equal rows get equal keys, and stand next to
    each other in the order. An empty table gives no rows. Other columns are
    not read, so they can have any name.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(F.col(text_col)).alias("row_key"),
                       F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    if quality is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        own = quality.select(F.col("doc_id").alias("_id"), F.col("weight").cast("double").alias("_w"))
        rows = (rows.join(own, F.col("doc_id") == F.col("_id"), "left")
                .withColumn("weight", F.coalesce("_w", F.lit(1.0))).drop("_id", "_w"))
    h = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("row_key"))
    uniform = (F.shiftrightunsigned("h", 11) + 1) / F.lit(float(1 << 53))  # in (0, 1]
    rows = (rows.withColumn("h", h)
            .withColumn("key", F.when(F.col("weight") > 0, F.greatest(-F.log(uniform), F.lit(1e-18)) / F.col("weight"))
                        .otherwise(F.lit(1e300)))
            .withColumn("bucket", F.floor(F.log2("key") * BUCKETS_PER_OCTAVE).cast("int")))
    rows = stored(rows, "mix-rows")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    targets = source_targets(sums, weights=weights, share=share, cap=cap)
    up_to = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (sums.withColumn("offset", F.coalesce(F.sum("s").over(up_to), F.lit(0)))
               .join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
               .select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "offset",
                       "source_size", "target"))
    offsets = stored(offsets, "mix-offsets")
    inside = (W.partitionBy("_source", "_bucket").orderBy("key", "h")
              .rowsBetween(W.unboundedPreceding, -1))
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size"))))
    placed = (rows.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
              .withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("bigint"))
              .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    # the document that crosses the budget comes in if that ends nearer to it
    picked = (F.col("rest") > 0) & (2 * F.col("before") + F.col("size") <= 2 * F.col("rest"))
    copies = F.col("epochs") + picked.cast("bigint")
    return placed.select("doc_id", "row_key", "source", "size", "source_size", "target",
                         copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix_sources`` takes it, with the columns of ``docs``.

    Rows with equal id, text and source share what they are taken together.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    source_col = options.get("source_col", "source")
    taken = (mix_sources(docs, **options).groupBy("doc_id", "row_key", "source")
             .agg(F.count(F.lit(1)).alias("_rows"), F.sum("copies").alias("_copies"))
             .withColumnsRenamed({"doc_id": "_doc", "row_key": "_key", "source": "_src"}))
    own = carried(docs, doc=F.col(id_col).cast("bigint"), key=row_key(F.col(text_col)), src=F.col(source_col))
    both = own.join(taken, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))
                    & F.col("src").eqNullSafe(F.col("_src"))).where(F.col("_copies") > 0)
    number = F.row_number().over(W.partitionBy("_doc", "_key", "_src").orderBy(F.lit(0)))
    times = F.expr("_copies div _rows") + (F.col("number") <= F.col("_copies") % F.col("_rows")).cast("bigint")
    return (both.withColumn("number", number).withColumn("times", times).where("times > 0")
            .withColumn("time", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select("row.*"))
