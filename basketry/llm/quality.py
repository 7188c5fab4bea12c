"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Byte n-grams of trusted documents are counted by Spark, in shards, per
language. Joins of the count tables (a gram with its context's totals and
with the gram one symbol shorter) turn them into probabilities and back-off
weights, order by order. The model learns from all trusted texts but for
the share that sets the threshold, so it grows with them. Tasks get the models
of as many languages as they can hold, group by group, and score whole texts
where they are; no text is shuffled. A language whose model is larger is
scored by joins: texts are dealt to batches, a batch's distinct grams
are joined with the model's tables, and their probabilities go back to the
batch. A document is rejected where its perplexity lies above a quantile of
trusted documents of its language that the model has not seen.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.llm.bytegrams import gram_numbers, padded, row_sums
from basketry.llm.common import carried, row_key, slices, stored, utf8

#: trusted texts per language that the model is made from, at most (None: all)
SAMPLE = None
#: the share of a language's trusted texts that the model is made from; all others set the threshold
SHARE = 0.5
#: model rows that tasks hold at once: with more, languages are scored group by group, and those with more by joins
MODEL_ROWS = 4_000_000
#: bytes of text in a batch of such a language, on average
BATCH_BYTES = 32 << 20
#: high bits of a hash that say which bucket a text is ranked in
BUCKET_BITS = 8
#: symbols that a text can have
ALPHABET = 256
#: rows that are handed on at once
ROWS = 200_000


def _inside(number: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """False for grams that go over the end of a row."""
    inside = np.ones(len(number), bool)
    for k in range(1, order):
        inside[ends[1:-1] - k] = False
    return inside


def _gram_counts(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(lang, gram, c) of the grams of ``order`` symbols in each batch."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, bounds = utf8(batch.column(1))
        for i, j in slices(bounds):
            for lang in dict.fromkeys(langs[i:j]):
                own = [k for k in range(i, j) if langs[k] == lang]
                text = np.concatenate([data[bounds[k]: bounds[k + 1]] for k in own])
                at = np.concatenate(([0], np.cumsum([bounds[k + 1] - bounds[k] for k in own])))
                symbols, ends = padded(text, at, order - 1)
                number, keys = gram_numbers(symbols, order - 1)
                c = np.bincount(number[_inside(number, ends, order)], minlength=len(keys))
                keys, c = keys[c > 0], c[c > 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(c)],
                    names=["lang", "gram", "c"])


def picked(docs: DataFrame, trusted: DataFrame, most: int | None, share: float = 1.0) -> DataFrame:
    """(doc_id, row_key, lang) of the trusted documents to learn from, one for each text.

    Per language ``share`` of the texts (rounded up), ``most`` of them if it is given: those whose hashes are
    lowest. ``docs``: ``doc_id, row_key, lang, n_symbols``.
    """
    ids = docs.select("doc_id", "row_key", "lang").join(trusted.select("doc_id"), "doc_id", "left_semi")
    hashed = F.xxhash64("row_key")
    texts = (ids.groupBy("lang", "row_key").agg(F.min("doc_id").alias("doc_id"))
             .withColumn("_bucket", F.shiftright(hashed, 64 - BUCKET_BITS)))
    texts = stored(texts, "trusted-texts")
    # texts are ranked by hash inside narrow buckets; the buckets' sizes are a small table
    sizes = texts.groupBy("lang", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("lang").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = stored(sizes.select(F.col("lang").alias("_lang"), F.col("_bucket").alias("_b"),
                                F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                                F.sum("_n").over(W.partitionBy("lang")).alias("_texts")), "trusted-buckets")
    wanted = F.ceil(F.col("_texts") * share)
    if most is not None:
        wanted = F.least(wanted, F.lit(most))
    rank = F.row_number().over(W.partitionBy("lang", "_bucket").orderBy(hashed, "row_key"))
    texts = (texts.join(sizes, (F.col("lang") == F.col("_lang")) & (F.col("_bucket") == F.col("_b")))
             .where(F.col("_before") < wanted).withColumn("_rank", rank))
    return texts.where(F.col("_before") + F.col("_rank") <= wanted).select("doc_id", "row_key", "lang")


def sample(docs: DataFrame, trusted: DataFrame, most: int | None, share: float = 1.0) -> DataFrame:
    """(lang, text) of the documents that ``picked`` names."""
    own = stored(picked(docs, trusted, most, share), "learned-texts")
    # a row for each language: no text above its highest hash is shuffled
    hashed = F.xxhash64("row_key")
    highest = stored(own.groupBy(F.col("lang").alias("_lang")).agg(F.max(hashed).alias("_highest")), "highest-hashes")
    low = docs.join(F.broadcast(highest), (F.col("lang") == F.col("_lang")) & (hashed <= F.col("_highest")), "left_semi")
    return low.join(own.hint("merge"), ["doc_id", "row_key", "lang"], "left_semi").select("lang", "text")


def kneser_ney(counts: DataFrame, order: int) -> list[DataFrame]:
    """Model tables from (lang, gram, c), for n = order down to 1: (lang, gram, p, weight).

    ``p``: the probability of the gram's last symbol behind the others.
    ``weight``: what is left to the shorter context behind the gram's context
    (the same in all its rows). Orders below the highest count the different
    symbols in front of a gram instead of its occurrences.
    """
    def tail(n: int):  # the last n symbols
        return F.col("gram").bitwiseAND((1 << 8 * n) - 1)

    by_order = {order: stored(counts, f"kn-counts-{order}")}
    for n in range(order - 1, 0, -1):
        by_order[n] = stored(by_order[n + 1].select("lang", tail(n).alias("gram")).groupBy("lang", "gram")
                             .agg(F.count(F.lit(1)).alias("c")), f"kn-counts-{n}")
    tables: dict[int, DataFrame] = {}
    for n in range(1, order + 1):
        grams = by_order[n]
        # one row per language: numbers of grams seen once to four times, and the three discounts
        seen = [F.count_if(F.col("c") == k).cast("double") for k in (1, 2, 3, 4)]
        n1, n2, n3, n4 = (F.col(f"n{k}") for k in (1, 2, 3, 4))
        y = F.coalesce(F.try_divide(n1, n1 + 2 * n2), F.lit(0.5))
        discount = [F.coalesce(k - (k + 1) * y * F.try_divide(b, a), F.lit(0.5 * k))
                    for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discount = [F.greatest(F.lit(0.1 * k), F.least(F.lit(0.9 * k), d)) for k, d in zip((1, 2, 3), discount)]
        discounts = (grams.groupBy("lang").agg(*[s.alias(f"n{k}") for k, s in zip((1, 2, 3, 4), seen)])
                     .select(F.col("lang").alias("_lang"), *[d.alias(f"d{k}") for k, d in zip((1, 2, 3), discount)]))
        own = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        grams = (grams.join(F.broadcast(discounts), F.col("lang") == F.col("_lang")).withColumn("d", own)
                 .withColumn("context", F.shiftright("gram", 8)).select("lang", "gram", "context", "c", "d"))
        totals = grams.groupBy("lang", "context").agg(F.sum("c").alias("t"), F.sum("d").alias("left"))
        joined = grams.join(totals, ["lang", "context"])
        weight = F.col("left") / F.col("t")
        kept = (F.col("c") - F.col("d")) / F.col("t")
        if n == 1:
            lower = joined.withColumn("lower", F.lit(1.0 / ALPHABET))
        else:
            shorter = tables[n - 1].select("lang", F.col("gram").alias("short"), F.col("p").alias("lower"))
            lower = joined.withColumn("short", tail(n - 1)).join(shorter, ["lang", "short"])
        tables[n] = stored(lower.select("lang", "gram", (kept + weight * F.col("lower")).alias("p"),
                                        weight.alias("weight")), f"kn-model-{n}")
    return [tables[n] for n in range(order, 0, -1)]


class Model:
    """The model tables of one language, as sorted arrays."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = []
        for gram, p, weight in tables:
            by = np.argsort(gram)
            gram, p, weight = gram[by], p[by], weight[by]
            context, first = np.unique(gram >> 8, return_index=True)
            self.levels.append((gram, p, context, weight[first]))
        self.order = len(tables)

    def log2(self, grams: np.ndarray) -> np.ndarray:
        """log2 of the probability of each gram of ``order`` symbols."""
        out, factor, rest = np.zeros(len(grams)), np.ones(len(grams)), np.arange(len(grams))
        for n, (gram, p, context, weight) in zip(range(self.order, 0, -1), self.levels):
            key = grams[rest] & ((1 << 8 * n) - 1)
            at = np.minimum(np.searchsorted(gram, key), len(gram) - 1)
            hit = gram[at] == key
            out[rest[hit]] = np.log2(p[at[hit]] * factor[rest[hit]])
            rest, key = rest[~hit], key[~hit] >> 8
            at = np.minimum(np.searchsorted(context, key), len(context) - 1)
            factor[rest] *= np.where(context[at] == key, weight[at], 1.0)
        out[rest] = np.log2(factor[rest] / ALPHABET)
        return out


def language_groups(rows: dict[str, int], most: int) -> list[list[str]]:
    """Languages dealt to groups whose model rows come to ``most`` at most (a language is never split)."""
    groups: list[list[str]] = []
    room = 0
    for lang in sorted(rows):
        if rows[lang] > room:
            groups.append([])
            room = most
        groups[-1].append(lang)
        room -= rows[lang]
    return groups


def models(tables: list[DataFrame], langs: list[str]) -> dict[str, Model]:
    """The models of these languages, from the model tables."""
    found: dict[str, list] = {}
    for table in tables:
        t = table.where(F.col("lang").isin(langs)).toArrow()  # MODEL_ROWS at most
        own = t.column("lang").to_numpy(zero_copy_only=False)
        columns = [t.column(c).to_numpy() for c in ("gram", "p", "weight")]
        for lang in langs:
            found.setdefault(lang, []).append(tuple(c[own == lang] for c in columns))
    return {lang: Model(x) for lang, x in found.items()}


def model_tables(docs: DataFrame, trusted: DataFrame, order: int, most: int | None = SAMPLE,
                 share: float = 1.0) -> list[DataFrame]:
    """The tables of ``kneser_ney`` from the trusted documents that ``picked`` names."""
    counts = (sample(docs, trusted, most, share)
              .mapInArrow(lambda b: _gram_counts(b, order), "lang string, gram bigint, c bigint")
              .groupBy("lang", "gram").agg(F.sum("c").alias("c")))
    return kneser_ney(counts, order)


def perplexities(docs: DataFrame, trusted: DataFrame, *, order: int = 5, most: int | None = SAMPLE, share: float = 1.0,
                 model_rows: int = MODEL_ROWS, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """``doc_id, row_key, lang, n_symbols, perplexity`` for every row; see ``classify``.

    The model learns from ``share`` of the trusted texts of a language, and from ``most`` of them if that is given.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(F.col(text_col)).alias("row_key"),
                       F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
                       (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("bigint").alias("n_symbols"),
                       F.col(text_col).alias("text"))
    tables = model_tables(rows, trusted, order, most, share)
    total: dict[str, int] = {}
    for table in tables:
        for lang, n in table.groupBy("lang").count().collect():  # a row for each language
            total[lang] = total.get(lang, 0) + n
    large = [lang for lang, n in total.items() if n > model_rows]
    groups = language_groups({lang: n for lang, n in total.items() if n <= model_rows}, model_rows)
    one = len(groups) == 1 and not large
    parts = []
    for langs in groups:
        # one group: a single pass over all rows, else one for each group and one for the rest
        own = rows if one else rows.where(F.col("lang").isin(langs))
        parts.append(_scored(own, models(tables, langs), order))
    if large:
        parts.append(_joined(rows.where(F.col("lang").isin(large)), tables))
    if not one:
        rest = rows.where(~F.col("lang").isin(list(total)))
        parts.append(rest.select("doc_id", "row_key", "lang", "n_symbols", F.lit(None).cast("double").alias("perplexity")))
    return functools.reduce(DataFrame.unionAll, parts)


def _scored(rows: DataFrame, known_models: dict[str, Model], order: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(known_models)  # MODEL_ROWS rows at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            data, bounds = utf8(batch.column("text"))
            bits = np.full(len(langs), np.nan)
            for i, j in slices(bounds):
                for lang in dict.fromkeys(langs[i:j]):
                    if (model := known.get(lang)) is None:
                        continue
                    own = [k for k in range(i, j) if langs[k] == lang]
                    text = np.concatenate([data[bounds[k]: bounds[k + 1]] for k in own])
                    at = np.concatenate(([0], np.cumsum([bounds[k + 1] - bounds[k] for k in own])))
                    symbols, ends = padded(text, at, order - 1)
                    number, keys = gram_numbers(symbols, order - 1)
                    bits[own] = -row_sums(model.log2(keys.astype(np.int64))[number], ends, order - 1)
            size = np.diff(bounds) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), batch.column("lang"), batch.column("n_symbols"),
                 pa.array(np.exp2(bits / size), from_pandas=True)],
                names=["doc_id", "row_key", "lang", "n_symbols", "perplexity"])

    return rows.mapInArrow(score, "doc_id bigint, row_key bigint, lang string, n_symbols bigint, perplexity double")


def _distinct_grams(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(lang, batch, gram): the distinct grams of one batch of one language."""
    found, lang, number = [np.empty(0, np.uint64)], None, 0
    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        if batch.num_rows:
            lang, number = batch.column("lang")[0].as_py(), batch.column("batch")[0].as_py()
        for i, j in slices(bounds):
            symbols, ends = padded(data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i], order - 1)
            at, keys = gram_numbers(symbols, order - 1)
            there = np.zeros(len(keys), bool)
            there[at[_inside(at, ends, order)]] = True
            found.append(keys[there])
            if sum(map(len, found[1:])) > len(found[0]):
                found = [np.unique(np.concatenate(found))]
    grams = np.unique(np.concatenate(found)).view(np.int64)
    for i in range(0, len(grams), ROWS):
        part = grams[i: i + ROWS]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(part), pa.string()), pa.array(np.full(len(part), number, np.int32)), pa.array(part)],
            names=["lang", "batch", "gram"])


def _batch_perplexities(docs: pa.Table, values: pa.Table, order: int) -> pa.Table:
    gram, bits = (values.column(c).to_numpy() for c in ("gram", "bits"))
    by = np.argsort(gram)
    gram, bits = gram[by], bits[by]
    found = []
    for batch in docs.to_batches():
        data, bounds = utf8(batch.column("text"))
        for i, j in slices(bounds):
            symbols, ends = padded(data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i], order - 1)
            number, keys = gram_numbers(symbols, order - 1)
            keys = keys.view(np.int64)
            at = np.minimum(np.searchsorted(gram, keys), len(gram) - 1)
            own = np.where(gram[at] == keys, bits[at], 0.0)  # none for grams that go over the end of a row
            total = row_sums(own[number], ends, order - 1)
            found.append(np.exp2(-total / (np.diff(bounds[i: j + 1]) + 1)))
    out = docs.select(["doc_id", "row_key", "lang", "n_symbols"])
    return out.append_column("perplexity", pa.array(np.concatenate(found) if found else np.empty(0, np.float64)))


def _joined(rows: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Perplexities of rows whose languages all have models, by joins with the model's tables."""
    order = len(tables)
    size = rows.agg(F.sum("n_symbols")).first()[0] or 0
    rows = rows.withColumn("batch", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "row_key"),
                                           F.lit(max(1, -(-size // BATCH_BYTES)))).cast("int"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _distinct_grams(batches, order)

    wanted = stored(rows.select("lang", "batch", "text").groupBy("lang", "batch").applyInArrow(
        distinct, "lang string, batch int, gram bigint"), "wanted-grams")
    values = wanted.select("lang", "gram").distinct().withColumn("value", F.lit(1.0 / ALPHABET))
    # from the shortest grams on: a gram's own probability, or what its context leaves to the shorter one
    for n, table in zip(range(1, order + 1), reversed(tables)):
        own = F.col("gram").bitwiseAND((1 << 8 * n) - 1)
        known = table.select(F.col("lang").alias("_l"), F.col("gram").alias("_g"), "p")
        contexts = table.groupBy(F.col("lang").alias("_k"), F.shiftright("gram", 8).alias("_c")).agg(
            F.any_value("weight").alias("weight"))
        values = (values.join(known, (F.col("lang") == F.col("_l")) & (own == F.col("_g")), "left")
                  .join(contexts, (F.col("lang") == F.col("_k")) & (F.shiftright(own, 8) == F.col("_c")), "left")
                  .select("lang", "gram", F.coalesce("p", F.coalesce("weight", F.lit(1.0)) * F.col("value")).alias("value")))
    values = stored(values.select("lang", "gram", F.log2("value").alias("bits")), "gram-bits")
    back = wanted.join(values, ["lang", "gram"]).select("lang", "batch", "gram", "bits").groupBy("lang", "batch")
    return rows.groupBy("lang", "batch").cogroup(back).applyInArrow(
        lambda d, v: _batch_perplexities(d, v, order),
        "doc_id bigint, row_key bigint, lang string, n_symbols bigint, perplexity double")


def classify(docs: DataFrame, trusted: DataFrame, *, quantile: float = 0.99, typical: int = 64, most: int | None = SAMPLE,
             share: float = SHARE, **options) -> DataFrame:
    """Perplexity and verdict of every row of ``docs``.

    ``doc_id, row_key, lang, n_symbols`` (bytes of the text and its end),
    ``perplexity`` (per symbol), ``evened``, ``threshold``, ``kept``.
    ``trusted``: the ids of trusted documents (column ``doc_id``; ids that are
    not in ``docs`` do nothing). A few symbols say little, so ``evened`` is the
    perplexity with ``typical`` more symbols at the median rate of the
    language's unseen trusted documents, those whose texts the model has not
    learned from: it learns from ``share`` of all trusted texts of the language
    (from ``most`` of them, if that is given), the others set the threshold. A document is kept unless ``evened`` is above the ``quantile`` of them.

    A language without trusted documents has no model: perplexity and
    threshold are null, and all is kept. With a single trusted text none is
    unseen: threshold and ``evened`` are null, and all is kept. A null language is a language of its
    own, shown as "". A null or empty text is its end alone. A long text is scored whole, in one step. Equal rows are
    scored alike. An empty table gives no rows. Other columns are not read.
    """
    scored = stored(perplexities(docs, trusted, most=most, share=share, **options), "perplexities")
    rate = F.log2("perplexity")
    learned = stored(picked(scored, trusted, most, share).select("lang", "row_key"), "learned-keys")
    good = (scored.join(trusted.select("doc_id").distinct(), "doc_id", "left_semi")
            .join(learned, ["lang", "row_key"], "left_anti"))
    # a row for each language; stored, so that Spark knows how small they are when it joins rows with them
    medians = stored(good.groupBy(F.col("lang").alias("_l")).agg(F.percentile_approx(rate, 0.5, 100_000).alias("_median")),
                     "language-medians")
    evened = F.pow(F.lit(2.0), (rate * F.col("n_symbols") + F.col("_median") * typical) / (F.col("n_symbols") + typical))

    def with_evened(rows: DataFrame) -> DataFrame:
        return rows.join(medians, F.col("lang") == F.col("_l"), "left").withColumn("evened", evened).drop("_l", "_median")

    limits = (with_evened(good).groupBy(F.col("lang").alias("_lang"))
              .agg(F.percentile_approx("evened", quantile, 100_000).alias("threshold")))
    limits = stored(limits, "language-limits")
    kept = F.coalesce(F.col("evened") <= F.col("threshold"), F.lit(True))
    return (with_evened(scored).join(limits, F.col("lang") == F.col("_lang"), "left").drop("_lang")
            .withColumn("kept", kept))


def filter_documents(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                     **options) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all columns."""
    verdict = (classify(docs, trusted, id_col=id_col, text_col=text_col, **options).where("not kept")
               .select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key")).distinct())
    own = carried(docs, doc=F.col(id_col).cast("bigint"), key=row_key(F.col(text_col)))
    return own.join(verdict, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")),
                    "left_anti").select("row.*")
