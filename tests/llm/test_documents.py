"""The operators on documents against brute force, on hand-made rows with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import forest, line_dedup, mixing, packing, ppm, quality, substring
from basketry.llm.queries import trusted as trusted_ids
from basketry.llm.queries import word_bpe
from tests.llm.conftest import edge_documents, prose


def split(text):
    return (text or "").encode().split()


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


# ------------------------------------------------------------------ op1


def brute_repeats(rows, window):
    last = math.inf
    first = {}
    for doc, text, *_ in rows:
        w = split(text)
        for i in range(len(w) - window + 1):
            k = tuple(w[i: i + window])
            first[k] = min(first.get(k, last), last if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        w, gone = split(text), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i: i + window])] < (last if doc is None else doc):
                gone |= set(range(i, i + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("window, hot", [(50, 20_000), (8, 1), (8, 20_000), (3, 2)])
def test_substring_dedup(docs, window, hot):
    got = substring.remove_repeats(docs, window=window, hot=hot)
    got = got.withColumn("sha", F.sha2("text", 256))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "sha") == brute_repeats(edge_documents(), window)


def test_substring_dedup_random(spark):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice("abc") for _ in range(r.randrange(40)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for hot in (2, 20_000):
        got = substring.remove_repeats(df, window=6, hot=hot).withColumn("sha", F.sha2("text", 256))
        assert rows_of(got, "doc_id", "n_words", "n_removed", "sha") == brute_repeats(rows, 6)


def test_substring_dedup_splits_a_hot_anchor(spark, monkeypatch):
    shared, search, hot = prose("hot", 48), substring._search, 20

    def spied(table, window):
        assert max(collections.Counter(table.column("anchor").to_pylist()).values()) <= hot
        return search(table, window)

    monkeypatch.setattr(substring, "_search", spied)
    monkeypatch.setattr(substring, "SHARD_WORDS", 20_000)
    rows = [(k, " ".join((prose(f"a{k}", 5), prose(f"b{k // 2}", 30), shared, prose(f"c{k // 2}", 30)))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = substring.remove_repeats(df, hot=hot).withColumn("sha", F.sha2("text", 256))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "sha") == brute_repeats(rows, 50)


# ------------------------------------------------------------------ op2


def test_quality_model_is_a_distribution(docs):
    read = docs.select("doc_id", F.xxhash64("text").alias("row_key"), F.coalesce("lang", F.lit("")).alias("lang"), "text",
                       F.lit(1).alias("n_symbols"))
    trusted = docs.where("lang = 'en'").select("doc_id").where("doc_id is not null").distinct()
    model = quality.models(quality.model_tables(read, trusted, 4, 100), ["en"])["en"]
    for context in (b" sh", b"the", b"a1 ", b"\xfe\xfe\xfe", b"@@@"):
        grams = (int.from_bytes(context, "big") << 8) + np.arange(256)
        assert np.exp2(model.log2(grams)).sum() == pytest.approx(1, abs=1e-9)


def test_quality_matches_a_plain_kneser_ney(spark):
    texts = ["abab abba", "abcab", "bca ab", "cabba", "abcabcab", "aabbcc"]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    order = 3
    got = {r.doc_id: r.perplexity for r in
           quality.perplexities(df, df.select("doc_id"), order=order, most=10).collect()}
    seqs = [[0xFE] * (order - 1) + list(t.encode()) + [0xFF] for t in texts]
    counts = {order: collections.Counter(tuple(s[i: i + order]) for s in seqs for i in range(len(s) - order + 1))}
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    steps = {}
    for n, c in counts.items():
        of = collections.Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else 0.5
        d = [k - (k + 1) * y * of[k + 1] / of[k] if of[k] else 0.5 * k for k in (1, 2, 3)]
        steps[n] = [min(0.9 * k, max(0.1 * k, x)) for k, x in zip((1, 2, 3), d)]

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / quality.ALPHABET
        own = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        take = {g: steps[n][min(c, 3) - 1] for g, c in own.items()}
        kept = own[gram] - take[gram] if gram in own else 0
        return kept / total + sum(take.values()) / total * p(gram[1:])

    for k, s in enumerate(seqs):
        bits = -sum(math.log2(p(tuple(s[i: i + order]))) for i in range(len(s) - order + 1))
        assert got[k] == pytest.approx(2 ** (bits / (len(s) - order + 1)))


def test_quality_edges(docs, no_docs):
    trusted = docs.where("lang = 'en' and doc_id >= 100").select("doc_id").distinct()
    got = quality.classify(docs, trusted, order=4, most=20)
    assert got.count() == docs.count()
    by_lang = {r.lang: r for r in got.collect()}
    assert by_lang["fr"].perplexity is None and by_lang["fr"].kept  # nothing trusted
    assert by_lang[""].kept  # null language
    odd = got.where("doc_id = 21").first()
    assert not odd.kept and odd.perplexity > odd.threshold
    assert got.where("doc_id >= 100 and not kept").isEmpty()
    kept = quality.filter_documents(docs, trusted, order=4, most=20)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert quality.classify(no_docs, trusted).isEmpty()
    assert quality.classify(docs, trusted.limit(0)).where("not kept").isEmpty()


def test_quality_scores_languages_in_groups(spark, docs):
    trusted = docs.where("doc_id between 5 and 19").select("doc_id").distinct()
    rows = docs.withColumn("lang", F.when(F.col("doc_id") < 10, "en").when(F.col("doc_id") < 17, "de").otherwise(F.col("lang")))
    one, many = (quality.perplexities(rows, trusted, order=3, model_rows=n).withColumn("p", F.round("perplexity", 9))
                 for n in (quality.MODEL_ROWS, 1))
    columns = ("doc_id", "row_key", "lang", "n_symbols", "p")
    assert rows_of(one, *columns) == rows_of(many, *columns)
    assert quality.language_groups({"a": 3, "b": 3, "c": 9, "d": 1}, 6) == [["a", "b"], ["c"], ["d"]]


def test_quality_threshold_is_of_unseen_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = trusted_ids(spark, sf)
    got = quality.classify(docs, good).collect()
    seen = {(r.lang, r.row_key) for r in quality.picked(spark.createDataFrame(got), good, quality.SAMPLE, 0.5).collect()}
    good = {r.doc_id for r in good.collect()}
    by_lang = collections.defaultdict(list)
    for r in got:
        if r.doc_id in good and (r.lang, r.row_key) not in seen:
            by_lang[r.lang].append(r.evened)
    for r in got:
        own = sorted(by_lang[r.lang])
        assert r.threshold == pytest.approx(own[math.ceil(0.99 * len(own)) - 1]) and r.kept == (r.evened <= r.threshold)
    # one text, whatever its copies, is on one side
    copies = docs.unionAll(docs.withColumn("doc_id", F.col("doc_id") + 10_000_000))
    more = quality.classify(copies, trusted_ids(spark, sf).unionAll(
        trusted_ids(spark, sf).select(F.col("doc_id") + 10_000_000)))
    assert {(r.lang, round(r.threshold, 9)) for r in more.collect()} == {(r.lang, round(r.threshold, 9)) for r in got}


def test_quality_learns_from_all_trusted_texts(spark):
    texts = [prose(k, 12) for k in range(2600)]
    rows = [(k, t, "en", k, len(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, row_key bigint, n_symbols bigint").repartition(5)
    assert quality.picked(df, df.select("doc_id"), quality.SAMPLE, 0.5).count() == 1300
    # the grams of all of them; with a half, those with the lowest hashes
    hashes = {r.row_key: r.h for r in df.select("row_key", F.xxhash64("row_key").alias("h")).collect()}
    for share in (1.0, 0.5, 0.3):
        learned = sorted(range(2600), key=hashes.get)[: math.ceil(2600 * share)]
        want = collections.Counter()
        for k in learned:
            s = b"\xfe\xfe" + texts[k].encode() + b"\xff"
            want.update(int.from_bytes(s[i: i + 3], "big") for i in range(len(s) - 2))
        counts = (quality.sample(df, df.select("doc_id"), quality.SAMPLE, share)
                  .mapInArrow(lambda b: quality._gram_counts(b, 3), "lang string, gram bigint, c bigint")
                  .groupBy("gram").agg(F.sum("c").alias("c")).collect())
        assert {r.gram: r.c for r in counts} == want
    # a part of the texts that is given by number
    assert quality.picked(df, df.select("doc_id"), 70, 0.5).count() == 70


def test_quality_joins_texts_with_a_large_model(spark, docs, monkeypatch):
    monkeypatch.setattr(quality, "BATCH_BYTES", 5000)
    monkeypatch.setattr(quality, "ROWS", 100)
    trusted = docs.where("doc_id between 5 and 21 or doc_id > 100").select("doc_id").distinct()
    whole, joined = (quality.perplexities(docs, trusted, share=0.5, model_rows=n).withColumn("p", F.round("perplexity", 9))
                     for n in (quality.MODEL_ROWS, 0))
    columns = ("doc_id", "row_key", "lang", "n_symbols", "p")
    assert rows_of(whole, *columns) == rows_of(joined, *columns)
    assert joined.where("perplexity is not null").count() > 20


# ------------------------------------------------------------------ op4


def brute_lines(rows, min_docs, keep_first):
    def key(line):
        return line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})

    seen = collections.defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            seen[key(line)].add(doc)
    frequent = {k for k, d in seen.items() if k and len(d) >= min_docs}
    out, first = [], set()
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            if key(line) not in frequent or keep_first and key(line) not in first:
                kept.append(line)
            first.add(key(line))
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("min_docs", [1, 2, 3, 10])
def test_line_dedup(docs, min_docs):
    got = line_dedup.line_digests(docs, min_docs=min_docs)
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == \
        brute_lines(edge_documents(), min_docs, False)


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("parts", [1, 3, 40])
def test_line_runs_over_partitions(spark, keep_first, parts):
    r = random.Random(7)
    rows = [(k, "\n".join(r.choice(["hot", "Warm", f"cold {r.randrange(30)}", ""]) for _ in range(r.randrange(6))))
            for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = rows_of(line_dedup.line_digests(df, min_docs=4, keep_first=keep_first),
                      "doc_id", "n_lines", "n_dropped", "kept_sha256")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_lines(rows, 4, keep_first)


def test_line_dedup_documents(docs, no_docs):
    got = line_dedup.dedup_lines(docs, min_docs=10)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert got.where("doc_id = 100").first().text == edge_documents()[-12][1].split("\n", 1)[1].replace("  shared LINE\n", "")
    assert got.where("doc_id = 11").first().text is None
    assert line_dedup.line_digests(no_docs).isEmpty()


# ------------------------------------------------------------------ op5


def brute_targets(sizes, weights, cap):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, open_ = float(sum(sizes.values())), set(order)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        over = 0.0
        for s in sorted(open_, key=str):
            target[s] += left * w[s] / total
            if target[s] >= cap * sizes[s]:
                over += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_ = open_ - {s}
        left = over
    return target


def test_mixing(spark, docs):
    weight = docs.where("doc_id is not null").select("doc_id").distinct().withColumn(
        "weight", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(0.5))
    got = mixing.mix_sources(docs, quality=weight).collect()
    rows = edge_documents()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += len(split(text))
    target = brute_targets(sizes, (1, 2, 3), 3)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], abs=1e-6)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        assert r.copies - math.floor(r.target / r.source_size + 1e-9 if r.source_size else 0) in (0, 1) or not r.size
        taken[r.source] += r.taken
    for s in sizes:  # half of the largest document at most
        most = max(len(split(t)) for _, t, _, x in rows if x == s)
        assert abs(taken[s] - target[s]) <= most / 2 + 1e-6
    again = mixing.mix_sources(docs.repartition(7), quality=weight)
    assert rows_of(again, "doc_id", "row_key", "taken") == ordered((r.doc_id, r.row_key, r.taken) for r in got)
    mixed = mixing.mix_documents(docs, quality=weight)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert {(r.doc_id, r.source): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()} == {
        k: n for k, n in collections.Counter({(d, s): sum(r.copies for r in got if r.doc_id == d and r.source == s)
                                               for d, s in {(r.doc_id, r.source) for r in got}}).items() if n}


def test_mixing_follows_the_weights(spark):
    rows = [(k, "w " * (1 + k % 7), ["a", "b"][k % 2]) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weight = df.select("doc_id", F.when(F.col("doc_id") % 4 < 2, 3.0).otherwise(1.0).alias("weight"))
    got = mixing.mix_sources(df, quality=weight, weights=(1, 3)).where("source = 'a'")
    heavy, light = (got.where(c).agg(F.avg("copies")).first()[0] for c in ("doc_id % 4 < 2", "doc_id % 4 >= 2"))
    assert heavy > light + 0.2  # half of the source is taken, the heavier documents first


def test_mixing_empty(no_docs):
    assert mixing.mix_sources(no_docs).isEmpty()
    assert mixing.mix_documents(no_docs).isEmpty()


# ------------------------------------------------------------------ op7


def test_ppm_base_and_counts(docs, no_docs):
    rows = edge_documents()
    learns = [d is not None and d % 3 != 1 for d, *_ in rows]
    got = ppm.ppm_scores(docs, F.col("doc_id") % 3 != 1, order=3)
    counts = collections.Counter()
    for (_, text, *_), yes in zip(rows, learns):
        if yes:
            counts.update(split(lower(text)))
            counts[None] += 1
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for (doc, text, *_), yes in zip(rows, learns):
        tokens = split(lower(text)) + [None]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        want.append((doc, yes, len(tokens), sum(counts[t] > 0 for t in tokens), total, round(base, 6)))
    got = got.withColumn("base", F.round("base_score", 6))
    assert rows_of(got, "doc_id", "train", "n_tokens", "n_known", "train_tokens", "base") == ordered(want)
    assert got.where("score >= 0").isEmpty()
    assert ppm.ppm_scores(no_docs, F.lit(True)).isEmpty()
    untrained = ppm.ppm_scores(docs.where("doc_id = 14"), F.lit(False)).first()
    assert untrained.score == pytest.approx(-8 * 8 * math.log10(2)) and untrained.n_known == 0


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


class PlainPpm:
    """PPM with escape method D, update exclusion and symbol exclusion, by dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        grams = collections.Counter()
        for t in texts:
            s = bytes([0xFE]) * order + t.encode() + b"\xff"
            grams.update(s[i: i + order + 1] for i in range(len(s) - order))
        self.tables = {order: grams}
        for n in range(order - 1, -1, -1):
            self.tables[n] = collections.Counter(g[1:] for g in self.tables[n + 1])

    def bits(self, text):
        s = bytes([0xFE]) * self.order + (text or "").encode() + b"\xff"
        return sum(self.symbol(s[i: i + self.order], s[i + self.order]) for i in range(len(s) - self.order))

    def symbol(self, context, symbol):
        excluded, out = set(), 0.0
        for n in range(self.order, -1, -1):
            own = {g[-1]: c for g, c in self.tables[n].items() if g[:-1] == context[len(context) - n:]}
            free = {k: c for k, c in own.items() if k not in excluded}
            if free:
                total = sum(free.values())
                if symbol in free:
                    return out - math.log2((2 * free[symbol] - 1) / (2 * total))
                out -= math.log2(len(free) / (2 * total))
            excluded |= set(own)
        return out + math.log2(ppm.ALPHABET - len(excluded))


def test_ppm_matches_plain_ppm(spark):
    r = random.Random(3)
    rows = [(k, "".join(r.choice("abcd é") for _ in range(r.randrange(40)))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for order in (2, 3, 5):
        model = PlainPpm([t for k, t in rows if k % 4], order)
        got = {x.doc_id: x.score for x in ppm.ppm_scores(df, F.col("doc_id") % 4 != 0, order=order).collect()}
        for k, t in rows:
            assert got[k] == pytest.approx(-model.bits(t) * math.log10(2))


# ------------------------------------------------------------------ op8


def brute_near(rows, similarity, length):
    rows = [r for r in rows if r[0] is not None]
    sets = []
    for _, text, *_ in rows:
        w = split(text)
        sets.append({tuple(w[i: i + length]) for i in range(max(len(w) - length + 1, min(len(w), 1)))})
    n = len(rows)
    linked = [[j for j in range(n) if j != i and (
        sets[i] == sets[j] == set() or sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity)]
        for i in range(n)]
    component = [r[0] for r in rows]
    for _ in range(n):
        component = [min([component[i], *(component[j] for j in linked[i])]) for i in range(n)]
    # rows with one id are rows of one class only if their texts agree; components go by smallest id
    return ordered((rows[i][0], len(linked[i]), component[i], component[i] == rows[i][0]) for i in range(n))


@pytest.mark.parametrize("block", [2, 1024])
def test_near_documents(docs, block):
    rows = [r for r in edge_documents() if r[0] != 22]
    got = forest.near_documents(docs.where("doc_id is null or doc_id <> 22"), block=block)
    assert rows_of(got, "doc_id", "n_links", "component_id", "kept") == brute_near(rows, 0.8, 5)


def test_near_documents_texts_of_one_id(spark):
    rows = edge_documents()
    a, b = prose("one", 100), prose("two", 100)
    rows += [(50, a), (50, b), (50, prose("three", 100)), (51, a + " end"), (52, b + " end"), (52, b + " end")]
    rows = [r[:2] for r in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = forest.near_documents(df)
    assert rows_of(got, "doc_id", "n_links", "component_id", "kept") == brute_near(rows, 0.8, 5)


def test_near_documents_recall_in_a_large_group(spark):
    r = random.Random(11)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = rows_of(forest.near_documents(df, block=40), "doc_id", "n_links", "component_id", "kept")
    want = brute_near(rows, 0.8, 5)
    assert sum(x[1] for x in got) >= 0.99 * sum(x[1] for x in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want))


def test_prefixes_are_shortened_as_far_as_the_data_need():
    close, far = np.full(500, 0.98), np.linspace(0.8, 0.86, 500)
    least = forest.matched_depth(16, 8, 0.8, 0.998)
    assert least == 5
    assert forest.shortened(close, 16, 8, least, 0.8, 0.998) == 7
    assert forest.shortened(far, 16, 8, least, 0.8, 0.998) == least
    assert forest.shortened(np.concatenate((close, far * 0.5)), 16, 8, least, 0.8, 0.998) == 7  # not similar enough to count
    depths = [forest.shortened(np.full(100, x), 16, 8, least, 0.8, 0.998) for x in (0.81, 0.84, 0.88, 0.95)]
    assert depths == sorted(depths) and depths[0] < depths[-1]


def test_recall_is_measured_on_all_matched_pairs(spark, monkeypatch):
    """2,400 pairs of texts, more than the sample there once was, and each is counted with its similarity."""
    r = random.Random(6)
    rows = []
    for k in range(2400):
        words = [f"p{k}w{i}" for i in range(40)]
        rows.append((2 * k, " ".join(words)))
        for i in range(r.randrange(3)):
            words[-1 - i] = f"p{k}x{i}"
        rows.append((2 * k + 1, " ".join(words) + f" end{k}"))
    seen = []

    def spied(found, trees, depth, least, similarity, recall, counts=None):
        seen.append(collections.Counter(dict(zip(np.round(found, 3), counts))))
        return least

    monkeypatch.setattr(forest, "shortened", spied)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = rows_of(forest.near_documents(df), "doc_id", "n_links")
    texts = dict(rows)
    want = collections.Counter()
    for k in range(2400):
        x, y = ({tuple(w[i: i + 5]) for i in range(len(w) - 4)} for w in (texts[2 * k].split(), texts[2 * k + 1].split()))
        want[max(0.8, math.floor(len(x & y) / len(x | y) * 1000) / 1000)] += 1
    assert min(want) > 0.8 and sum(seen[0].values()) == sum(n for _, n in got) / 2 >= 2395
    assert set(seen[0]) == set(want) and all(0 <= want[s] - n <= 5 for s, n in seen[0].items())


@pytest.mark.parametrize("cuts", [(), (3, 7, 8, 20, 60)])
def test_links_of_the_forest_connect_the_runs_of_each_depth(cuts):
    """Over partitions of sorted strings: links of depth d connect the texts that share d values, and no others."""
    import pyarrow as pa

    r = random.Random(2)
    rows = sorted((t, bytes(np.array([r.randrange(2) if k else t for k in range(4)], ">u4").tobytes()), k)
                  for k in range(80) for t in [r.randrange(2)])
    links, ends = [], []
    for a, b in zip((0, *cuts), (*cuts, len(rows))):
        part = rows[a:b]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*part[i: i + 9]), (pa.int32(), pa.binary(), pa.int64()))],
                                              names=["tree", "string", "id"]) for i in range(0, len(part), 9)]
        for out in forest._matches(iter(batches), 2, 4):
            for x in out.to_pylist():
                (links if x["b"] is not None else ends).append(x)
    for x in ends:
        links += [{"a": y["a"], "b": x["a"], "depth": x["depth"]} for y in ends
                  if (x["depth"], x["tree"], x["prefix"]) == (y["depth"], y["tree"], y["prefix"])]
    for depth in (2, 3, 4):
        group = {k: k for *_, k in rows}

        def root(k):
            while group[k] != k:
                k = group[k]
            return k

        for x in links:
            if x["depth"] == depth:
                group[root(x["a"])] = root(x["b"])
        want = collections.defaultdict(set)
        for t, string, k in rows:
            want[t, string[: 4 * depth]].add(k)
        got = collections.defaultdict(set)
        for k in group:
            got[root(k)].add(k)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_one_of_each(docs, no_docs):
    got = forest.one_of_each(docs)
    assert got.columns == docs.columns
    ids = sorted(r.doc_id for r in got.where("doc_id is not null").collect())
    assert {8, 14, 16}.issubset(ids) and not {9, 10, 15, 17}.intersection(ids)
    assert got.where("doc_id is null").count() == 2
    assert forest.near_documents(no_docs).isEmpty()


# ------------------------------------------------------------------ op10


@pytest.mark.parametrize("size", [8, 64, 2048])
def test_packing_round_trip(docs, size):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe())
    want = sorted([*t.encode(text or "", add_special_tokens=False).ids, 1] for _, text, *_ in edge_documents())
    got = packing.pack_documents(docs, word_bpe, size=size).collect()
    by_sequence = collections.defaultdict(list)
    for p in got:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == size or at < size and at & (at - 1) == 0  # nothing is padded
    # every token of every document lies in one piece with its checksum
    left = collections.defaultdict(list)
    for p in got:
        left[p.doc_id, p.doc_tokens].append((p.start, p.length, p.ids_crc32))
    n = 0
    for doc, text, *_ in edge_documents():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        pieces, start = left[doc, len(ids)], 0
        while start < len(ids):
            piece = next(x for x in sorted(pieces) if x[0] == start
                         and zlib.crc32(ids[start: start + x[1]].tobytes()) == x[2])
            pieces.remove(piece)
            start += piece[1]
            n += 1
        assert start == len(ids)
    assert n == len(got) and len(want) == len(edge_documents())


def test_packing_places_by_sum_of_squares():
    levels = packing.LevelArray(10)
    r = random.Random(2)
    for _ in range(300):
        n = r.randrange(1, 10)
        before = levels.count.copy()
        levels.place(("d", 0, None, n), n)
        after = int((levels.count[1:10] ** 2).sum())
        best = math.inf
        for level in range(0, 11 - n):
            if level and not before[level]:
                continue
            c = before.copy()
            if level:
                c[level] -= 1
            if level + n < 10:
                c[level + n] += 1
            best = min(best, int((c[1:10] ** 2).sum()))
        assert after == best


def test_packing_places_by_sum_of_squares_of_coarse_levels():
    levels = packing.LevelArray(100, 10)
    r = random.Random(5)
    windows = []  # what the open windows hold, by level, last in first out

    def squares(held):
        return sum(n * n for n in collections.Counter(h // 10 for h in held).values())

    for _ in range(2000):
        n = r.randrange(1, 100)
        last = {h // 10: k for k, h in enumerate(windows)}
        options = [squares([*windows, n] if n <= 90 else windows)]
        for k in last.values():
            if windows[k] + n <= 100:
                left = windows[:k] + windows[k + 1:]
                options.append(squares([*left, windows[k] + n] if windows[k] + n <= 90 else left))
        filled = levels.place(n, n)
        windows = [h for row in levels.fill for h in row]
        assert squares(windows) == min(options) == int((levels.count ** 2).sum())
        assert filled is None or 90 < filled[1] <= 100 and sum(filled[0]) == filled[1]


def test_packing_leaves_little_for_the_end():
    r = random.Random(1)
    packer = packing.Packer(2048, 0)
    total = 0
    for k in range(1000):
        n = int(r.lognormvariate(6.4, 0.8)) + 1
        packer.add(k, np.arange(n, dtype=np.uint32))
        total += n
    packer.finish()
    assert packer.redealt < 0.1 * total


def test_packing_empty(no_docs):
    assert packing.pack_documents(no_docs, word_bpe).isEmpty()


# ------------------------------------------------------------------ op1: the index


@pytest.mark.parametrize("threshold, alphabet, seed", [(5, 2, 1), (4, 3, 2), (7, 2, 3), (50, 3, 4)])
def test_matching_statistics_of_passages_that_are_not_indexed(threshold, alphabet, seed):
    from basketry.llm.fm_index import FMIndex

    r = random.Random(seed)
    base = [r.randrange(alphabet) for _ in range(120)]
    indexed = [[r.randrange(alphabet) for _ in range(r.randrange(1, 90))] for _ in range(6)] + [base]
    streamed = [[r.randrange(alphabet + 1) for _ in range(r.randrange(1, 80))] for _ in range(5)]
    changed = list(base)
    changed[60] = alphabet  # mismatches inside a passage
    streamed += [changed, base[10:100], [alphabet] * 3]
    labels = np.array([r.randrange(100) for _ in indexed])
    lengths = np.array([len(x) for x in indexed])
    index = FMIndex(np.concatenate(indexed), lengths, labels, alphabet + 1, threshold)
    sizes = np.array([len(x) for x in streamed])
    got, _ = index.matches(np.concatenate(streamed), np.cumsum(sizes) - sizes, sizes)
    owners = index.owners(np.concatenate(streamed), np.cumsum(sizes) - sizes, sizes, -1).tolist()
    want, first = [], []
    for x in streamed:
        for i in range(len(x)):
            n = 0
            while n < min(threshold, len(x) - i) and any(
                    x[i: i + n + 1] == y[j: j + n + 1] for y in indexed for j in range(len(y) - n)):
                n += 1
            want.append(n)
            if i + threshold <= len(x):
                own = [k for k, y in zip(labels, indexed) for j in range(len(y) - threshold + 1)
                       if y[j: j + threshold] == x[i: i + threshold]]
                first.append(min(own, default=-1))
    assert got.tolist() == want and owners == first
    if threshold < 50:
        assert max(want) == threshold and min(want) < threshold


def test_every_two_passages_meet_once_as_index_and_stream():
    import pyarrow as pa

    r = random.Random(6)
    base = [f"w{r.randrange(30)}" for _ in range(14)]
    rows = []
    for k in range(11):
        words = list(base)
        words[r.randrange(14)] = f"x{r.randrange(3)}"
        anchor = 7 if k < 9 else 8
        rows.append((anchor, k, 100 - k, 14 - 4 + 1, " ".join(f"{w}-{anchor}" for w in words)))
    table = pa.table(dict(zip(("anchor", "passage", "doc", "n", "text"), map(list, zip(*rows)))))
    table = table.set_column(3, "n", table.column("n").cast(pa.int32()))
    for row, firsts in zip(rows, substring._search(table, 4).column("firsts").to_pylist()):
        words = row[4].split()
        assert firsts == [min(x[2] for x in rows if any(x[4].split()[j: j + 4] == words[i: i + 4] for j in range(11)))
                          for i in range(11)]
