"""Toxicity, ranked search and spelling variants against brute force and held-out labels."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import search, spelling, toxicity
from basketry.llm.common import pieces
from basketry.llm.queries import QUERIES
from tests.llm.conftest import edge_documents, prose
from tests.llm.test_documents import ordered, rows_of

SF = "/root/testdata/sf0.001"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def long_text(n):
    r = random.Random(n)
    return " ".join(r.choice(("alpha", "beta", "gamma", "delta")) + str(r.randrange(3000)) for _ in range(n))


def test_long_rows_are_cut_between_runs():
    data = np.frombuffer(b"ab cd efghijklmnop qr" + b"x" * 50 + b" y", np.uint8)
    bounds = np.array([0, 2, 21, len(data)])
    owner, cuts = pieces(data, bounds, data_member := toxicity.IS_LETTER, most=6)
    assert cuts[0] == 0 and cuts[-1] == len(data) and (np.diff(cuts) >= 0).all() and set(owner) == {0, 1, 2}
    for c, o in zip(cuts[1:-1], owner[1:]):
        assert c in bounds or not data_member[data[c - 1]]
    got = collections.Counter()
    for o, a, b in zip(owner, cuts, cuts[1:]):
        got.update((o, w) for w in data[a:b].tobytes().split())
    want = collections.Counter((k, w) for k in range(3) for w in data[bounds[k]: bounds[k + 1]].tobytes().split())
    assert got == want


# ------------------------------------------------------------------ op11


def labelled_texts():
    """1 where an insult meets a group, 0 where either stands alone: no sum of two weights tells them apart."""
    r = random.Random(4)
    rows = []
    for k in range(400):
        insult, group = k % 2, (k // 2) % 2
        words = prose(k, 30).split()
        if insult:
            words.insert(r.randrange(30), "rotten")
        if group:
            words.insert(r.randrange(30), "martians")
        rows.append((k, " ".join(words), int(insult and group)))
    return rows


def learned(spark):
    """(documents, labels), ids from 0 on."""
    df = spark.createDataFrame(labelled_texts(), "doc_id bigint, text string, label int").repartition(3)
    return df.select("doc_id", "text"), df.select("doc_id", "label")


def test_pairs_are_learned(spark):
    known, labels = learned(spark)
    new = [(1000, "the martians are rotten " + prose("p", 20)), (1001, "the martians are here " + prose("q", 20)),
           (1002, "rotten apples " + prose("r", 20)), (1003, prose("s", 25))]
    docs = known.unionByName(spark.createDataFrame(new, "doc_id bigint, text string"))
    got = toxicity.toxic_scores(docs, labels).where("doc_id >= 1000")
    assert rows_of(got, "doc_id", "predicted") == [(1000, 1), (1001, 0), (1002, 0), (1003, 0)]
    again = toxicity.toxic_scores(docs.repartition(5), labels.repartition(2)).where("doc_id >= 1000")
    assert rows_of(got, "doc_id", "score") == rows_of(again, "doc_id", "score")


def test_machine_scores_are_the_sum_over_pairs():
    m = toxicity.Machine(5, 3)
    m.bias, m.weight = 0.25, np.arange(5) / 10
    row, term = np.array([0, 0, 0, 2, 2]), np.array([0, 2, 4, 1, 3])
    for k, z in enumerate(m.scores(row, term, 3)):
        own = term[row == k]
        pairs = sum(m.factor[a] @ m.factor[b] for i, a in enumerate(own) for b in own[i + 1:])
        assert z == pytest.approx(0.25 + m.weight[own].sum() + pairs)


def test_toxic_edges(spark, docs, no_docs):
    known, labels = learned(spark)
    known, labels = known.selectExpr("doc_id + 1000000 AS doc_id", "text"), labels.selectExpr("doc_id + 1000000 AS doc_id", "label")
    labels = labels.unionAll(spark.createDataFrame([(None, 1), (7, None), (3000000, 1), (1000000, 0)], labels.schema))
    edge = docs.unionByName(known, allowMissingColumns=True).unionByName(
        spark.createDataFrame([(77, long_text(400_000) + " rotten martians")], "doc_id bigint, text string"),
        allowMissingColumns=True)
    got = [r for r in toxicity.toxic_scores(edge, labels).collect() if r.doc_id is None or r.doc_id < 1_000_000]
    assert len(got) == len(edge_documents()) + 1 and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (11, 12, 13)}
    assert len(empty) == 1  # null, empty and blank texts have no terms
    same = collections.defaultdict(set)
    for r in got:
        same[r.row_key].add(r.score)
    assert all(len(s) == 1 for s in same.values())
    assert toxicity.toxic_scores(no_docs, labels).isEmpty()
    for nothing in (labels.limit(0), labels.where("label = 0"), labels.withColumn("label", F.lit(None).cast("int"))):
        assert {(r.predicted, round(r.score, 6)) for r in toxicity.toxic_scores(docs, nothing).collect()} == {(0, 0.5)}


def test_op11_query(spark):
    got = QUERIES["op11_factorization_toxicity"](spark, "/root/testdata/sf0.01")
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    caught = [r.predicted for r in held if toxic[r.doc_id]]
    wrong = [r.predicted for r in held if not toxic[r.doc_id]]
    assert sum(caught) >= 0.6 * len(caught) and sum(wrong) <= 0.05 * len(wrong)


# ------------------------------------------------------------------ op12


def brute_search(docs, items, k):
    run = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text):
        return run.findall(ascii_lower(text or ""))

    own = [(doc, collections.Counter(terms(text))) for doc, text, *_ in docs]
    n = sum(1 for _, c in own if c)
    total = sum(sum(c.values()) for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    asked = collections.defaultdict(list)
    for item, text in items:
        if item is not None:
            asked[item] += terms(text)
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, c in own:
            m = 100 - 75 + (75 * sum(c.values()) * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in wanted if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return ordered(out)


def search_items():
    base = prose("base", 120).split()
    return [(1, " ".join(base[20:45])), (2, "SAME same Shared line"), (3, None), (4, ""), (5, "?!"), (6, "unheard-of words"),
            (None, "same"), (7, prose(5, 10)), (7, "漢字 ünïcode ÜNÏCODE"), (8, prose("long", 30)), (9, "x" * 30000 + " one")]


@pytest.mark.parametrize("k, first", [(10, 4), (3, 1), (1, 1)])
def test_search(spark, docs, monkeypatch, k, first):
    monkeypatch.setattr(search, "FIRST", first)
    items = spark.createDataFrame(search_items(), "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    got = search.search(docs, items, k=k)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == brute_search(edge_documents(), search_items(), k)


def test_search_random(spark, monkeypatch):
    """Few coordinates, so that bounds lie above scores; many copies; several batches of queries."""
    monkeypatch.setattr(search, "BATCH_QUERIES", 7)
    r = random.Random(8)
    words = [f"t{int(r.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 60)))) for k in range(300)]
    docs += [(1000 + k, docs[5][1]) for k in range(60)] + [(2000, long_text(30_000))]
    items = [(k, " ".join(r.choice(words) for _ in range(8))) for k in range(20)] + [(100, docs[5][1]), (101, "alpha7 beta9")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = search.search(df, spark.createDataFrame(items, "item_id bigint, text string"), k=10, width=64)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == brute_search(docs, items, 10)


def test_bounds_are_upper_bounds():
    import pyarrow as pa

    texts = [long_text(50), "alpha1 alpha1 beta2", ""]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, None]), pa.array([1, 2, 3]), pa.array(texts)],
                                       names=["doc_id", "row_key", "text"])
    (sketch,) = search._sketches(iter([batch]), 2, 60, search.WIDTH)
    q = search.Queries([5], ["alpha1 beta2 beta2 gamma3"])
    q.weigh(np.array([1000, 2000, 3000][: len(q.terms)]))
    (_, bound), = search.bounds_of(sketch, q)
    rows = pa.RecordBatch.from_arrays([*batch.columns, pa.array([[0], [0], [0]])], names=[*batch.schema.names, "wanted"])
    (scored,) = search._scored(iter([rows]), q, 2, 60)
    exact = scored.column("score").to_pylist()
    assert all(b >= e for b, e in zip(bound[:, 0], exact)) and exact[1] > 0 and exact[2] == 0


def test_search_empty(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "same")], "item_id bigint, text string")
    assert search.search(no_docs, items).isEmpty()
    assert search.search(docs, items.limit(0)).isEmpty()
    assert search.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


# ------------------------------------------------------------------ op13


def brute_variants(rows, least, min_count, ratio, every):
    counts = collections.Counter()
    for doc, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = ascii_lower(w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least:
                counts[w] += 1
    v = {w: n for w, n in counts.items() if n >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    form, count = {}, {}
    for w in v:
        found = sorted((-v[x], x) for x in v if near(w, x))
        count[w] = len(found)
        form[w] = found[0][1] if found and -found[0][0] >= ratio * v[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return ordered((w, form[w], root(w), v[w], count[w], v[form[w]] if form[w] else None) for w in v)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def variant_rows(seed, size):
    """Words with variants of variants, anagrams, letters that share bits, and a very long one."""
    r = random.Random(seed)
    alphabet = "abcdeéèÀÒÿz"
    base = ["".join(r.choice(alphabet) for _ in range(r.randrange(3, 9))) for _ in range(size)]
    rows = []
    for k, w in enumerate(base):
        for times in (60, 6, 1):
            rows.append((k, " ".join([w.capitalize() if w.isascii() else w] * times)))
            w = list(w)
            p = r.randrange(len(w))
            w[p: p + 1] = r.choice(([], [r.choice(alphabet)], [w[p], r.choice(alphabet)]))
            w = "".join(w) or "a"
    return rows + [(None, "aab aab abb abb bab"), (None, None), (5, ""), (6, "q" * 5000 + " " + "q" * 5001)]


@pytest.mark.parametrize("seed, least, min_count, ratio, every", [(1, 2, 1, 2, 0), (2, 3, 2, 10, 3), (3, 1, 1, 5, 1)])
def test_variants(spark, seed, least, min_count, ratio, every):
    rows = variant_rows(seed, 60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit("clash")).repartition(4)
    got = spelling.spelling_variants(df, least=least, min_count=min_count, ratio=ratio, every=every)
    assert rows_of(got, *COLUMNS) == brute_variants(rows, least, min_count, ratio, every)


def test_variants_in_many_cells(spark):
    """Trees that cut every length into many cells, cells that several tasks share, leaves of a few words."""
    rows = variant_rows(9, 200)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    words = df.mapInArrow(lambda b: spelling.word_counts(b, 1, 0), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    got = rows_of(spelling.near_words(words, cell_letters=40, visitor_letters=60, sample=100,
                                       least=4, leaf=4), "word", "n_near")
    want = [(w, n) for w, _, _, _, n, _ in brute_variants(rows, 1, 1, 2, 0) if n]
    assert got == want


def test_vectors_differ_by_two_bits_at_most():
    import pyarrow as pa

    r = random.Random(3)
    alphabet = "abczéÿÀÒß×"
    for _ in range(300):
        w = [r.choice(alphabet) for _ in range(r.randrange(1, 12))]
        x = list(w)
        p = r.randrange(len(x))
        x[p: p + 1] = r.choice(([], [r.choice(alphabet)], [x[p], r.choice(alphabet)]))
        a, b = (spelling.vectors(spelling.letters(pa.array(["".join(y)]))[0])[0] for y in (w, x))
        assert np.bitwise_count(a ^ b).sum() <= (2 if len(w) == len(x) else 1)


def test_variants_edges(spark, docs, no_docs):
    rows = edge_documents()
    got = spelling.spelling_variants(docs, least=3, every=31)
    assert rows_of(got, *COLUMNS) == brute_variants(rows, 3, 2, 10, 31)
    assert spelling.spelling_variants(no_docs).isEmpty()
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs, ratio=1)


def test_op13_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op13_kd_spelling_variants"](spark, SF)
    want = brute_variants(docs, 7, 2, 10, 31)
    assert rows_of(got, *COLUMNS) == want and len(want) > 100
