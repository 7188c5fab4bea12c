"""The registered queries as they are, columns and parameters included, on the whole smallest folder; and the
pipeline's stages on rows with nulls, empty texts, ties, repeats and clashing columns."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basketry.llm import quality
from basketry.llm.queries import ORACLE, QUERIES, trusted, word_bpe
from basketry.session import shared_path
from tests.llm.conftest import CLASHING, edge_documents, prose
from tests.llm.test_documents import brute_near, brute_targets, lower, ordered, rows_of, split
from tests.llm.test_vectors import brute_links

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_every_query_is_there():
    assert sorted(QUERIES, key=lambda q: (q == "pipeline", len(q.split("_")[0]), q))[-1] == "pipeline"
    numbers = {int(q[2:].split("_")[0]) for q in QUERIES if q != "pipeline"}
    assert numbers == set(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def test_op2_rejects_what_its_model_finds_unlikely(spark, texts):
    got = QUERIES["op2_kneser_ney_quality"](spark, SF)
    assert got.columns == ["doc_id", "lang", "n_symbols", "perplexity", "evened", "threshold", "kept"]
    rows = got.collect()
    size = {d: len((t or "").encode()) + 1 for d, t, *_ in texts}
    assert sorted(r.doc_id for r in rows) == sorted(size)
    want = {r.doc_id: (r.perplexity, r.kept) for r in quality.classify(
        spark.read.parquet(f"{SF}/documents.parquet"), trusted(spark, SF)).collect()}
    for r in rows:
        assert r.n_symbols == size[r.doc_id] and r.kept == (r.threshold is None or r.evened <= r.threshold)
        assert want[r.doc_id] == (pytest.approx(r.perplexity), r.kept)


def test_op5_takes_what_the_sources_are_due(spark, texts):
    got = QUERIES["op5_weighted_mix"](spark, SF).collect()
    size = {d: len(split(t)) for d, t, *_ in texts}
    source = {d: s for d, *_, s in texts}
    total = collections.Counter()
    for d, n in size.items():
        total[source[d]] += n
    target = brute_targets(total, (1, 2, 3), 3)
    taken = collections.Counter()
    assert sorted(r.doc_id for r in got) == sorted(size)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], total[source[r.doc_id]])
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s, want in target.items():
        assert abs(taken[s] - want) <= max(n for d, n in size.items() if source[d] == s)


def test_op7_learns_from_four_of_five_documents(spark, texts):
    got = QUERIES["op7_ppm_scoring"](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"),
                          ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, *_ in texts}
    counts = collections.Counter()
    for d, t, *_ in texts:
        if not held[d]:
            counts.update([*split(lower(t)), None])
    total, distinct = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(texts)
    for d, t, *_ in texts:
        tokens = [*split(lower(t)), None]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in tokens)
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            held[d], len(tokens), sum(counts[x] > 0 for x in tokens), total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    # what is learned: texts of the training part are likelier, symbol by symbol
    bits = {h: np.mean([rows[d].score / (len(t or "") + 1) for d, t, *_ in texts if held[d] == h]) for h in (True, False)}
    assert bits[False] > bits[True]


def test_op8_finds_the_links(spark, texts):
    got = rows_of(QUERIES["op8_minhash_forest_join"](spark, SF), "doc_id", "n_links", "component_id", "kept")
    assert got == brute_near(texts, 0.8, 5)


def test_op9_finds_the_links(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op9_e8_near_vectors"](spark, SF)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == brute_links(rows, 0.95)


def test_op10_packs_every_id_once(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_bpe())
    pieces = collections.defaultdict(list)
    windows = collections.defaultdict(list)
    for p in QUERIES["op10_sum_of_squares_packing"](spark, SF).collect():
        pieces[p.doc_id].append(p)
        windows[p.sequence_id].append((p.offset, p.length))
    for d, t, *_ in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in sorted(pieces.pop(d), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(ids[p.start: at].tobytes())
        assert at == len(ids)
    assert not pieces
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0


# ------------------------------------------------------------------ the pipeline on edge rows


@pytest.fixture(scope="module")
def edge_folder(spark):
    """A folder whose documents are the edge rows, with more columns; its labels have nulls, repeats and unknown ids."""
    folder = shared_path(spark, "edge")
    rows = edge_documents() + [(200 + k, prose(k, 60), "en", "a") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs = docs.withColumns({"n_chars": F.length("text").cast("bigint"), **{c: F.lit("clash") for c in CLASHING}})
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, 0) for k in (5, 6, 7, 8, 16, 20, *range(200, 212))] + [(5, 1, 0), (None, 1, 0), (999, 1, 0), (9, None, None), (18, 0, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_on_edge_rows(spark, edge_folder):
    docs = spark.read.parquet(f"{edge_folder}/documents.parquet")
    kept = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES, start=1):
        before, path = kept, shared_path(spark, "edge-stage")
        stage(spark, kept, edge_folder).write.parquet(path)
        kept = spark.read.parquet(path)
        if number < len(corpus_pipeline.STAGES):
            assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
            assert kept.where("n = 'clash' AND `_doc` = 'clash'").count() == kept.count() > 0
            if number < 4:  # the mix repeats documents
                assert kept.select("doc_id", "source").exceptAll(before.select("doc_id", "source")).isEmpty()
    covered = kept.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"))
    assert covered.where("n % doc_tokens <> 0").isEmpty() and not covered.isEmpty()


def test_stages_on_empty_tables(spark, edge_folder):
    empty = spark.read.parquet(f"{edge_folder}/documents.parquet").limit(0)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES, start=1):
        out = stage(spark, empty, edge_folder)
        assert out.isEmpty() and (number == 5 or out.columns == empty.columns)


def test_trusted_documents_stay_and_copies_go(spark, edge_folder):
    docs = spark.read.parquet(f"{edge_folder}/documents.parquet")
    good = corpus_pipeline.classify_quality(spark, docs, edge_folder)
    names = {r.doc_id for r in good.select("doc_id").collect()}
    assert {5, 6, 7, 8, 16, 200, 211} <= names
    one = [r.doc_id for r in corpus_pipeline.join_near_copies(spark, docs, edge_folder).select("doc_id").collect()]
    near = {w[0]: w[3] for w in brute_near(edge_documents(), 0.8, 5)}
    assert {8, 16}.issubset(one) and not {9, 10, 17}.intersection(one) and near[8] and not near[9]
    assert ordered([(d,) for d in one if d is not None and 200 <= d]) == [(200 + k,) for k in range(12)]
