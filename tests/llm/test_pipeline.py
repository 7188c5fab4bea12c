"""Each stage of the corpus pipeline against brute force on its own input, over a whole small folder."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basketry.llm import mixing, quality
from basketry.llm.queries import label_weights, trusted, word_bpe
from basketry.session import shared_path
from tests.llm.test_documents import brute_lines, brute_near, brute_targets, ordered, split

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        path = shared_path(spark, "stage")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_columns(stages):
    for kept in stages[1:5]:
        assert kept.columns == stages[0].columns and kept.dtypes == stages[0].dtypes
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_quality_keeps_what_the_model_accepts(spark, stages):
    kept = quality.classify(stages[0], trusted(spark, SF)).where("kept")
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(r.doc_id for r in kept.collect())
    clean = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0")
    assert stages[1].join(clean, "doc_id", "left_semi").count() >= 0.98 * clean.join(stages[0], "doc_id", "left_semi").count()


def test_lines(stages):
    want = brute_lines(rows(stages[1]), 10, True)
    got = ordered((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in rows(stages[2]))
    assert got == ordered((w[0], w[3]) for w in want)


def test_one_of_each_group_stays(stages):
    kept = {w[0] for w in brute_near(rows(stages[2]), 0.8, 5) if w[3]}
    assert sorted(d for d, *_ in rows(stages[3])) == sorted(kept)


def test_mix(spark, stages):
    plan = mixing.mix_sources(stages[3], quality=label_weights(spark, SF)).collect()
    got = collections.Counter(d for d, *_ in rows(stages[4]))
    assert got == collections.Counter({r.doc_id: r.copies for r in plan if r.copies})
    sizes = collections.Counter()
    for _, text, _, source in rows(stages[3]):
        sizes[source] += len(split(text))
    target = brute_targets(sizes, (1, 2, 3), 3)
    taken = collections.Counter()
    for _, text, _, source in rows(stages[4]):
        taken[source] += len(split(text))
    for s, want in target.items():
        most = max(len(split(t)) for _, t, _, x in rows(stages[3]) if x == s)
        assert abs(taken[s] - want) <= most / 2 + 1


def test_pack_and_run(spark, stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_bpe())
    pieces = stages[5].collect()
    size = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t, *_ in rows(stages[3])}
    assert all(p.doc_tokens == size[p.doc_id] for p in pieces)
    covered = collections.Counter()
    for p in pieces:
        covered[p.doc_id] += p.length
    times = collections.Counter(d for d, *_ in rows(stages[4]))
    assert covered == collections.Counter({d: n * size[d] for d, n in times.items()})
    filled = collections.Counter()
    for p in pieces:
        filled[p.sequence_id] += p.length
    assert all(n <= 2048 and (n == 2048 or n & (n - 1) == 0) for n in filled.values())
    run = corpus_pipeline.run(spark, SF)
    total = run.agg(F.sum("length"), F.count_distinct("doc_id")).first()
    assert tuple(total) == (sum(p.length for p in pieces), len(covered))
    assert np.array([p.length for p in pieces]).min() >= 1
