"""N-gram Jaccard join by a MinHash LSH forest.

Each tree sees a text as a string of MinHash values. Sorted, the strings of a
tree are its prefix trie: a text's deepest common prefix is that with its
neighbour in front, and all texts that share a prefix stand in one run. One
pass over the sorted strings links every text, for each prefix length, to the
head of the run it is in.

The prefix that counts as a match starts at the whole string and is shortened,
one value at a time, until the recall reaches the target. Recall is measured on
the data: all links of the shortest prefix are compared exactly, and the chance
that pairs of their similarities match in some tree is averaged. Collections of
close copies thus stop at long prefixes, and short ones, with their chance
matches, are taken only where less similar pairs need them.

What matches, directly or over others, is a candidate group; in it all pairs
are verified on their exact sets of word n-grams, block by block, and counts
and spanning edges come out, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import (
    carried, mix64, partitions, row_key, run_hashes, slices, span_hashes, stored, utf8, word_spans,
)
from basketry.llm.components import components, in_blocks
from basketry.llm.lattice import forest_edges, grouped_rows

#: trees, and MinHash values of a tree
TREES, DEPTH = 16, 8
#: the share of pairs that are taken to be just similar enough whatever the linked pairs say
DOUBT = 0.05
#: similarities are counted by steps of one part in so many, rounded down
STEPS = 1000
#: texts of a block
BLOCK = 1024
#: bytes of text in a task
TASK_BYTES = 8 << 20
#: n-grams that at least this many texts of a group share are counted by matrix products
DENSE = 16
#: columns of such a matrix
COLUMNS = 4096


def match_chance(similarity: float | np.ndarray, trees: int, depth: int) -> float | np.ndarray:
    """The chance that texts of this similarity have ``depth`` values in common in some tree."""
    return 1 - (1 - similarity ** depth) ** trees


def matched_depth(trees: int, depth: int, similarity: float, recall: float) -> int:
    """The longest prefix, from ``depth`` down, with which texts of this similarity match in some tree often enough."""
    for k in range(depth, 0, -1):
        if match_chance(similarity, trees, k) >= recall:
            return k
    raise ValueError(f"{trees} trees cannot reach a recall of {recall} at similarity {similarity}")


def shortened(found: np.ndarray, trees: int, depth: int, least: int, similarity: float, recall: float,
              counts: np.ndarray | None = None) -> int:
    """The prefix from ``depth`` down to ``least`` at which measured recall reaches ``recall``.

    ``found``: similarities of pairs, ``counts``: how many pairs have each; those below ``similarity`` do not count.
    """
    near = found >= similarity
    close, weights = found[near], None if counts is None else counts[near]
    for k in range(depth, least, -1):
        measured = float(np.average(match_chance(close, trees, k), weights=weights)) if len(close) else 1.0
        if (1 - DOUBT) * measured + DOUBT * match_chance(similarity, trees, k) >= recall:
            return k
    return least


def shingles(words: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of ``length`` words, bounds by row); a shorter row that has words is one run."""
    n = np.diff(first)
    count = np.where(n >= length, n - length + 1, np.minimum(n, 1))
    bounds = np.concatenate(([0], np.cumsum(count)))
    row = np.repeat(np.arange(len(n)), count)
    start = first[:-1][row] + np.arange(bounds[-1]) - bounds[:-1][row]
    size = np.minimum(n[row], length)
    return mix64(run_hashes(words, start, size) + size.astype(np.uint64)), bounds


def multipliers(count: int) -> np.ndarray:
    return mix64(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)


def _signatures(batches: Iterator[pa.RecordBatch], length: int, trees: int, depth: int) -> Iterator[pa.RecordBatch]:
    factors = multipliers(trees * depth)
    for batch in batches:
        data, bounds = utf8(batch.column(2))
        for i, j in slices(bounds):
            own = data[bounds[i]: bounds[j]]
            start, end, first = word_spans(own, bounds[i: j + 1] - bounds[i])
            words = span_hashes(own, start, end)
            n = np.diff(first)
            x = mix64(run_hashes(words, first[:-1], n) + n.astype(np.uint64))
            y = mix64(run_hashes(mix64(words + np.uint64(1)), first[:-1], n))
            grams, at = shingles(words, first, length)
            has = np.flatnonzero(n > 0)
            least = np.empty((len(has), len(factors)), dtype=">u4")
            for k, f in enumerate(factors):
                values = ((grams * f) >> np.uint64(32)).astype(np.uint32)
                if len(has):
                    least[:, k] = np.minimum.reduceat(values, at[:-1][has])
            signature: list[bytes | None] = [None] * (j - i)
            for k, row in zip(has.tolist(), least):
                signature[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(x.view(np.int64)),
                 pa.array(y.view(np.int64)), pa.array(signature, pa.binary())],
                names=["doc_id", "row_key", "x", "y", "signature"])


def _strings(batches: Iterator[pa.RecordBatch], trees: int, depth: int) -> Iterator[pa.RecordBatch]:
    """A row for each text and tree, with the tree's MinHash values."""
    for batch in batches:
        n = batch.num_rows
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, trees, 4 * depth)
        ids = batch.column(0).to_numpy()
        for t in range(trees):
            raw = np.ascontiguousarray(values[:, t])
            offsets = pa.py_buffer((np.arange(n + 1) * 4 * depth).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, t, np.int32)), pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(raw)]),
                 pa.array(ids)], names=["tree", "string", "id"])


MATCHES = "a bigint, b bigint, depth int, tree int, prefix binary"


def _matches(batches: Iterator[pa.RecordBatch], least: int, depth: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b, depth) over sorted strings: for each depth, from the head of the run that a text is in to the text.

    A run of depth d are neighbours with the first d values in common. Runs of less than ``least`` values
    are left out. A run may go on in the next partition: the first and the last text come out with their
    prefixes and the heads of their runs (b null), for each depth.
    """
    def ends(tree: int, string: np.ndarray, heads: list[int]) -> pa.RecordBatch:
        depths = list(range(least, depth + 1))
        return pa.RecordBatch.from_arrays(
            [pa.array(heads, pa.int64()), pa.nulls(len(depths), pa.int64()), pa.array(depths, pa.int32()),
             pa.array([tree] * len(depths), pa.int32()), pa.array([string[: 4 * d].tobytes() for d in depths], pa.binary())],
            names=["a", "b", "depth", "tree", "prefix"])

    last: tuple[int, np.ndarray] | None = None
    heads: list[int] = []  # of the last text's runs, by depth
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        tree, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        strings = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, -1)
        values = strings.view(">u4")
        same = np.zeros((n, depth), dtype=bool)
        same[1:] = (values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None]
        if last is not None and last[0] == int(tree[0]):
            same[0] = values[0] == last[1].view(">u4")
        common = np.where(same.all(axis=1), depth, np.argmin(same, axis=1))  # values shared with the text in front
        if last is None:
            yield ends(int(tree[0]), strings[0], [int(ids[0])] * (depth - least + 1))
            heads = [int(ids[0])] * (depth - least + 1)
        head = np.empty((n, depth - least + 1), dtype=np.int64)
        for k, d in enumerate(range(least, depth + 1)):
            at = np.maximum.accumulate(np.where(common < d, np.arange(n), -1))
            head[:, k] = np.where(at >= 0, ids[at], heads[k])
        for k, d in enumerate(range(least, depth + 1)):
            linked = np.flatnonzero(common >= d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(head[linked, k]), pa.array(ids[linked]), pa.array(np.full(len(linked), d, np.int32)),
                 pa.nulls(len(linked), pa.int32()), pa.nulls(len(linked), pa.binary())],
                names=["a", "b", "depth", "tree", "prefix"])
        last, heads = (int(tree[-1]), strings[-1].copy()), head[-1].tolist()
    if last is not None:
        yield ends(*last, heads)


def _grams(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(id, grams): the set of a text's n-grams."""
    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        for i, j in slices(bounds):
            own = data[bounds[i]: bounds[j]]
            start, end, first = word_spans(own, bounds[i: j + 1] - bounds[i])
            grams, cuts = shingles(span_hashes(own, start, end), first, length)
            sets = [np.unique(grams[a:b]).view(np.int64) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["id", "grams"])


def _similarities(pairs: DataFrame, texts: DataFrame, length: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(similarities of ``similarity`` and more, rounded down to STEPS, how many of the pairs have each)."""
    sets = stored(texts.mapInArrow(lambda b: _grams(b, length), "id bigint, grams array<bigint>"), "candidate-grams")
    # a text has one head in each tree, but heads have many texts: they are joined last, when Spark sees how large
    # the rows of such a key are
    both = (pairs.join(sets.select(F.col("id").alias("_b"), F.col("grams").alias("y")), F.col("b") == F.col("_b"))
            .join(sets.select(F.col("id").alias("_a"), F.col("grams").alias("x")), F.col("a") == F.col("_a")))
    shared = F.size(F.array_intersect("x", "y"))
    found = both.select(F.try_divide(shared, F.size("x") + F.size("y") - shared).alias("s")).where(F.col("s") >= similarity)
    steps = F.greatest(F.lit(similarity), F.floor(F.col("s") * STEPS) / STEPS)
    rows = found.groupBy(steps.alias("s")).count().collect()  # STEPS rows at most
    return np.array([r["s"] for r in rows], dtype=np.float64), np.array([r["count"] for r in rows], dtype=np.float64)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets (sorted, distinct) have in common."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    run = np.cumsum(new) - 1
    share = np.bincount(run) if len(run) else np.empty(0, np.int64)
    out = np.zeros(n * n, dtype=np.int64)
    few = np.flatnonzero((share[run] > 1) & (share[run] < DENSE)) if len(run) else np.empty(0, np.int64)
    few_owner, few_run = owner[few], run[few]
    for d in range(1, min(DENSE, n)):  # the members of a run are neighbours
        same = np.flatnonzero(few_run[d:] == few_run[:-d])
        if len(same):
            np.add.at(out, few_owner[same] * n + few_owner[same + d], 1)
    out = out.reshape(n, n)
    out += out.T
    wide = np.flatnonzero(share >= DENSE)
    if len(wide):
        column = np.full(len(share), -1)
        column[wide] = np.arange(len(wide))
        cell = column[run]
        for c in range(0, len(wide), COLUMNS):
            here = np.flatnonzero((cell >= c) & (cell < c + COLUMNS))
            x = np.zeros((n, min(COLUMNS, len(wide) - c)), dtype=np.float32)
            x[owner[here], cell[here] - c] = 1
            out += (x @ x.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _verified(table: pa.Table, length: int, similarity: float) -> pa.Table:
    """Links of each group (or pair of its blocks): rows (a, b) that span them, and rows (a, null, n) that count them."""
    by, bounds = grouped_rows(table, ["component", "lo", "hi"])
    ids, copies = table.column("id").to_numpy()[by], table.column("copies").to_numpy()[by]
    left = table.column("left").to_numpy(zero_copy_only=False)[by]
    texts = table.column("text").combine_chunks()
    texts = texts.take(pa.array(by))
    edges: list[np.ndarray] = [np.empty((0, 2), np.int64)]
    links = np.zeros(len(by), dtype=np.int64)
    for a, b in zip(bounds[:-1], bounds[1:]):
        data, at = utf8(texts.slice(a, b - a))
        start, end, first = word_spans(data, at)
        grams, cuts = shingles(span_hashes(data, start, end), first, length)
        sets = [np.unique(grams[p:q]) for p, q in zip(cuts[:-1], cuts[1:])]
        common = common_counts(sets)
        size = np.array([len(s) for s in sets])
        linked = common / np.maximum(size[:, None] + size[None, :] - common, 1) >= similarity
        np.fill_diagonal(linked, False)
        if not left[a:b].all():
            linked &= left[a:b][:, None] != left[a:b][None, :]
        links[a:b] = linked @ copies[a:b]
        edges.append(ids[a:b][np.array(forest_edges(linked), dtype=np.int64).reshape(-1, 2)])
    pairs = np.concatenate(edges)
    some = links > 0
    return pa.table({
        "a": pa.array(np.concatenate((pairs[:, 0], ids[some]))),
        "b": pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(int(some.sum()), pa.int64())]),
        "n": pa.array(np.concatenate((np.zeros(len(pairs), np.int64), links[some])))})


def near_documents(docs: DataFrame, *, similarity: float = 0.8, length: int = 5, trees: int = TREES,
                   depth: int = DEPTH, recall: float = 0.998, block: int = BLOCK, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, row_key, n_links, component_id, kept``: one row per row of ``docs`` that has an id.

    Texts are sets of runs of ``length`` words (parted by ASCII white space,
    unchanged); a shorter text with words is one run. Two are linked if the
    Jaccard similarity of their sets is at least ``similarity`` and the forest
    finds them, or if both are in one candidate group; pairs below are never
    linked. ``n_links``: other rows linked directly. ``component_id``: the
    smallest id that links reach; ``kept``: whether that is the row's own.

    The forest's prefix is the longest at which recall, measured on all links of
    the shortest one, reaches ``recall`` (``shortened``), and at least as long as pairs that are just
    similar enough need for it. Long texts are worked on whole, one by one.

    Texts with the same words in the same order are copies: they are linked,
    are one to the forest, and count each. Null and empty texts have no words
    and are copies of each other. Rows with one id count like others; of equal
    rows all are kept or none. Rows without id are left out. An empty table
    gives no rows. Other columns are not read. Words and runs are told apart
    by 64 bits of hash, copies by 128.
    """
    spark = docs.sparkSession
    least = matched_depth(trees, depth, similarity, recall)  # enough whatever the data
    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(F.col(text_col)).alias("row_key"),
                       F.col(text_col).alias("text")).where("doc_id is not null")
    signed = stored(read.mapInArrow(lambda b: _signatures(b, length, trees, depth),
                                    "doc_id bigint, row_key bigint, x bigint, y bigint, signature binary"), "signatures")
    # texts of one doc_id are classes of their own: a class has a number, fixed when the table is stored
    classes = (signed.groupBy("x", "y").agg(F.min(F.struct("doc_id", "row_key")).alias("first"),
                                            F.count(F.lit(1)).alias("copies"), F.any_value("signature").alias("signature"))
               .select("x", "y", F.monotonically_increasing_id().alias("id"), F.col("first.doc_id").alias("doc"),
                       F.col("first.row_key").alias("key"), "copies", "signature"))
    classes = stored(classes, "text-classes")

    strings = classes.where("signature is not null").select("id", "signature").mapInArrow(
        lambda b: _strings(b, trees, depth), "tree int, string binary, id bigint")
    order = ["tree", "string", "id"]
    found = stored(strings.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
                   .mapInArrow(lambda b: _matches(b, least, depth), MATCHES), "matches")
    # two rows of each partition and depth
    ends = found.where("b is null").select(F.col("a").alias("id"), "depth", "tree", "prefix")
    heads = ends.groupBy("depth", "tree", "prefix").agg(F.min("id").alias("a"))
    over = ends.join(heads, ["depth", "tree", "prefix"]).select("a", F.col("id").alias("b"), "depth")
    links = found.where("b is not null").select("a", "b", "depth").unionAll(over).where("a <> b")
    # links of longer prefixes are between texts that shorter ones link too
    sides = (F.least("a", "b"), F.greatest("a", "b"))  # a text may be the other's head in one tree, and not in another
    pairs = (links.where(F.col("depth") == least).groupBy(*[x.alias(f"_{k}") for k, x in enumerate(sides)])
             .agg(F.min(F.struct("a", "b")).alias("pair")))
    pairs = stored(pairs.select("pair.*"), "matched-pairs")
    ids = pairs.select(F.col("a").alias("_i")).unionAll(pairs.select("b")).distinct()
    wanted = stored(classes.join(ids, F.col("id") == F.col("_i")).select("id", "doc", "key"), "candidates")
    # rows that are equal in id and text are of one class; one of them will do
    texts = read.join(wanted.hint("merge"), (F.col("doc_id") == F.col("doc")) & (F.col("row_key") == F.col("key")))
    texts = stored(texts.select("id", "text").dropDuplicates(["id"]), "candidate-texts")
    matched = least
    if least < depth:
        alike, counts = _similarities(pairs, texts, length, similarity)
        matched = shortened(alike, trees, depth, least, similarity, recall, counts)
    groups = stored(components(links.where(F.col("depth") == matched).select("a", "b")), "candidate-groups")

    sizes = stored(groups.groupBy(F.col("component").alias("_c")).agg(F.count(F.lit(1)).alias("members")), "group-sizes")
    members = (groups.join(sizes, F.col("component") == F.col("_c")).select("id", "component", "members")
               .join(classes.select("id", "copies"), "id"))
    texts = stored(texts.join(members, "id").select("id", "component", "members", "copies", "text"), "group-texts")
    size = texts.agg(F.sum(F.octet_length("text") * F.ceil(F.col("members") / block))).first()[0] or 0
    dealt = in_blocks(texts, "component", "members", "id", block)
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("component", "lo", "hi"),
                                            F.lit(max(1, -(-int(size) // TASK_BYTES)))))
    links = stored(dealt.groupBy("task").applyInArrow(lambda t: _verified(t, length, similarity),
                                                      "a bigint, b bigint, n bigint"), "links")
    joined = stored(components(links.where("b is not null").select("a", "b")), "linked-classes")
    docs_of = classes.select(F.col("id").alias("_j"), "doc")
    least = (joined.join(docs_of, F.col("id") == F.col("_j")).groupBy(F.col("component").alias("_c"))
             .agg(F.min("doc").alias("component_id")))
    joined = (joined.join(stored(least, "component-docs"), F.col("component") == F.col("_c"))
              .select(F.col("id").alias("_j"), "component_id"))
    counts = links.where("b is null").groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("n"))
    known = (classes.select("x", "y", "id", "doc", "copies")
             .join(counts, F.col("id") == F.col("_a"), "left")
             .join(joined, F.col("id") == F.col("_j"), "left")
             .select(F.col("x").alias("_x"), F.col("y").alias("_y"),
                     (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"),
                     F.coalesce("component_id", "doc").alias("component_id")))
    known = stored(known, "text-links")
    return (signed.select("doc_id", "row_key", "x", "y")
            .join(known, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")))
            .select("doc_id", "row_key", "n_links", "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept")))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``near_documents`` keeps, and those without id; all columns as before."""
    gone = (near_documents(docs, id_col=id_col, text_col=text_col, **options).where("not kept")
            .select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key")).distinct())
    own = carried(docs, doc=F.col(id_col).cast("bigint"), key=row_key(F.col(text_col)))
    return own.join(gone, (F.col("doc") == F.col("_doc")) & (F.col("key") == F.col("_key")),
                    "left_anti").select("row.*")
