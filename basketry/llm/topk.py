"""Exact top-k inner products by the three-phase uniform threshold.

Each vector's components are dealt to ``nodes`` equal stretches; a node's
score of a row is the inner product over its stretch, and a row's score their
sum. Nodes work apart: a task has one node's stretches of a block of rows and a
block of queries, and what it says of the other nodes' scores it has to be told.

1. Every node lists its k best rows per query. The listed rows are scored
   exactly; the k-th best of these scores is a safe cutoff for the query, as k
   rows reach it.
2. The cutoffs are sent to all nodes, and each gives the entries that reach its
   uniform share, cutoff / nodes. A row that reaches the cutoff has such an
   entry at some node. Entries of a row are added up; where a node gave none,
   its score is below the share, and rows whose sum stays below the cutoff even
   so are left out.
3. The remaining scores are resolved exactly and ranked.

Rows with equal vectors are one to the nodes. Of such rows the k + 1 with the
smallest ids are kept, as no other can be among a query's k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.llm.common import stored

#: bytes of the vectors of a block, of rows as of queries: each row is sent once for each block of
#: queries, each query once for each block of rows, and equal blocks make the two the same
BLOCK_BYTES = 4 << 20
#: queries scored at once inside a block
AT_ONCE = 256


def usable(vector: Column) -> Column:
    """Not null, and all components neither null nor infinite nor NaN."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column whose lists are equally long."""
    column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(values) else np.zeros((len(column), 0))


def whole_numbers(*tables: np.ndarray) -> list[np.ndarray]:
    """Matrices of whole numbers, in doubles where these hold all their inner products exactly, else in Python's integers."""
    most = 1.0
    for t in tables:
        most *= max(float(np.abs(t).max(initial=0.0)), 1.0)
    if most * max(tables[0].shape[-1], 1) < 2.0 ** 52:
        return list(tables)
    return [np.array([[int(v) for v in r] for r in t], dtype=object).reshape(t.shape) for t in tables]


def _checked(scores) -> list[int]:
    out = [int(s) for s in scores]
    if any(abs(s) >= 1 << 63 for s in out):
        raise ArithmeticError("a score does not fit 64 bits")
    return out


def _node_scores(rows: pa.Table, queries: pa.Table) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """A node's scores of a block, a slice of its queries at a time: (slice, scores, whether the row may be listed)."""
    if not rows.num_rows or not queries.num_rows:
        return
    q, r = whole_numbers(matrix(queries.column("part")), matrix(rows.column("part")))
    alone, classes = rows.column("copies").to_numpy() == 1, rows.column("id").to_numpy()
    ids = queries.column("id").to_numpy()
    for a in range(0, len(q), AT_ONCE):
        at = slice(a, a + AT_ONCE)
        p = q[at] @ r.T if q.shape[1] else np.zeros((len(q[at]), len(r)), dtype=q.dtype)
        yield at, p, ~((ids[at][:, None] == classes[None, :]) & alone[None, :])


ENTRIES = "query_id bigint, class bigint, node int, score bigint"


def _entries(found: list[tuple[np.ndarray, np.ndarray, list[int]]], node: int) -> pa.Table:
    queries, classes = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
    scores = [s for f in found for s in f[2]]
    return pa.table([pa.array(queries, pa.int64()), pa.array(classes, pa.int64()),
                     pa.array(np.full(len(scores), node, np.int32)), pa.array(scores, pa.int64())],
                    names=["query_id", "class", "node", "score"])


def _lists(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Phase 1 in a block: a node's k best rows (classes of equal ones) of each query, ties to the smaller id."""
    found = []
    ids, classes = queries.column("id").to_numpy(), rows.column("id").to_numpy()
    for at, p, allowed in _node_scores(rows, queries):
        good = allowed
        if p.shape[1] > k + 1 and p.dtype != object:
            # one of the k + 1 best may be the query's own
            good = allowed & (p >= np.partition(p, p.shape[1] - k - 1, axis=1)[:, [p.shape[1] - k - 1]])
        q, r = np.nonzero(good)
        own = p[q, r]
        by = np.lexsort((classes[r], -own, q)) if p.dtype != object else np.array(
            sorted(range(len(q)), key=lambda i: (q[i], -own[i], classes[r[i]])), dtype=np.int64)
        place = np.arange(len(by)) - np.searchsorted(q[by], q[by])
        by = by[place < k]
        found.append((ids[at][q[by]], classes[r[by]], _checked(own[by])))
    return _entries(found, rows.column("node")[0].as_py() if rows.num_rows else 0)


def _shares(rows: pa.Table, queries: pa.Table, nodes: int) -> pa.Table:
    """Phase 2 in a block: the entries that reach the node's share of the query's cutoff (null: all of them)."""
    found = []
    ids, classes = queries.column("id").to_numpy(), rows.column("id").to_numpy()
    cutoffs = queries.column("cutoff").to_pylist()
    for at, p, allowed in _node_scores(rows, queries):
        free = np.array([c is None for c in cutoffs[at]])
        least = np.array([0 if c is None else c for c in cutoffs[at]], dtype=p.dtype)
        q, r = np.nonzero(allowed & (free[:, None] | (p * nodes >= least[:, None]).astype(bool)))
        found.append((ids[at][q], classes[r], _checked(p[q, r])))
    return _entries(found, rows.column("node")[0].as_py() if rows.num_rows else 0)


def _lookups(rows: pa.Table, queries: pa.Table) -> pa.Table:
    """The exact scores of the rows of a block that its queries want."""
    classes = rows.column("id").to_numpy() if rows.num_rows else np.empty(0, np.int64)
    lists = queries.column("wanted").combine_chunks()
    query = np.repeat(np.arange(queries.num_rows), np.diff(lists.offsets.to_numpy()))
    wanted = lists.flatten().to_numpy()
    by = np.argsort(classes)
    at = np.minimum(np.searchsorted(classes, wanted, sorter=by), max(len(by) - 1, 0))
    row = by[at] if len(by) else at
    here = classes[row] == wanted if len(by) else np.zeros(len(wanted), dtype=bool)  # of the same length, that is
    query, row = query[here], row[here]
    scores = []
    if len(query):
        q, r = whole_numbers(matrix(queries.column("part")), matrix(rows.column("part")))
        for i in range(0, len(query), 50_000):
            part = slice(i, i + 50_000)
            scores += _checked((q[query[part]] * r[row[part]]).sum(axis=1))
    return pa.table([pa.array(queries.column("id").to_numpy()[query], pa.int64()), pa.array(classes[row], pa.int64()),
                     pa.array(scores, pa.int64())], names=["query_id", "class", "score"])


def top_k(rows: DataFrame, queries: DataFrame, *, k: int = 5, scale: float = 256.0, nodes: int = 2,
          block_bytes: int = BLOCK_BYTES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k rows with the highest integer inner product.

    Components become floor(scale * x), x as double. A row with the query's id
    is the query's own and no candidate. Ties go to the smaller id. Queries
    with fewer than k candidates get all of them.

    Rows and queries without an id, or whose vector is null or holds null or
    non-finite components, take no part; vectors of another length than the
    query's are no candidates. Of several rows with one id the least vector
    counts, so repeated rows count once. An empty table on either side gives
    no rows. A score beyond 64 bits raises ArithmeticError. Other columns are
    not read. Fewer nodes make the uniform shares of a cutoff prune more.
    """
    x = F.col("v")

    def whole(v: Column) -> Column:  # from 2^52 on, doubles are whole numbers
        return F.when(F.abs(v) < 2.0 ** 52, F.floor(v).cast("double")).otherwise(v)

    def ready(df: DataFrame) -> DataFrame:
        return (df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
                .where(F.col("id").isNotNull() & usable(x)).groupBy("id").agg(F.min("v").alias("v"))
                .select("id", F.transform(x, lambda c: whole(c * F.lit(scale))).alias("v")))

    # equal vectors: the k + 1 smallest ids, one of which may be the query's own
    first_ids = F.row_number().over(W.partitionBy("v").orderBy("id"))
    classes = (ready(rows).withColumn("n", first_ids).where(F.col("n") <= k + 1).groupBy("v")
               .agg(F.sort_array(F.collect_list("id")).alias("ids")))
    classes = stored(classes.select(F.col("ids")[0].alias("id"), F.size("ids").alias("copies"), "ids", "v"), "topk-rows")
    ask = stored(ready(queries), "topk-queries")

    def blocks(df: DataFrame) -> int:
        return max(1, -(-(df.agg(F.sum(F.size("v"))).first()[0] or 0) * 8 // block_bytes))

    row_blocks, query_blocks = blocks(classes), blocks(ask)

    def block(own: str, n: int, c: str = "id") -> Column:
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(own)

    def dealt(df: DataFrame, others: Column | None, own: str, own_n: int, other: str, nodes: int):
        """The stretches of each vector, in its own block, for each block of the other side and each node."""
        dim = F.size("v")
        cut = [F.floor(dim * j / nodes).cast("int") for j in range(nodes + 1)]
        parts = F.array(*[F.struct(F.lit(j).alias("node"), F.slice("v", cut[j] + 1, cut[j + 1] - cut[j]).alias("part"))
                          for j in range(nodes)])
        out = df.select("*", block(own, own_n), dim.alias("dim"), F.inline(parts)).drop("v")
        if others is not None:
            out = out.withColumn(other, F.explode(others))
        return out.groupBy("rb", "qb", "node", "dim")

    all_rb, all_qb = (F.sequence(F.lit(0), F.lit(n - 1)) for n in (row_blocks, query_blocks))

    def row_side(nodes: int):
        return dealt(classes.drop("ids"), all_qb, "rb", row_blocks, "qb", nodes)

    def query_side(df: DataFrame, nodes: int):
        return dealt(df, all_rb, "qb", query_blocks, "rb", nodes)

    def resolve(pairs: DataFrame) -> DataFrame:
        """Scores of (query_id, class): a block of rows is told which of them each query wants."""
        wanted = pairs.groupBy("query_id", block("rb", row_blocks, "class")).agg(F.collect_list("class").alias("wanted"))
        asked = ask.join(wanted, F.col("id") == F.col("query_id")).select("id", "v", "rb", "wanted")
        return row_side(1).cogroup(dealt(asked, None, "qb", query_blocks, "rb", 1)).applyInArrow(
            _lookups, "query_id bigint, class bigint, score bigint")

    def members(scored: DataFrame) -> DataFrame:
        """Rows instead of classes, without the query's own, with their place."""
        of = scored.join(classes.select(F.col("id").alias("_c"), "ids"), F.col("class") == F.col("_c"))
        out = of.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return out.withColumn("rank", place).where(F.col("rank") <= k)

    lists = row_side(nodes).cogroup(query_side(ask, nodes)).applyInArrow(
        lambda r, q: _lists(r, q, k), ENTRIES)
    listed = F.row_number().over(W.partitionBy("query_id", "node").orderBy(F.col("score").desc(), "class"))
    lists = lists.withColumn("n", listed).where(F.col("n") <= k).select("query_id", "class").distinct()
    cutoffs = members(resolve(lists)).where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("cutoff"))
    cutoffs = stored(cutoffs, "topk-cutoffs")

    told = ask.join(cutoffs, F.col("id") == F.col("_q"), "left").select("id", "v", "cutoff")
    shares = row_side(nodes).cogroup(query_side(told, nodes)).applyInArrow(
        lambda r, q: _shares(r, q, nodes), ENTRIES)
    sums = (shares.groupBy("query_id", "class").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))
            .join(cutoffs, F.col("query_id") == F.col("_q"), "left"))
    known, cutoff = F.col("score").cast("decimal(25,0)"), F.col("cutoff").cast("decimal(25,0)")
    reachable = F.col("cutoff").isNull() | (known * nodes + (nodes - F.col("n")) * cutoff >= cutoff * nodes)
    sums = stored(sums.where(reachable).select("query_id", "class", "score", "n"), "topk-sums")
    complete = sums.where(F.col("n") == nodes).select("query_id", "class", "score")
    rest = resolve(sums.where(F.col("n") < nodes).select("query_id", "class"))
    return members(complete.unionAll(rest)).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
