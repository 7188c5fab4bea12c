"""Embedding near-dedup by E8 lattice hashing.

Each table projects the vectors at random onto two times eight dimensions and
takes the nearest points of the E8 lattice there as a cell. A vector stands in
its home cell and probes the cells next nearest to it. Cells in which some
vector is at home and another one meets it are verified by cosine, and the
links found join vectors into components. All links inside a component are
then counted by cosine, block by block. Neither step emits a group's pairs:
cells give spanning edges, components give counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import mix64, stored
from basketry.llm.components import block_rows, components, in_blocks
from basketry.llm.e8 import nearest, neighbours
from basketry.llm.topk import matrix, usable

#: with these, 99.6 percent of pairs with cosine 0.95 meet in a cell (64 dimensions, simulated)
TABLES, WIDTH, PROBES = 10, 1.7, 2
#: vectors of a block
BLOCK = 2048
#: rows of a task, on average, copies for other blocks included
TASK_ROWS = 100_000
#: cells up to this size are verified pair by pair
SMALL = 8


def projection(dims: int, table: int, width: float) -> np.ndarray:
    """dims x 16 normal numbers; the same for a table wherever it is asked for."""
    return np.random.default_rng([dims, table]).normal(size=(dims, 16)) / width


def cells(unit: np.ndarray, table: int, width: float, probes: int) -> np.ndarray:
    """Cell numbers of each vector: the home cell, then ``probes`` neighbours for either half."""
    y = unit @ projection(unit.shape[1], table, width)
    halves = [y[:, :8], y[:, 8:]]
    home = [nearest(h) for h in halves]

    def number(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), table + 1, dtype=np.uint64)
        for column in np.rint(2 * np.concatenate((a, b), axis=1)).astype(np.int64).T:
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + column.view(np.uint64))
        return out.view(np.int64)

    out = [number(*home)]
    for half in (0, 1):
        offsets, _ = neighbours(halves[half], home[half], probes)
        for k in range(probes):
            moved = list(home)
            moved[half] = home[half] + offsets[:, k]
            out.append(number(*moved))
    return np.stack(out, axis=1)


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    v = matrix(column)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # lengths of huge or tiny components stay in range
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def forest_edges(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric matrix links, one fewer than the nodes of each component."""
    n = len(linked)
    fresh = np.ones(n, dtype=bool)
    out = []
    for root in range(n):
        if not fresh[root]:
            continue
        fresh[root] = False
        queue = [root]
        while queue:
            u = queue.pop()
            found = np.flatnonzero(linked[u] & fresh)
            fresh[found] = False
            out += [(u, int(v)) for v in found]
            queue += found.tolist()
    return out


def grouped_rows(table: pa.Table, key: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row order, bounds) of the groups with equal keys."""
    columns = [table.column(c).to_numpy() for c in key]
    by = np.lexsort(columns[::-1])
    new = np.ones(len(by) + 1, dtype=bool)
    new[1:-1] = np.any([c[by][1:] != c[by][:-1] for c in columns], axis=0)
    return by, np.flatnonzero(new)


def _edges(table: pa.Table, least: float) -> pa.Table:
    """(a, b): spanning edges of the vectors of each cell (or pair of its blocks) whose cosine is at least ``least``."""
    by, bounds = grouped_rows(table, ["dim", "cell", "lo", "hi"])
    ids, left = table.column("id").to_numpy()[by], table.column("left").to_numpy(zero_copy_only=False)[by]
    out: list[np.ndarray] = [np.empty((0, 2), np.int64)]
    dims = table.column("dim").to_numpy()[by]
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        v = _unit(table.column("v").take(pa.array(by[rows])))
        base = rows[0]
        mine = bounds[(bounds >= base) & (bounds <= rows[-1] + 1)] - base
        size = np.diff(mine)
        group = np.repeat(np.arange(len(size)), size)
        small = np.flatnonzero(size[group] <= SMALL)
        for d in range(1, SMALL):
            i = small[small + d < len(v)]
            i = i[(group[i] == group[i + d])]
            i = i[ids[base + i] != ids[base + i + d]]
            good = np.einsum("ij,ij->i", v[i], v[i + d]) >= least
            out.append(np.stack((ids[base + i[good]], ids[base + i[good] + d]), axis=1))
        for g in np.flatnonzero(size > SMALL):
            a, b = mine[g], mine[g + 1]
            own, own_ids, own_left = v[a:b], ids[base + a: base + b], left[base + a: base + b]
            linked = own @ own.T >= least
            if not own_left.all():  # two blocks: each is verified in itself elsewhere
                linked &= own_left[:, None] != own_left[None, :]
            found = forest_edges(linked)
            out.append(own_ids[np.array(found, dtype=np.int64).reshape(-1, 2)])
    pairs = np.concatenate(out)
    return pa.table({"a": pa.array(pairs.min(axis=1) if len(pairs) else pairs[:, 0]),
                     "b": pa.array(pairs.max(axis=1) if len(pairs) else pairs[:, 0])})


def _counts(table: pa.Table, least: float) -> pa.Table:
    """(id, n): links of each vector in its component (or pair of its blocks), as many as the other has copies."""
    by, bounds = grouped_rows(table, ["component", "lo", "hi"])
    ids, copies = table.column("id").to_numpy()[by], table.column("copies").to_numpy()[by]
    left = table.column("left").to_numpy(zero_copy_only=False)[by]
    v = _unit(table.column("v").take(pa.array(by)))  # a component has one length of vectors; a task may have several
    n = np.zeros(len(by), dtype=np.int64)
    for a, b in zip(bounds[:-1], bounds[1:]):
        linked = v[a:b] @ v[a:b].T >= least
        np.fill_diagonal(linked, False)
        if not left[a:b].all():
            linked &= left[a:b][:, None] != left[a:b][None, :]
        n[a:b] = linked @ copies[a:b]
    return pa.table({"id": pa.array(ids), "n": pa.array(n)})


def near_vectors(vectors: DataFrame, *, least: float = 0.95, tables: int = TABLES, width: float = WIDTH,
                 probes: int = PROBES, block: int = BLOCK, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per id.

    Vectors whose cosine (in doubles) is at least ``least`` are linked if the
    lattice finds them, or if they are in one component; pairs below it never.
    ``n_links``: other vectors linked directly. ``component_id``: the smallest
    id that links reach. ``kept``: whether that is the row's own id.

    Vectors that are null, zero or empty, or hold null or non-finite
    components, link with nothing, and vectors of different lengths do not
    link. Equal vectors are linked, are one to the lattice, and count each. Of
    several rows with one id the least vector counts; rows without id are left
    out. An empty table gives no rows. Other columns are not read.
    """
    rows = (vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where("id is not null").groupBy("id").agg(F.min("v").alias("v")))
    good = usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumns({"good": good, "x": F.xxhash64("v"), "y": F.xxhash64(F.lit(1), "v")})
    rows = stored(rows, "vectors")
    copies = stored(rows.where("good").groupBy("x", "y").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")),
                    "vector-copies")
    single = copies.select(F.col("rep").alias("id"), "copies").join(rows.select("id", "v"), "id")
    single = stored(single.withColumn("dim", F.size("v")), "distinct-vectors")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = pa.Table.from_batches([batch]).filter(pa.array(dims == dim))
                unit, ids = _unit(own.column("v")), own.column("id").to_numpy()
                for table in range(tables):
                    found = cells(unit, table, width, probes)
                    home = np.zeros(found.shape, dtype=bool)
                    home[:, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.ravel()), pa.array(np.repeat(ids, found.shape[1])), pa.array(home.ravel())],
                        names=["cell", "id", "home"])

    spots = stored(single.select("id", "v", "dim").mapInArrow(placed, "cell bigint, id bigint, home boolean"), "cells")
    busy = stored(spots.groupBy(F.col("cell").alias("_cell")).agg(
        F.count(F.lit(1)).alias("members"), F.count_if("home").alias("homes")).where("members > 1 and homes > 0"),
        "busy-cells")
    met = spots.join(busy, F.col("cell") == F.col("_cell")).select("cell", "id", "members")
    met = stored(met, "met")
    tasks = max(1, -(-block_rows(busy, "members", block) // TASK_ROWS))
    met = in_blocks(met.join(single.select("id", "v", "dim"), "id"), "cell", "members", "id", block)
    met = met.withColumn("task", F.pmod(F.xxhash64("cell", "lo", "hi"), F.lit(tasks)))
    edges = met.groupBy("task").applyInArrow(lambda t: _edges(t, least), "a bigint, b bigint")
    groups = stored(components(edges), "vector-components")

    sizes = stored(groups.groupBy(F.col("component").alias("_c")).agg(F.count(F.lit(1)).alias("members")), "sizes")
    count_tasks = max(1, -(-block_rows(sizes, "members", block) // TASK_ROWS))
    within = groups.join(sizes, F.col("component") == F.col("_c")).select("id", "component", "members")
    within = in_blocks(within.join(single, "id"), "component", "members", "id", block)
    within = within.withColumn("task", F.pmod(F.xxhash64("component", "lo", "hi"), F.lit(count_tasks)))
    counts = (within.groupBy("dim", "task").applyInArrow(lambda t: _counts(t, least), "id bigint, n bigint")
              .groupBy("id").agg(F.sum("n").alias("n")))
    reps = (copies.select("x", "y", "rep", "copies")
            .join(counts.withColumnRenamed("id", "_id"), F.col("rep") == F.col("_id"), "left")
            .join(groups.withColumnRenamed("id", "_gid"), F.col("rep") == F.col("_gid"), "left")
            .select(F.col("x").alias("_x"), F.col("y").alias("_y"),
                    (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                    F.coalesce("component", "rep").alias("component_id")))
    reps = stored(reps, "vector-links")
    out = rows.select("id", "x", "y", "good").join(
        reps, F.col("good") & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id"),
                      (F.coalesce("component_id", "id") == F.col("id")).alias("kept"))
