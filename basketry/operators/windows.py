"""Order-dependent window values (RANK, NTILE, PERCENT_RANK, running sums,
LAG/LEAD, FIRST_VALUE) without funnelling a whole ordering into one task.

A window with no PARTITION BY, or one whose partition holds a third of the
rows, makes Spark sort everything in a single task. Here Spark's range
partitioner deals the rows to ranges of the full sort key (order columns,
then tie columns), so one hot value spreads over many ranges. Two ways
lead on from there:

``with_windows``: ordinary windows number the rows inside each range, for
all window specifications over one ORDER BY at once, whatever their
PARTITION BY. The rows are stored with these numbers. What a range has of a
partition is one row of a summary table; windows over that table (the
neighbouring ranges' halo: counts before, the peers and values at the ends)
turn numbers inside the range into places over all rows, by a join and a
projection. The rows are sorted once and never sorted back.

``tile_columns``: NTILE needs only the last row of each tile. The rows of
several orderings are sorted together, as narrow (ordering, key, tie) rows;
the number of rows in each range says in which range a border lies, and
there the border row is looked up. A row's tile is the number of borders in
front of it, an expression over its own columns: no row is shuffled back.

The same plan runs at every size. Order is the range partitioner's, that is
Spark's own for ``ORDER BY ... NULLS LAST``: strings, dates and timestamps
in either direction, NaN above all numbers, zone-free timestamps as they
are. Ties are resolved by the caller's tie columns, so positions, running
sums and LAG/LEAD are the same under any partitioning.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.exprs import exact
from basketry.session import stored, stored_together

#: a row's place in ``tile_columns``: its range in the upper bits, its number in the range below
RANGE_BITS = 33


@dataclass(frozen=True)
class Ordering:
    """A window specification: PARTITION BY ``partition_by`` ORDER BY ``order_by``.

    ``order_by`` is a tuple of ``(column, descending)``; ``tie_by`` are the
    columns appended to make the order total (they must be unique together
    with the partition columns). NULLs sort last in both directions.
    """

    order_by: tuple[tuple[str, bool], ...]
    tie_by: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()

    def order_columns(self) -> list[Column]:
        return [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in self.order_by]

    def sort_columns(self) -> list[Column]:
        """The order that all specifications over one ORDER BY share: no partition columns."""
        return [*self.order_columns(), *[F.col(c).asc_nulls_last() for c in self.tie_by]]

    def check(self, df: DataFrame) -> None:
        for c in [*self.partition_by, *[c for c, _ in self.order_by], *self.tie_by]:
            if c not in df.columns:
                raise ValueError(f"window ordering: missing column {c!r}; have {df.columns}")
        if not self.sort_columns():
            raise ValueError("window ordering: no columns to order by")


def _partitions(df: DataFrame, ranges: int | None) -> int:
    return ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------- windows over one order


@dataclass(frozen=True)
class _Spec:
    prefix: str
    o: Ordering
    value: str | None = None
    running: bool = False
    neighbours: bool = False
    first_value: bool = False
    reverse_rank: bool = False

    def name(self, what: str) -> str:
        return f"_{what}_{self.prefix}"

    def in_range(self) -> dict[str, Column]:
        """What a row is told inside its range, before anything is known of other ranges."""
        part = [F.col("_range"), *[F.col(c) for c in self.o.partition_by]]
        rows = Window.partitionBy(*part).orderBy(*self.o.sort_columns())
        peers = Window.partitionBy(*part).orderBy(*self.o.order_columns()) if self.o.order_by else None
        same = Window.partitionBy(*part, *[F.col(c) for c, _ in self.o.order_by])
        out = {"rn": F.row_number().over(rows),
               "rank": F.rank().over(peers) if peers is not None else F.lit(1),
               "peers": F.count(F.lit(1)).over(same)}
        if self.neighbours:
            out |= {"lag": F.lag(self.value).over(rows), "lead": F.lead(self.value).over(rows)}
        if self.running:
            out["sum"] = F.sum(exact(self.value)).over(rows.rowsBetween(Window.unboundedPreceding, 0))
        return {self.name(k): c.cast("long") if k in ("rn", "rank", "peers") else c for k, c in out.items()}

    def summary(self, rows: DataFrame) -> DataFrame:
        """A row per range and partition: what rows of the range need to know of the other ranges."""
        o = self.o
        key = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, (c, _) in enumerate(o.order_by)])
        rn, rank, peers = (F.col(self.name(x)) for x in ("rn", "rank", "peers"))
        found = [F.count(F.lit(1)).alias("n"),
                 F.min_by(F.struct(key.alias("key"), peers.alias("head")), rn).alias("first"),
                 F.max_by(F.struct(key.alias("key"), rank.alias("tail")), rn).alias("last")]
        if o.order_by:
            found.append(F.count(o.order_by[0][0]).alias("known"))
        if self.value is not None:
            v = F.struct(F.col(self.value).alias("v"))
            found += [F.min_by(v, rn).alias("v_first"), F.max_by(v, rn).alias("v_last")]
        if self.running:
            found.append(F.sum(exact(self.value)).alias("s"))
        names = [f"_p{i}" for i in range(len(o.partition_by))]
        table = rows.groupBy(F.col("_range").alias("_r"), *[F.col(c).alias(p) for c, p in zip(o.partition_by, names)]).agg(*found)

        in_order = Window.partitionBy(*names).orderBy("_r")
        before = in_order.rowsBetween(Window.unboundedPreceding, -1)
        up_to = in_order.rowsBetween(Window.unboundedPreceding, 0)
        onward = Window.partitionBy(*names).orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*names)
        one = F.col("first.key").eqNullSafe(F.col("last.key"))
        goes_on = F.coalesce(F.lag("last").over(in_order)["key"].eqNullSafe(F.col("first.key")), F.lit(False))
        comes_on = F.coalesce(F.lead("first").over(in_order)["key"].eqNullSafe(F.col("last.key")), F.lit(False))
        table = table.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(whole),
                                   "on": goes_on, "next": comes_on, "one": one})
        # of the peers that a range ends with, the first place; of those that it begins with, the last:
        # a range that is all peers of its neighbour leaves it as it was
        starts = F.last(F.when(~(F.col("on") & F.col("one")), F.col("before") + F.col("last.tail")), ignorenulls=True).over(up_to)
        ends = F.last(F.when(~(F.col("next") & F.col("one")), F.col("before") + F.col("first.head")), ignorenulls=True).over(onward)
        table = table.withColumns({"start": starts, "end": ends})
        out = {"before": F.col("before"), "total": F.col("total"), "size": F.col("n"),
               "first_start": F.when(F.col("on"), F.lag("start").over(in_order)).otherwise(F.col("before") + 1),
               "last_end": F.when(F.col("next"), F.lead("end").over(in_order)).otherwise(F.col("before") + F.col("n")),
               "tail": F.col("last.tail")}
        if self.reverse_rank and o.order_by:
            out["known"] = F.sum("known").over(whole)
        if self.neighbours:
            out |= {"v_before": F.lag("v_last").over(in_order)["v"], "v_behind": F.lead("v_first").over(in_order)["v"]}
        if self.first_value:
            out["v_first"] = F.first("v_first").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["v"]
        if self.running:
            out["carry"] = F.sum("s").over(before)
        return table.select("_r", *names, *[c.alias(self.name(f"t_{k}")) for k, c in out.items()])

    def joined(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        on = F.col("_range") == F.col("_r")
        for i, c in enumerate(self.o.partition_by):
            on = on & F.col(c).eqNullSafe(F.col(f"_p{i}"))
        return rows.join(table, on).drop("_r", *[f"_p{i}" for i in range(len(self.o.partition_by))])

    def values(self) -> dict[str, Column]:
        rn, rank, peers = (F.col(self.name(x)) for x in ("rn", "rank", "peers"))
        t = {k: F.col(self.name(f"t_{k}")) for k in ("before", "total", "size", "first_start", "last_end", "tail")}
        start = F.when(rank == 1, t["first_start"]).otherwise(t["before"] + rank)
        end = F.when(rank == t["tail"], t["last_end"]).otherwise(t["before"] + rank + peers - 1)
        out = {"pos": t["before"] + rn, "n": t["total"], "rank": start, "rank_last": end}
        if self.reverse_rank:
            is_null = F.col(self.o.order_by[0][0]).isNull()
            out["rank_rev"] = F.when(is_null, start).otherwise(F.col(self.name("t_known")) - end + 1)
        if self.neighbours:
            out["lag"] = F.when(rn == 1, F.col(self.name("t_v_before"))).otherwise(F.col(self.name("lag")))
            out["lead"] = F.when(rn == t["size"], F.col(self.name("t_v_behind"))).otherwise(F.col(self.name("lead")))
        if self.first_value:
            out["first"] = F.col(self.name("t_v_first"))
        if self.running:
            own, carry = F.col(self.name("sum")), F.col(self.name("t_carry"))
            out["running"] = F.when(own.isNull() & carry.isNull(), F.lit(None)).otherwise(
                F.coalesce(own, exact(F.lit(0))) + F.coalesce(carry, exact(F.lit(0))))
        return {f"{self.prefix}{k}": c for k, c in out.items()}


def with_windows(df: DataFrame, specs: Mapping[str, tuple[Ordering, Mapping]], *, ranges: int | None = None) -> DataFrame:
    """``df`` with the window values of several specifications over one ORDER BY, each name with its prefix.

    The orderings differ in ``partition_by`` alone. Of each: ``pos``
    (ROW_NUMBER), ``n`` (rows of the partition), ``rank`` (RANK),
    ``rank_last`` (rows up to the last peer); with ``reverse_rank``
    ``rank_rev`` (RANK in the opposite direction, NULLs still last); for
    ``value``: ``running`` (exact running SUM), ``lag`` and ``lead`` (with
    ``neighbours``), ``first`` (FIRST_VALUE, with ``first_value``).
    """
    made = [_Spec(prefix, o, **options) for prefix, (o, options) in specs.items()]
    for s in made:
        s.o.check(df)
        if (s.running or s.neighbours or s.first_value) and s.value is None:
            raise ValueError("running, neighbours and first_value need a value column")
        if (s.o.order_by, s.o.tie_by) != (made[0].o.order_by, made[0].o.tie_by):
            raise ValueError("with_windows: the orderings must agree in order_by and tie_by")
    n = _partitions(df, ranges)
    # stored: the range partitioner reads its input twice, to find the ranges and to deal the rows
    dealt = stored(df, "window-rows").repartitionByRange(n, *made[0].o.sort_columns())
    dealt = dealt.withColumn("_range", F.spark_partition_id()).repartitionById(n, "_range")
    rows = dealt.select("*", *[c.alias(k) for s in made for k, c in s.in_range().items()])
    rows = stored(rows, "range-windows")
    # a row per range and partition: as many as ranges, or partitions in ranges, but never more than rows.
    # Stored, so that Spark knows their size when it chooses how to join them
    tables = stored_together([(s.summary(rows), "range-summary") for s in made])
    out = rows
    for s, table in zip(made, tables):
        out = s.joined(out, table)
    return out.select(*df.columns, *[c.alias(k) for s in made for k, c in s.values().items()])


def with_positions(df: DataFrame, o: Ordering, prefix: str, *, ranges: int | None = None, **options) -> DataFrame:
    """``with_windows`` for one ordering."""
    return with_windows(df, {prefix: (o, options)}, ranges=ranges)


def ntile(pos: str | Column, n: str | Column, k: int) -> Column:
    """NTILE(k) from the position and the row count: the first n mod k tiles
    hold one row more."""
    p = (F.col(pos) if isinstance(pos, str) else pos).cast("long")
    rows = (F.col(n) if isinstance(n, str) else n).cast("long")
    size, extra = F.floor(rows / k), rows % k
    head = extra * (size + 1)
    in_head = F.floor((p - 1) / (size + 1)) + 1
    behind = F.floor(F.try_divide(p - 1 - head, size)) + extra + 1
    return F.when(p <= head, in_head).otherwise(behind).cast("int")


def percent_rank(rank: str | Column, n: str | Column) -> Column:
    """(rank - 1) / (n - 1), and 0 for a partition of one row."""
    r = (F.col(rank) if isinstance(rank, str) else rank).cast("double")
    rows = (F.col(n) if isinstance(n, str) else n).cast("double")
    return F.when(rows <= 1, F.lit(0.0)).otherwise((r - 1) / (rows - 1))


# ------------------------------------------------------------------ tile borders


def tile_ends(n: int, k: int) -> list[int]:
    """Positions of the last rows of the tiles of NTILE(k) over n rows, but for the last tile."""
    size, extra = divmod(n, k)
    ends = [t * size + min(t, extra) for t in range(1, k)]
    return [e for t, e in enumerate(ends, start=1) if t < n]


def _literal(value, dtype: str) -> Column:
    if isinstance(value, _dt.datetime) and dtype == "timestamp_ntz":
        return F.lit(value.isoformat(sep=" ")).cast(dtype)
    return F.lit(value).cast(dtype)


def _behind(columns: Iterable[tuple[Column, bool, Column, bool]]) -> Column:
    """Whether a row comes after a border row: (column, descending, border's value, whether that is null) by importance."""
    out = F.lit(False)
    for c, descending, border, is_null in reversed(list(columns)):
        after = F.lit(False) if is_null else c.isNull() | F.coalesce(c < border if descending else c > border, F.lit(False))
        out = after | (c.eqNullSafe(border) & out)
    return out


def tile_columns(df: DataFrame, tiles: Mapping[str, tuple[Ordering, int]], *, ranges: int | None = None) -> dict[str, Column]:
    """NTILE values over all rows of ``df``, a column expression over its rows for each name.

    ``tiles``: name -> (ordering without partition columns, number of tiles).
    The orderings are sorted in one pass over narrow rows. ``df`` should be
    a stored table, as it is read twice here and again where the columns are used.
    """
    dtypes = dict(df.dtypes)
    keys: list[list[tuple[str, bool]]] = []
    for o, _ in tiles.values():
        o.check(df)
        if o.partition_by:
            raise ValueError("tile_columns: orderings over all rows only")
        keys.append([*o.order_by, *[(c, False) for c in o.tie_by]])
    # one sort column for each column and direction that an ordering has at its place; null for the others
    places: dict[tuple[int, str, bool], str] = {}
    for columns in keys:
        for place, (c, d) in enumerate(columns):
            places.setdefault((place, dtypes[c], d), f"k{len(places)}")
    by = [F.col("o"), *[F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_last()
                        for (_, _, d), k in sorted(places.items(), key=lambda x: x[0][0])]]
    rows = []
    for number, columns in enumerate(keys):
        at = {places[place, dtypes[c], d]: F.col(c) for place, (c, d) in enumerate(columns)}
        rows.append(F.struct(F.lit(number).alias("o"), *[at.get(k, F.lit(None)).cast(t).alias(k)
                                                        for (_, t, _), k in places.items()]))
    narrow = df.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    placed = (narrow.repartitionByRange(_partitions(df, ranges), *by).sortWithinPartitions(*by)
              .withColumn("p", F.monotonically_increasing_id()))
    placed = stored(placed.withColumn("r", F.shiftright("p", RANGE_BITS)), "tile-orders")
    # a row per ordering and range
    counted = placed.groupBy("o", "r").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first")).collect()
    counted.sort(key=lambda c: (c["o"], c["r"]))
    wanted: dict[int, tuple[int, int]] = {}  # place of a border -> (ordering, its number)
    for number, (_, k) in enumerate(tiles.values()):
        own = [c for c in counted if c["o"] == number]
        seen, ends = 0, tile_ends(sum(c["n"] for c in own), k)
        for c in own:
            for t, end in enumerate(ends):
                if seen < end <= seen + c["n"]:
                    wanted[c["first"] + end - seen - 1] = (number, t)
            seen += c["n"]
    borders = {}
    if wanted:
        for b in placed.where(F.col("p").isin(list(wanted))).collect():  # a row per border
            borders[wanted[b["p"]]] = b
    out = {}
    for number, (name, columns) in enumerate(zip(tiles, keys)):
        tile = F.lit(1)
        for (of, _), b in sorted(borders.items()):
            if of == number:
                values = [b[places[place, dtypes[c], d]] for place, (c, d) in enumerate(columns)]
                after = _behind([(F.col(c), d, _literal(v, dtypes[c]), v is None) for (c, d), v in zip(columns, values)])
                tile = tile + after.cast("int")
        out[name] = tile
    return out
