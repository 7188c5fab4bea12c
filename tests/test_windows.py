"""Windows over sorted ranges must equal Spark's native windows row for row."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.operators.windows import Ordering, ntile, percent_rank, tile_columns, tile_ends, with_positions, with_windows


@pytest.fixture(scope="module")
def skewed(spark):
    # a third of the rows share one value and one partition key; nulls in both
    rnd = random.Random(3)
    rows = []
    for uid in range(900):
        v = rnd.choice([None, 1.0, 1.0, 1.0, 2.5, round(rnd.random() * 100, 2)])
        c = rnd.choice(["AR", "AR", "AR", "MX", None, "CL"])
        rows.append((uid, c, v))
    return spark.createDataFrame(rows, "uid long, country string, v double")


def _native(df, part, desc):
    vo = F.col("v").desc_nulls_last() if desc else F.col("v").asc_nulls_last()
    vr = F.col("v").asc_nulls_last() if desc else F.col("v").desc_nulls_last()
    w = Window.partitionBy(*part).orderBy(vo, "uid")
    wp = Window.partitionBy(*part).orderBy(vo)
    cols = [
        "uid",
        F.row_number().over(w).alias("pos"),
        F.count(F.lit(1)).over(Window.partitionBy(*part)).alias("n"),
        F.rank().over(wp).alias("rank"),
        F.rank().over(Window.partitionBy(*part).orderBy(vr)).alias("rank_rev"),
        F.lag("v").over(w).alias("lag"),
        F.lead("v").over(w).alias("lead"),
        F.first("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("first"),
        F.ntile(5).over(w).alias("nt5"),
        F.percent_rank().over(wp).alias("pr"),
    ]
    if not part:
        cols.append(F.sum(F.col("v").cast("decimal(28,2)")).over(
            w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))
    return df.select(*cols)


def _mine(df, part, desc, ranges):
    o = Ordering(order_by=(("v", desc),), tie_by=("uid",), partition_by=part)
    out = with_positions(df, o, "x_", value="v", running=not part, neighbours=True,
                         first_value=True, reverse_rank=True, ranges=ranges)
    cols = ["uid", F.col("x_pos").alias("pos"), F.col("x_n").alias("n"), F.col("x_rank").alias("rank"),
            F.col("x_rank_rev").alias("rank_rev"), F.col("x_lag").alias("lag"), F.col("x_lead").alias("lead"),
            F.col("x_first").alias("first"), ntile("x_pos", "x_n", 5).alias("nt5"),
            percent_rank("x_rank", "x_n").alias("pr")]
    if not part:
        cols.append(F.col("x_running").alias("running"))
    return out.select(*cols)


@pytest.mark.parametrize("part", [(), ("country",)])
@pytest.mark.parametrize("desc", [True, False])
@pytest.mark.parametrize("ranges", [1, 11, 90])
def test_matches_native(spark, skewed, part, desc, ranges):
    nat = {r.uid: tuple(r) for r in _native(skewed, part, desc).collect()}
    mine = {r.uid: tuple(r) for r in _mine(skewed, part, desc, ranges).collect()}
    assert len(mine) == len(nat)
    bad = [(u, nat[u], mine[u]) for u in nat if nat[u] != mine[u]]
    assert not bad, bad[:3]


def test_ntile_formula(spark):
    df = spark.range(1, 8).select(F.col("id").alias("pos"), F.lit(7).cast("long").alias("n"))
    assert [r[0] for r in df.select(ntile("pos", "n", 5)).orderBy("pos").collect()] == [1, 1, 2, 2, 3, 4, 5]
    df3 = spark.range(1, 4).select(F.col("id").alias("pos"), F.lit(3).cast("long").alias("n"))
    assert [r[0] for r in df3.select(ntile("pos", "n", 5)).collect()] == [1, 2, 3]
    one = spark.range(1).select(percent_rank(F.lit(1), F.lit(1)).alias("p"))
    assert one.first().p == 0.0


@pytest.mark.parametrize("ranges", [1, 7])
def test_two_order_columns_and_two_partitions(spark, ranges):
    rnd = random.Random(11)
    rows = [(uid, rnd.choice(["a", "b"]), rnd.choice([1, 2]), rnd.choice([None, 1, 2, 3]),
             rnd.choice([0.5, 1.5, None])) for uid in range(600)]
    df = spark.createDataFrame(rows, "uid long, p1 string, p2 int, k1 int, k2 double")
    o = Ordering((("k1", True), ("k2", False)), ("uid",), ("p1", "p2"))
    out = with_positions(df, o, "x_", value="k2", neighbours=True, first_value=True, ranges=ranges)
    mine = {r.uid: (r.x_pos, r.x_n, r.x_rank, r.x_rank_last, r.x_lag, r.x_lead, r.x_first)
            for r in out.collect()}
    order = [F.col("k1").desc_nulls_last(), F.col("k2").asc_nulls_last()]
    w = Window.partitionBy("p1", "p2").orderBy(*order, "uid")
    wp = Window.partitionBy("p1", "p2").orderBy(*order)
    nat = df.select(
        "uid", F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy("p1", "p2")),
        F.rank().over(wp), F.count(F.lit(1)).over(wp.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        F.lag("k2").over(w), F.lead("k2").over(w),
        F.first("k2").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    want = {r[0]: tuple(r[1:]) for r in nat.collect()}
    assert mine == want


def test_string_partition_values_with_quotes_and_accents(spark):
    rnd = random.Random(5)
    names = ["a'b", "c\\d", "electrónica", "x\"y", "plain", "日本"]
    rows = [(uid, rnd.choice(names), rnd.choice([1.0, 2.0, 3.0])) for uid in range(400)]
    df = spark.createDataFrame(rows, "uid long, cat string, v double")
    o = Ordering((("v", True),), ("uid",), ("cat",))
    out = with_positions(df, o, "x_", value="v", neighbours=True, ranges=9)
    mine = {r.uid: (r.x_pos, r.x_rank, r.x_lag, r.x_lead) for r in out.collect()}
    w = Window.partitionBy("cat").orderBy(F.col("v").desc(), "uid")
    nat = df.select("uid", F.row_number().over(w), F.rank().over(Window.partitionBy("cat").orderBy(F.col("v").desc())),
                    F.lag("v").over(w), F.lead("v").over(w))
    assert mine == {r[0]: tuple(r[1:]) for r in nat.collect()}


@pytest.mark.parametrize("desc", [True, False])
def test_nan_infinities_strings_and_zone_free_times(spark, desc):
    """NaN is above all numbers, strings sort either way, and a time without zone is not shifted by the session's."""
    rnd = random.Random(8)
    inf = float("inf")
    rows = [(uid, rnd.choice([None, float("nan"), inf, -inf, 0.0, -0.0, 1.5, -9e300]),
             rnd.choice([None, "", "a", "B", "é", "漢"]), rnd.choice([None, -(1 << 63), (1 << 63) - 1, 0]),
             f"2023-03-12 {rnd.choice(['01:59', '02:15', '02:45', '03:15', '03:45'])}:00") for uid in range(300)]
    df = spark.createDataFrame(rows, "uid long, v double, s string, l long, t string")
    df = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for c in ("v", "s", "l", "t"):
            o = Ordering(((c, desc),), ("uid",))
            got = {r.uid: (r.x_pos, r.x_rank) for r in with_positions(df, o, "x_", ranges=6).collect()}
            by = F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last()
            w = Window.orderBy(by, "uid")
            want = df.select("uid", F.row_number().over(w), F.rank().over(Window.orderBy(by)))
            assert got == {r[0]: (r[1], r[2]) for r in want.collect()}, c
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_empty_one_row_and_missing_column(spark, skewed):
    o = Ordering((("v", True),), ("uid",))
    assert with_positions(skewed.limit(0), o, "x_", value="v", running=True, neighbours=True).isEmpty()
    r = with_positions(skewed.where("uid = 3"), o, "x_", value="v", running=True, neighbours=True, first_value=True).first()
    assert (r.x_pos, r.x_n, r.x_rank, r.x_lag, r.x_lead) == (1, 1, 1, None, None)
    with pytest.raises(ValueError, match="missing column"):
        with_positions(skewed, Ordering((("nope", True),)), "x_")


def test_several_specifications_over_one_order(spark, skewed):
    order = ((("v", True),), ("uid",))
    specs = {"a_": (Ordering(*order), dict(value="v", running=True, reverse_rank=True)),
             "b_": (Ordering(*order, ("country",)), dict(value="v", neighbours=True))}
    out = with_windows(skewed, specs, ranges=7)
    assert out.columns == [*skewed.columns, "a_pos", "a_n", "a_rank", "a_rank_last", "a_rank_rev", "a_running",
                           "b_pos", "b_n", "b_rank", "b_rank_last", "b_lag", "b_lead"]
    got = {r.uid: (r.a_pos, r.a_rank, r.a_rank_rev, r.b_pos, r.b_rank, r.b_lag, r.b_lead) for r in out.collect()}
    v = F.col("v").desc_nulls_last()
    a, b = Window.orderBy(v, "uid"), Window.partitionBy("country").orderBy(v, "uid")
    want = skewed.select("uid", F.row_number().over(a), F.rank().over(Window.orderBy(v)),
                         F.rank().over(Window.orderBy(F.col("v").asc_nulls_last())), F.row_number().over(b),
                         F.rank().over(Window.partitionBy("country").orderBy(v)), F.lag("v").over(b), F.lead("v").over(b))
    assert got == {r[0]: tuple(r[1:]) for r in want.collect()}
    with pytest.raises(ValueError, match="agree"):
        with_windows(skewed, {"a_": specs["a_"], "c_": (Ordering((("v", False),), ("uid",)), {})})


@pytest.mark.parametrize("k, ranges", [(5, 1), (4, 6), (1, 3), (1200, 5)])
def test_tile_columns_match_native(spark, skewed, k, ranges):
    """Several orderings in one pass; tiles cut equal values, hold nulls, or are more than rows."""
    tiles = {"a": (Ordering((("v", True),), ("uid",)), k), "b": (Ordering((("v", False),), ("uid",)), k),
             "c": (Ordering((("country", False), ("v", True)), ("uid",)), k), "d": (Ordering((), ("uid",)), 3)}
    got = skewed.select("uid", *[c.alias(n) for n, c in tile_columns(skewed, tiles, ranges=ranges).items()])
    v, country = F.col("v"), F.col("country").asc_nulls_last()
    want = skewed.select("uid", F.ntile(k).over(Window.orderBy(v.desc_nulls_last(), "uid")),
                         F.ntile(k).over(Window.orderBy(v.asc_nulls_last(), "uid")),
                         F.ntile(k).over(Window.orderBy(country, v.desc_nulls_last(), "uid")),
                         F.ntile(3).over(Window.orderBy("uid")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("desc", [True, False])
def test_tile_columns_of_any_type(spark, desc):
    rnd = random.Random(8)
    inf = float("inf")
    rows = [(uid, rnd.choice([None, float("nan"), inf, -inf, 0.0, -0.0, 1.5, -9e300]),
             rnd.choice([None, "", "a'b", "B\\", "é", "漢"]), rnd.choice([None, -(1 << 63), (1 << 63) - 1, 0]),
             f"2023-03-12 {rnd.choice(['01:59', '02:15', '02:45', '03:15', '03:45'])}:00") for uid in range(100)]
    df = spark.createDataFrame(rows, "uid long, v double, s string, l long, t string")
    df = df.withColumns({"n": F.col("t").cast("timestamp_ntz"), "z": F.col("t").cast("timestamp"), "d": F.col("l").cast("decimal(20,0)"),
                         "day": F.date_add(F.lit("2023-01-01").cast("date"), F.pmod("l", F.lit(5)).cast("int")), "b": F.col("uid") % 3 == 0})
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        names = ("v", "s", "l", "n", "z", "d", "day", "b")
        tiles = {f"{c}_tile": (Ordering(((c, desc),), ("uid",)), 7) for c in names}
        got = df.select("uid", *[c.alias(n) for n, c in tile_columns(df, tiles, ranges=5).items()]).collect()
        by = {c: F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c in names}
        want = df.select("uid", *[F.ntile(7).over(Window.orderBy(by[c], "uid")) for c in names]).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_tile_ends():
    assert tile_ends(7, 5) == [2, 4, 5, 6] and tile_ends(3, 5) == [1, 2] and tile_ends(0, 5) == [] and tile_ends(8, 4) == [2, 4, 6]


def test_tiles_of_no_rows(spark, skewed):
    columns = tile_columns(skewed.limit(0), {"t": (Ordering((("v", True),), ("uid",)), 5)})
    assert skewed.limit(0).select(columns["t"]).isEmpty()
    with pytest.raises(ValueError, match="all rows"):
        tile_columns(skewed, {"t": (Ordering((("v", True),), ("uid",), ("country",)), 5)})
