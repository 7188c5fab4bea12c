"""Stored results: order, buckets, run folders, maps of any categories."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from basketry.operators.order import order_breaks, order_columns, stored_order
from basketry.operators.reshape import pivot_revenue_map
from basketry.plans.inspect import executed_plan
from basketry.session import run_folder, shared_path, stored, stored_together
from basketry.sources import write_buckets


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(5000).selectExpr(
        "id", "CASE WHEN id % 11 > 0 THEN (id * 7919) % 97 END AS a", "CASE WHEN id % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE id % 13 * 0.5D END AS b")


@pytest.mark.parametrize("order", [(("a", True),), (("a", False), ("b", True)), (("b", False), ("id", True))])
def test_sorted_results_have_no_breaks(rows, order):
    found = stored_order(rows.repartition(7).orderBy(*order_columns(order)), order).first()
    assert (found["rows"], found["breaks"]) == (5000, 0) and found["files"] >= 1


def test_breaks_are_found(spark, rows):
    order = (("a", True), ("id", False))
    assert stored_order(rows.repartition(3), order).first()["breaks"] > 1000
    path = shared_path(spark, "two-files")
    for part in ("id >= 10", "id < 10"):  # each file in order, but not the second behind the first
        spark.range(20).where(part).coalesce(1).sortWithinPartitions("id").write.mode("append").parquet(path)
    # part numbers are equal: the border is judged in one of the two orders of the files
    assert order_breaks(spark, path, (("id", False),)).first()["breaks"] <= 1
    one = spark.createDataFrame([(k, v) for k, v in enumerate([1, 2, None, 3, 2, 2, None, None])], "k int, v int").coalesce(1)
    assert tuple(stored_order(one.select("v"), (("v", False),)).first()) == (8, 1, 2)
    assert tuple(stored_order(one.select("v").limit(0), (("v", False),)).first())[::2] == (0, 0)


def test_bucketed_tables_join_without_exchange(spark):
    names = [f"b_{uuid.uuid4().hex}" for _ in range(2)]
    orders = spark.range(4000).selectExpr("id AS order_id", "id % 300 AS user_id", "id * 1.5D AS amount")
    users = spark.range(300).selectExpr("id AS user_id", "id % 7 AS country")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for name, df in zip(names, (orders, users)):
            write_buckets(df, name, "user_id", 4, path=shared_path(spark, name))
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = spark.table(names[0]).join(spark.table(names[1]), "user_id")
        per_user = joined.groupBy("user_id", "country").agg(F.sum("amount").alias("s"))
        got = {(r.user_id, r.country, r.s) for r in per_user.collect()}
        assert "Exchange" not in executed_plan(per_user)
        want = orders.join(users, "user_id").groupBy("user_id", "country").agg(F.sum("amount").alias("s"))
        assert got == {(r.user_id, r.country, r.s) for r in want.collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_run_folder_is_removed(spark):
    with run_folder(spark) as folder:
        kept = stored(spark.range(10).toDF("id"), "kept")
        assert kept.count() == 10 and all(folder in f for f in kept.inputFiles())
        assert os.listdir(folder)
    assert not os.path.exists(folder)
    assert not any("/run-" in f for f in stored(spark.range(3).toDF("id"), "later").inputFiles())
    with pytest.raises(ZeroDivisionError):
        with run_folder(spark) as folder:
            stored(spark.range(10).toDF("id"), "kept")
            1 / 0
    assert not os.path.exists(folder)


def test_tables_stored_together(spark):
    """Threads of one session leave its settings as they were, and store in the run folder that is open."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with run_folder(spark) as folder:
        frames = [(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().where(f"k <> {n}"), f"t{n}") for n in range(5)]
        tables = stored_together(frames)
        assert [t.count() for t in tables] == [6] * 5
        assert all(folder in f for t in tables for f in t.inputFiles())
    assert spark.conf.get(name) == before
    with pytest.raises(Exception, match="no"):
        stored_together([(spark.range(3).selectExpr("raise_error('no') AS x"), "bad"), (spark.range(3).toDF("id"), "good")])
    assert spark.conf.get(name) == before


def test_pivot_of_any_number_of_categories(spark):
    revenue = spark.range(3000).selectExpr(
        "make_date(2024, CAST(1 + id % 2 AS INT), 1) AS month", "CASE WHEN id % 1500 > 0 THEN 'c' || (id % 1500) END AS category",
        "CASE WHEN id > 5 THEN id * 1.0D END AS revenue")
    got = {r.month: r.revenue for r in pivot_revenue_map(revenue).collect()}
    want = {}
    for r in revenue.collect():
        cells = want.setdefault(r.month.strftime("%Y-%m"), {})
        c = "null" if r.category is None else r.category
        cells[c] = cells.get(c, 0.0) + (r.revenue or 0.0)
    assert got == want and len(got["2024-01"]) == 750
    with pytest.raises(Exception, match="called null"):
        pivot_revenue_map(revenue.unionByName(revenue.withColumn("category", F.lit("null")))).collect()
