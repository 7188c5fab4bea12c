"""Readers, adapters and the Parquet sink."""

import os
import tempfile

from pyspark.sql import functions as F

from basketry.sources import read_table, shop_events, shop_orders, shop_users, write_parquet

SF = "/root/testdata/sf0.001"


def test_adapters_shape(spark):
    raw = read_table(spark, SF, "orders")
    orders = shop_orders(raw)
    assert orders.columns == ["order_id", "user_id", "order_date", "amount", "category", "status", "status_code"]
    assert dict(orders.dtypes)["order_date"] == "date"
    statuses = {r.status for r in orders.select("status").distinct().collect()}
    assert statuses <= {"completed", "returned", "cancelled"}
    users = shop_users(read_table(spark, SF, "customer"), read_table(spark, SF, "nation"), raw)
    assert users.columns == ["user_id", "country", "plan", "registered_at"]
    assert users.count() == read_table(spark, SF, "customer").count()
    first = raw.groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("d"))
    joined = users.join(first, users.user_id == first.o_custkey)
    assert joined.where(F.col("registered_at") != F.col("d")).count() == 0
    events = shop_events(read_table(spark, SF, "events"))
    assert events.columns == ["event_id", "user_id", "event_type", "event_date"]


def test_write_parquet_round_trip(spark):
    from basketry.operators import revenue_breakdown

    out = os.path.join(tempfile.mkdtemp(prefix="basketry-out-"), "revenue")
    df = revenue_breakdown(shop_orders(read_table(spark, SF, "orders")), status_col="status_code", completed="F")
    write_parquet(df, out, partition_by=["category"])
    back = spark.read.parquet(out)
    assert back.count() == df.count()
    assert sorted(back.columns) == sorted(df.columns)


def test_sql_views_and_summary_dict(spark):
    from basketry.operators import executive_summary, summary_dict
    from basketry.sources import register_views

    raw = read_table(spark, SF, "orders")
    orders = shop_orders(raw)
    register_views(spark, {"shop_orders": orders})
    n_sql = spark.sql("SELECT COUNT(*) AS n FROM shop_orders WHERE status = 'completed'").first().n
    kpis = summary_dict(executive_summary(orders, status_col="status_code", completed="F",
                                          returned="P", cancelled="O"))
    assert kpis["completed_orders"] == n_sql
    assert set(kpis) == {"total_users", "completed_orders", "total_revenue", "avg_order_value",
                         "return_rate_pct", "cancel_rate_pct"}
