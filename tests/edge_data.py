"""Hand-made shop tables with the awkward cases, for Spark and DuckDB alike.

users: a duplicate id, a NULL registration date, a user with no orders.
orders: NULL date, NULL amount, NULL user, an order before registration,
an unknown user, a category with a gap month, equal spend at tile edges,
a month whose revenue is 0, a user with only returned/cancelled orders.
events: no first step at all, an unknown type and a NULL type.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from basketry.plans.oracle import SHOP

D = dt.date

USERS = [
    (1, "AR", "free", D(2001, 1, 5)),
    (2, "AR", "basic", D(2001, 1, 20)),
    (3, "MX", "pro", D(2001, 2, 1)),
    (4, "MX", "free", None),
    (5, "CL", "free", D(2001, 3, 10)),
    (5, "CL", "free", D(2001, 3, 10)),
    (6, "AR", "pro", D(2001, 1, 31)),
    (7, "BR", "free", D(2001, 2, 15)),
    (8, "AR", "basic", D(2001, 4, 1)),
    (10, None, "pro", D(2001, 5, 1)),
]
USERS_SCHEMA = "user_id long, country string, plan string, registered_at date"

ORDERS = [
    (101, 1, D(2001, 1, 5), 100.00, "ropa", "completed"),
    (102, 1, D(2001, 2, 10), 50.50, "ropa", "completed"),
    (103, 1, D(2001, 4, 2), 20.00, "hogar", "completed"),
    (104, 2, D(2001, 1, 20), 150.50, "ropa", "completed"),
    (105, 2, D(2001, 3, 1), 20.00, "hogar", "completed"),
    (106, 3, D(2001, 1, 15), 80.00, "hogar", "completed"),
    (107, 3, D(2001, 2, 1), 90.50, "ropa", "completed"),
    (108, 4, None, 30.00, "ropa", "completed"),
    (109, 4, D(2001, 3, 5), None, "hogar", "completed"),
    (110, 5, D(2001, 3, 10), 0.00, "libros", "completed"),
    (111, 6, D(2001, 1, 31), 170.50, "ropa", "completed"),
    (112, 6, D(2001, 2, 1), 0.00, "libros", "returned"),
    (113, 7, D(2001, 2, 20), 60.00, "ropa", "returned"),
    (114, 7, D(2001, 2, 21), 70.00, "ropa", "cancelled"),
    (115, 9, D(2001, 5, 1), 10.00, "ropa", "completed"),
    (116, None, D(2001, 5, 2), 5.00, "ropa", "completed"),
    (117, 1, D(2001, 6, 30), 0.00, "libros", "completed"),
    (118, 2, D(2001, 7, 3), 0.00, "libros", "completed"),
    (119, 10, D(2001, 5, 1), 170.50, "ropa", "completed"),
    (120, 10, D(2001, 5, 9), 12.25, None, "completed"),
]
ORDERS_SCHEMA = ("order_id long, user_id long, order_date date, amount double, "
                 "category string, status string")

T = dt.datetime
EVENTS = [
    (1, 1, "click", T(2001, 1, 1, 10, 0)),
    (2, 2, "click", T(2001, 1, 1, 11, 0)),
    (3, 1, "signup", T(2001, 1, 1, 10, 3)),
    (4, 3, "purchase", T(2001, 1, 2, 9, 0)),
    (5, 2, "error", T(2001, 1, 2, 9, 30)),
    (6, 3, None, T(2001, 1, 3, 8, 0)),
    (7, 1, "purchase", T(2001, 1, 3, 12, 0)),
    (8, 4, "signup", T(2001, 1, 4, 12, 0)),
    (9, 5, "click", T(2001, 1, 5, 12, 0)),
    (10, 10, "click", T(2001, 1, 5, 13, 0)),
]
EVENTS_SCHEMA = "event_id long, user_id long, event_type string, event_date timestamp"

EDGE_SHOP = """
shop_orders AS (SELECT * FROM e_orders),
shop_users AS (SELECT * FROM e_users),
shop_events AS (SELECT * FROM e_events),
done AS (SELECT * FROM shop_orders WHERE status = 'completed')"""


class EdgeShop:
    """Same interface as ``catalog.Shop`` over in-memory tables."""

    def __init__(self, spark, users=USERS, orders=ORDERS, events=EVENTS):
        self.users = spark.createDataFrame(users, USERS_SCHEMA)
        code = F.col("status")
        self.orders = spark.createDataFrame(orders, ORDERS_SCHEMA).withColumn(
            "status_code", F.when(code == "completed", "F").when(code == "returned", "P")
            .when(code == "cancelled", "O"))
        self.events = spark.createDataFrame(events, EVENTS_SCHEMA)
        self._rows = (users, orders, events)

    @property
    def registered(self):
        return self.users.select("user_id", "registered_at")

    def completed(self):
        return self.orders.where(F.col("status_code") == "F")

    def duck(self):
        import duckdb

        con = duckdb.connect()
        users, orders, events = self._rows
        con.execute("CREATE TABLE e_users (user_id BIGINT, country VARCHAR, plan VARCHAR, registered_at DATE)")
        con.execute("CREATE TABLE e_orders (order_id BIGINT, user_id BIGINT, order_date DATE, amount DOUBLE, "
                    "category VARCHAR, status VARCHAR)")
        con.execute("CREATE TABLE e_events (event_id BIGINT, user_id BIGINT, event_type VARCHAR, "
                    "event_date TIMESTAMP)")
        for name, rows, width in (("e_users", users, 4), ("e_orders", orders, 6), ("e_events", events, 4)):
            if rows:
                con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * width)})", [list(r) for r in rows])
        return con

    @staticmethod
    def sql(oracle_sql: str) -> str:
        assert SHOP in oracle_sql
        return oracle_sql.replace(SHOP, EDGE_SHOP)
