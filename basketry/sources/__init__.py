"""Input tables (Parquet), adapters to the shop model, and result sinks."""

from basketry.sources.adapters import (  # noqa: F401
    EVENT_STEPS,
    STATUS_BY_CODE,
    shop_events,
    shop_orders,
    shop_users,
)
from basketry.sources.tables import (  # noqa: F401
    TABLES,
    read_table,
    register_views,
    table_path,
    write_buckets,
    write_parquet,
)
