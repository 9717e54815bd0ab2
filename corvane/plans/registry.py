"""Named queries over the tables and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType

from ..sources.tables import Tables

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: The views of sources.tables in SQL.
VIEWS = {
    "spectra": "select o_orderkey as rid, o_totalprice as mz, o_orderstatus = 'F' as positive, o_orderpriority as lib, o_custkey as key from orders",
    "peaks": "select l_orderkey as rid, l_partkey % 200 as bin, sqrt(l_quantity) as w from lineitem",
    "signal": "select user_id as series, event_id, floor(epoch(ts))::bigint as sec, value, event_type = 'error' as reset, event_type from events",
    "scores": "select user_id as file, (floor(epoch(ts))::bigint // 3600)::bigint as start, event_type as class, round(avg(value), 9) as score from events group by all",
    "fps": "select vec_id as key, label, list_sum(list_transform(range(1, 61), lambda i: case when embedding[i] > 0 then (1::bigint << (60 - i)::int) else 0 end))::bigint as fp from embeddings",
    "asked": "select o_orderkey as rid, o_totalprice as mz, o_custkey as key from orders where o_orderkey % 50 = 0",
}


def settled(df: DataFrame, digits: int = 6) -> DataFrame:
    """Small integers as longs, real numbers as doubles rounded to the digits that both engines agree on."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ByteType, ShortType, IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (FloatType, DoubleType)):
            c = F.round(c.cast("double"), digits)
        out.append(c.alias(f.name))
    return df.select(*out)


def plan(name: str, sql: str | None = None, views: str = ""):
    """Registers a function of Tables as a query; views names the views that its SQL starts from."""

    def register(make: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, path: settled(make(Tables(spark, path)))
        if sql:
            parts = [f"{v} as ({VIEWS[v]})" for v in views.split()]
            body = sql.strip()
            if parts and body.lower().startswith("with "):
                body = body[5:]
                SQL[name] = f"with {', '.join(parts)}, {body}"
            else:
                SQL[name] = (f"with {', '.join(parts)} " if parts else "") + body
        return make

    return register
