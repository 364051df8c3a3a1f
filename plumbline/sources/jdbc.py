"""A database table or a read-only SELECT as a DataFrame; filters run at the source."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..errors import Refused

READ_ONLY = re.compile(r"^\s*(select|with)\b", re.I)
FORBIDDEN = re.compile(r";|\b(insert|update|delete|drop|alter|create|truncate|grant|copy)\b", re.I)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def checked_select(sql: str) -> str:
    if not READ_ONLY.match(sql) or FORBIDDEN.search(sql):
        raise Refused("NOT_READ_ONLY", "only a single SELECT may be sent to the source")
    return sql.strip()


def table_options(url: str, table: str, schema: str = "public", where: str | None = None,
                  limit: int | None = None, partition: tuple[str, int, int, int] | None = None,
                  fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options. ``partition`` is (column, low, high, tasks): that many ranges read at once."""
    name = f"{quoted(schema)}.{quoted(table)}"
    options = {"url": url, "fetchsize": str(fetch_size)}
    if where or limit is not None:
        if where and FORBIDDEN.search(where):
            raise Refused("NOT_READ_ONLY", where)
        sql = f"SELECT * FROM {name}" + (f" WHERE {where}" if where else "")
        sql += f" LIMIT {int(limit)}" if limit is not None else ""
        options["dbtable"] = f"({sql}) AS source"
    else:
        options["dbtable"] = name
    if partition:
        column, low, high, tasks = partition
        options.update(partitionColumn=column, lowerBound=str(low), upperBound=str(high),
                       numPartitions=str(tasks))
    return options


def load_table(spark: SparkSession, url: str, table: str, **kw) -> DataFrame:
    return spark.read.format("jdbc").options(**table_options(url, table, **kw)).load()


def query_source(spark: SparkSession, url: str, sql: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=checked_select(sql)).load()
