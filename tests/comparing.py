"""Compare a Spark result with a DuckDB result: columns, types and rows, in any order."""

from __future__ import annotations

import datetime
import decimal

_DUCK_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DATE": "date", "DOUBLE": "double",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "VARCHAR[]": "array<string>",
}


def _plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, (decimal.Decimal, datetime.date, datetime.datetime)):
        return str(value)
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def mismatch(df, con, sql: str) -> str | None:
    """A description of the first difference, or None."""
    found = con.execute(sql)
    duck_columns = [d[0] for d in found.description]
    duck_types = {d[0]: str(d[1]) for d in found.description}
    duck_rows = found.fetchall()
    if sorted(df.columns) != sorted(duck_columns):
        return f"columns {sorted(df.columns)} and {sorted(duck_columns)}"
    for name, spark_type in df.dtypes:
        duck_type = _DUCK_TYPES.get(duck_types[name], duck_types[name].lower())
        if spark_type.replace("timestamp_ntz", "timestamp") != duck_type:
            return f"type of {name}: {spark_type} and {duck_type}"
    rows = df.collect()
    if len(rows) != len(duck_rows):
        return f"{len(rows)} and {len(duck_rows)} rows"
    for ours, theirs in zip(_bag(df.columns, rows), _bag(duck_columns, duck_rows)):
        if ours != theirs:
            return f"{ours} and {theirs}"
    return None


def executions_since(spark, last: int | None = None) -> list:
    """What the session has run after the execution ``last``; by number, as the list forgets its oldest ones."""
    listed = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [e for e in map(listed.apply, range(listed.size())) if last is None or e.executionId() > last]


def last_execution(spark) -> int:
    return max((e.executionId() for e in executions_since(spark)), default=-1)
