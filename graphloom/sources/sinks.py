"""Where results go."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame


def write_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object per row; null columns are written too."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)


def iterate(df: DataFrame) -> Iterator[dict]:
    """Rows one by one, a partition at a time in the driver."""
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield row.asDict(recursive=True)


def json_body(df: DataFrame, limit: int) -> str:
    """{"columns", "rows"} of at most `limit` rows."""
    return json.dumps({"columns": df.columns, "rows": [list(r.asDict(recursive=True).values()) for r in df.limit(limit).collect()]})
