from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from courierflow.sources.binding import Tables, with_views


@dataclass(frozen=True)
class Query:
    key: str
    run: Callable[[Tables], DataFrame]
    sql: str | None = None


def query(key: str, run: Callable[[Tables], DataFrame], sql: str | None = None, **extra: str) -> Query:
    """A query whose oracle text gets the binding views it mentions."""
    return Query(key, run, with_views(sql, **extra) if sql else None)


def py_round_sql(x: str, digits: int) -> str:
    """SQL of Python's round for one or two digits, from the exact binary fraction."""
    scale = 10**digits
    units = f"(cast((abs({x}) - floor(abs({x}))) * 72057594037927936.0e0 as bigint) * {scale})"
    rest = f"({units} & 72057594037927935)"
    step = f"({units} >> 56)"
    up = (
        f"case when {rest} > 36028797018963968 or ({rest} = 36028797018963968 and {step} % 2 = 1) "
        "then 1 else 0 end"
    )
    return f"(sign({x}) * (floor(abs({x})) * {scale} + {step} + {up}) / {scale}.0e0)"
