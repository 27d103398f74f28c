"""Registered queries: one per operator, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

from courierflow.catalog.base import Query


def all_queries() -> list[Query]:
    from courierflow.catalog import (
        dispatch,
        features,
        kitchen,
        learning,
        lookups,
        quality,
        storage,
        streams,
    )

    modules = (quality, features, lookups, kitchen, learning, dispatch, storage, streams)
    return [query for module in modules for query in module.QUERIES]
