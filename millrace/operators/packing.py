"""Byte-budgeted packing: a scope's rows stream through a task in order.

Rows are dealt to tasks by scope and sorted there, so a task holds a batch of
rows and the running state of one scope: sizes, and names of what was packed or
is stuck, which the budget bounds or which are groups of the scope.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENVELOPE = 256


def streamed(rows: DataFrame, scope: list[str], order: list[str], columns: list[str], fold: Callable, schema: str) -> DataFrame:
    """``fold(scope values, rows of the scope)`` over sorted rows of every scope; it takes an iterator of tuples of ``columns`` and gives tuples."""
    ordered = rows.select(*dict.fromkeys([*scope, *order, *columns])).repartition(*scope).sortWithinPartitions(*scope, *order)
    names = [part.split()[0].strip("`") for part in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                own, values = batch[scope].itertuples(index=False, name=None), batch[columns].itertuples(index=False, name=None)
                yield from zip(own, values, strict=True)

        rest, pending = each(), []
        out: list[tuple] = []

        def of(key: tuple) -> Iterator[tuple]:
            while pending and pending[0][0] == key:
                yield pending.pop()[1]
                if (row := next(rest, None)) is not None:
                    pending.append(row)

        if (first := next(rest, None)) is not None:
            pending.append(first)
        while pending:
            key = pending[0][0]
            group = of(key)
            for row in fold(group):
                out.append((*key, *row))
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            for _ in group:  # what the fold has left
                pass
        yield pd.DataFrame(out, columns=names)

    return ordered.mapInPandas(work, schema)


def _kinds(rows: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)


def in_turns(rows: DataFrame, scope: list[str], group: str, order: str) -> DataFrame:
    """Adds ``_turn``: the place of a row within its group."""
    return rows.withColumn("_turn", F.row_number().over(Window.partitionBy(*scope, group).orderBy(order)))


def pack_round_robin(rows: DataFrame, scope: list[str], group: str, order: str, cost: str, limit: int, item: str) -> DataFrame:
    """One item of each group a round; an item that does not fit is skipped for good, an id counts once.

    Returns scope, the packed ids in order, their size and how many were deferred.
    """

    def fold(items: Iterator[tuple]) -> Iterator[tuple]:
        ids, known, size, deferred = [], set(), 0, 0
        for name, price in items:
            name = str(name)
            if name in known:
                continue
            if size + price <= limit:
                ids.append(name)
                known.add(name)
                size += price
            else:
                deferred += 1
        yield ids, size, deferred

    turns = in_turns(rows, scope, group, order)
    return streamed(turns, scope, ["_turn", group], [item, cost], fold, f"{_kinds(rows, *scope)}, ids array<string>, size bigint, deferred int")


def ration(rows: DataFrame, scope: list[str], group: str, order: str, cost: str, limit: int) -> DataFrame:
    """One record of each group a round; a group whose next record does not fit stays stuck on it.

    Returns scope, group and how many of its records are shown and omitted.
    """

    def fold(items: Iterator[tuple]) -> Iterator[tuple]:
        counts: dict = {}
        size, stuck = 0, set()
        for name, price in items:
            shown, omitted = counts.get(name, (0, 0))
            if name not in stuck and size + price <= limit:
                size += price
                counts[name] = shown + 1, omitted
            else:
                stuck.add(name)
                counts[name] = shown, omitted + 1
        yield from ((name, *n) for name, n in counts.items())

    turns = in_turns(rows, scope, group, order)
    return streamed(turns, scope, ["_turn", group], [group, cost], fold, f"{_kinds(rows, *scope, group)}, shown bigint, omitted bigint")


def scope_records(rows: DataFrame, scope: list[str], group: str, order: str, cost: str, limit: int, item: str) -> DataFrame:
    """One record of each group a round, none counted twice or left out for its id; one that does not fit is deferred.

    Returns scope, group, item and ``place`` among the packed, null for deferred ones.
    """

    def fold(items: Iterator[tuple]) -> Iterator[tuple]:
        size = place = 0
        for name, what, price in items:
            fits = size + price <= limit
            if fits:
                size, place = size + price, place + 1
            yield name, what, place if fits else None

    turns = in_turns(rows, scope, group, order)
    return streamed(turns, scope, ["_turn", group], [group, item, cost], fold, f"{_kinds(rows, *scope, group, item)}, place int")


def pack_by_path(rows: DataFrame, scope: list[str], path: str, order: str, cost: str, limit: int, item: str) -> DataFrame:
    """:func:`pack_round_robin` by path, paths in the order in which they first come."""
    first = rows.groupBy(*scope, path).agg(F.min(order).alias("_first"))
    return pack_round_robin(rows.join(first, [*scope, path]), scope, "_first", order, cost, limit, item)


def batches(rows: DataFrame, scope: list[str], order: str, cost: str, limit: int, most: int) -> DataFrame:
    """Adds ``batch``: passages in order, a new batch when the size or the number would pass its limit."""

    def fold(items: Iterator[tuple]) -> Iterator[tuple]:
        batch = size = n = 0
        for place, price in items:
            if n and (size + price > limit or n >= most):
                batch, size, n = batch + 1, 0, 0
            size, n = size + price, n + 1
            yield place, batch

    return streamed(rows, scope, [order], [order, cost], fold, f"{_kinds(rows, *scope, order)}, batch int")


def joined_texts(rows: DataFrame, scope: list[str], order: str, text: str, gap: str) -> DataFrame:
    """``scope, hash, bytes`` of a scope's texts joined in order, hashed piece by piece."""
    import hashlib

    def fold(items: Iterator[tuple]) -> Iterator[tuple]:
        total, size = hashlib.sha256(), 0
        for number, (part,) in enumerate(items):
            data = ((gap if number else "") + (part or "")).encode()
            total.update(data)
            size += len(data)
        yield total.hexdigest(), size

    return streamed(rows, scope, [order], [text], fold, f"{_kinds(rows, *scope)}, hash string, bytes bigint")
