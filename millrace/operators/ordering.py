"""Orders over graphs and over whole tables: components, depth-first reading order, global places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import drop_tables, tables, written

#: Parts that the rows of one label or hub are dealt to.
SALTS = 16
#: Parts of a range sort whose sizes reach the driver.
PARTS = 4096
#: Links and nodes of a scope that one task walks at once, and nodes of a batch of its results.
LINKS, WALKED = 1 << 18, 1 << 14


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """Adds ``salt``, so that rows of one key go to several parts; :func:`everywhere` is the other side of such a join."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def everywhere(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt by key to all of the session's shuffle partitions.

    Spark joins parts that are small as bytes of a shuffle until there is one for
    each core, which grow to many times that size in a task's memory; it leaves these alone.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def components(links: DataFrame) -> DataFrame:
    """``scope, id, component`` of all ids in ``links`` (scope, a, b): the least id of the scope that can be reached.

    Every round each label meets the neighbours' and is then replaced by what its
    own id is labelled, which doubles how far labels travel; rounds are written
    to the shared folder, hubs and large components are met in several parts.
    """
    spark, held = links.sparkSession, tables(links.sparkSession)
    turned = links.select("scope", F.col("b").alias("a"), F.col("a").alias("b"))
    both = written(dealt(links.select("scope", "a", "b").unionAll(turned).distinct(), "a"), "links")
    labels = written(both.groupBy("scope", F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "labels")
    while True:
        near = both.join(everywhere(labels.select("scope", F.col("id").alias("b"), "component")), ["scope", "b", "salt"]).groupBy("scope", F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, ["scope", "id"]).select("scope", "id", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        ups = everywhere(step.select("scope", F.col("id").alias("component"), F.col("component").alias("up")).filter("up < component"))
        step = written(dealt(step, "id").join(ups, ["scope", "component", "salt"], "left").select("scope", "id", "before", F.coalesce("up", "component").alias("component")), "labels")
        labels = step.select("scope", "id", "component")
        if step.filter("component < before").isEmpty():
            drop_tables(spark, [path for path in tables(spark)[:-1] if path not in held])
            return labels


def depth_first(near: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """All nodes, each with the places of its neighbours from the strongest on, in the order in which they are read; and the least node of each one's component.

    From the least node that is left one goes to the strongest neighbour and on
    from there; neighbours that were seen from an earlier node keep their turn.
    """
    waits, out, seeds = np.ones(len(near), bool), [], []
    for seed in range(len(near)):
        ahead = [seed] if waits[seed] else []
        waits[seed] = False
        while ahead:
            node = ahead.pop()
            out.append(node)
            new = near[node][waits[near[node]]]
            waits[new] = False
            ahead.extend(new[::-1].tolist())
        seeds += [seed] * (len(out) - len(seeds))
    return out, seeds


def walked(rows: DataFrame, whole: list[str], alone: bool) -> DataFrame:
    """``scope, node, component, step, place``: the depth-first order of each group ``whole`` of columns of ``rows``.

    ``rows``: scope, node, next, weight and what else is in ``whole``. If ``alone``, every node to
    return has a row with no ``next`` too. A group streams through one task, which holds its neighbour lists.
    """
    kind = rows.schema["scope"].dataType.simpleString()
    ordered = rows.repartition(*whole).sortWithinPartitions(*whole, "node", F.desc("weight"), "next").select("scope", "node", "next", *(F.col(c).alias(f"_{c}") for c in whole[1:]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, done, size = None, [], [], 0

        def steps() -> list[np.ndarray]:
            node, after, linked = (np.concatenate(x) for x in zip(*held, strict=True))
            ids, first = np.unique(node, return_index=True)  # sorted, as the rows are
            # A node's own row and links within the group; an empty link stands last in its node.
            to = np.searchsorted(ids, after)
            near = [t[k] for t, k in zip(np.split(to, first[1:]), np.split(linked, first[1:]), strict=True)]
            order, seeds = (np.array(x) for x in depth_first(near))
            # Nodes that only links name are walked through and not returned.
            own = np.isin(ids, node[~linked])[order] if alone else np.ones(len(ids), bool)
            step = np.arange(len(ids)) - np.searchsorted(seeds, seeds)
            return [ids[order][own], ids[seeds][own], step[own], np.arange(own.sum())]

        def batch_of(done: list) -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*(d[1] for d in done), strict=True)]
            scopes = pa.array([d[0] for d in done], scope_type).take(pa.array(np.repeat(np.arange(len(done)), [len(d[1][0]) for d in done])))
            return pa.RecordBatch.from_arrays([scopes, *map(pa.array, columns)], names=["scope", "node", "component", "step", "place"])

        for batch in batches:
            scope_type = batch.schema.field("scope").type
            node, after = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            linked = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            keys = list(zip(*(batch.column(k).to_pylist() for k in (0, *range(3, batch.num_columns))), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and keys[a] != place:
                    done.append((place[0], steps()))
                    size += len(done[-1][1][0])
                    held = []
                    if size >= WALKED:
                        yield batch_of(done)
                        done, size = [], 0
                place = keys[a]
                held.append((node[a:b].copy(), after[a:b].copy(), linked[a:b].copy()))
        if held:
            done.append((place[0], steps()))
        if done:
            yield batch_of(done)

    return ordered.mapInArrow(walk, f"scope {kind}, node bigint, component bigint, step bigint, place bigint")


def graph_order(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """``scope, node, component, step, place`` of every node (scope, node): read by component and, in it, by ``step``; ``place`` counts through the scope.

    ``weights`` (scope, a, b, weight) are undirected and added up. Components go
    by their least node, and each is walked depth first, the strongest neighbour
    next, the lesser of equals. A scope of at most ``LINKS`` links and nodes is walked at
    once; of a larger one, components are found by joins, and each streams through one
    task, which holds its neighbour lists as arrays, 8 bytes a link.
    """
    spark = nodes.sparkSession
    one = weights.filter("a <> b and scope is not null").groupBy("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))
    one = written(one, "weights")
    all_ = nodes.select("scope", F.col("node").cast("bigint").alias("node")).filter("node is not null")
    sizes = one.groupBy("scope").agg(F.count("*").alias("n")).unionAll(all_.groupBy("scope").agg(F.count("*").alias("n")))
    large = written(sizes.groupBy("scope").agg(F.sum("n").alias("n")).filter(F.col("n") > LINKS).select("scope"), "large")
    both = one.select("scope", F.col("a").cast("bigint").alias("node"), F.col("b").cast("bigint").alias("next"), "weight")
    both = both.unionAll(both.select("scope", "next", "node", "weight"))
    if large.isEmpty():
        return _within(all_, both)
    # One for each LINKS links and nodes at most.
    few = F.broadcast(large.select(F.col("scope").alias("_s")))
    mine = lambda rows, how: rows.join(few, F.col("scope").eqNullSafe(F.col("_s")), how)
    of = components(mine(one, "left_semi").select("scope", "a", "b"))
    lists = dealt(mine(both, "left_semi"), "next").join(everywhere(of.select("scope", F.col("id").alias("node"), "component")), ["scope", "node", "salt"]).drop("salt")
    steps = walked(lists, ["scope", "component"], False).drop("place")
    found = mine(all_, "left_semi").distinct().join(steps, ["scope", "node"], "left").select("scope", "node", F.coalesce("component", "node").alias("component"), F.coalesce("step", F.lit(0)).alias("step"))
    return _within(mine(all_, "left_anti"), mine(both, "left_anti")).unionByName(placed(found, ["component", "step"], group=["scope"]))


def _within(nodes: DataFrame, both: DataFrame) -> DataFrame:
    """The order of scopes that are walked at once."""
    alone = nodes.select("scope", "node", F.lit(None).cast("bigint").alias("next"), F.lit(None).cast(both.schema["weight"].dataType).alias("weight"))
    return walked(both.unionAll(alone), ["scope"], True)


def first_of(rows: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """``key, first``: the ``most`` least values of every key in order; tasks rank theirs before any shuffle."""
    ranked = rows.select(key, value).withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(value))).filter(F.col("_rank") <= most)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("first"))


def placed(rows: DataFrame, order: list[Column | str], group: list[str] | None = None, name: str = "place") -> DataFrame:
    """Adds ``name``: the place, from 0, of each row in the order of all rows, or of its group.

    No task sees more than its range: rows are sorted by range and written with
    their numbers there; the sizes of ranges, a row each, say where each begins.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    sorted_ = rows.repartitionByRange(*map(F.col, group or []), *columns).sortWithinPartitions(*map(F.col, group or []), *columns)
    numbered = written(sorted_.withColumn("_id", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_id", 33)
    counts = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    if len(counts) > PARTS:
        raise ValueError(f"{len(counts)} ranges; set fewer shuffle partitions")
    starts, at = [], 0
    for r in sorted(counts):
        starts.append((r.part, at))
        at += r.n
    table = F.broadcast(rows.sparkSession.createDataFrame(starts, "part bigint, start bigint"))
    whole = numbered.withColumn("part", part).join(table, "part").withColumn("_at", F.col("start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("part", "start", "_id")
    if not group:
        return whole.withColumnRenamed("_at", name)
    first = whole.groupBy(*group).agg(F.min("_at").alias("_first"))
    return dealt(whole, "_at").join(everywhere(first), [*group, "salt"]).withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_first", "salt")
