"""Name resolution, neighbourhoods, intervals and trees as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written


def tail_name(target):
    """What stands behind the last ``:`` or ``.`` of a callee."""
    return F.element_at(F.split(target, "[:.]"), -1)


def resolve_links(calls: DataFrame, declarations: DataFrame, keep: int = 4) -> DataFrame:
    """Call sites folded by caller and callee, with where the callee is declared.

    ``calls``: file, owner, name; ``declarations``: file, name. A name declared
    nowhere is unresolved, only in the caller's file internal, in one other file
    resolved, in several ambiguous (``keep`` candidates). Calls are counted
    before any join, and names are resolved once each.
    """
    folded = calls.groupBy("file", "owner", "name").agg(F.count("*").alias("calls"))
    places = declarations.select(F.col("file").alias("place"), "name").distinct()
    counted = places.groupBy("name").agg(F.count("*").alias("places"))
    ranked = places.withColumn("_rank", F.row_number().over(Window.partitionBy("name").orderBy("place"))).filter(F.col("_rank") <= keep + 1)
    few = ranked.groupBy("name").agg(F.array_sort(F.collect_list("place")).alias("few"))  # keep + 1 at most
    own = places.select("name", F.col("place").alias("file"), F.lit(1).alias("own"))
    joined = folded.join(counted, "name", "left").join(few, "name", "left").join(own, ["name", "file"], "left")
    others = F.coalesce("places", F.lit(0)) - F.coalesce("own", F.lit(0))
    kind = F.when(F.col("places").isNull(), "unresolved").when(others == 0, "internal").when(others == 1, "resolved").otherwise("ambiguous")
    candidates = F.slice(F.filter("few", lambda p: p != F.col("file")), 1, keep)
    shown = F.when(others >= 1, F.concat_ws(",", candidates)).otherwise("")
    return joined.select("file", "owner", "name", "calls", kind.alias("kind"), shown.alias("candidates"))


def neighbourhood(seeds: DataFrame, edges: DataFrame, parents: DataFrame | None = None, seed_score: int = 1000, callee: int = 600, caller: int = 500, parent: int = 200) -> DataFrame:
    """Scores of the seeds (id) and what is one step away; a node has its best."""
    rows = seeds.select("id", F.lit(seed_score).alias("score"))
    rows = rows.unionAll(edges.join(seeds, edges.source == seeds.id).select(F.col("target"), F.lit(callee)))
    rows = rows.unionAll(edges.join(seeds, edges.target == seeds.id).select(F.col("source"), F.lit(caller)))
    if parents is not None:
        rows = rows.unionAll(parents.join(seeds, "id").select("parent", F.lit(parent)))
    return rows.filter("id is not null").groupBy("id").agg(F.max("score").alias("score"))


def first_overlap(sites: DataFrame, ranges: DataFrame, key: str, block: int = 64) -> DataFrame:
    """For each site (key, site, at) the first range (key, ordinal, start, end) that holds it.

    Rows meet by key and block of positions, so a key with many ranges is no nested loop over all of them.
    """
    spread = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))))
    hits = sites.withColumn("_block", F.floor(F.col("at") / block)).join(spread, [key, "_block"]).filter((F.col("start") <= F.col("at")) & (F.col("end") >= F.col("at")))
    return hits.groupBy(key, "site").agg(F.min("ordinal").alias("ordinal"))


def tree_closure(edges: DataFrame) -> DataFrame:
    """``ancestor, node, depth`` of a forest of (parent, node), itself included.

    Distances double each round, each of which is written to the shared folder,
    until a round finds nothing: a tree of depth d takes log2(d) + 1 joins.
    Only the farthest pairs of a round lead to new ones.
    """
    edges = written(edges.select("parent", "node").distinct(), "edges")
    nodes = edges.select("node").unionAll(edges.select("parent")).distinct()
    reach = nodes.select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("depth"))
    # All pairs at distances from 1 to span.
    far, span = edges.select(F.col("parent").alias("ancestor"), "node", F.lit(1).alias("depth")), 1
    while True:
        top = far.filter(F.col("depth") == span).select(F.col("ancestor").alias("top"), F.col("node").alias("ancestor"))
        grown = written(far.join(top, "ancestor").select(F.col("top").alias("ancestor"), "node", (F.col("depth") + span).alias("depth")), "reach")
        if grown.isEmpty():
            return reach.unionAll(far)
        far, span = far.unionAll(grown), 2 * span


def prefix_resolve(prefixes: DataFrame, ids: DataFrame, stem: int) -> DataFrame:
    """``prefix, matches, id``: the only id that begins with a prefix of at least ``stem`` characters, else null.

    Ids meet prefixes by their own beginnings, one for each length that a prefix
    has, so that work grows with ids times lengths and not with their pairs.
    """
    left = prefixes.filter(F.length("prefix") >= stem).select("prefix").distinct()
    # As many as an id has characters, at most.
    lengths = [r.n for r in left.select(F.length("prefix").alias("n")).distinct().collect()]
    starts = ids.select("id", F.explode(F.array(*map(F.lit, lengths))).alias("n")).filter(F.length("id") >= F.col("n")) if lengths else ids.select("id", F.lit(0).alias("n")).limit(0)
    counted = starts.groupBy(F.left("id", F.col("n")).alias("prefix"), "n").agg(F.count("*").alias("matches"), F.min("id").alias("id")).drop("n")
    # Beginnings are many more than the ids they are made from, by whose size Spark would broadcast them.
    found = left.join(counted.hint("merge"), "prefix", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return found.select("prefix", F.col("matches").cast("bigint").alias("matches"), F.when(F.col("matches") == 1, F.col("id")).alias("id"))


def begun(requests: DataFrame, ids: DataFrame, scope: str, prefix: str = "prefix") -> DataFrame:
    """``requests`` with ``first`` and ``second``: the least two ids of their scope that ``prefix`` begins, null where there is none.

    Requests and ids of one scope and first character are sorted together, where
    what a prefix begins stands right behind it. Each is shuffled once, and
    nothing is broadcast: hashes are many more bytes than the tables they are made
    from, by which Spark would choose.
    """
    place = [scope, "_stem"]
    stem = F.left("_text", F.lit(1)).alias("_stem")
    own = ids.select(scope, F.col("id").alias("_text")).select(scope, stem, "_text").repartition(*place).distinct()
    after = F.lead("_text").over(Window.partitionBy(*place).orderBy("_text"))
    own = own.withColumn("_pair", F.struct(F.col("_text").alias("first"), after.alias("second")))
    asked = requests.select("*", F.col(prefix).alias("_text")).select("*", stem).repartition(*place)
    behind = F.last("_pair", ignorenulls=True).over(Window.partitionBy(*place).orderBy(F.desc("_text"), F.col("_pair").isNull()))
    met = asked.unionByName(own, allowMissingColumns=True).withColumn("_near", behind).filter(F.col("_pair").isNull() & F.col("_text").isNotNull())
    begins = lambda c: F.when((F.col("_text") != "") & F.col(c).startswith(F.col("_text")), F.col(c))
    return met.select(*requests.columns, begins("_near.first").alias("first"), begins("_near.second").alias("second"))


def resolve_all(requests: DataFrame, ids: DataFrame, scope: str, request: str) -> DataFrame:
    """``scope, request, ids``: the ids of a request's prefixes in order, or null if any begins none or several of its scope's ids.

    ``requests``: scope, request, pos, prefix; ``ids``: scope, id. Blanks around a prefix do not count, and an empty one names nothing.
    """
    asked = requests.select(scope, request, "pos", F.coalesce(F.trim("prefix"), F.lit("")).alias("prefix"))
    met = begun(asked, ids, scope).withColumn("id", F.when(F.col("second").isNull(), F.col("first")))
    one = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])  # as long as the request
    return met.groupBy(scope, request).agg(F.when(F.count_if(F.col("id").isNull()) == 0, one).alias("ids"))


def shortest_unique_prefix(ids: DataFrame, least: int = 8, stem: int = 4) -> DataFrame:
    """``id, short``: the shortest prefix that no other id has, ``least`` characters at least.

    Ids are sorted within equal stems, where their nearest neighbours stand
    unless the stem alone sets them apart.
    """
    w = Window.partitionBy(F.left("id", F.lit(stem))).orderBy("id")
    near = ids.select("id", F.lag("id").over(w).alias("_a"), F.lead("id").over(w).alias("_b"))
    common = lambda a: F.coalesce(F.aggregate(F.sequence(F.lit(1), F.length("id")), F.lit(0), lambda n, k: F.when(F.substring("id", 1, k) == F.substring(a, 1, k), k).otherwise(n)), F.lit(0))
    length = F.greatest(F.lit(least), common(F.col("_a")) + 1, common(F.col("_b")) + 1)
    return near.select("id", F.left("id", length).alias("short"))
