"""Several tables changed at once: data files first, then one manifest that makes all of them visible.

A folder holds ``data``, with a new folder for every table of a try, and
``commits``, numbered manifests that are renamed to their place when they are
whole. Readers follow manifests alone, so a commit that was killed midway has
left files that nobody sees. A number is taken once: of two writers the second
finds it taken and tries the next. A commit is known by its id and made once.

A manifest's rows name a table, a part of it and a path: a later commit's part
takes the place of an earlier one, and a part without rows is empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import written

MANIFEST = "number bigint, id string, name string, part string, path string"
#: Numbers that are tried when others commit at the same time.
TRIES = 20


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all manifests, in no order."""
    where, store = _store(spark, f"{folder}/commits")
    if not store.exists(where) or not len(store.listStatus(where)):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/commits/*")


def commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame], id: str, parts: dict[str, tuple[str, list[str]]] | None = None) -> bool:
    """Write ``tables`` and show them at once; false, and nothing written, if a commit has this ``id``.

    Rows are appended, but for tables in ``parts``: (column, values) says that
    the rows of these values of the column replace all earlier ones.
    """
    if not commits(spark, folder).filter(F.col("id") == id).isEmpty():
        return False
    rows = []
    for name, df in tables.items():
        path = f"{folder}/data/{name}/{uuid.uuid4().hex}"
        if parts and name in parts:
            column, values = parts[name]
            df.withColumn("_part", F.col(column).cast("string")).repartition("_part").write.partitionBy("_part").parquet(path)
            rows += [(name, value, f"{path}/_part={value}") for value in values]
        else:
            df.write.parquet(path)
            rows.append((name, path, path))
    for _ in range(TRIES):
        number = (commits(spark, folder).agg(F.max("number")).first()[0] or 0) + 1
        pending = f"{folder}/pending/{uuid.uuid4().hex}"
        spark.createDataFrame([(number, id, *r) for r in rows], MANIFEST).coalesce(1).write.parquet(pending)
        source, store = _store(spark, pending)
        target, _ = _store(spark, f"{folder}/commits/{number:012d}")
        store.mkdirs(target.getParent())
        if not store.exists(target) and store.rename(source, target):
            return True
        if not commits(spark, folder).filter(F.col("id") == id).isEmpty():
            return False
    raise OSError(f"{folder}: {TRIES} commits by others at the same time")


def read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """What commits show of table ``name``: the newest rows of every part, with the commit's number as ``commit``."""
    newest = Window.partitionBy("part").orderBy(F.desc("number"))
    # A row a part.
    shown = commits(spark, folder).filter(F.col("name") == name).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select("number", "path").collect()
    there = [(r.number, r.path) for r in shown if _store(spark, r.path)[1].exists(_store(spark, r.path)[0])]
    if not there:
        return spark.createDataFrame([], schema).withColumn("commit", F.lit(None).cast("bigint"))
    # Files know their folder, and a folder its commit.
    numbers = F.broadcast(spark.createDataFrame([(n, p.split("/data/", 1)[1]) for n, p in there], "commit bigint, _folder string"))
    rows = spark.read.schema(schema).parquet(*(p for _, p in there)).withColumn("_folder", F.regexp_extract(F.input_file_name(), r"/data/(.*)/[^/]+$", 1))
    return rows.join(numbers, "_folder").drop("_folder")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (with ``commit``) of the last commit of every key: many keys of many tables change together or not at all."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "commit").alias("_last"))
    return last.select(*keys, "_last.*")


FILES = "path string, hash string, version string, language string, symbols bigint, edges bigint, bucket int"
SYMBOLS = "path string, line int, kind string, name string, id string, signature string, language string, bucket int"
EDGES = "path string, owner string, kind string, target string, line int, bucket int"
SCHEMAS = {"files": FILES, "symbols": SYMBOLS, "edges": EDGES}


def rebuild(spark: SparkSession, files: DataFrame, folder: str, version: str, id: str, symbols: Callable[[DataFrame], DataFrame], edges: Callable[[DataFrame], DataFrame], buckets: int = 16) -> int:
    """Bring stored graphs up to ``files`` (path, content, hash, language); how many files were parsed.

    Only files that are stored nowhere, or of another hash or parser version, are
    parsed, after their content was held against its hash: a snapshot that has
    changed stops the run, and nothing is shown of it. Files that went lose
    their rows. Tables are kept in buckets of paths, of which only those with a
    change are written again, all tables in one commit.
    """
    changed = files.filter(F.sha2(F.col("content").cast("binary"), 256) != F.col("hash")).select("path").limit(3).collect()
    if changed:
        raise ValueError(f"stored snapshots have changed: {', '.join(r.path for r in changed)}")
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
    now = files.withColumn("bucket", bucket)
    held = read(spark, folder, "files", FILES)
    same = ["path", "hash", "version"]
    stale = written(now.withColumn("version", F.lit(version)).join(held.select(*same), same, "left_anti"), "stale")
    gone = held.join(now.select("path"), "path", "left_anti")
    # Of the buckets, a bounded number.
    touched = sorted(r.bucket for r in stale.select("bucket").union(gone.select("bucket")).distinct().collect())
    if not touched:
        return 0
    parsed = stale.select("path", "content")
    # More files want more buckets, so that one fits a task.
    # Used twice, so parsed once.
    new = {"symbols": written(symbols(parsed).withColumn("bucket", bucket), "symbols"), "edges": written(edges(parsed).withColumn("bucket", bucket), "edges")}
    sizes = [new[k].groupBy("path").agg(F.count("*").alias(k)) for k in ("symbols", "edges")]
    counted = stale.select("path", "hash", "version", "language", "bucket").join(sizes[0], "path", "left").join(sizes[1], "path", "left")
    new["files"] = counted.select("path", "hash", "version", "language", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("edges", F.lit(0)).alias("edges"), "bucket")
    stays = held.filter(F.col("bucket").isin(touched)).join(now.select("path", "hash").withColumn("version", F.lit(version)), same, "left_semi").select("path")
    tables = {}
    for name, schema in SCHEMAS.items():
        old = read(spark, folder, name, schema).filter(F.col("bucket").isin(touched)).join(stays, "path", "left_semi").drop("commit")
        tables[name] = old.unionByName(new[name].select(*old.columns))
    count = stale.count()
    commit(spark, folder, tables, id, {name: ("bucket", [str(b) for b in touched]) for name in tables})
    return count
