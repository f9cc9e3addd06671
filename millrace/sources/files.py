"""Source trees as tables: scan, filter, snapshot, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import paths
from millrace.operators.packing import joined_texts

MAX_FILE_BYTES = 20 << 20


def scan(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``path, length, content`` of all files under the roots, each once."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    plain = F.regexp_replace("path", "^file:/+", "/")
    return found.select(plain.alias("path"), "length", "content").dropDuplicates(["path"])


def snapshot(files: DataFrame, include: list[str] = (), exclude: list[str] = (), roots: list[str] = (), most: int = MAX_FILE_BYTES) -> DataFrame:
    """Every file with ``status`` indexed, excluded or skipped, why, and text and hash where indexed."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    out = paths.is_skipped_by_default(F.col("path")) | ~paths.matches_filters(F.col("path"), list(roots), list(include), list(exclude))
    binary = F.instr(text, "\u0000") > 0
    detail = F.when(out, "excluded by filters").when(F.col("length") > most, "larger than the limit").when(text.isNull(), "not valid UTF-8").when(binary, "binary")
    status = F.when(out, "excluded").when(detail.isNotNull(), "skipped").otherwise("indexed")
    return files.select("path", "length", status.alias("status"), detail.alias("detail"), F.when(detail.isNull(), text).alias("content"), F.when(detail.isNull(), F.sha2("content", 256)).alias("hash"), paths.language(F.col("path")).alias("language"))


def counters(files: DataFrame) -> DataFrame:
    return files.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("indexed", "excluded", "skipped")))


def fingerprint(files: DataFrame, version: str) -> DataFrame:
    """One hash of all indexed files: of (path, hash) lines in sorted order, folded by first byte of the path's hash.

    Lines of a part stream through a task in order and are hashed one by one;
    256 partial hashes are joined, so no task holds all files.
    """
    lines = files.filter("status = 'indexed'").select(F.substring(F.sha2("path", 256), 1, 2).alias("part"), F.concat_ws(":", "path", "hash").alias("line"))
    parts = joined_texts(lines, ["part"], "line", "line", "\n")
    return parts.agg(F.sha2(F.concat_ws(":", F.lit(version), F.array_sort(F.collect_list(F.concat("part", "hash")))), 256).alias("fingerprint"))
