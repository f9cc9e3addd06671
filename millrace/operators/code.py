"""Declarations and call sites of source files, line by line.

Reduced fidelity: declarations and calls are found by patterns for each
language, not by a grammar, and the owner of a call is the declaration that
stands last before it in the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import paths

DECLARED = (
    r"^\s*(?:pub(?:\([a-z]+\))?\s+|export\s+|default\s+|public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+|async\s+|unsafe\s+|const\s+)*"
    r"(?:(def|class|fn|func|function|struct|enum|trait|interface|impl|mod|module|type)\b\s*(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)"
    r"|(?:[A-Za-z_][A-Za-z0-9_<>\[\]*&:]*\s+)+\*?([A-Za-z_][A-Za-z0-9_]*)\s*\([^;]*\)\s*(?:const\s*)?\{)"
)
CALLED = r"([A-Za-z_][A-Za-z0-9_]*(?:(?:\.|::|->)[A-Za-z_][A-Za-z0-9_]*)*)\s*\("
BRANCH = r"^\s*(?:\}\s*)?(?:else\s+)?(if|elif|for|while|switch|match|case|loop|select|try|catch|except)\b"
# Words that stand before a parenthesis without being called.
NOT_CALLED = ("if", "for", "while", "switch", "match", "catch", "return", "fn", "def", "func", "function", "sizeof", "elif", "and", "or", "not", "in", "select", "loop", "class")


def code_lines(files: DataFrame) -> DataFrame:
    """``path, line, content, kind, name`` of files (path, content)."""
    rows = files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "content"))
    keyword, name, c_name = (F.regexp_extract("content", DECLARED, i) for i in (1, 2, 3))
    found = F.when(name != "", name).when((c_name != "") & ~c_name.isin(*NOT_CALLED), c_name)
    kind = F.when(keyword.isin("class", "struct", "enum", "trait", "interface", "type"), "type").when(keyword == "impl", "implementation").when(keyword.isin("mod", "module"), "module").when(found.isNotNull(), "function")
    return rows.select("path", (F.col("pos") + 1).alias("line"), "content", kind.alias("kind"), found.alias("name"))


def symbols(files: DataFrame) -> DataFrame:
    """Declarations with their path-scoped ids."""
    found = code_lines(files).filter("name is not null")
    local = F.concat_ws(":", "kind", F.col("line").cast("string"))
    return found.select("path", "line", "kind", "name", F.sha2(F.concat_ws(":", "path", local), 256).alias("id"), F.trim("content").alias("signature"), paths.language(F.col("path")).alias("language"))


def edges(files: DataFrame) -> DataFrame:
    """``path, owner, kind, target, line``: calls and branches, owned by the declaration before them.

    Owners come from a window over each file's lines; a file is one text and so
    already fits a task.
    """
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    owned = code_lines(files).withColumn("owner", F.coalesce(F.last("name", ignorenulls=True).over(w), F.lit("file")))
    called = owned.select("path", "owner", F.lit("calls").alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(CALLED), F.lit(1))).alias("target"), "line", "name")
    calls = called.filter(~F.col("target").isin(*NOT_CALLED) & (F.col("name").isNull() | (F.col("target") != F.col("name")))).drop("name")
    branches = owned.filter(F.regexp_extract("content", BRANCH, 1) != "").select("path", "owner", F.lit("branch").alias("kind"), F.lit("").alias("target"), "line")
    return calls.unionAll(branches)
