"""Ignore rules of a source tree: ordered patterns with negation that hold from their folder down."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import dealt, everywhere

#: Rules up to which they go out by broadcast, about 20 MB.
FEW_RULES = 100_000


def pattern_of(line: str) -> tuple[str, bool, bool] | None:
    """A rule's expression for paths relative to its folder, whether it takes paths in again, and whether it is for folders alone.

    A pattern with a slash at its start or inside is bound to its folder, any other
    fits a name at every depth; ``**`` stands for any folders.
    """
    text = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not text or text.startswith("#"):
        return None
    again, text = text.startswith("!"), text.removeprefix("!")
    folder, text = text.endswith("/"), text.rstrip("/")
    if not text:
        return None
    bound, text = "/" in text, text.lstrip("/")
    out, at = [], 0
    while at < len(text):
        rest = text[at:]
        if rest.startswith("**/") and (at == 0 or text[at - 1] == "/"):
            out.append("(?:[^/]+/)*")
            at += 3
        elif rest == "**" and (at == 0 or text[at - 1] == "/"):
            out.append(".+")
            at += 2
        elif rest[0] == "*":
            out.append("[^/]*")
            at += len(rest) - len(rest.lstrip("*"))
        elif rest[0] == "?":
            out.append("[^/]")
            at += 1
        elif rest[0] == "[" and (m := re.match(r"\[[!^]?\]?[^\]]*\]", rest)):
            inner = m[0][1:-1]
            no = inner[:1] in ("!", "^")
            body = inner[no:].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&&", "&\\&")
            out.append(f"[{'^/' if no else ''}{body}]")
            at += len(m[0])
        else:
            at += rest[0] == "\\" and len(rest) > 1
            out.append(re.escape(text[at]))
            at += 1
    return ("^" if bound else "^(?:.*/)?") + "".join(out) + "$", again, folder


def rules_of(files: DataFrame, names: tuple[str, ...] = (".gitignore", ".ignore")) -> DataFrame:
    """``folder, depth, number, expression, again, folders`` of the ignore files (path, content) of a tree."""

    @F.pandas_udf("array<struct<number:int,expression:string,again:boolean,folders:boolean>>")
    def parsed(contents: pd.Series) -> pd.Series:
        keys = ("number", "expression", "again", "folders")
        lines = lambda text: ((k, pattern_of(line)) for k, line in enumerate((text or "").split("\n")))
        return pd.Series([[dict(zip(keys, (k, *p), strict=True)) for k, p in lines(text) if p is not None] for text in contents])

    name = F.element_at(F.split("path", "/"), -1)
    # Of one folder, rules of the later name come after those of the earlier.
    rank = sum(((F.when(name == n, k)).otherwise(0) for k, n in enumerate(names)), F.lit(0))
    kept = files.filter(name.isin(*names)).select(folder_of(F.col("path")).alias("folder"), rank.alias("rank"), F.explode(parsed("content")).alias("r"))
    return kept.select("folder", F.size(F.filter(F.split("folder", "/"), lambda x: x != "")).alias("depth"), (F.col("rank") * 1_000_000 + F.col("r.number")).alias("number"), "r.expression", "r.again", "r.folders")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``path, ignored`` for every path, relative to the tree's root.

    A path and each folder above it is judged by the last rule that fits it, of
    the deepest folder with such a rule; a path in an ignored folder is ignored,
    whatever takes it in again. Folders are judged once each.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("item"), (k < F.size(parts)).alias("is_folder")))
    chain = files.select("path").distinct().select("path", F.explode(above).alias("c")).select("path", "c.*")
    items = chain.select("item", "is_folder").distinct()
    # An item meets the rules of every folder it is in.
    names = F.split("item", "/")
    homes = items.select("item", "is_folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda k: F.struct(F.array_join(F.slice(names, 1, k), "/").alias("folder"), F.array_join(F.slice(names, k + 1, F.size(names)), "/").alias("rest")))).alias("h")).select("item", "is_folder", "h.*")
    met = homes.join(F.broadcast(rules), "folder") if rules.count() <= FEW_RULES else dealt(homes, "item").join(everywhere(rules), ["folder", "salt"])
    fits = met.filter((F.col("is_folder") | ~F.col("folders")) & F.expr("rest rlike expression"))
    last = fits.groupBy("item", "is_folder").agg(F.max_by("again", F.struct("depth", "number")).alias("again"))
    out = last.filter("not again").select("item", "is_folder")
    hit = chain.join(out, ["item", "is_folder"], "left_semi").select("path").distinct().withColumn("ignored", F.lit(True))
    return files.select("path").join(hit, "path", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))
