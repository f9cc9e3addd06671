"""The stages of the corpus pipeline: each over all that the one before kept.

Language ID drops texts that no language fits, near-duplicate detection keeps one
document of each group, decontamination drops documents that hold benchmark
passages, the secret scan replaces secrets by their kind, and the last stage
codes every text in pieces of a public vocabulary.

Decisions are on rows, not on ids: rows without an id, rows that repeat one and
an id with two texts are documents of their own in every stage, of repeated
documents one stays (that of the least id, rows without an id last), and a row
never goes for another row of its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, langid, near_dup, pieces, secret_scan
from millrace.llm.common import held_out, tokenizer_path
from millrace.session import drop_tables, tables, written
from millrace.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bits a byte beyond which a text is no language that was learned; prose has 2 to 3, noise 7 and more.
MAX_BITS = 7.0
#: Percent of all shingles that near duplicates have in common; op6's query is held to 85.
NEAR_SHARE = 80
#: Benchmark items of fewer words are no evidence by themselves.
LEAST_ITEM_WORDS = 5
#: Rows up to which keys go out by broadcast; about 20 MB.
BROADCAST_KEYS = 250_000


#: Equal texts are judged alike, so what is decided of a text goes by its hash.
TEXT_KEY = "sha2(text, 256) AS _key"


def _settled(spark: SparkSession) -> None:
    """Executors collect their garbage before a stage, so that what the last one took of their heaps is the system's again.

    A heap that shuffles have filled stays as large as it was until then, beside
    the Python workers of the next stage. Tasks reach every executor only by
    chance, so there are several for each core; one that is missed costs memory alone.
    """
    tasks = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("gc")).write.format("noop").mode("overwrite").save()


def _few(keys: DataFrame) -> DataFrame:
    """``keys`` in the shared folder, broadcast if a count shows that they are few."""
    keys = written(keys, "keys")
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that are null, without a letter, or as costly as noise in every language."""
    _settled(spark)
    docs = docs.selectExpr(*COLUMNS, TEXT_KEY)
    model = langid.fit(docs.filter(~held_out(F.col("doc_id"), 4, 2)))
    judged = langid.predict(docs, model, key="_key")
    out = judged.filter((F.col("lang_pred") == "und") | (F.col("bits_per_byte") > MAX_BITS)).select("_key").distinct()
    return docs.filter("text is not null").join(_few(out), "_key", "left_anti").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group the document that has the least id."""
    _settled(spark)
    # Rows are numbered in the table that is written, so that numbers stay.
    docs = written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = near_dup.near_duplicates(docs, key="_row", share=NEAR_SHARE).select("_row", F.col("component_id").alias("group"))
    named = written(groups.join(docs.select("_row", "doc_id"), "_row"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row"))
    several = named.groupBy("group").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1").select("group", F.col("first._row").alias("stays"))
    # A group may hold much of all rows.
    met = near_dup.salted(named, "_row", near_dup.SALTS).join(near_dup.for_all_salts(several, near_dup.SALTS), ["group", "salt"])
    return docs.join(_few(met.filter("_row <> stays").select("_row")), "_row", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    _settled(spark)
    docs = docs.selectExpr(*COLUMNS, TEXT_KEY)
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), key="_key")
    out = found.filter(F.col("item_words") >= LEAST_ITEM_WORDS).select("_key").distinct()
    return docs.join(_few(out), "_key", "left_anti").select(*COLUMNS)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts."""
    _settled(spark)
    docs = docs.select(*COLUMNS)
    return secret_scan.redact(docs, secret_scan.fit(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best segmentation of every text, and the scores of the four best."""
    _settled(spark)
    return pieces.encode(docs, pieces.Vocabulary.load(tokenizer_path()), n=4, with_others=False)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scans", remove_secrets),
    ("SentencePiece encoding", encode),
]

#: SQL expresses neither the language model nor the field of the secret scan; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again.

    Tables that a stage has written on its way go once its rows are written.
    """
    docs, rows = table(spark, sf_dir, "documents", *COLUMNS), []
    for number, (_, stage) in enumerate(STAGES[:-1]):
        held = tables(spark)
        docs = written(stage(spark, docs, sf_dir), f"stage{number}")
        drop_tables(spark, [path for path in tables(spark)[:-1] if path not in held] + rows)
        rows = tables(spark)[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
