"""WARC archives: a deterministic sharded writer and its reader.

Records are sorted by (page id, payload hash, copy) and cut into shards at
quantiles of a sample that hashes of ids choose, so the same pages give the same
shards, files and bytes on any cluster and in any order of rows. A task streams
one sorted shard, compresses every record as a gzip member of its own and begins a
new file once the present one has ``roll_bytes`` compressed. Headers and digests
are made anew from the payload; of equal payloads the record of the largest page id
is the response and the others are revisits, whose payloads are not even shuffled.

Files get temporary names of their attempt. What a task has finished comes back as
manifest rows through Spark's own commit, so attempts that were lost or repeated
leave files that no manifest names; then the named files are renamed, which may be
repeated, and the manifest itself is renamed last. Readers see a folder without
``_manifest`` as not committed, read the files that it names alone, and check
their digests and that of every payload.

Files are opened through ``pyarrow.fs``, so the folder may be any that it knows
(a mounted path, HDFS, an object store).

Defined cases: null html is an empty payload; a null url has no target field, and
control characters in urls are percent-encoded; rows without an id stand last and
count below all ids; rows that repeat an id and a payload are records of their own,
of which one, of the least url, is the response. An empty table commits a manifest
without files. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import slices, tidy
from millrace.llm.near_dup import for_all_salts, salted
from millrace.session import written

#: Rows of facts on repeated payloads that go out by broadcast, about 25 MB.
FEW_FACTS = 250_000
#: Parts that the rows of one payload are dealt to, and sampled records a shard.
SALTS, SAMPLES = 32, 16
#: Bytes that a record takes besides its payload, about.
HEAD_BYTES = 400
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, file int, name string, temporary string, bytes bigint, records bigint, first_page bigint, last_page bigint, sha256 string"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, record_id string, date string, name string"


def order_key(page: Column, key: Column, copy: Column) -> Column:
    """Text that orders records; ids ascend as signed numbers, none comes last."""
    biased = F.lpad(F.hex(page.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(biased, F.lit("~" * 16)), F.substring(F.hex(key), 1, 16), F.lpad(F.hex(copy.cast("bigint")), 12, "0"))


@dataclass
class Planned:
    """What is known of all records before payloads move: counts by page and payload, and facts on payloads that occur again."""

    pages: DataFrame
    least: int
    counts: DataFrame = field(init=False)
    facts: DataFrame = field(init=False)

    def __post_init__(self):
        html = F.coalesce(F.col("html").cast("string"), F.lit(""))
        self.rows = self.pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.unhex(F.sha2(html, 256)).alias("key"), F.octet_length(html).cast("bigint").alias("bytes"))
        self.counts = written(self.rows.groupBy("page_id", "key", "bytes").agg(F.count("*").alias("n")), "payloads")
        again = self.counts.groupBy("key").agg(F.sum("n").alias("total"), F.max("page_id").alias("last")).filter("total > 1")
        again = for_all_salts(again.select("key", "last"), SALTS)
        self.facts = written(salted(self.counts, "page_id", SALTS).join(again, ["key", "salt"]).select("key", "page_id", "n", "last"), "repeats")

    def sample(self, shard_bytes: int, most_shards: int) -> tuple[int, list[str]]:
        """How many shards there are to be, and the order keys where all but the first begin."""
        total = self.counts.agg(F.sum("n"), F.sum((F.col("bytes") + HEAD_BYTES) * F.col("n"))).first()
        if not total[0]:
            return 1, []
        shards = min(most_shards, -(-total[1] // shard_bytes))
        step = -(-total[0] // (SAMPLES * shards))
        chosen = self.counts.filter((F.col("n") >= step) | (F.pmod(F.xxhash64("page_id", "key"), F.lit(step)) == 0))
        copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"), F.lit(step).cast("bigint"))).alias("copy")
        keys = chosen.select("page_id", "key", "bytes", copy).select(order_key(F.col("page_id"), F.col("key"), F.col("copy")).alias("at"), (F.col("bytes") + HEAD_BYTES).alias("weight")).collect()
        keys = sorted((r.at, r.weight) for r in keys)
        reached = np.cumsum([w for _, w in keys])
        cuts = np.searchsorted(reached, reached[-1] * np.arange(1, shards) / shards) if keys else []
        bounds = sorted({keys[min(c + 1, len(keys) - 1)][0] for c in cuts})
        return len(bounds) + 1, bounds

    def records(self) -> DataFrame:
        """``page_id, url, html, key, bytes, sha1, copy, record_type, refers_to``; revisits carry no html."""
        few = self.facts.count() <= FEW_FACTS
        facts = self.facts.select(F.col("key").alias("_key"), F.col("page_id").alias("_page"), "n", "last", F.lit(True).alias("again"))
        met = self.rows.withColumn("sha1", F.sha1("html")).join(F.broadcast(facts) if few else facts, F.col("key").eqNullSafe(F.col("_key")) & F.col("page_id").eqNullSafe(F.col("_page")), "left")
        own = F.col("again").isNull() | (F.col("bytes") < self.least) | F.col("page_id").eqNullSafe(F.col("last"))
        columns = ["page_id", "url", "html", "key", "bytes", "sha1", "copy", "record_type", "refers_to"]

        def typed(rows: DataFrame, response: Column) -> DataFrame:
            return rows.withColumn("html", F.when(response, F.col("html"))).withColumn("record_type", F.when(response, "response").otherwise("revisit")).withColumn("refers_to", F.when(~response, F.col("last"))).select(*columns)

        single = typed(met.filter("coalesce(n, 1) = 1").withColumn("copy", F.lit(1).cast("bigint")), own)
        if self.facts.filter("n > 1").isEmpty():
            return single
        # Rows that repeat page and payload become one row with a count before they move, then copies without payloads.
        like = met.filter("n > 1").groupBy("page_id", "url", "key", "bytes", "sha1", "last", "again").agg(F.count("*").alias("m"), F.first("html").alias("html"))
        like = written(like, "copies")
        least = like.groupBy(F.col("key").alias("_key"), F.col("page_id").alias("_page")).agg(F.min("url").alias("_url"), F.lit(True).alias("first"))
        same = F.col("key").eqNullSafe(F.col("_key")) & F.col("page_id").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url"))
        copies = like.join(least, same, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
        chosen = (F.col("bytes") < self.least) | (own & F.coalesce("first", F.lit(False)) & (F.col("copy") == 1))
        return single.unionByName(typed(copies, chosen))


def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=5)}>"


def _base32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def _safe(url: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member without time or name."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    coder = zlib.compressobj(wbits=31)
    return b"".join((coder.compress(head.encode()), coder.compress(block), coder.compress(b"\r\n\r\n"), coder.flush()))


def record(row: dict, least: int, date: str) -> bytes:
    """The compressed record of a row of :meth:`Planned.records`."""
    page, key, kept = row["page_id"], bytes(row["key"]), row["record_type"] == "response"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    payload = row["html"].encode("utf-8", "surrogatepass") if kept else b""
    # Of a long payload there is one response, so that revisits can name it.
    name = ("response", page, key) if kept and row["bytes"] >= least else (row["record_type"], page, key, row["url"], row["copy"])
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", _urn(*name)), ("WARC-Date", date)]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", _safe(row["url"])))
    block = head + payload
    fields += [("WARC-Payload-Digest", _base32(hashlib.sha1(payload).digest() if kept else bytes.fromhex(row["sha1"]))), ("WARC-Block-Digest", _base32(hashlib.sha1(block).digest()))]
    if not kept:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn("response", row["refers_to"], key))]
        if row["refers_to"] is not None:
            fields.append(("X-Refers-To-Page-Id", str(row["refers_to"])))
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    return _member([*fields, ("Content-Type", "application/http;msgtype=response")], block)


class _Roll:
    """The files of one shard: written under temporary names, one after another."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, date: str):
        self.fs, self.path = files.FileSystem.from_uri(folder)
        self.shard, self.roll_bytes, self.date, self.out, self.done = shard, roll_bytes, date, None, []
        self.fs.create_dir(f"{self.path}/_temporary", recursive=True)

    def add(self, page: int | None, data: bytes) -> None:
        if self.out is not None and self.size >= self.roll_bytes:
            self.close()
        if self.out is None:
            number = len(self.done)
            self.name = f"part-{self.shard:05d}-{number:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.count, self.pages, self.hash = self.fs.open_output_stream(f"{self.path}/{self.temporary}", compression=None), 0, 0, [], hashlib.sha256()
            self._put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn("warcinfo", self.name)), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(data)
        self.count += 1
        self.pages = [self.pages[0] if self.pages else page, page]

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append({"shard": self.shard, "file": len(self.done), "name": self.name, "temporary": self.temporary, "bytes": self.size, "records": self.count, "first_page": self.pages[0], "last_page": self.pages[1], "sha256": self.hash.hexdigest()})
            self.out = None


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def write(pages: DataFrame, folder: str, least: int = 1000, shard_bytes: int = 8 << 20, most_shards: int = 16_384, roll_bytes: int = 64 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Archive ``pages`` (page_id, url, html) in a new folder; gives its manifest.

    Payloads of ``least`` bytes and more are written once. ``date`` stands in every record.
    """
    spark = pages.sparkSession
    plan = Planned(pages, least)
    shards, bounds = plan.sample(shard_bytes, most_shards)
    rows = plan.records().withColumn("at", order_key(F.col("page_id"), F.col("key"), F.col("copy")))
    shard_of = F.pandas_udf(lambda at: pd.Series([bisect_right(bounds, x) for x in at], dtype="int32"), "int")
    rows = rows.withColumn("shard", shard_of("at") if bounds else F.lit(0))
    columns = ["shard", "page_id", "url", "html", "key", "bytes", "sha1", "copy", "record_type", "refers_to"]
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "at", "url").select(*columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, done = None, []
        for part in slices(batches, 3):
            for row in part.to_pylist():
                if roll is None or roll.shard != row["shard"]:
                    if roll is not None:
                        roll.close()
                        done += roll.done
                    roll = _Roll(folder, row["shard"], roll_bytes, date)
                roll.add(row["page_id"], record(row, least, date))
        if roll is not None:
            roll.close()
            done += roll.done
        yield pa.RecordBatch.from_pylist(done, schema=_schema(MANIFEST))

    return _commit(spark, dealt.mapInArrow(tidy(work), MANIFEST), folder)


def _rename(folder: str, batch: pa.RecordBatch) -> None:
    """Temporary names to names; may be repeated, also by two tasks at once."""
    fs, path = files.FileSystem.from_uri(folder)
    for row in batch.to_pylist():
        try:
            fs.move(f"{path}/{row['temporary']}", f"{path}/{row['name']}")
        except FileNotFoundError:
            found = fs.get_file_info(f"{path}/{row['name']}")
            if found.type != files.FileType.File or found.size != row["bytes"]:
                raise


def _commit(spark: SparkSession, finished: DataFrame, folder: str) -> DataFrame:
    pending = f"{folder}/_pending-{uuid.uuid4().hex}"
    finished.write.parquet(f"{pending}/finished")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _rename(folder, batch)
            yield batch

    spark.read.parquet(f"{pending}/finished").mapInArrow(work, MANIFEST).drop("temporary").write.parquet(f"{pending}/manifest")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    final = path(f"{folder}/_manifest")
    # A rename to a folder that is there would move into it.
    if store.exists(final) or not store.rename(path(f"{pending}/manifest"), final):
        raise OSError(f"cannot commit {folder}: it has a manifest")
    store.delete(path(pending), True)
    store.delete(path(f"{folder}/_temporary"), True)
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``shard, file, name, bytes, records, first_page, last_page, sha256`` of every committed file."""
    return spark.read.parquet(f"{folder}/_manifest")


def members(block: Callable[[], bytes]) -> Iterator[bytes]:
    """The decompressed gzip members of a file that ``block`` gives part by part."""
    data = block()
    while data:
        decoder, out = zlib.decompressobj(31), []
        while not decoder.eof:
            data = data or block()
            if not data:
                raise ValueError("a record is cut off")
            out.append(decoder.decompress(data))
            data = decoder.unused_data
        yield b"".join(out)
        data = data or block()


def parsed(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields, HTTP head and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("this is no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """All records but file headers: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, record_id, date, name``.

    ``with_payload`` adds ``html``, null for revisits. A file or payload that
    does not fit its digest fails the job.
    """
    listed = manifest(spark, folder)
    spread = listed.select("name", "sha256").repartition(max(1, min(listed.count(), 16_384)))
    schema = _schema(RECORD)
    if with_payload:
        schema = schema.append(pa.field("html", pa.string()))

    def row_of(data: bytes, name: str) -> dict | None:
        fields, http, payload = parsed(data)
        if fields["WARC-Type"] == "warcinfo":
            return None
        kept = fields["WARC-Type"] == "response"
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
        if kept and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
            raise ValueError(f"{name}: the payload of {fields['WARC-Record-ID']} does not fit its digest")
        number = lambda of: int(fields[of]) if of in fields else None
        row = {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"), "payload_bytes": size, "payload_digest": digest, "record_id": fields["WARC-Record-ID"], "date": fields["WARC-Date"], "name": name}
        return row | {"html": payload.decode("utf-8", "surrogatepass") if kept else None} if with_payload else row

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = files.FileSystem.from_uri(folder)
        for batch in batches:
            for name, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, sha = [], 0, hashlib.sha256()
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:

                    def block(stream=stream, sha=sha) -> bytes:
                        sha.update(data := stream.read(1 << 20))
                        return data

                    for data in members(block):
                        row = row_of(data, name)
                        if row is not None:
                            rows.append(row)
                            held += len(data) if with_payload else 300
                        if held >= 1 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if sha.hexdigest() != want:
                    raise ValueError(f"{name} does not fit the digest in the manifest")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spread.mapInArrow(tidy(work), RECORD + ", html string" if with_payload else RECORD)
