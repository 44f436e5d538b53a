"""WARC archives: a deterministic sharded writer, and a reader.

Rows are cut into shards by ranges of page_id whose bounds come from exact histograms
of payload bytes, so the same table gives the same files. Each shard is sorted and
written record by record, a gzip member each, and a file is closed once its compressed
size reaches the limit. Headers, identifiers and digests are made from the payload.

Commit: tasks write under temporary names and return a manifest row for each file.
Spark's own commit of the manifest table chooses one attempt of each task; the chosen
files are then renamed, which can be repeated after a loss, and the final manifest
is written last. Files that no manifest names are leftovers of lost attempts.

The folder is a URI that pyarrow's file systems open (file, hdfs, s3, gs); by default it
lies in the session's shared folder.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peagelens.session import fresh_path, settle

#: A file is closed at so many compressed bytes; a shard holds about so many payload bytes,
#: more where there would be more than so many shards.
ROLL, SHARD, MOST_SHARDS = 32 << 20, 64 << 20, 10_000
#: Equal payloads of at least so many bytes become revisits.
LEAST = 100
#: The table has no fetch times; records carry this one.
DATE = "1970-01-01T00:00:00Z"
_LEVEL = 6
_FINER = 16
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

MANIFEST = "shard long, file long, temporary string, records long, bytes long, sha256 string, first_page long, last_page long"


def payload_facts(pages: DataFrame) -> DataFrame:
    """(page_id, digest, bytes) for each row; a null html is an empty payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))


def originals(facts: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, original) for pages whose payload is that of another row.

    The smallest page_id of a payload is its original; a null id is never smaller than
    a known one. The join sees ids and digests only; a payload that a third of all
    rows share is summed up before the shuffle and its rows are split by Spark.
    """
    groups = facts.where(F.col("bytes") >= least).groupBy("digest")
    shared = groups.agg(F.count("*").alias("n"), F.min("page_id").alias("original")).where(F.col("n") > 1)
    return facts.select("page_id", "digest").join(shared.drop("n"), "digest").distinct()


def shard_bounds(facts: DataFrame, shard_bytes: int = SHARD, most: int = MOST_SHARDS) -> list[int]:
    """First page_id of each shard but the first, from exact sums of bytes by id range.

    Ids are counted into equal ranges; ranges of more than a shard's bytes are counted again in
    finer ones, all of a level in one pass over the small facts, until they fit or are
    single ids. The driver sees some sums for each shard, and shards grow before
    their number passes ``most``.
    """
    low, high, total = facts.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    if low is None:
        return []
    limit = max(shard_bytes, -(-total // most))
    width = -(-(high - low + 1) // (4 * most))
    page = F.col("page_id").cast("decimal(20,0)")

    def into(start: Column, step: int) -> Column:
        return start + F.floor((page - start) / F.lit(step).cast("decimal(20,0)")) * step

    known = facts.where(F.col("page_id").isNotNull())
    rows = known.select("page_id", "bytes", into(F.lit(low).cast("decimal(20,0)"), width).cast("decimal(20,0)").alias("start"))
    final: list[tuple[int, int]] = []
    while True:
        sums = [(int(r["start"]), r["s"]) for r in rows.groupBy("start").agg(F.sum("bytes").alias("s")).collect()]
        full = [(a, s) for a, s in sums if s > limit and width > 1]
        final += [x for x in sums if x not in set(full)]
        if not full:
            break
        width = -(-width // _FINER)
        again = facts.sparkSession.createDataFrame([(a,) for a, _ in full], "a long")
        again = again.select(F.col("a").cast("decimal(20,0)").alias("start"))
        finer = rows.join(again, "start").select("page_id", "bytes", into(F.col("start"), width).cast("decimal(20,0)").alias("start"))
        rows = settle(finer, "warc-ranges")
    bounds, filled = [], 0
    for at, size in sorted(final):
        if filled and filled + size > limit:
            bounds.append(at)
            filled = 0
        filled += size
    return bounds


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, original: tuple | None) -> bytes:
    """One WARC record; ``original`` is (page_id,) of the record that a revisit refers to."""
    block = _HTTP % len(payload) + (b"" if original else payload)
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if original else 'response'}",
        f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page is None else page}",
    ]
    if original:
        lines += [
            f"WARC-Profile: {_REVISIT}",
            f"WARC-Refers-To: {record_id(original[0], digest)}",
            f"X-Refers-To-Page: {'' if original[0] is None else original[0]}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Files:
    """Files of the current shard of a task, rolled by compressed size."""

    def __init__(self, folder: str, roll: int):
        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.roll, self.attempt, self.out, self.rows = roll, uuid.uuid4().hex, None, []
        self.shard = self.number = -1

    def add(self, shard: int, page: int | None, raw: bytes) -> None:
        if self.out is not None and (shard != self.shard or self.size >= self.roll):
            self.close()
        if self.out is None:
            self.number = self.number + 1 if shard == self.shard else 0
            self.shard, self.size, self.count, self.first = shard, 0, 0, page
            self.name = f"_temporary/{shard:06d}-{self.number:06d}-{self.attempt}"
            self.out, self.sum = self.system.open_output_stream(f"{self.root}/{self.name}", compression=None), hashlib.sha256()
        z = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        self.out.write(member)
        self.sum.update(member)
        self.size, self.count, self.last = self.size + len(member), self.count + 1, page

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.rows.append((self.shard, self.number, self.name, self.count, self.size, self.sum.hexdigest(), self.first, self.last))


def write_warc(pages: DataFrame, folder: str | None = None, roll: int = ROLL, shard_bytes: int = SHARD, least: int = LEAST) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files and return the final manifest.

    Rows are written by page_id, then payload digest, null ids last. Of rows alike in
    both, the first is a response and the rest revisit it, if the payload is long enough;
    short payloads are all responses. An empty table gives no file.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1] + "/_temporary", recursive=True)
    facts = settle(payload_facts(pages), "warc-facts")
    bounds = np.array(shard_bounds(facts, shard_bytes), np.int64)

    @F.pandas_udf("long")
    def shard_of(page: pd.Series) -> pd.Series:
        known = page.notna().to_numpy()
        out = np.full(len(page), len(bounds), np.int64)
        out[known] = np.searchsorted(bounds, page[known].astype("int64").to_numpy(), "right")
        return pd.Series(out)

    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    marks = originals(facts, least).select(
        "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"),
        "digest", "original", F.lit(0).alias("kind"),
    )
    rows = rows.withColumn("original", F.lit(None).cast("long")).withColumn("kind", F.lit(1))
    both = marks.unionByName(rows).withColumn("shard", shard_of("page_id"))
    # Each shard is a partition of its own, so none waits behind another in one task.
    dealt = both.repartitionById(len(bounds) + 1, F.col("shard").cast("int")).sortWithinPartitions(
        "shard", F.col("page_id").asc_nulls_last(), "digest", "kind", F.col("url").asc_nulls_first()
    )
    dealt = dealt.select("shard", "page_id", "digest", "kind", "original", "url", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, mark, seen = _Files(folder, roll), None, None
        for batch in batches:
            for shard, page, digest, kind, original, url, payload in zip(*(_values(c) for c in batch.columns)):
                if kind == 0:
                    mark, seen = (page, digest, original), False
                    continue
                refers = None
                if mark is not None and mark[:2] == (page, digest):
                    first = mark[2] == page and not seen
                    seen, refers = True, None if first else (mark[2],)
                files.add(shard, page, record(page, url, payload, digest, refers))
        files.close()
        if files.rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in files.rows], schema)

    empty = spark.createDataFrame([], MANIFEST)
    names = empty.columns
    schema = pa.schema([(f, pa.string() if t == "string" else pa.int64()) for f, t in empty.dtypes])
    chosen = settle(dealt.mapInArrow(run, MANIFEST), "warc-manifest")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            final = []
            for r in batch.to_pylist():
                final.append(f"{r['shard']:06d}-{r['file']:06d}.warc.gz")
                if system.get_file_info(f"{root}/{r['temporary']}").type != fs.FileType.NotFound:
                    system.move(f"{root}/{r['temporary']}", f"{root}/{final[-1]}")
                if system.get_file_info(f"{root}/{final[-1]}").size != r["bytes"]:
                    raise OSError(f"{root}/{final[-1]} is not the file of the manifest")
            at = batch.schema.get_field_index("temporary")
            yield batch.set_column(at, "temporary", pa.array(final, pa.string()))

    named = chosen.mapInArrow(rename, MANIFEST).withColumnRenamed("temporary", "name")
    path = f"{folder}/manifest"
    named.withColumn("folder", F.lit(folder)).write.parquet(path)
    return spark.read.parquet(path)


def _values(column: pa.Array) -> Iterator:
    """Items of a column one by one, so that payloads are not all copied at once."""
    return (x.as_py() for x in column)


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each member of a gzip stream read in pieces."""
    z, raw, data = zlib.decompressobj(31), bytearray(), b""
    while data or (data := stream.read(1 << 20)):
        raw += z.decompress(data)
        data = b""
        if z.eof:
            head, _, rest = bytes(raw).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
                raise ValueError(f"record {fields['WARC-Record-ID']} has a wrong length")
            yield fields, rest[:size]
            data, raw = z.unused_data, bytearray()
            z = zlib.decompressobj(31)
    if raw:
        raise ValueError("the archive ends inside a record")


def read_warc(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record.

    Each file of the manifest is read by one task; lengths, block digests and the payload
    digests of responses are verified, and a difference is an error.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda text: int(text) if text else None
        kinds = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for row in batch.to_pylist():
                system, root = fs.FileSystem.from_uri(row["folder"])
                out, held = [], 0
                with system.open_input_stream(f"{root}/{row['name']}", compression=None) as stream:
                    for fields, block in _records(stream):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if fields["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                        kind = fields["WARC-Type"]
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"record {fields['WARC-Record-ID']} has a wrong digest")
                        size = int(head.rsplit(b"Content-Length: ", 1)[1])
                        refers = number(fields.get("X-Refers-To-Page", ""))
                        whole = payload if kind == "response" else None
                        out.append((number(fields["X-Page-Id"]), fields["WARC-Target-URI"], size, digest, kind, refers, whole))
                        held += len(payload)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    files = manifest.select("folder", "name")
    tasks = max(1, files.count())
    return files.repartition(min(tasks, 10_000), "name").mapInArrow(run, schema)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages and read them back: one row per record, without the payloads."""
    return read_warc(write_warc(pages, **options)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
