"""WARC archives written from and read to a chunked record table.

A payload is rows of (record, chunk number, at most a segment's bytes) from the moment it is
read, so no later step holds a record as a whole, and digests are carried from chunk to chunk.

Writing. Chunk rows get running digests; of equal payloads (SHA-256 and length) the record
with the largest id is a response, the others revisit it and send no payload. A payload of
several segments becomes a record and its continuations, as the format provides for. Spark's
text writer writes the files, with the end of a record as the end of a line, gzipped.

Reading. Spark's text reader streams the files as lines, and a parser in the task keeps the
state of the record it is in, whose payload it passes on in chunks as it comes. Segments of
one record, which may lie in any files, meet in order for their digest, chunk by chunk.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memberlens.llm.scratch import Scratch

#: Bytes of payload in one WARC record, and so in a chunk row.
SEGMENT = 1 << 20
#: Bytes of an HTTP header, at most; where a block has no end of it within, all is payload.
HTTP_HEAD = 1 << 20
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_rows(rows: DataFrame, *, id: str, url: str, payload: str, segment: int = SEGMENT) -> DataFrame:
    """row (a number), id, uri, chunk, last and body of every payload; a null one is empty."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    given = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(url).alias("uri"), body.alias("body")
    )
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / segment)).cast("int")
    cut = F.expr(f"substring(body, chunk * {segment} + 1, {segment})")
    return given.withColumn("n", n).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "row", "id", "uri", "chunk", (F.col("chunk") == F.col("n") - 1).alias("last"),
        F.when(F.col("n") == 1, F.col("body")).otherwise(cut).alias("body"),
    )


def with_digests(chunks: DataFrame) -> DataFrame:
    """The last chunk of each payload gets its size, SHA-1 and SHA-256, carried from chunk to chunk."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long, size = hashlib.sha1(), hashlib.sha256(), 0
        for batch in batches:
            sizes, shorts, longs = [], [], []
            for body, last in zip(batch.column("body"), batch.column("last").to_pylist(), strict=True):
                piece = body.as_buffer()
                short.update(piece)
                long.update(piece)
                size += piece.size
                sizes.append(size if last else None)
                shorts.append(base32(short.digest()) if last else None)
                longs.append(long.hexdigest() if last else None)
                if last:
                    short, long, size = hashlib.sha1(), hashlib.sha256(), 0
            more = [pa.array(sizes, pa.int64()), pa.array(shorts, pa.string()), pa.array(longs, pa.string())]
            names = [*batch.schema.names, "size", "sha1", "sha256"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInArrow(digest, f"{kinds}, size bigint, sha1 string, sha256 string")


def _decided(chunks: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """row, size, sha1, and for a revisit the row it refers to."""
    keys = scratch.saved(chunks.filter("last").select("row", "id", "size", "sha1", "sha256"))
    best = F.max(F.struct(F.col("id").isNotNull(), F.col("id"), F.col("row").alias("row")))
    # A table of its own, so that a join on a payload that very many share can be split.
    first = scratch.saved(
        keys.filter(F.col("size") >= least).groupBy("sha256", "size").agg(best.alias("best")).select("*", F.col("best.row").alias("first")).drop("best")
    )
    refers = F.when(F.col("first") != F.col("row"), F.col("first")).alias("refers")
    return scratch.saved(keys.join(first, ["sha256", "size"], "left").select("row", "size", "sha1", refers))


def _urn(run: str, row: Column, chunk: Column) -> Column:
    """A record id, the same whenever a task is run again."""
    digest = F.md5(F.concat_ws("/", F.lit(run), row, chunk))
    parts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; line ends inside are written as in URIs."""
    text = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), text, F.lit("\r\n")), F.lit(""))


def _records(chunks: DataFrame, run: str, date: str) -> DataFrame:
    """The records' text, from chunk rows with their row's decision."""
    row, chunk, revisit = F.col("row"), F.col("chunk"), F.col("refers").isNotNull()
    first, several = chunk == 0, ~(F.col("last") & (chunk == 0))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit("\r\n\r\n"),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("body").cast("string"))
    block = F.when(first, F.concat(http, body)).otherwise(body)
    segmented = several & ~revisit
    total = F.octet_length(http) + F.col("size")
    fields = [
        ("WARC-Type", F.when(revisit, "revisit").when(first, "response").otherwise("continuation")),
        ("WARC-Record-ID", _urn(run, row, chunk)),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("uri")),
        ("WARC-Source-ID", F.when(first, F.col("id").cast("string"))),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("sha1")))),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("WARC-Refers-To", F.when(revisit, _urn(run, F.col("refers"), F.lit(0)))),
        ("WARC-Segment-Number", F.when(segmented, chunk + 1)),
        ("WARC-Segment-Origin-ID", F.when(~first, _urn(run, row, F.lit(0)))),
        ("WARC-Segment-Total-Length", F.when(segmented & F.col("last"), total)),
        ("Content-Type", F.when(first, "application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block)),
    ]
    head = F.concat(F.lit("WARC/1.1\r\n"), *[_field(n, v) for n, v in fields], F.lit("\r\n"))
    return chunks.filter(first | ~revisit).select(F.concat(head, block).alias("value"))


def write(
    rows: DataFrame,
    folder: str,
    *,
    id: str,
    url: str,
    payload: str,
    least: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    segment: int = SEGMENT,
) -> None:
    """Writes a record for every row to gzipped archives in ``folder``, which must not exist.

    Payloads of ``least`` bytes or more are written once: of equal ones the record with the
    largest id is the response (null ids come last, of rows that repeat an id any one), and
    the others revisit it. A null payload is empty, a null url or id leaves its field out; rows that repeat are
    records each. ``WARC-Source-ID`` keeps the row's id. Other columns are not looked at. An
    empty table makes a folder without records.
    """
    scratch = Scratch(rows.sparkSession)
    try:
        chunks = with_digests(chunk_rows(rows, id=id, url=url, payload=payload, segment=segment))
        chunks = scratch.saved(chunks, compression="zstd")
        decided = _decided(chunks, least, scratch)
        placed = chunks.drop("size", "sha1", "sha256").join(decided, "row").sortWithinPartitions("row", "chunk")
        run = scratch.folder.rsplit("/", 1)[-1]
        text = _records(placed, run, date)
        text.write.option("lineSep", END.decode()).option("compression", "gzip").text(folder)
    finally:
        scratch.remove()


# What the parser says of a record, in the rows that read() returns.
SAID = {"source": "warc-source-id", "uri": "warc-target-uri", "refers": "warc-refers-to", "stated": "warc-payload-digest"}
READ = (
    "record string, kind string, source string, uri string, refers string, stated string,"
    " segment int, chunk int, last boolean, body binary, size bigint, digest string"
)
NAMES = [part.split()[0] for part in READ.split(",")]


class Parser:
    """The records of one file, from its bytes as they come; ``rows`` are chunk rows to fetch."""

    def __init__(self, bodies: bool):
        self.bodies, self.rest, self.left, self.rows = bodies, b"", None, []

    def feed(self, data: bytes) -> None:
        data, at = self.rest + data, 0
        while True:
            if self.left is None:
                while data[at : at + 1] in (b"\r", b"\n"):
                    at += 1
                end = data.find(END, at)
                if end < 0:
                    break
                self._open(data[at:end])
                at = end + len(END)
            if self.http:
                end = data.find(END, at, at + self.left)
                if end < 0 and len(data) - at < min(self.left, HTTP_HEAD):
                    break
                self.http = False
                if end >= 0:
                    self.left -= end + len(END) - at
                    at = end + len(END)
            take = min(self.left, len(data) - at)
            self._payload(data, at, at + take)
            at += take
            self.left -= take
            if self.left:
                break
            self._close()
        self.rest = data[at:]

    def end(self) -> None:
        if self.left is not None or self.rest.strip():
            raise ValueError("an archive ends within a record")

    def _open(self, head: bytes) -> None:
        version, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {version[:40]!r}")
        said = {}
        for line in lines:
            name, _, value = line.partition(":")
            said[name.strip().lower()] = value.strip()
        self.left = int(said["content-length"])
        kind, segment = said.get("warc-type"), said.get("warc-segment-number")
        self.segment = int(segment) if segment else None
        self.http = kind == "response" and said.get("content-type", "").startswith("application/http")
        self.http |= kind == "revisit" and said.get("content-type", "").startswith("application/http")
        self.said = [said.get("warc-segment-origin-id") or said.get("warc-record-id"), kind]
        self.said += [said.get(name) for name in SAID.values()]
        self.chunk, self.size, self.sha1, self.held = 0, 0, hashlib.sha1(), b""

    def _payload(self, data: bytes, lo: int, hi: int) -> None:
        view = memoryview(data)
        keep = self.bodies or self.segment is not None
        for a in range(lo, hi, SEGMENT):
            piece = view[a : min(hi, a + SEGMENT)]
            self.sha1.update(piece)
            self.size += len(piece)
            if keep:
                if self.held:
                    self._row(False, self.held)
                self.held = bytes(piece)

    def _row(self, last: bool, body: bytes) -> None:
        digest = base32(self.sha1.digest()) if last else None
        kept = body if self.bodies or self.segment is not None else None
        size = self.size if last else None
        self.rows.append((*self.said, self.segment, self.chunk, last, kept, size, digest))
        self.chunk += 1

    def _close(self) -> None:
        self._row(True, self.held)
        self.left = None


def _in_order(spark: SparkSession, folder: str) -> DataFrame:
    """file and line: every file's lines one after the other in one task.

    Gzipped files are read whole by a task as they are; others may be split, and meet again.
    """
    lines = spark.read.option("lineSep", "\n").text(folder)
    file, line = F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    if listed.filter(~F.col("path").endswith(".gz")).isEmpty():
        return lines.select(file, line)
    place = [F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    split = lines.select(file, line, *place)
    return split.repartition("file").sortWithinPartitions("file", "block", "at").select("file", "line")


def read(spark: SparkSession, folder: str, *, bodies: bool = True) -> DataFrame:
    """Chunk rows of all records in the archives of a folder, gzipped or plain.

    ``record`` is the record's id (for a continuation that of its first segment), ``segment``
    is null for a payload that one record holds, and ``chunk`` counts within the record. The
    last chunk has the size and digest of what the record holds; HTTP headers are left out.
    Without ``bodies``, only payloads of several segments, whose digest is still to be made,
    come with their bytes. A file that ends within a record raises an error.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, own = Parser(bodies), None
        schema = pa.schema([(n, _ARROW.get(n, pa.string())) for n in NAMES])
        for batch in batches:
            files = batch.column(0).to_numpy()
            cuts = [0, *(files[1:] != files[:-1]).nonzero()[0] + 1, len(files)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi <= lo:
                    continue
                if files[lo] != own:
                    parser.end()
                    rows, parser, own = parser.rows, Parser(bodies), files[lo]
                    parser.rows = rows
                parser.feed(b"\n".join(batch.column(1).slice(lo, hi - lo).to_pylist()) + b"\n")
            if parser.rows:
                columns = [pa.array(c, schema.field(k).type) for k, c in enumerate(zip(*parser.rows, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                parser.rows = []
        parser.end()

    return _in_order(spark, folder).mapInArrow(parse, READ)


_ARROW = {
    "segment": pa.int32(), "chunk": pa.int32(), "last": pa.bool_(), "body": pa.binary(), "size": pa.int64(),
}


def _joined(chunks: DataFrame) -> DataFrame:
    """record, size and digest of payloads of several segments."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha1, size = None, None, 0

        def row() -> pa.RecordBatch:
            columns = [pa.array([own]), pa.array([size], pa.int64()), pa.array([base32(sha1.digest())])]
            return pa.RecordBatch.from_arrays(columns, names=["record", "size", "digest"])

        for batch in batches:
            for record, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if record != own:
                    if own is not None:
                        yield row()
                    own, sha1, size = record, hashlib.sha1(), 0
                piece = body.as_buffer()
                sha1.update(piece)
                size += piece.size
        if own is not None:
            yield row()

    placed = chunks.filter("segment is not null").repartition("record").sortWithinPartitions("record", "segment", "chunk")
    return placed.select("record", "body").mapInArrow(digest, "record string, size bigint, digest string")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of a payload: record, kind, source, uri, stated, size, digest, refers, refers_source.

    ``size`` and ``digest`` are those of the payload that was read; a revisit has those of the
    record it refers to, or nulls where that is not among the archives. ``stated`` is what the header says.
    """
    scratch, kept = Scratch(spark), Scratch(spark)
    try:
        chunks = scratch.saved(read(spark, folder, bodies=False))
        about = ["record", "kind", "source", "uri", "stated", "refers"]
        whole = chunks.filter("last and segment is null").select(*about, "size", "digest")
        first = chunks.filter("last and segment = 1").select(*about).join(_joined(chunks), "record")
        records = scratch.saved(whole.unionByName(first))
        payloads = records.filter("kind = 'response'").select(
            F.col("record").alias("refers"), F.col("source").alias("refers_source"), "size", "digest"
        )
        revisits = records.filter("kind = 'revisit'").drop("size", "digest").join(payloads, "refers", "left")
        others = records.filter("kind <> 'revisit'").withColumn("refers_source", F.lit(None).cast("string"))
        return kept.saved(others.unionByName(revisits))
    finally:
        scratch.remove()
