"""WARC archives written and read as tables of record chunks.

The writer is a projection: each page becomes one record, or one ``response`` and further ``continuation`` records where
its block exceeds ``chunk_bytes``; a record's chunks are rows that are cut from the payload one by one, and no record is
ever put together. Spark's text writer puts CRLF CRLF after every row, which is how WARC ends a record,
so archives go to any store that Spark can write, in files that are compressed as a whole.
The reader splits files at CRLF CRLF, puts the byte stream together again and follows Content-Length, so that payloads
may hold anything. It yields a row (record_id, chunk_no) for each chunk, with the digest of the payload so far, and
never holds more of a payload than one chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.hot import spread_join
from tallyloom.llm.scratch import materialize, text_batches

#: Bytes of block in a record before it is continued in another; least payload that may be a revisit; repeated digests (some 100 bytes each) that are broadcast.
CHUNK_BYTES, MIN_REVISIT, BROADCAST_DIGESTS = 1 << 16, 100, 100_000
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Columns id, url, payload (binary), payload_bytes, payload_digest, record_type and refers_to, for each row of ``pages``.

    Null payloads are empty. Of equal payloads of ``min_revisit`` bytes or more, that of the smallest id is the response
    and those of other ids revisit it; rows that repeat that id with that payload are responses too. Rows without an id
    are never referred to. Only digests and ids are shuffled to find the first of each payload. Digests that occur several
    times are written to a table of one row each and joined: by broadcast while there are BROADCAST_DIGESTS of them at most,
    so that payloads stay where they were read; beyond that by digest, split where many pages share a payload.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    found = rows.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    found = materialize(found, "warc-repeats")
    first = found.select("payload_digest", "first")
    if found.count() <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(first), "payload_digest", "left")
    else:
        joined = spread_join(rows, first, ["payload_digest"], ["id"], counts=found.select("payload_digest", "n"), how="left")
    again = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first")))
    return joined.select("id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _header(*fields: tuple[str, Column]) -> Column:
    """Header lines; fields that are null are left out."""
    lines = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))) for name, value in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(x, F.lit("")) for x in lines])


def write_archives(found: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write what ``records`` returns as gzipped WARC files under ``path``."""
    # A block is the HTTP header and, in a response, the payload; it is cut into chunks without being put together.
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n")).cast("binary")
    name = F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.substring("payload_digest", 1, 16))
    size = F.octet_length(http) + F.when(F.col("record_type") == "response", F.octet_length("payload")).otherwise(0)
    rows = found.withColumns({"http": http, "name": name, "size": size}).withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("size") / chunk_bytes)).cast("int"))
    part = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    # Where the chunk's payload starts, before 0 for what of the chunk is HTTP header.
    at = F.col("k") * chunk_bytes - F.octet_length("http")
    head = F.substring(F.col("http"), F.col("k") * chunk_bytes + 1, F.lit(chunk_bytes))
    body = F.substring(F.col("payload"), F.greatest(F.lit(0), at) + 1, F.greatest(F.lit(0), F.least(F.lit(chunk_bytes), at + chunk_bytes)))
    piece = F.concat(head, F.when(F.col("record_type") == "response", body).otherwise(F.lit(b"")))
    first, many = F.col("k") == 0, F.col("n") > 1
    own = F.when(first, F.col("name")).otherwise(F.concat(F.col("name"), F.lit(":"), F.col("k").cast("string")))
    header = _header(
        ("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        ("WARC-Record-ID", F.concat(F.lit("<"), own, F.lit(">"))),
        ("WARC-Date", F.lit(_DATE)),
        ("WARC-Target-URI", F.when(first, F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"))),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), F.col("payload_digest")))),
        ("WARC-Profile", F.when(F.col("record_type") == "revisit", _PROFILE)),
        ("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("<urn:x-page:"), F.col("refers_to").cast("string"), F.lit(":"), F.substring("payload_digest", 1, 16), F.lit(">")))),
        ("WARC-Segment-Number", F.when(many, (F.col("k") + 1).cast("string"))),
        ("WARC-Segment-Origin-ID", F.when(~first, F.concat(F.lit("<"), F.col("name"), F.lit(">")))),
        ("WARC-Segment-Total-Length", F.when(many & (F.col("k") == F.col("n") - 1), F.col("size").cast("string"))),
        ("X-Page-Id", F.when(first, F.col("id").cast("string"))),
        ("X-Payload-Bytes", F.when(first, F.col("payload_bytes").cast("string"))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length(piece).cast("string")),
    )
    line = F.concat(header.cast("binary"), F.lit(b"\r\n"), piece).cast("string")
    part.select(line.alias("value")).write.option("lineSep", _END.decode()).option("compression", "gzip").text(path)


class ChunkReader:
    """Follows the byte stream of one archive; ``feed`` yields (record, chunk) with a record's state up to that chunk."""

    def __init__(self) -> None:
        self.buffer, self.left, self.tail = b"", 0, 0
        self.record: dict | None = None

    def feed(self, data: bytes) -> Iterator[dict]:
        at = 0
        while at < len(data):
            if self.left:
                part = data[at : at + self.left]
                at += len(part)
                self.left -= len(part)
                yield from self._block(part)
            elif self.tail:
                step = min(self.tail, len(data) - at)
                if data[at : at + step] != _END[4 - self.tail : 4 - self.tail + step]:
                    raise ValueError("a record does not end in CRLF CRLF")
                at += step
                self.tail -= step
            else:
                known = len(self.buffer)
                self.buffer += data[at:]
                if (cut := self.buffer.find(_END, max(0, known - 3))) < 0:
                    return
                # Line ends before a record do not count: a file whose last payload ends in CRLF seems to have some.
                head, self.buffer = self.buffer[:cut], b""
                at += cut + 4 - known
                if not head.strip(b"\r\n"):
                    continue
                yield from self._start(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]))

    def close(self) -> None:
        """At a file's end: everything must be complete; line ends after the last record do not matter."""
        if self.left or self.buffer.strip(b"\r\n") or (self.record and self.record["length"] != self.record["seen"]):
            raise ValueError("the archive ends inside a record")

    def _start(self, head: dict[str, str]) -> Iterator[dict]:
        self.left, self.tail = int(head["Content-Length"]), 4
        if head["WARC-Type"] != "continuation":
            page, refers = head.get("X-Page-Id"), head.get("WARC-Refers-To")
            size = int(head["X-Payload-Bytes"])
            self.record = {
                "record_id": head["WARC-Record-ID"].strip("<>"), "type": head["WARC-Type"], "page": page, "refers": refers and refers.strip("<>").split(":")[2], "url": head.get("WARC-Target-URI"),
                "declared": head["WARC-Payload-Digest"].removeprefix("sha256:"), "size": size, "length": size if head["WARC-Type"] == "response" else 0, "seen": 0, "chunk": 0, "http": b"", "hash": hashlib.sha256(),
            }
        elif self.record is None or head["WARC-Segment-Origin-ID"].strip("<>") != self.record["record_id"]:
            raise ValueError("a continuation does not follow its record")
        if not self.left:
            yield from self._block(b"")

    def _block(self, part: bytes) -> Iterator[dict]:
        r = self.record
        if r["http"] is not None:  # the HTTP header comes first and is small
            r["http"] += part
            if (cut := r["http"].find(_END)) < 0:
                return
            part, r["http"] = r["http"][cut + 4 :], None
        elif not part:
            return
        r["seen"] += len(part)
        r["hash"].update(part)
        last = r["seen"] == r["length"]
        digest = r["hash"].copy().hexdigest()
        if last and r["type"] == "response" and digest != r["declared"]:
            raise ValueError(f"{r['record_id']}: the payload has another digest than its header says")
        yield r | {"data": part, "last": last, "digest": digest if r["type"] == "response" else r["declared"]}
        r["chunk"] += 1


#: Columns of the chunk table.
SCHEMA = "record_id string, chunk_no int, page_id string, url string, record_type string, refers_to string, bytes_so_far long, digest_so_far string, payload_bytes long, is_last boolean"


def read_chunks(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives under ``path``: SCHEMA, and ``data`` (binary) if asked for.

    ``digest_so_far`` is the SHA-256 of the payload up to and with the chunk; in a revisit, whose payload is elsewhere,
    the digest that its header gives. A digest that is not the header's, or a cut archive, raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        reader, current = ChunkReader(), None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 11
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)] + ([pa.array(columns[10], pa.binary())] if with_data else [])
            return pa.RecordBatch.from_arrays(arrays, names + ["data"] * with_data)

        rows, held = [], 0
        for batch in batches:
            for piece, file in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if file != current:
                    reader.close()
                    reader, current = ChunkReader(), file
                data = piece.as_buffer().to_pybytes() + _END
                for x in reader.feed(data):
                    rows.append((x["record_id"], x["chunk"], x["page"], x["url"], x["type"], x["refers"], x["seen"], x["digest"], x["size"], x["last"], x["data"]))
                    held += len(x["data"]) if with_data else 0
                    if held > 8_000_000 or len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows, held = [], 0
        reader.close()
        yield batch_of(rows)

    text_batches(spark)
    # A gzipped file is read by one task from its start to its end.
    text = spark.read.option("lineSep", _END.decode()).text(path)
    pieces = text.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"))
    return pieces.mapInArrow(run, SCHEMA + ", data binary" * with_data)


def round_trip(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``pages`` written to archives under ``path`` and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, n_chunks."""
    write_archives(records(pages), path, chunk_bytes)
    id_type = pages.schema["page_id"].dataType.simpleString()
    last = read_chunks(pages.sparkSession, path, with_data=False).where("is_last")
    return last.select(
        F.col("page_id").cast(id_type).alias("page_id"), "payload_bytes", F.col("digest_so_far").alias("payload_digest"), "record_type", F.col("refers_to").cast(id_type).alias("refers_to"), (F.col("chunk_no") + 1).alias("n_chunks")
    )


ORACLE_SQL = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages
), digests AS (
  SELECT page_id, payload_bytes, sha256(html) AS payload_digest FROM rows
), first AS (
  SELECT payload_digest, min(page_id) AS first FROM digests WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM digests d LEFT JOIN first f ON d.payload_digest = f.payload_digest
"""
