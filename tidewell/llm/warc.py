"""WARC archives: captures are written as concurrent records and assembled from them again.

Each capture is a transaction of three records: the ``request``, its ``response`` (or a ``revisit`` of an
earlier response with the same payload) and a ``metadata`` record. Request and metadata name the response in
``WARC-Concurrent-To``. A file is gzipped WARC 1.1; Spark's own text writer commits it, a record's closing
blank lines being the separator of "lines", so that a task that runs again leaves no half-written file, in
any file system. Bytes that aren't UTF-8 pass as they are.

The reader takes a file as one stream, cuts records by ``Content-Length`` (payloads may hold anything, other
records too) and holds one record at a time. ``captures`` then groups records by the identifiers that their
concurrent-to fields name, in whichever direction and through whichever record of the transaction they point.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import scratch, stored, table

CRLF = "\r\n"
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records that a transaction is about; the others belong to one of them.
PRINCIPALS = ("response", "revisit", "resource")
#: Records of one file; a file is read by one task.
FILE_RECORDS = 60_000

_RECORD = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, declared_digest string, payload_bytes long, payload_digest string, payload binary, fields map<string,string>"
_RECORD_ARROW = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
    ("declared_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string())),
])


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1: five hex digits make four of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column) -> Column:
    """A record id that is the same whenever it is computed: a name-based UUID of the parts."""
    h = F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts)), 256)
    cut = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _header_value(text: Column) -> Column:
    """A value that stays on its line: control characters and spaces are percent-encoded."""
    code = lambda c: F.when(c.rlike(r"[\x00-\x20\x7f]"), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c)
    return F.when(text.rlike(r"[\x00-\x20\x7f]"), F.array_join(F.transform(F.split(text, ""), code), "")).otherwise(text)


def _field(name: str, value: Column) -> Column:
    """One header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _record(kind: Column | str, record_id: Column, block: Column, block_type: str, **fields: Column) -> Column:
    lines = [_field(name.replace("_", "-"), value) for name, value in fields.items()]
    kind = F.lit(kind) if isinstance(kind, str) else kind
    size = F.octet_length(block).cast("string")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit(CRLF), _field("WARC-Record-ID", record_id), *lines, F.lit(f"Content-Type: {block_type}\r\nContent-Length: "), size, F.lit(CRLF + CRLF), block
    )


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str | None = None) -> None:
    """Write three records for each row of ``pages`` to gzipped WARC files in ``path``.

    A null payload counts as empty. Of the rows with equal payloads of at least ``least_bytes`` bytes the one with
    the smallest id (null last, then the smallest address) holds the payload, the others revisit it; smaller payloads
    are all written. Repeated rows and rows that share an id are captures of their own. A null address leaves
    ``WARC-Target-URI`` out, a null id the metadata field. Other columns are not read. An empty table gives no records.

    Payloads travel once, one copy of each for every task that meets it; who revisits whom is found on digests.
    """
    when = F.lit(date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("uri"), body.alias("body"))
    rows = rows.withColumns({"sha": F.sha2("body", 256), "size": F.octet_length("body").cast("long"), "digest": base32_sha1(F.col("body"))})
    payload, alone = ["sha", "size", "digest"], F.col("size") < least_bytes
    place = F.struct(F.col("id").isNull().alias("none"), "id", F.col("uri").isNull().alias("bare"), "uri")
    copies = lambda first, n: F.explode(F.sequence(F.lit(first).cast("long"), n - 1)).alias("copy")
    # Payloads with their holders: each row of a small payload, the first row of another.
    held = rows.groupBy(*payload, F.when(alone, F.struct("id", "uri")).alias("own")).agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n"), F.any_value("body").alias("body"))
    responses = held.select(*payload, F.col("at.id").alias("id"), F.col("at.uri").alias("uri"), "body", F.lit(None).cast("struct<id:bigint,uri:string>").alias("of"), copies(0, F.when(alone, F.col("n")).otherwise(1)))
    counted = stored(rows.groupBy(*payload, "id", "uri").agg(F.count(F.lit(1)).alias("n")).where(~alone), "warc-ids")
    first = stored(counted.groupBy(*payload).agg(F.min(place).alias("at"), F.sum("n").alias("all")).where("all > 1").drop("all"), "warc-first")
    holder = F.col("id").eqNullSafe(F.col("at.id")) & F.col("uri").eqNullSafe(F.col("at.uri"))
    later = counted.join(first, payload).withColumn("from", F.when(holder, 1).otherwise(0).cast("long")).where(F.col("from") < F.col("n"))
    revisits = later.select(*payload, "id", "uri", F.lit(None).cast("string").alias("body"), F.struct(F.col("at.id").alias("id"), F.col("at.uri").alias("uri")).alias("of"), F.explode(F.sequence("from", F.col("n") - 1)).alias("copy"))
    both = responses.unionByName(revisits)
    urn = lambda of, copy: _urn(F.lit("page"), F.col(f"{of}id"), F.col(f"{of}uri"), F.col("sha"), copy)
    again = F.col("of").isNotNull()
    both = both.select("id", "body", "size", "digest", urn("", F.col("copy")).alias("own"), F.when(again, urn("of.", F.lit(0))).alias("target"), _header_value(F.col("uri")).alias("uri"), _header_value(F.col("of.uri")).alias("of_uri"))
    own, uri, target = F.col("own"), F.col("uri"), F.col("target")
    again = target.isNotNull()
    http = F.concat(F.lit(HTTP_OK + "Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF), F.coalesce("body", F.lit("")))
    main = _record(
        F.when(again, "revisit").otherwise("response"), own, http, "application/http; msgtype=response", WARC_Date=when, WARC_Target_URI=uri, WARC_Payload_Digest=F.concat(F.lit("sha1:"), F.col("digest")),
        WARC_Profile=F.when(again, F.lit(PROFILE)), WARC_Refers_To=target, WARC_Refers_To_Target_URI=F.when(again, F.col("of_uri")), WARC_Refers_To_Date=F.when(again, when),
    )
    asked = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + CRLF + CRLF))
    request = _record("request", _urn(F.lit("request"), own), asked, "application/http; msgtype=request", WARC_Date=when, WARC_Target_URI=uri, WARC_Concurrent_To=own)
    fields = F.concat(_field("page-id", F.col("id").cast("string")), F.lit("fetched-by: batch" + CRLF))
    metadata = _record("metadata", _urn(F.lit("metadata"), own), fields, "application/warc-fields", WARC_Date=when, WARC_Target_URI=uri, WARC_Concurrent_To=own)
    both.select(F.explode(F.array(request, main, metadata)).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)



_HEAD = re.compile(rb"WARC/1\.\d\r?\n")
#: Bytes without a record head after which they are given out as damaged.
_JUNK = 4 << 20
_FOLD = re.compile(rb"\r?\n[ \t]+")


def _headers(raw: bytes) -> dict[str, list[str]]:
    """Field names in lower case and their values, in order; continuation lines are joined."""
    fields: dict[str, list[str]] = {}
    for line in _FOLD.sub(b" ", raw).split(b"\n"):
        name, colon, value = line.partition(b":")
        if colon:
            fields.setdefault(name.strip().lower().decode("utf-8", "replace"), []).append(value.strip().decode("utf-8", "replace"))
    return fields


def _one(fields: dict[str, list[str]], name: str) -> str | None:
    return fields[name][0] if name in fields else None


def _entity(block: bytes) -> bytes:
    """The payload of an HTTP message: what follows its head."""
    at = block.find(b"\r\n\r\n")
    return block[at + 4 :] if at >= 0 else b""


def _row(fields: dict[str, list[str]], block: bytes) -> dict:
    kind, http = (_one(fields, "content-type") or ""), None
    payload = _entity(block) if kind.startswith("application/http") else block
    if kind.startswith("application/warc-fields"):
        http = [(k, v[0]) for k, v in _headers(block).items()]
    return {
        "record_id": _one(fields, "warc-record-id"), "type": _one(fields, "warc-type"), "concurrent_to": fields.get("warc-concurrent-to", []), "refers_to": _one(fields, "warc-refers-to"),
        "target_uri": _one(fields, "warc-target-uri"), "date": _one(fields, "warc-date"), "declared_digest": _one(fields, "warc-payload-digest"), "payload_bytes": len(payload),
        "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "payload": payload, "fields": http,
    }


class _Stream:
    """The records of one file, from the pieces of its bytes in order."""

    def __init__(self) -> None:
        self.waiting: list[bytes] = []
        self.size = self.need = 0

    def feed(self, data: bytes) -> Iterator[dict]:
        self.waiting.append(data)
        self.size += len(data)
        if self.size >= self.need:
            yield from self._cut(False)

    def end(self) -> Iterator[dict]:
        yield from self._cut(True)

    def _cut(self, last: bool) -> Iterator[dict]:
        data, at, self.need = b"".join(self.waiting), 0, 0
        while True:
            head = _HEAD.search(data, at)
            if head is None or (skipped := data[at : head.start()]).strip():
                # No record begins here: what was cut off or damaged is one row of that type.
                if head is None and not last:
                    if len(data) - at > _JUNK:
                        yield _row({"warc-type": ["damaged"]}, data[at:-16])
                        at = len(data) - 16
                    break
                lost = (data[at:] if head is None else skipped).strip()
                if lost:
                    yield _row({"warc-type": ["damaged"]}, lost)
                if head is None:
                    at = len(data)
                    break
            blank = re.compile(rb"\r?\n\r?\n").search(data, head.end() - 1)
            fields = _headers(data[head.end() : blank.start()]) if blank else {}
            length = _one(fields, "content-length") or ""
            size = int(length) if length.isdigit() else 0
            if blank is None or blank.end() + size > len(data):
                at = head.start()
                if not last:
                    self.need = blank.end() - at + size if blank else 0
                    break
                yield _row({**fields, "warc-type": ["damaged"]}, data[at:])
                at = len(data)
                break
            yield _row(fields, data[blank.end() : blank.end() + size])
            at = blank.end() + size
        self.waiting, self.size = [data[at:]], len(data) - at


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the WARC files in ``path`` (gzipped or not): identifiers, links and payload.

    ``payload`` is the entity of HTTP blocks and the block of others; its length and base32 SHA-1 are computed
    from its bytes, ``declared_digest`` is what the header says. ``fields`` holds application/warc-fields blocks.
    A record that is cut off, and bytes between records, are rows of type ``damaged``: nothing stops the rest of
    the file. Files that aren't gzipped must not be split: keep them below ``spark.sql.files.maxPartitionBytes``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, name, out, size = _Stream(), None, [], 0
        for batch in batches:
            names, lines = batch.column(0).dictionary_encode(), batch.column(1).to_pylist()
            codes = names.indices.to_numpy()
            edges = [0, *(i + 1 for i in (codes[1:] != codes[:-1]).nonzero()[0].tolist()), len(lines)]
            for a, b in zip(edges, edges[1:], strict=False):
                found = []
                if a < b and (here := names.dictionary[int(codes[a])].as_py()) != name:
                    found.extend(stream.end())
                    stream, name = _Stream(), here
                found.extend(stream.feed(b"\n".join([*lines[a:b], b""])))
                out += found
                size += sum(r["payload_bytes"] for r in found)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=_RECORD_ARROW)
                    out, size = [], 0
        out.extend(stream.end())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_RECORD_ARROW)

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(cut, _RECORD)


def captures(records: DataFrame, payloads: bool = True) -> DataFrame:
    """One nested row for each capture: capture_id, ``response`` (response, revisit or resource), ``requests``, ``metadata``.

    Records join through ``concurrent_to``: request and metadata may name the response, the response its request, or
    one the other; records of a transaction may lie in different files. First every record goes to the one that it
    names (or to its own id); groups without a response then follow the ids that whole groups mention. What finds no
    response stays as a capture with a null ``response``. Records without an id, warcinfo and damaged ones take no
    part. Without ``payloads`` no payload bytes are moved. Requests and metadata are in order of their ids.
    """
    kept = records.where(F.col("record_id").isNotNull() & ~F.col("type").isin("warcinfo", "damaged"))
    if not payloads:
        kept = kept.withColumn("payload", F.lit(None).cast("binary"))
    main = F.col("type").isin(*PRINCIPALS)
    side = F.struct("record_id", "target_uri", "date", "payload", "fields")
    said = F.struct("record_id", "type", "refers_to", "target_uri", "date", "declared_digest", "payload_bytes", "payload_digest", "payload")
    of_type = lambda kind: F.collect_list(F.when(F.col("type") == kind, side))
    parts = stored(
        kept.groupBy(F.coalesce(F.array_min("concurrent_to"), F.col("record_id")).alias("key")).agg(
            F.collect_list(F.when(main, said)).alias("mains"), of_type("request").alias("requests"), of_type("metadata").alias("metadata"),
            F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("record_id"), "concurrent_to")))).alias("mentioned"),
        ),
        "warc-parts",
    )
    lone = F.size("mains") == 0
    whole = parts.where(~lone).withColumn("capture_id", F.array_min(F.col("mains.record_id")))
    known = whole.select(F.explode("mentioned").alias("key"), "capture_id").where(F.col("key") != F.col("capture_id")).groupBy("key").agg(F.min("capture_id").alias("capture_id"))
    late = parts.where(lone).join(known, "key", "left").withColumn("capture_id", F.coalesce("capture_id", "key"))
    joined = whole.select("capture_id", "mains", "requests", "metadata").unionByName(late.select("capture_id", "mains", "requests", "metadata"))
    gather = lambda name: F.array_sort(F.flatten(F.collect_list(name)), lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)).alias(name)
    grouped = joined.groupBy("capture_id").agg(gather("mains"), gather("requests"), gather("metadata"))
    return grouped.select("capture_id", F.get("mains", F.lit(0)).alias("response"), "requests", "metadata")


def resolved(found: DataFrame) -> DataFrame:
    """Captures with ``of``: the row of the response that a revisit refers to (capture_id, metadata, payload_bytes, payload_digest).

    A revisit of a record that isn't among ``found`` has a null ``of``.
    """
    revisit = F.when(F.col("response.type") == "revisit", F.col("response.refers_to"))
    held = found.where(F.col("response.type") == "response").select(F.col("capture_id").alias("held"), F.struct("capture_id", "metadata", "response.payload_bytes", "response.payload_digest").alias("of"))
    return found.withColumn("wanted", revisit).join(held, F.col("wanted") == F.col("held"), "left").drop("wanted", "held")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_captures(table(spark, sf_dir, "pages"), path)
    page_id = lambda metadata: F.get(metadata, F.lit(0))["fields"]["page-id"].cast("long")
    found = stored(captures(read_records(spark, path), payloads=False).withColumn("page_id", page_id(F.col("metadata"))), "warc-captures")
    held = lambda name: F.coalesce(F.col(f"of.{name}"), F.col(f"response.{name}")).alias(name)
    return resolved(found).select("page_id", held("payload_bytes"), held("payload_digest"), F.col("response.type").alias("record_type"), page_id(F.col("of.metadata")).alias("refers_to"))


OP11_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
d AS (SELECT *, sha1(body) AS digest, row_number() OVER same AS k, first_value(page_id) OVER same AS held
      FROM p WINDOW same AS (PARTITION BY body ORDER BY page_id NULLS LAST, url NULLS LAST)),
groups AS (SELECT digest, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(digest, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT) + 1, 1), '' ORDER BY i) AS b32
      FROM (SELECT DISTINCT digest FROM d), range(32) r(i) GROUP BY digest)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, b32 AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN held END AS refers_to
FROM d JOIN groups USING (digest)
"""
