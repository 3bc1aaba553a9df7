"""WARC: page captures as request, response or revisit, and metadata records; reading joins them again.

``write`` makes three records for each row of a page table and writes them with
Spark's text sink: a record ends with two line ends, the second of which is the
sink's line separator, so the files are plain WARC/1.1 in gzip, and Spark's
commit protocol keeps exactly one copy of what a task wrote.  A payload that an
earlier page has is not written again: its record is a revisit, which names the
payload by its digest.

``records`` reads any gzip archives of WARC 1.0 or 1.1: Spark cuts them at
``WARC/1.``, and a task puts together again what a payload with that text made
several pieces of, by the record's Content-Length.  ``captures`` is the
transaction assembly: requests and metadata are joined to the response, revisit
or resource record that their WARC-Concurrent-To names (or that names them), and
each capture is one nested row.

Defined cases: a null payload is an empty one; a null page_id is written
without one and read as null, and never the one that others refer to while
another has the payload; of rows that share the smallest page_id and the
payload, each is a response; line ends and blanks in a url are escaped in the
header; further columns of the table are not read; an empty table gives an
empty archive and no rows.  Requests and metadata that name no record of the
archives are captures of their own, without response.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import register, shared_dir, stored, table

# Fixed values of the format.
CRLF = "\r\n"
CUT = "WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of fewer bytes are written each time.
LEAST_SHARED = 100
#: When the pages were fetched, where the table does not say.
FETCHED = "2000-01-01T00:00:00Z"

RECORD = "record_id string, record_type string, version string, target_uri string, date string, content_type string, concurrent_to array<string>, refers_to string, http_status int, payload_bytes long, payload_digest string, payload binary"
NAMES = [x.split()[0] for x in RECORD.split(", ")]
KINDS = [pa.string()] * 6 + [pa.list_(pa.string()), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
#: Records that a capture is made of, one each; the others belong to one.
MAIN = ("response", "revisit", "resource")


def _lines(*lines: Column | str) -> Column:
    return F.concat_ws(CRLF, *(F.lit(x) if isinstance(x, str) else x for x in lines))


def _header(name: str, value: Column) -> Column:
    """A header line, or null (no line) where the value is null."""
    return F.concat(F.lit(f"{name}: "), value)


def _record(kind: str | Column, rid: Column, block: Column, content_type: Column, *more: Column) -> Column:
    """One record without its last line end, which the sink writes."""
    head = _lines(
        "WARC/1.1",
        F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind),
        _header("WARC-Record-ID", rid),
        _header("WARC-Date", F.lit(FETCHED)),
        _header("Content-Type", content_type),
        _header("Content-Length", F.octet_length(block).cast("string")),
        *more,
    )
    return F.concat(head, F.lit(CRLF + CRLF), block, F.lit(CRLF))


def _urn(seed: Column, kind: str) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat(seed, F.lit(kind))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write the archives of ``pages`` to the folder ``path``."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumns({"digest": F.sha2(F.col("body").cast("binary"), 256), "size": F.octet_length("body").cast("long")})
    # Only payloads that occur again need to meet their rows.
    again = rows.where(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("digest").alias("again"), "first")
    rows = rows.join(again, F.col("digest") == F.col("again"), "left")
    rows = rows.withColumn("kind", F.when(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), "revisit").otherwise("response"))
    rows = rows.withColumn("seed", F.expr("uuid()"))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("url", " ", "%20"), "\r", "%0D"), "\n", "%0A"), "\t", "%09")
    place = F.regexp_extract(uri, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)(.*)$", 2)
    host = F.regexp_extract(uri, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)
    target, main = _header("WARC-Target-URI", uri), _urn(F.col("seed"), "response")
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.col("size").cast("string")), "", "")
    get = F.coalesce(_lines(F.concat(F.lit("GET "), F.when(place == "", "/").otherwise(place), F.lit(" HTTP/1.1")), F.concat(F.lit("Host: "), host), "", ""), F.lit(CRLF))
    revisit = F.col("kind") == "revisit"
    both = [target, F.concat(F.lit("WARC-Concurrent-To: "), main)]
    made = F.array(
        _record("request", _urn(F.col("seed"), "request"), get, F.lit("application/http; msgtype=request"), *both),
        _record(
            F.col("kind"), main, F.when(revisit, http).otherwise(F.concat(http, F.col("body"))), F.lit("application/http; msgtype=response"), target,
            _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        ),
        _record("metadata", _urn(F.col("seed"), "metadata"), F.concat(F.coalesce(_header("page-id", F.col("key").cast("string")), F.lit("page-id-unknown: 1")), F.lit(CRLF)), F.lit("application/warc-fields"), *both),
    )
    rows.select(F.explode(made).alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").text(path)


def _row(raw: bytes, payloads: bool) -> tuple:
    """A row of ``RECORD`` from a record's bytes after ``WARC/1.``."""
    head, _, block = raw.partition(b"\r\n\r\n")
    found: dict[str, str] = {}
    linked = []
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "warc-concurrent-to":
            linked.append(value)
        else:
            found[name] = value
    kind = found.get("warc-type")
    payload = block[: int(found["content-length"])] if "content-length" in found else block
    status = length = None
    if found.get("content-type", "").startswith("application/http"):
        http, _, payload = payload.partition(b"\r\n\r\n")
        first, *lines = http.split(b"\r\n")
        words = first.split()
        status = int(words[1]) if first.startswith(b"HTTP/") and len(words) > 1 and words[1].isdigit() else None
        length = next((int(v) for k, _, v in (x.partition(b":") for x in lines) if k.strip().lower() == b"content-length" and v.strip().isdigit()), None)
    declared = found.get("warc-payload-digest")
    size, digest = (length, declared.split(":", 1)[-1] if declared else None) if kind == "revisit" else (len(payload), hashlib.sha256(payload).hexdigest())
    return (
        found.get("warc-record-id"), kind, "1." + raw[:1].decode("ascii", "replace"), found.get("warc-target-uri"), found.get("warc-date"), found.get("content-type"),
        linked, found.get("warc-refers-to"), status, size, digest, payload if payloads or kind not in MAIN else None,
    )


def _need(held: bytearray) -> int | None:
    """Bytes up to the end of the block, as soon as the header is whole."""
    end = held.find(b"\r\n\r\n")
    if end < 0:
        return None
    for line in bytes(held[:end]).split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return end + 4 + int(value)
    return end + 4


def records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the gzip archives in ``path``, in columns ``RECORD``.

    ``payload_bytes`` and ``payload_digest`` (SHA-256) are of the full payload:
    of a revisit, as it declares them.  Without ``payloads`` those of main
    records are left out, after they were read.
    """
    W.small_batches(spark)
    pieces = spark.read.option("lineSep", CUT).text(path).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def whole(batches):
        at, held, need, out, size = None, bytearray(), None, [], 0
        for batch in batches:
            for piece, file, start in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if start:
                    raise ValueError(f"{file} was split; archives are read as gzip files")
                raw = piece.as_py()
                if file != at:
                    if held:
                        raise ValueError(f"{at} ends inside a record")
                    at = file
                    if raw.strip():
                        raise ValueError(f"{file} does not begin with a record")
                    continue
                if held:
                    held += CUT.encode()
                held += raw
                need = _need(held) if need is None else need
                if need is not None and len(held) >= need:
                    out.append(_row(bytes(held), payloads))
                    size += len(held)
                    held, need = bytearray(), None
                if len(out) >= 8 * W.BATCH_ROWS or size >= 8 * W.SLICE_BYTES:
                    yield _batch(out)
                    out, size = [], 0
        if held:
            raise ValueError(f"{at} ends inside a record")
        if out:
            yield _batch(out)

    return pieces.mapInArrow(whole, RECORD)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)


def _links(found: DataFrame) -> DataFrame:
    """(member, capture): of each record that is no main one, the main record it belongs to.

    A record belongs to a main record that it names or that names it; else to
    that of a record which it names or which names it; else it is its own.
    """
    named = found.select(F.col("record_id").alias("member"), F.explode("concurrent_to").alias("to"))
    edges = named.unionByName(named.select(F.col("to").alias("member"), F.col("member").alias("to"))).distinct()
    main = found.where(F.col("record_type").isin(*MAIN)).select(F.col("record_id").alias("capture"))
    side = found.where(~F.col("record_type").isin(*MAIN, "warcinfo")).select(F.col("record_id").alias("member"))
    near = edges.join(main, edges["to"] == main["capture"]).groupBy("member").agg(F.min("capture").alias("capture"))
    first = side.join(near, "member", "left")
    left = first.where("capture is null").select("member")
    hop = edges.join(left, "member", "left_semi").join(near.select(F.col("member").alias("to"), F.col("capture").alias("by")), "to").groupBy("member").agg(F.min("by").alias("by"))
    return first.join(hop, "member", "left").select("member", F.coalesce("capture", "by", "member").alias("capture"))


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture of ``records``: capture, response, requests, metadata.

    ``response`` is the main record (null for records that belong to none).
    The records are read several times: give a written table.
    """
    own = ["record_id", "record_type", "target_uri", "date", "content_type", "http_status", "payload_bytes", "payload_digest", "refers_to", "payload"]
    main = found.where(F.col("record_type").isin(*MAIN)).select(F.col("record_id").alias("capture"), F.struct(*own).alias("response"))
    side = found.where(~F.col("record_type").isin(*MAIN, "warcinfo")).select(F.col("record_id").alias("member"), "record_type", F.struct("record_id", "target_uri", "date", "content_type", "payload").alias("record"))
    side = side.join(_links(found), "member").groupBy("capture").agg(
        F.array_sort(F.collect_list(F.when(F.col("record_type") == "request", F.col("record")))).alias("requests"),
        F.array_sort(F.collect_list(F.when(F.col("record_type") != "request", F.col("record")))).alias("metadata"),
    )
    return main.join(side, "capture", "full").select("capture", "response", "requests", "metadata")


def page_rows(found: DataFrame) -> DataFrame:
    """The captures of archives that ``write`` made, one row per page, revisits with the page they refer to.

    refers_to is the smallest page_id among the responses with the revisit's payload.
    """
    fields = F.decode(F.get("metadata", F.lit(0))["payload"], "utf-8")
    response = F.col("response")
    rows = captures(found).where("response is not null").select(
        F.regexp_extract(fields, r"(?m)^page-id: (-?\d+)", 1).try_cast("long").alias("page_id"), response["target_uri"].alias("url"),
        *(response[c].alias(c) for c in ("payload_bytes", "payload_digest", "record_type")),
    )
    rows = stored(rows, "captures")
    first = rows.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= LEAST_SHARED)).groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"))
    again = rows.where("record_type = 'revisit'").join(first, "payload_digest", "left")
    new = rows.where("record_type != 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return new.select(*cols).unionByName(again.select(*cols))


SQL = f"""
with p as (select page_id, url, coalesce(html, '') as h from pages),
d as (select page_id, url, cast(strlen(h) as bigint) as payload_bytes, sha256(h) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= {LEAST_SHARED} group by 1)
select page_id, payload_bytes, payload_digest,
  case when f.first is not null and page_id is distinct from f.first then 'revisit' else 'response' end as record_type,
  case when f.first is not null and page_id is distinct from f.first then f.first end as refers_to,
  replace(replace(replace(replace(url, ' ', '%20'), chr(13), '%0D'), chr(10), '%0A'), chr(9), '%09') as url
from d left join f using (payload_digest)
"""


@register("op11_warc_transactions", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    return page_rows(stored(records(spark, path, payloads=False), "records"))
