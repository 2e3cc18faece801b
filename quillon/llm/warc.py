"""WARC records: reading, writing, and resolving not-modified revisits.

A crawler that is told "304 Not Modified" stores a revisit record: headers without a body. To use such a capture
one needs the body of the latest earlier full response for the same canonical URL, provided its validators agree
with those of the 304, under headers merged as HTTP prescribes: the stored ones, updated by the few that a 304
may carry.

The as-of join is two-level, since one URL may have a third of all captures: inside a (URL, time bucket) a window
carries the latest response forward; buckets' last responses, one row each, carry it across buckets.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm._shared import let

#: The response headers that a 304 may update (lower case).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not change the page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)="
#: Seconds in a time bucket of the as-of join.
BUCKET_S = 3_600

SCHEMA = "record_id long, kind string, url string, ts long, status int, headers map<string,string>, payload binary"


def canonical(url: Column) -> Column:
    """The URL that captures are compared by; null for null.

    The scheme, the fragment, a default port, a leading www, a slash at the end and tracking parameters are
    dropped, the host is lower-cased, and parameters are sorted. An empty path is '/'.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")

    def built(u: Column) -> Column:
        host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^([^/?]*)", 1)), ":(80|443)$", ""), r"^www[0-9]*\.", "")
        path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), "/+$", "")
        given = F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&")
        query = F.array_join(F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
        return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))

    return F.when(url.isNotNull(), let(bare, built))


def lowered(headers: Column) -> Column:
    """A map of headers with names in lower case; of names that differ in case alone the last in byte order counts, null is empty."""
    none = F.create_map().cast("map<string,string>")
    put = lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"]))
    return F.aggregate(F.array_sort(F.map_entries(F.coalesce(headers, none))), none, put)


def merged(stored_: Column, update: Column) -> Column:
    """The stored response's headers with the permitted ones of the 304 put over them; both lowered()."""
    allowed = F.map_filter(update, lambda k, _: k.isin(*PERMITTED))
    return let(allowed, lambda new: F.map_concat(F.map_filter(stored_, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False))), new))


def resolve(records: DataFrame, carry: tuple[str, ...] = ("payload",), bucket_s: int = BUCKET_S) -> DataFrame:
    """Every record with what it stands for: canonical_url, outcome, response_id, response_ts, merged headers, carried columns.

    records: record_id, kind ('response' or 'revisit'), url, ts (seconds), status, headers, and the carried
    columns; others are dropped. A revisit is matched with the response of status 200 that has the latest ts
    before its own at the same canonical URL (of equal ts, the largest record_id). Outcomes:

    - response: the record is a full response itself and keeps its own headers and carried columns;
    - resolved: etags agree (a leading W/ is ignored) or, where the revisit has none, the last-modified values do;
    - mismatch: a validator of the revisit differs from the response's or the response has none;
    - unvalidated: the revisit has neither validator;
    - no response: none is earlier, or the url is null. A null ts is before every other.

    Unresolved revisits keep their own headers and have null carried columns. Repeated rows stay repeated.
    """
    inner = F.struct(*(F.col(c) for c in carry)) if carry else F.struct(F.lit(None).alias("_none"))
    rows = records.select("record_id", "kind", "url", "ts", "status", "headers", inner.alias("_carried"))
    rows = rows.withColumn("canonical_url", canonical(F.col("url")))
    rows = rows.withColumn("_at", F.coalesce("ts", F.lit(-(2**62)))).withColumn("_bucket", F.floor(F.col("_at") / bucket_s).cast("long"))
    rows = rows.withColumn("_low", lowered(F.col("headers")))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    response = F.when(full, F.struct(F.col("_at").alias("at"), F.col("record_id").alias("id"), F.col("ts").alias("ts"), F.col("_low").alias("headers"), F.col("_carried").alias("carried")))
    rows = rows.withColumn("_full", response)

    order = [F.col("_at"), F.when(F.col("kind") == "revisit", 0).otherwise(1), F.col("record_id")]
    inside = Window.partitionBy("canonical_url", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_near", F.last("_full", ignorenulls=True).over(inside))

    latest = rows.where(F.col("_full").isNotNull() & F.col("canonical_url").isNotNull())
    latest = latest.groupBy("canonical_url", "_bucket").agg(F.max_by("_full", F.struct("_full.at", "_full.id")).alias("_last"))
    needing = rows.where((F.col("kind") == "revisit") & F.col("_near").isNull() & F.col("canonical_url").isNotNull()).select("canonical_url", "_bucket").distinct()
    across = Window.partitionBy("canonical_url").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = latest.join(needing, ["canonical_url", "_bucket"], "full")
    spans = spans.select("canonical_url", "_bucket", F.last("_last", ignorenulls=True).over(across).alias("_before"))

    joined = rows.join(spans, ["canonical_url", "_bucket"], "left")
    found = F.when((F.col("kind") == "revisit") & F.col("canonical_url").isNotNull(), F.coalesce("_near", "_before"))
    joined = joined.withColumn("_found", found)

    tag = lambda m: F.regexp_replace(F.element_at(m, "etag"), "^W/", "")
    mine, theirs = tag(F.col("_low")), tag(F.col("_found.headers"))
    since, known = F.element_at("_low", "last-modified"), F.element_at("_found.headers", "last-modified")
    outcome = (
        F.when(F.col("kind") != "revisit", "response")
        .when(F.col("_found").isNull(), "no response")
        .when(mine.isNull() & since.isNull(), "unvalidated")
        .when(F.when(mine.isNotNull(), mine == theirs).otherwise(since == known), "resolved")
        .otherwise("mismatch")
    )
    joined = joined.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    given = lambda c: F.when(done, F.col(f"_found.carried.{c}")).when(F.col("kind") != "revisit", F.col(f"_carried.{c}")).alias(c)
    return joined.select(
        "record_id",
        "kind",
        "canonical_url",
        "ts",
        "outcome",
        F.when(done, F.col("_found.id")).alias("response_id"),
        F.when(done, F.col("_found.ts")).alias("response_ts"),
        F.when(done, merged(F.col("_found.headers"), F.col("_low"))).otherwise(F.col("headers")).alias("headers"),
        *(given(c) for c in carry),
    )


def from_pages(pages: DataFrame) -> DataFrame:
    """A crawl made of a table of pages (page_id, url, html): for each page a full response and two revisits.

    Page p is fetched at 60 * p seconds. It is asked for again 90 seconds and a day later; the 304 carries the
    page's etag, but on every 7th page another one, on every 5th page only the last-modified date, and on every
    11th page nothing to compare. The second revisit of every 13th page is dated a day before the fetch. Bodies
    are represented by their size and digest, so that html is read once and does not move.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", F.length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_sha256"))
    tag, page, at = F.substring("payload_sha256", 1, 16), F.col("page_id"), F.col("page_id") * 60
    old, text = F.concat(F.lit("t"), at.cast("string")), lambda c: c.cast("string")
    stored_ = F.map_from_arrays(F.array(*map(F.lit, ("etag", "last-modified", "content-type", "date"))), F.array(tag, old, F.lit("text/html"), text(at)))

    def again(ts: Column) -> Column:
        date = text(ts)
        return (
            F.when(page % 11 == 4, F.map_from_arrays(F.array(F.lit("date")), F.array(date)))
            .when(page % 7 == 3, F.map_from_arrays(F.array(F.lit("ETag"), F.lit("date")), F.array(F.concat(F.lit("x"), tag), date)))
            .when(page % 5 == 2, F.map_from_arrays(F.array(F.lit("Last-Modified"), F.lit("date")), F.array(old, date)))
            .otherwise(F.map_from_arrays(F.array(F.lit("ETag"), F.lit("Date"), F.lit("content-type")), F.array(F.concat(F.lit("W/"), tag), date, F.lit("none"))))
        )

    late = F.when(page % 13 == 6, at - 86_400).otherwise(at + 86_400)
    none = [F.lit(None).cast("long").alias("payload_bytes"), F.lit(None).cast("string").alias("payload_sha256")]
    record = lambda k, kind, ts, status, headers, rest: F.struct((page * 3 + k).alias("record_id"), F.lit(kind).alias("kind"), F.col("url"), ts.alias("ts"), F.lit(status).alias("status"), headers.alias("headers"), *rest)
    three = F.array(
        record(0, "response", at, 200, stored_, [F.col("payload_bytes"), F.col("payload_sha256")]),
        record(1, "revisit", at + 90, 304, again(at + 90), none),
        record(2, "revisit", late, 304, again(late), none),
    )
    return base.select(F.inline(three))


# -- files


def parse(raw: bytes) -> Iterator[dict]:
    """The records of an uncompressed or gzip (one member a record, or one in all) WARC file, in order.

    Types other than response and revisit are passed over. A record whose lengths do not fit ends the file:
    what came before it is kept, in a gzip file that is cut or damaged too. Header names are lower-cased; of repeated
    ones the last counts.
    """
    data = io.BytesIO(_unzipped(raw) if raw[:2] == b"\x1f\x8b" else raw)
    while True:
        line = data.readline()
        while line in (b"\r\n", b"\n"):
            line = data.readline()
        if not line.startswith(b"WARC/"):
            return
        head = _headers(data)
        length = head.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            return
        body = data.read(int(length))
        if len(body) < int(length):
            return
        if head.get("warc-type") not in ("response", "revisit"):
            continue
        inner = io.BytesIO(body)
        first = inner.readline().split(None, 2)
        status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
        yield {"kind": head["warc-type"], "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "status": status, "headers": _headers(inner), "payload": inner.read()}


def _unzipped(raw: bytes) -> bytes:
    """What the members of a gzip file hold, up to the first that is cut or damaged."""
    out, at = [], 0
    while at < len(raw):
        member = zlib.decompressobj(zlib.MAX_WBITS | 16)
        try:
            while not member.eof and at < len(raw):
                some = raw[at : at + (1 << 16)]
                out.append(member.decompress(some))
                at += len(some) - len(member.unused_data)
        except zlib.error:
            break
    return b"".join(out)


def _headers(data: io.BytesIO) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in iter(data.readline, b""):
        line = line.rstrip(b"\r\n")
        if not line:
            break
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def dump(record: dict) -> bytes:
    """One record as WARC/1.1 bytes; parse() gives it back."""
    lines = [f"HTTP/1.1 {record['status'] if record['status'] is not None else '-'} x", *(f"{k}: {v}" for k, v in record["headers"].items()), "", ""]
    body = "\r\n".join(lines).encode() + (record["payload"] or b"")
    head = ["WARC/1.1", f"WARC-Type: {record['kind']}", f"WARC-Target-URI: {record['url']}", f"WARC-Date: {record['date']}", "Content-Type: application/http", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files (one task reads a file whole), as resolve() takes them.

    record_id orders records by file path and place; ts comes from WARC-Date and is null where that is no date.
    """
    found = spark.read.format("binaryFile").load(path)
    numbers = found.select("path", F.row_number().over(Window.orderBy("path")).cast("long").alias("file_no"))  # one row a file
    files = found.select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(parse(batch.column(1)[i].as_py()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * len(found), pa.string()),
                        pa.array(range(len(found)), pa.int64()),
                        *(pa.array([r[k] for r in found], pa.string()) for k in ("kind", "url", "date")),
                        pa.array([r["status"] for r in found], pa.int32()),
                        pa.array([list(r["headers"].items()) for r in found], pa.map_(pa.string(), pa.string())),
                        pa.array([r["payload"] for r in found], pa.binary()),
                    ],
                    ["path", "place", "kind", "url", "date", "status", "headers", "payload"],
                )

    rows = files.mapInArrow(run, "path string, place long, kind string, url string, date string, status int, headers map<string,string>, payload binary")
    rows = rows.join(numbers, "path")
    return rows.select((F.col("file_no") * F.lit(1 << 31) + F.col("place")).alias("record_id"), "kind", "url", F.unix_timestamp(F.try_to_timestamp("date")).alias("ts"), "status", "headers", "payload")


def write(records: DataFrame, path: str) -> int:
    """records (kind, url, date, status, headers, payload) as WARC files under path, which read() takes; how many.

    Each partition writes one file, a gzip member for each record, under a name of its own that it gets only when it is
    whole; a task that is run again replaces it. path is a URI or a folder that the executors reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        task, n = TaskContext.get(), 0
        store.create_dir(folder, recursive=True)
        name, draft = f"{folder}/part-{task.partitionId():06d}.warc.gz", f"{folder}/.part-{task.taskAttemptId()}.tmp"
        with store.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for r in batch.to_pylist():
                    out.write(gzip.compress(dump(r | {"headers": dict(r["headers"] or [])})))
                    n += 1
        store.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    told = records.select("kind", "url", "date", "status", "headers", "payload").mapInArrow(run, "n long")
    return sum(r.n for r in told.collect())  # one row a partition


def digest_columns(resolved: DataFrame) -> DataFrame:
    """The query's columns: flat, so that any engine can compare them."""
    pick = lambda name: F.element_at("headers", name)
    return resolved.select(
        "record_id",
        F.floor(F.col("record_id") / 3).cast("long").alias("page_id"),
        "kind",
        "canonical_url",
        "ts",
        "outcome",
        "response_id",
        "response_ts",
        F.coalesce(pick("etag"), pick("ETag")).alias("etag"),
        F.coalesce(pick("last-modified"), pick("Last-Modified")).alias("last_modified"),
        pick("content-type").alias("content_type"),
        F.coalesce(pick("date"), pick("Date")).alias("date"),
        "payload_bytes",
        "payload_sha256",
    )


ORACLE_SQL = r"""
WITH base AS (
  SELECT page_id AS p, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_sha256,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)='))), '&') AS query FROM base
), named AS (
  SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical_url,
    substr(payload_sha256, 1, 16) AS tag, 't' || (p * 60) AS old FROM parts
), responses AS (
  SELECT p * 3 AS record_id, canonical_url, p * 60 AS ts, tag, old, payload_bytes, payload_sha256 FROM named
), revisits AS (
  SELECT p * 3 + k AS record_id, p, canonical_url, tag, old,
    CASE WHEN k = 1 THEN p * 60 + 90 WHEN p % 13 = 6 THEN p * 60 - 86400 ELSE p * 60 + 86400 END AS ts
  FROM named, (VALUES (1), (2)) t(k)
), sent AS (
  SELECT *, CASE WHEN p % 11 = 4 THEN NULL WHEN p % 7 = 3 THEN 'x' || tag WHEN p % 5 = 2 THEN NULL ELSE 'W/' || tag END AS etag,
    CASE WHEN p % 11 <> 4 AND p % 7 <> 3 AND p % 5 = 2 THEN old END AS since,
    CASE WHEN p % 11 = 4 OR p % 7 = 3 OR p % 5 = 2 THEN NULL ELSE 'none' END AS content_type FROM revisits
), matched AS (
  SELECT s.*, r.record_id AS rid, r.ts AS rts, r.tag AS rtag, r.old AS rold, r.payload_bytes, r.payload_sha256
  FROM sent s LEFT JOIN responses r ON r.canonical_url = s.canonical_url AND r.ts < s.ts
  QUALIFY row_number() OVER (PARTITION BY s.record_id ORDER BY r.ts DESC NULLS LAST, r.record_id DESC) = 1
), told AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'no response' WHEN etag IS NULL AND since IS NULL THEN 'unvalidated'
    WHEN coalesce(regexp_replace(etag, '^W/', '') = rtag, since = rold) THEN 'resolved' ELSE 'mismatch' END AS outcome FROM matched
)
SELECT record_id::BIGINT AS record_id, (record_id // 3)::BIGINT AS page_id, 'response' AS kind, canonical_url, ts::BIGINT AS ts, 'response' AS outcome,
  NULL::BIGINT AS response_id, NULL::BIGINT AS response_ts, tag AS etag, old AS last_modified, 'text/html' AS content_type,
  ts::VARCHAR AS date, payload_bytes, payload_sha256 FROM responses
UNION ALL
SELECT record_id, p, 'revisit', canonical_url, ts, outcome, CASE WHEN outcome = 'resolved' THEN rid END, CASE WHEN outcome = 'resolved' THEN rts END,
  CASE WHEN outcome = 'resolved' THEN coalesce(etag, rtag) ELSE etag END, CASE WHEN outcome = 'resolved' THEN coalesce(since, rold) ELSE since END,
  CASE WHEN outcome = 'resolved' THEN 'text/html' ELSE content_type END, ts::VARCHAR,
  CASE WHEN outcome = 'resolved' THEN payload_bytes END, CASE WHEN outcome = 'resolved' THEN payload_sha256 END
FROM told
"""
