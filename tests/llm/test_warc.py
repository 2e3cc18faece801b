import gzip
import random

import pytest

from quillon.llm import warc as w

SCHEMA = "outcome string, record_id long, kind string, url string, ts long, status int, headers map<string,string>, payload binary"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://WWW.Example.com:80/a/?b=2&a=1#x", "example.com/a?a=1&b=2"),
        ("https://example.com", "example.com/"),
        ("https://example.com/?ref=x&utm_source=y", "example.com/"),
        ("example.com/Path?Q=1&&", "example.com/Path?Q=1"),
        ("https://example.com:443?z", "example.com/?z"),
        ("", "/"),
        (None, None),
    ],
)
def test_canonical(spark, url, want):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(w.canonical(df.url)).first()[0] == want


def brute(rows):
    out = {}
    for _, rid, kind, url, ts, _status, headers, payload in rows:
        low = {k.lower(): v for k, v in (headers or {}).items()}
        if kind != "revisit":
            out[rid] = ("response", None, headers, payload)
            continue
        at = -(2**62) if ts is None else ts
        earlier = [r for r in rows if r[2] == "response" and r[5] == 200 and url is not None and r[3] == url and (-(2**62) if r[4] is None else r[4]) < at]
        if not earlier:
            out[rid] = ("no response", None, headers, None)
            continue
        best = max(earlier, key=lambda r: (-(2**62) if r[4] is None else r[4], r[1]))
        base = {k.lower(): v for k, v in (best[6] or {}).items()}
        tag = lambda m: None if "etag" not in m else m["etag"].removeprefix("W/")
        if tag(low) is None and "last-modified" not in low:
            out[rid] = ("unvalidated", None, headers, None)
        elif (tag(low) == tag(base)) if tag(low) is not None else (low["last-modified"] == base.get("last-modified")):
            out[rid] = ("resolved", best[1], base | {k: v for k, v in low.items() if k in w.PERMITTED}, best[7])
        else:
            out[rid] = ("mismatch", None, headers, None)
    return out


def random_rows(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["response", "revisit"])
        headers = {}
        if rng.random() < 0.7:
            headers[rng.choice(["ETag", "etag"])] = rng.choice(["", "W/"]) + rng.choice("ab")
        if rng.random() < 0.5:
            headers["Last-Modified"] = rng.choice("pq")
        headers |= {"Content-Type": kind, "Date": str(i)}
        url = rng.choice(["h.com/hot"] * 6 + ["h.com/a", "h.com/b", None])
        rows.append(("x", i, kind, url, rng.choice([None, *range(0, 40)]), rng.choice([200, 200, 200, 404]), rng.choice([headers, headers, headers, None]), bytes([i % 250])))
    return rows


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_as_of_join_against_brute_force(spark, bucket):
    rows = random_rows(bucket)
    found = w.resolve(spark.createDataFrame(rows, SCHEMA).repartition(4), bucket_s=bucket).collect()
    want = brute(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r.outcome, r.response_id, r.headers, None if r.payload is None else bytes(r.payload)) == want[r.record_id]
    assert {r.outcome for r in found} == {"response", "resolved", "mismatch", "unvalidated", "no response"}


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert w.resolve(empty).collect() == []
    row = ("x", 1, "response", "a.com", 1, 200, {"etag": "e"}, b"p")
    again = ("x", 2, "revisit", "a.com", 5, 304, {"etag": "e"}, None)
    found = w.resolve(spark.createDataFrame([row, row, again, again], SCHEMA)).collect()
    assert len(found) == 4 and all(bytes(r.payload) == b"p" for r in found)
    pages = spark.createDataFrame([(1, None, None, 7), (None, "http://x.com", "h", 1)], "page_id long, url string, html string, ts int")
    assert w.resolve(w.from_pages(pages), carry=("payload_bytes", "payload_sha256")).count() == 6


def test_names_that_differ_in_case(spark):
    rows = [("x", 1, "response", "a.com", 1, 200, {"ETag": "old", "etag": "e", "Vary": "x"}, b"p"), ("x", 2, "revisit", "a.com", 5, 304, {"etag": "e", "ETAG": "f", "VARY": "y"}, None)]
    found = {r.record_id: r for r in w.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[2].outcome == "resolved" and found[2].headers == {"etag": "e", "vary": "y"}


def test_files_round_trip(spark, tmp_path):
    records = [
        {"kind": "response", "url": "http://a.com/", "date": "2024-01-01T00:00:00Z", "status": 200, "headers": {"etag": '"1"', "x": "y: z"}, "payload": b"body\r\n\r\nWARC/1.0 inside"},
        {"kind": "revisit", "url": "http://a.com/", "date": "2024-01-02T00:00:00Z", "status": 304, "headers": {"etag": '"1"'}, "payload": b""},
    ]
    raw = b"".join(map(w.dump, records))
    assert list(w.parse(raw)) == records
    zipped = b"".join(gzip.compress(w.dump(r)) for r in records)
    assert list(w.parse(zipped)) == records
    assert list(w.parse(raw[:-30])) == records[:1] or len(list(w.parse(raw[:-30]))) <= 2
    assert list(w.parse(b"")) == list(w.parse(b"junk")) == []
    (tmp_path / "one.warc").write_bytes(raw)
    (tmp_path / "two.warc.gz").write_bytes(zipped)
    read = w.read(spark, str(tmp_path)).orderBy("record_id").collect()
    assert [r.record_id % (1 << 31) for r in read] == [0, 1, 0, 1] and len({r.record_id for r in read}) == 4
    found = w.resolve(w.read(spark, str(tmp_path))).collect()
    assert sorted(r.outcome for r in found) == ["resolved", "resolved", "response", "response"]
    assert all(bytes(r.payload) == records[0]["payload"] for r in found)
    written = w.write(spark.createDataFrame([tuple(r.values()) for r in records], "kind string, url string, date string, status int, headers map<string,string>, payload binary"), str(tmp_path / "out"))
    again = w.read(spark, str(tmp_path / "out" / "*.warc.gz")).collect()
    assert written == len(again) == 2 and not [p for p in (tmp_path / "out").iterdir() if p.suffix != ".gz"]
    tell = lambda kind, status, headers, payload: (kind, status, sorted(headers.items()), bytes(payload))
    assert sorted(tell(r.kind, r.status, r.headers, r.payload) for r in again) == sorted(tell(r["kind"], r["status"], r["headers"], r["payload"]) for r in records)


def test_damaged_files_keep_what_came_before():
    records = [{"kind": "response", "url": f"http://a.com/{i}", "date": "2024-01-01T00:00:00Z", "status": 200, "headers": {"x": "1"}, "payload": bytes(range(256)) * (i + 1) * 400} for i in range(4)]
    zipped = [gzip.compress(w.dump(r)) for r in records]
    whole = b"".join(zipped)
    assert list(w.parse(whole)) == list(w.parse(gzip.compress(b"".join(map(w.dump, records))))) == records
    assert list(w.parse(whole[: len(whole) - 20])) == records[:3]
    assert list(w.parse(whole[: len(zipped[0]) + 30])) == records[:1]
    assert list(w.parse(zipped[0] + b"no member")) == records[:1]
    bad = w.dump(records[1])
    for length in (b"-5", b"x", b"", b"99999999999"):
        start = bad.index(b"Content-Length: ") + 16
        cut = bad[:start] + length + bad[bad.index(b"\r\n", start) :]
        assert list(w.parse(w.dump(records[0]) + cut + w.dump(records[2]))) == records[:1]
