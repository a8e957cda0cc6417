"""WARC records, and resolution of not-modified revisits by an as-of join."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, ready, spread_join

#: Header fields of a 304 response that never replace those of the stored response (they describe the payload or the connection). Fixed values.
KEPT_FROM_STORED = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]

RECORD = "record_id string, kind string, url string, time string, status int, headers map<string,string>, body binary"


def canonical_url(url: Column) -> Column:
    """Scheme, leading www., fragment, the scheme's default port, utm_ and ref parameters and a closing slash go; the host is lower-cased. Null stays null.

    Port 80 goes without a scheme and with http, 443 with https. Other hosts of a site (m., amp.) stay apart: they answer with other pages."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), "^www[.]", "")
    host = F.when(scheme.isin("", "http"), F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    rest = F.regexp_replace(u, "^[^/?]*", "")
    rest = F.regexp_replace(rest, "([?&])(utm_[^&]*|ref=[^&]*)", "$1")
    rest = F.regexp_replace(rest, "&+", "&")
    rest = F.regexp_replace(F.regexp_replace(rest, "[?]&", "?"), "[?&]$", "")
    return F.concat(host, F.regexp_replace(rest, "/$", ""))


def seconds(records: DataFrame) -> Column:
    """The time column as whole seconds: numbers as they are, timestamps and ISO texts since the epoch (UTC where the text says no zone); null where a text is no time."""
    kind, t = records.schema["time"].dataType.simpleString(), F.col("time")
    if kind == "string":
        zoned = F.when(t.rlike(r"([Zz]|[+-][0-9]{2}:?[0-9]{2})\s*$"), t).otherwise(F.concat(t, F.lit("Z")))
        return F.coalesce(t.try_cast("long"), F.unix_seconds(zoned.try_cast("timestamp")))
    return F.unix_seconds(t.cast("timestamp")) if kind.startswith("timestamp") or kind == "date" else t.cast("long")


def resolve_revisits(records: DataFrame, buckets: int = 64) -> DataFrame:
    """One row a revisit: record_id, canonical_url, time, base_id, state, headers, body.

    records: record_id, url, time (a number, a timestamp or an ISO text, see seconds), kind ('response' or 'revisit'), headers (map), body and, if known, status. The base of a
    revisit is the latest full response of its canonical URL whose time is strictly earlier (equal times: the largest record_id, then etag, then date). A response is full if its
    status is 200 or null; partial, moved and failed ones are no base. state is
    'resolved', 'mismatch' (validators differ), 'no_validator' (the revisit states none that the base has too), 'no_base', or 'no_url'. ETags compare weakly and decide alone
    where both have one; else Last-Modified decides. Only a resolved revisit has headers and body: the base's, where header fields of the
    revisit replace the base's unless they are in KEPT_FROM_STORED. Header names are lower-cased; of names that then clash the last in order wins.

    Repeated rows are resolved each, also where a record_id stands for several records: a payload is found by record_id, URL, time and validators, and of
    records equal in all of these the one with the least headers, then body, counts. Other kinds and rows of a null time are left out; empty tables give no rows; other
    columns are ignored. The as-of step works on distinct pairs of URL and time, in `buckets` time spans of about equally many of them,
    with one carried row a span, so that a URL with a third of all captures is spread over as many tasks as spans. Payloads join last;
    pairs and payloads that many revisits share are dealt to parts.
    """
    ready(records.sparkSession)
    none = F.expr("map()").cast("map<string,string>")
    names = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    folded = F.aggregate(names, none, lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
    status = F.col("status").cast("int") if "status" in records.columns else F.lit(None).cast("int")
    full = (F.col("kind") == "response") & F.coalesce(status == 200, F.lit(True))
    h = F.when(F.col("headers").isNotNull(), folded)
    r = records.select("record_id", canonical_url(F.col("url")).alias("u"), seconds(records).alias("t"), "kind", full.alias("full"), h.alias("headers"), "body")
    r = r.where("t is not null and (full or kind = 'revisit')").withColumn("etag", F.regexp_replace(F.col("headers")["etag"], "^W/", "")).withColumn("modified", F.col("headers")["last-modified"])
    slim = materialize(r.where("u is not null").select("record_id", "u", "t", "kind", "etag", "modified"), "captures")

    # one row for each URL and time, whatever stands at it
    best = F.max(F.when(F.col("kind") == "response", F.struct("t", "record_id", "etag", "modified")))
    at = slim.groupBy("u", "t").agg(best.alias("full"), F.max(F.col("kind") == "revisit").alias("asked"))
    at = materialize(at, "moments")
    cuts = sorted({int(x) for x in at.approxQuantile("t", [i / buckets for i in range(1, buckets)], 0.25 / buckets)}) if buckets > 1 else []
    span = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda x: x <= F.col("t"))) if cuts else F.lit(0)
    at = at.withColumn("tb", span)
    inner = Window.partitionBy("u", "tb").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    near = at.withColumn("near", F.last("full", ignorenulls=True).over(inner)).where("asked")
    before = Window.partitionBy("u").orderBy("tb").rowsBetween(Window.unboundedPreceding, -1)
    ends = at.groupBy("u", "tb").agg(F.max("full").alias("end"))
    carried = ends.select("u", "tb", F.last("end", ignorenulls=True).over(before).alias("carried"))
    base = near.join(carried, ["u", "tb"], "left").select("u", "t", F.coalesce("near", "carried").alias("base"))

    own = materialize(r.where("kind = 'revisit'").select("record_id", "u", "t", "etag", "modified", F.col("headers").alias("own")), "revisits")
    found = spread_join(own.where("u is not null"), base, ["u", "t"], "record_id", "left")
    both_tags = F.col("etag").isNotNull() & F.col("base.etag").isNotNull()
    both_dates = F.col("modified").isNotNull() & F.col("base.modified").isNotNull()
    state = (
        F.when(F.col("base").isNull(), "no_base")
        .when(both_tags, F.when(F.col("etag") == F.col("base.etag"), "resolved").otherwise("mismatch"))
        .when(both_dates, F.when(F.col("modified") == F.col("base.modified"), "resolved").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    key = F.md5(F.to_json(F.struct("u", "base.t", "base.record_id", "base.etag", "base.modified")))
    found = materialize(found.select("record_id", "u", "t", "own", "base", state.alias("state"), F.when(state == "resolved", key).alias("k")), "resolved")
    stored = r.where("full and u is not null").withColumn("k", F.md5(F.to_json(F.struct("u", "t", "record_id", "etag", "modified"))))
    stored = stored.join(found.where("k is not null").select("k").distinct(), "k", "left_semi")
    stored = stored.groupBy("k").agg(F.min(F.struct(F.to_json("headers").alias("j"), "body")).alias("x"))
    stored = stored.select("k", F.from_json("x.j", "map<string,string>").alias("stored"), "x.body")
    whole = spread_join(found.where("k is not null"), stored, ["k"], "record_id", "left", least=2_000)
    allowed = F.map_filter(F.coalesce("own", none), lambda k, _: ~k.isin(KEPT_FROM_STORED))
    merged = F.map_concat(F.map_filter(F.coalesce("stored", none), lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    ids = [F.col("record_id"), F.col("u").alias("canonical_url"), F.col("t").alias("time"), F.col("base.record_id").alias("base_id"), F.col("state")]
    body_type, id_type = records.schema["body"].dataType, records.schema["record_id"].dataType
    blank = [F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast(body_type).alias("body")]
    done = whole.select(*ids, merged.alias("headers"), "body")
    rest = found.where("k is null").select(*ids, *blank)
    orphans = own.where("u is null").select("record_id", F.col("u").alias("canonical_url"), F.col("t").alias("time"), F.lit(None).cast(id_type).alias("base_id"), F.lit("no_url").alias("state"), *blank)
    return done.unionByName(rest).unionByName(orphans)


def iter_records(data: bytes) -> Iterator[tuple]:
    """(record_id, kind, url, time, status, headers, body) of each record of a WARC file, plain or gzipped by record; a broken tail ends the file."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)

    def fields() -> dict:
        out: dict = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            out[name.strip().lower()] = value.strip()
        return out

    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            head = fields()
            block = stream.read(int(head.get("content-length", 0) or 0))
            kind, status, http, body = head.get("warc-type", ""), None, {}, block
            if kind in ("response", "revisit") and block.startswith(b"HTTP/"):
                top, _, body = block.partition(b"\r\n\r\n")
                first, *rest = top.split(b"\r\n")
                code = first.split(b" ")[1:2]
                status = int(code[0]) if code and code[0].isdigit() else None
                for x in rest:
                    name, _, value = x.decode("utf-8", "replace").partition(":")
                    http[name.strip().lower()] = value.strip()
            yield head.get("warc-record-id", ""), kind, head.get("warc-target-uri"), head.get("warc-date"), status, http, body
    except (EOFError, OSError, ValueError):
        return


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under path. Each file is read by one task, as archives are written in bounded files."""
    ready(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "kind", "url", "time", "status", "headers", "body"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]

        def out(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            cols[5] = [list(h.items()) for h in cols[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for b in batches:
            for data in b.column(0).to_pylist():
                rows: list = []
                for record in iter_records(data):
                    rows.append(record)
                    if len(rows) >= 256:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)


def warc_bytes(records: list[tuple]) -> bytes:
    """A gzipped WARC file of (record_id, kind, url, time, status, headers, body) records."""
    out = io.BytesIO()
    for rid, kind, url, time, status, headers, body in records:
        block = f"HTTP/1.1 {status} x\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + body
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {time}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
        out.write(gzip.compress(head.encode() + block + b"\r\n\r\n"))
    return out.getvalue()
