"""WARC archives and an external merge of their capture index.

Writing: each page becomes one WARC/1.1 record.  The page with the smallest id among equal payloads is
the response; the others are revisit records that name it and carry only the HTTP head, whose
Content-Length still tells the full payload's size.  Files are gzip streams written by Spark's text sink with
the record terminator as line separator, so they live wherever the shared folder lives.

Reading: every file is parsed as a stream; its captures, sorted by URL key and timestamp, are one run.
The runs are dealt by ranges of (URL key, timestamp, page), never by URL alone, so a hot URL or host spreads
over many ranges.  In each range the slices of all runs meet in a loser tree, which emits the
capture history in global order.

Defined results: a null html is an empty payload; a null url has an empty URL key; rows without an id sort last
and are responses only if no row of the payload has an id; repeated rows are separate records.
Line breaks in a url are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postcred.llm.common import stored
from postcred.session import scratch_dir

CRLF = "\r\n"
EPOCH = "2020-01-01 00:00:00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE, FILE_BYTES = 20_000, 256 << 20
ROWS_PER_RANGE = 200_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(payload.cast("binary"))
    quads = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_record_type(pages: DataFrame) -> DataFrame:
    """Adds payload, payload_digest, payload_bytes, record_type and refers_to."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"),
                        base32_sha1(payload).alias("payload_digest"))
    shared = (rows.groupBy("payload_digest", "payload_bytes")
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = stored(shared.select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "first_id"), "warc-shared")
    out = rows.join(shared, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    revisit = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return out.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"))


def record_text(rows: DataFrame) -> Column:
    """The WARC record of a row of ``with_record_type``, without its terminator."""
    second = F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10 ** 8)))
    date = F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    response = F.col("record_type") == "response"
    body = F.concat(http, F.when(response, F.col("payload")).otherwise(F.lit("")))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", url), line("WARC-Date", date),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(response, F.lit("")).otherwise(line("WARC-Profile", F.lit(PROFILE))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit(CRLF), body)


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Archives of at most ``file_bytes`` before compression (a larger record is a file of its own), one folder per size band.

    All records of a band are at most its limit, so the record count of its files bounds their bytes whatever the mix of sizes.
    """
    rows = with_record_type(pages)
    record = record_text(rows)
    size = F.octet_length(F.coalesce("html", F.lit("")))
    limits = [file_bytes >> 14, file_bytes >> 10, file_bytes >> 6, file_bytes >> 2]
    band = F.lit(len(limits))
    for k in range(len(limits) - 1, -1, -1):
        band = F.when(size <= limits[k], F.lit(k)).otherwise(band)
    for k in sorted(r["band"] for r in pages.select(band.alias("band")).distinct().collect()) or [0]:  # at most five rows
        own = F.octet_length("payload")
        low = F.lit(True) if k == 0 else own > limits[k - 1]
        high = F.lit(True) if k == len(limits) else own <= limits[k]
        most = min(records_per_file, file_bytes // limits[k] if k < len(limits) else 1)
        (rows.where(low & high).select(record.alias("value")).write.option("lineSep", CRLF + CRLF)
         .option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/band-{k}"))


def records(content: bytes, step: int = 1 << 20):
    """(offset, header dict, block) of a gzip WARC stream, decompressed piece by piece."""
    inflate, buf, at, src = zlib.decompressobj(47), bytearray(), 0, 0

    def fill(n: int) -> bool:
        nonlocal src, inflate
        while len(buf) < n and src < len(content):
            piece = content[src:src + step]
            src += len(piece)
            buf.extend(inflate.decompress(piece))
            while inflate.eof and inflate.unused_data:  # per-record members are read as well
                rest = inflate.unused_data
                inflate = zlib.decompressobj(47)
                buf.extend(inflate.decompress(rest))
        return len(buf) >= n

    while fill(1):
        need, end = 1 << 12, -1
        while end < 0:
            more = fill(need)
            end = buf.find(b"\r\n\r\n")
            if end < 0 and not more:
                raise ValueError(f"broken record head at {at}")
            need = len(buf) + (1 << 12)
        head = dict(x.split(": ", 1) for x in buf[:end].decode().split(CRLF)[1:])
        size = end + 4 + int(head["Content-Length"])
        if not fill(size + 4):
            raise ValueError(f"broken record block at {at}")
        yield at, head, bytes(buf[end + 4:size])
        del buf[:size + 4]
        at += size + 4


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, then the lower-cased path and query; no scheme, www, port or fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip().lower())
        host = u.hostname or ""
    except ValueError:
        return url.lower()
    labels = host.split(".")
    if labels[0] == "www":
        labels = labels[1:]
    return ",".join(reversed(labels)) + ")" + (u.path.rstrip("/") or "/") + (f"?{u.query}" if u.query else "")


CAPTURE = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()),
                     ("url", pa.string()), ("offset", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64())])
CAPTURE_DDL = ("run string, url_key string, captured_at string, page_id long, url string, offset long, payload_bytes long, "
               "payload_digest string, record_type string, refers_to long")


def _order(row) -> tuple:
    """(url_key, captured_at, no id, id, run, offset) of a capture."""
    return row[1], row[2], row[3] is None, row[3] or 0, row[0], row[5]


def capture(path: str, at: int, head: dict, block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode().split(CRLF)[1:])
    n, digest, kind = int(fields["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    if kind == "response":
        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    page, first = (head.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("WARC-Record-ID", "WARC-Refers-To"))
    url = head.get("WARC-Target-URI")
    return (path, url_key(url or ""), head["WARC-Date"], int(page) if page else None, url, at, n, digest, kind,
            int(first) if first else None)


def capture_runs(spark, path: str) -> DataFrame:
    """One sorted run of captures per archive file."""
    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = sorted((capture(name, *r) for r in records(content.as_py())), key=_order)
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo:lo + 10_000]), CAPTURE)],
                                                     schema=CAPTURE)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, CAPTURE_DDL)


class LoserTree:
    """Tournament over k sorted lists of keys; each step replays one leaf-to-root path."""

    def __init__(self, keys: list[list[tuple]]):
        self.keys, self.k, self.at = keys, len(keys), [0] * len(keys)
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._replay(leaf, building=True)

    def _less(self, a: int, b: int) -> bool:
        ka = self.keys[a][self.at[a]] if self.at[a] < len(self.keys[a]) else None
        kb = self.keys[b][self.at[b]] if self.at[b] < len(self.keys[b]) else None
        return ka is not None and (kb is None or ka < kb)

    def _replay(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) >> 1
        while node > 0:
            rival = self.tree[node]
            if rival < 0 and building:
                self.tree[node] = winner
                return
            if rival >= 0 and self._less(rival, winner):
                self.tree[node], winner = winner, rival
            node >>= 1
        self.tree[0] = winner

    def __iter__(self):
        for _ in range(sum(map(len, self.keys))):
            w = self.tree[0]
            yield w, self.at[w]
            self.at[w] += 1
            self._replay(w)


def merge_runs(runs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Globally ordered captures: partition after partition, row after row."""
    spark = runs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // rows_per_range))

    def run(batches):
        table = pa.Table.from_batches(batches, CAPTURE)
        if not table.num_rows:
            return
        columns = [table.column(i).to_pylist() for i in range(6)]
        slices: dict[str, list[int]] = {}
        for i, name in enumerate(columns[0]):
            slices.setdefault(name, []).append(i)
        keys, where = [], []
        for rows in slices.values():
            k = [_order([c[i] for c in columns]) for i in rows]
            if any(a > b for a, b in zip(k, k[1:])):  # a fetch may hand a run's blocks over out of order
                rows = [r for _, r in sorted(zip(k, rows))]
                k.sort()
            keys.append(k)
            where.append(rows)
        order = np.fromiter((where[w][at] for w, at in LoserTree(keys)), np.int64, table.num_rows)
        yield from table.take(pa.array(order)).combine_chunks().to_batches(10_000)
    dealt = runs.repartitionByRange(ranges, "url_key", "captured_at", F.asc_nulls_last("page_id"), "run", "offset")
    return dealt.mapInArrow(run, CAPTURE_DDL)


def capture_history(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as archives under ``path`` and return the merged index read back from them."""
    spark = pages.sparkSession
    path = path or scratch_dir(spark, "llm-warc")
    write_archives(pages, path, **options)
    return merge_runs(stored(capture_runs(spark, path), "warc-runs"))


def op3_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return capture_history(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, payload_bytes,
       translate((SELECT string_agg(lpad(to_base(('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT, 32), 4, '0'), '' ORDER BY i)
                  FROM range(8) t(i)), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
