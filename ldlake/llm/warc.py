"""WARC archives with revisit records.

Payload digests are computed where the rows are read. Only headers (id, digest, length) are shuffled
to find, for each digest, the response that its copies revisit; the payloads then travel once, by
their row, and a revisit is written without its payload, but with the id, address and date of the record it
refers to. Archives are gzip members, one a record, in files of bounded size below the shared
folder. File names hold the task's attempt, so attempts never touch each other's files, and a
manifest lists the files of the attempts that counted: what a lost, repeated or
speculative attempt leaves behind is read by no one.
"""

from __future__ import annotations

import base64
import gzip
import io
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, table

LEAST = 1000
FILE_BYTES = 8_000_000
MOST_TASKS = 100_000  # that read archives; each takes as many files as there are then
MANIFEST = "_manifest"
WHEN = "2024-01-01T00:00:00Z"


def headers(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest (SHA-1, hex) of each row; null payload is empty."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    return pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest")
    )


def resolve(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """The response (largest page_id, with its url) of each digest with at least ``least`` bytes and two rows or more."""
    first = F.max(F.struct("page_id", "url")).alias("first")
    found = heads.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(first, F.count("*").alias("n")).where("n > 1")
    return found.select("payload_digest", F.col("first.page_id").alias("response"), F.col("first.url").alias("response_url"))


def _record_id(page: int | None, digest: str, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}/{digest}/{url}')}>"


def _is_plain(url: str | None) -> bool:
    """Whether a header line can hold the address as it is."""
    return bool(url) and url.isascii() and url.isprintable() and " " not in url


def _record(kind: str, page: int | None, url: str | None, digest: str, body: bytes, size: int, refers: int | None, refers_url: str | None) -> bytes:
    target = base64.b64encode((url or "").encode()).decode()  # any url, line ends too, must fit a header line
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page, digest, url)}", f"WARC-Date: {WHEN}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page-Id: {'' if page is None else page}", f"X-Target-Base64: {target}", f"X-Payload-Length: {size}",
    ]
    if _is_plain(url):
        lines.append(f"WARC-Target-URI: {url}")
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers, digest, refers_url)}", f"WARC-Refers-To-Date: {WHEN}", f"X-Refers-To-Page: {refers}"
        ]
        if _is_plain(refers_url):
            lines.append(f"WARC-Refers-To-Target-URI: {refers_url}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if kind == "revisit" else http + body
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_records(data: bytes):
    """Yield (headers, block) of each record of an archive, however its members are cut."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)))
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))


def write(
    pages: DataFrame, out: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST,
    partitions: int | None = None
) -> DataFrame:
    """Write the archives below ``out`` now; returns the manifest (file, records), one row a file.

    Of equal payloads of at least ``least`` bytes the largest page_id is the response, others revisit
    it; rows that share that page_id too are responses all. Smaller and null payloads (empty) are
    responses. A null page_id is written without a number and never is what another revisits, unless
    all of its copies have none: then all are responses. Other columns take no part, whatever their names.
    """
    heads = headers(pages, key, payload, url)
    winners = resolve(heads, least)
    # the decision travels to the payload by the page's row: (page_id, digest) is all it depends on
    decided = heads.drop("url").join(winners, "payload_digest").where("page_id is null or page_id < response").where("response is not null")
    decided = decided.select("page_id", "payload_digest", "response", "response_url").distinct()
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("body")
    )
    rows = rows.withColumns({"payload_digest": F.sha1("body"), "id_key": F.coalesce(F.col("page_id").cast("string"), F.lit(""))})
    decided = decided.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id_key"), "payload_digest", "response", "response_url")
    rows = rows.join(decided, ["id_key", "payload_digest"], "left")
    rows = rows.select(
        "page_id", "url", F.when(F.col("response").isNull(), F.col("body")).alias("body"), F.octet_length("body").alias("size"),
        "payload_digest", "response", "response_url"
    )
    if partitions:
        rows = rows.repartition(partitions)

    def save(frames):
        import pyarrow.fs as fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(out)
        store.create_dir(folder, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        buffer, records, number, done = io.BytesIO(), 0, 0, []

        def close():
            nonlocal buffer, records, number
            if records:
                name = f"part-{part:06d}-{attempt}-{number:04d}.warc.gz"
                with store.open_output_stream(f"{folder}/{name}", compression=None) as f:
                    f.write(buffer.getvalue())
                done.append((name, records))
            buffer, records, number = io.BytesIO(), 0, number + 1

        for frame in frames:
            for page, link, body, size, digest, response, address in frame.itertuples(index=False, name=None):
                ids = [None if pd.isna(x) else int(x) for x in (page, response)]
                kind = "response" if ids[1] is None else "revisit"
                record = _record(
                    kind, ids[0], link, digest, bytes(body or b""), size, ids[1], None if address is None or pd.isna(address) else address
                )
                buffer.write(gzip.compress(record, 1, mtime=0))
                records += 1
                if buffer.tell() >= FILE_BYTES:
                    close()
        close()
        if done:
            yield pd.DataFrame(done, columns=["file", "records"])

    # the manifest is what the attempts that counted returned
    rows.mapInPandas(save, "file string, records long").write.parquet(f"{out}/{MANIFEST}")
    return pages.sparkSession.read.parquet(f"{out}/{MANIFEST}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the archives: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Only files of the folder's manifest count. A response's digest and length are taken from its
    payload as read, and must equal its header's; a file that lacks records is an error.
    """
    def parse(frames):
        import hashlib

        import pyarrow.fs as fs

        store, at = fs.FileSystem.from_uri(folder)
        columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        for frame in frames:
            for name, records in zip(frame["file"], frame["records"]):
                with store.open_input_stream(f"{at}/{name}", compression=None) as f:
                    data = f.read()
                out = []
                for head, block in parse_records(data):
                    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    size, body = int(head["x-payload-length"]), None
                    if head["warc-type"] == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha1(body).hexdigest() != digest or len(body) != size:
                            raise ValueError(f"page {head['x-page-id']}: the payload doesn't match its header")
                    link = base64.b64decode(head["x-target-base64"]).decode()
                    page, refers = head["x-page-id"], head.get("x-refers-to-page")
                    out.append((int(page) if page else None, link, head["warc-type"], size, digest, int(refers) if refers else None, body))
                if len(out) != records:
                    raise ValueError(f"{name} doesn't have the records of its manifest")
                yield pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    listed = spark.read.parquet(f"{folder}/{MANIFEST}")
    tasks = min(MOST_TASKS, max(1, -(-listed.count() // 2)))
    return listed.repartition(tasks, "file").mapInPandas(
        parse, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    )


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages and read the archives back."""
    out = fresh_dir(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    if write(pages, out).isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
