"""WARC archives written and read as a chunked record table."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, new_path, written

CHUNK = 1 << 20
READ = 1 << 18
CHUNKS = "record_id string, page_key string, chunk_no int, data binary, so_far long, sha1_so_far string, last boolean, record_type string, refers_to string, stated_bytes long, stated_digest string, uri string"


def base32_sha1(h) -> str:
    return base64.b32encode(h.digest()).decode()


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """(id, url, body, sha1, payload_bytes, record_type, refers_to, named) of every row; a null body is empty.

    Of rows with equal payloads of at least min_revisit_bytes that with the largest id is the response, the others
    revisit it; a row without an id is a response that none refers to. named: the row is the only one with its id and
    payload, and others may refer to its record. Largest ids are found per digest with partial maxima before the shuffle
    and written, so that both sides of the join back are plain exchanges and the rows of a hot digest can be split over
    tasks.
    """
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body")).withColumn("sha1", F.sha1("body"))
    ids = rows.groupBy("sha1", "id").agg(F.count("*").alias("n"))
    top = written(ids.groupBy("sha1").agg(F.max("id").alias("top"), F.max_by("n", "id").alias("n")), "tops")
    size = F.octet_length("body").cast("long")
    revisit = F.coalesce((size >= min_revisit_bytes) & (F.col("id") < F.col("top")), F.lit(False))
    named = F.coalesce((F.col("id") == F.col("top")) & (F.col("n") == 1), F.lit(False))
    return rows.join(top, "sha1").select("id", "url", "body", "sha1", size.alias("payload_bytes"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("top")).alias("refers_to"), (named | (revisit & (F.col("n") == 1))).alias("named"))


def _record_id(key: str, sha1: str) -> str:
    """The record of the one row with this id and payload, which revisits refer to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}:{sha1}')}>"


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """One WARC file (a gzip member per record) per partition of plan_records() in folder; returns (path, records, bytes).

    Payloads go through the packer in pieces; a revisit holds none. A task writes under a name of its own attempt and
    renames at the end, so a repeated task leaves one whole file under the partition's name. Null urls are written as
    urn:page:ID. Every record has an id of its own; a revisit names its response's where that page is one row, and its
    page's key always.
    """
    payload = F.when(F.col("record_type") == "response", F.col("body")).otherwise(F.lit("").cast("binary"))
    rows = plan.select(F.col("id").cast("string").alias("k"), "url", payload.alias("b"), "payload_bytes", "sha1", "record_type", F.col("refers_to").cast("string").alias("r"), "named")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name, own = f"{root}/part-{part:06d}.warc.gz", f"{root}/.tmp-{part:06d}-{uuid.uuid4().hex}"
        n = size = 0
        with fs.open_output_stream(own) as out:
            for batch in batches:
                k, u, b, nb, dg, rt, rf, nm = (batch.column(i) for i in range(8))
                for i in range(batch.num_rows):
                    key, data = k[i].as_py(), b[i].as_buffer()
                    kind, refers, sha1 = rt[i].as_py(), rf[i].as_py(), dg[i].as_py()
                    own_id = _record_id(key, sha1) if nm[i].as_py() and refers is None else f"<urn:uuid:{uuid.uuid4()}>"
                    uri = (u[i].as_py() or f"urn:page:{key}").translate({10: "%0A", 13: "%0D"})
                    head = [
                        "WARC/1.1",
                        f"WARC-Type: {kind}",
                        f"WARC-Record-ID: {own_id}",
                        f"WARC-Target-URI: {uri}",
                        "WARC-Date: 2000-01-01T00:00:00Z",
                        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
                        *([] if key is None else [f"X-Page-Key: {key}"]),
                        f"X-Payload-Length: {nb[i].as_py()}",
                        f"Content-Length: {len(data)}",
                    ]
                    if refers is not None:
                        head += [*([f"WARC-Refers-To: {_record_id(refers, sha1)}"] if nm[i].as_py() else []), f"X-Refers-To-Key: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    size += out.write(z.compress(("\r\n".join(head) + "\r\n\r\n").encode()))
                    view = memoryview(data)
                    for at in range(0, len(view), CHUNK):
                        size += out.write(z.compress(view[at : at + CHUNK]))
                    size += out.write(z.compress(b"\r\n\r\n") + z.flush())
                    n += 1
        if n:
            fs.move(own, name)
        else:
            fs.delete_file(own)
        yield pa.RecordBatch.from_arrays([pa.array([name] if n else [], pa.string()), pa.array([n] if n else [], pa.int64()), pa.array([size] if n else [], pa.int64())], names=["path", "records", "bytes"])

    spark = plan.sparkSession
    found = arrow_map(rows, run, "path string, records long, bytes long").collect()  # a row per file
    return spark.createDataFrame(found, "path string, records long, bytes long").repartition(max(1, len(found)))


def _records(raw, chunk: int) -> Iterator[tuple]:
    """(headers, chunk number, data, bytes so far, digest so far, last) of a stream of gzip members or plain records."""

    def inflate() -> Iterator[bytes]:
        first = raw.read(2)
        if first != b"\x1f\x8b":
            while first:
                yield first
                first = raw.read(READ)
            return
        z, block = zlib.decompressobj(31), first + raw.read(READ)
        while block:
            got = z.decompress(block, CHUNK)
            if got:
                yield got
            if z.eof:
                block = z.unused_data or raw.read(READ)
                z = zlib.decompressobj(31)
            else:
                block = z.unconsumed_tail or raw.read(READ)

    source = inflate()
    buf = bytearray()

    def fill(n: int) -> bool:
        while len(buf) < n:
            more = next(source, None)
            if more is None:
                return False
            buf.extend(more)
        return True

    while True:
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not fill(len(buf) + 1):
                if buf.strip():
                    raise ValueError("a WARC header is cut off")
                return
        lines = bytes(buf[:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        del buf[: end + 4]
        head = {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in lines[1:])}
        left, sha, so_far, k = int(head["content-length"]), hashlib.sha1(), 0, 0
        while True:
            take = min(chunk, left)
            if not fill(take):
                raise ValueError("a WARC record is cut off")
            data = bytes(buf[:take])
            del buf[:take]
            left -= take
            so_far += take
            sha.update(data)
            yield head, k, data, so_far, base32_sha1(sha), left == 0
            k += 1
            if not left:
                break
        if not fill(4) or bytes(buf[:4]) != b"\r\n\r\n":
            raise ValueError("a WARC record has no end")
        del buf[:4]


def read_chunks(files: DataFrame, folder: str, *, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunk table of the archives: a row per record and chunk number, with the bytes and digest up to its end.

    No record is held whole: files are read in blocks, inflated in blocks and cut into rows of at most chunk bytes. A
    record without payload has one empty chunk. data=False leaves the bytes out. Malformed archives raise ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("record_id", pa.string()), ("page_key", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_()), ("record_type", pa.string()), ("refers_to", pa.string()), ("stated_bytes", pa.int64()), ("stated_digest", pa.string()), ("uri", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as raw:
                    for head, k, got, so_far, sha, last in _records(raw, chunk):
                        stated = head.get("x-payload-length")
                        rows.append((head.get("warc-record-id"), head.get("x-page-key"), k, got if data else None, so_far, sha, last, head.get("warc-type"), head.get("x-refers-to-key"), None if stated is None else int(stated), head.get("warc-payload-digest", "").removeprefix("sha1:") or None, head.get("warc-target-uri")))
                        held += len(got) if data else 0
                        if len(rows) >= 4096 or held >= 16 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return arrow_map(files.select("path"), run, CHUNKS)


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_revisit_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the archives, read them back, and give per page what the archives say.

    One row per record: id, payload_bytes, payload_digest, record_type, refers_to. A response's bytes and digest are
    those of the chunks read, a revisit's those its header states; a response whose chunks have another length or digest
    than the payload had before it was written (which its header tells) raises. Null payloads count as empty; rows with
    a null id have a record and are responses; repeated ids give a record each, and equal rows are written as responses
    both (neither has the larger id). Other columns are ignored; an empty table gives no rows.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    kind = pages.schema[id_col].dataType
    plan = plan_records(pages, id_col=id_col, url_col=url_col, body_col=body_col, min_revisit_bytes=min_revisit_bytes)
    files = write_archives(plan, folder)
    c = read_chunks(files, folder, data=False).where("last")
    revisit = F.col("record_type") == "revisit"
    wrong = ~revisit & ((F.col("sha1_so_far") != F.col("stated_digest")) | (F.col("so_far") != F.col("stated_bytes")))
    digest = F.when(wrong, F.raise_error(F.concat(F.lit("payload differs in record "), F.col("record_id")))).when(revisit, F.col("stated_digest")).otherwise(F.col("sha1_so_far"))
    return c.select(F.col("page_key").cast(kind).alias(id_col), F.when(revisit, F.col("stated_bytes")).otherwise(F.col("so_far")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
