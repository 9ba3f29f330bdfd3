"""WARC archives: writing, and reading by boundary-chain verification.

Writing: payloads are told apart by SHA-1; of equal ones (of at least ``revisit_bytes``) the page with the largest id is the
``response`` and the others are ``revisit`` records that refer to it.  Pages are dealt to archives of bounded size by a hash
of their id; an archive bears the name of the task attempt that writes it, and the manifest names those that count.

Reading: archives are cut into byte blocks, one task each.  A task looks for record magic in its block, whatever it
stands in, and emits for each candidate the offset of the record that would follow it.  What is a record is then decided by
the chain: offset 0 of each archive is one, and so is each offset that a record is followed by.  Chains within a
block are contracted in its task; over blocks they are found by pointer jumping, in a number of rounds that is the
logarithm of the blocks of an archive.  Magic inside a payload is never reached and is dropped.

Cases: null html is an empty payload; a null url an empty target; rows with a null id are left out, as their record
could not be named; of rows that repeat an id the one with the least payload digest is written; an empty table gives no
archive; an archive that breaks off gives the records before the break.  Control characters in a target are escaped.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize, shared_dir, tune
from .id_store import _fs, write_file

ARCHIVE_BYTES, BLOCK_BYTES = 16 << 20, 4 << 20
GZIP, PLAIN = b"\x1f\x8b\x08", b"WARC/1.0\r\n"
RECORD = "file long, block long, offset long, succ long, exit long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, sound boolean"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _escape(url: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page: int, url: str, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One record's bytes, uncompressed."""
    kind = "response" if refers is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_escape(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return PLAIN + "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _write(folder: str, compress: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        plan = {i: (d, r) for i, d, r in zip(*(right.column(c).to_pylist() for c in ("id", "d", "response")), strict=True)}
        ids = left.column("id").to_pylist()
        if not plan:
            return pa.table({"file": pa.array([], pa.int64()), "name": pa.array([], pa.string()), "bytes": pa.array([], pa.int64()), "records": pa.array([], pa.int64())})
        out, done, urls, html = [], set(), left.column("url"), left.column("html")
        for k in sorted(range(len(ids)), key=ids.__getitem__):
            i = ids[k]
            payload = (html[k].as_py() or "").encode()
            sha = hashlib.sha1(payload)
            if i in done or sha.hexdigest() != plan[i][0]:
                continue
            done.add(i)
            data = record(i, urls[k].as_py() or "", payload, base64.b32encode(sha.digest()).decode(), None if plan[i][1] == i else plan[i][1])
            out.append(_gzip(data) if compress else data)
        number = right.column("file")[0].as_py()
        data = b"".join(out)
        name = f"pages-{number}-{TaskContext.get().taskAttemptId()}.warc"
        write_file(folder, name, data)
        return pa.table({"file": [number], "name": [name], "bytes": [len(data)], "records": [len(out)]})

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0, compress: bool = True, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """(folder, manifest: file, name, bytes, records)."""
    tune(pages.sparkSession)
    d = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).where("id is not null")
    slim = d.select("id", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("d"), F.octet_length(F.coalesce(F.col("html"), F.lit(""))).cast("long").alias("size"))
    slim = materialize(slim.groupBy("id").agg(F.min(F.struct("d", "size")).alias("s")).select("id", "s.*"), "warc-digests")
    total = slim.agg(F.sum("size")).first()[0] or 0
    file = F.pmod(F.xxhash64("id"), F.lit(max(1, total // archive_bytes)))
    # payloads met once answer for themselves; those of very many pages are broadcast
    last = slim.where(F.col("size") >= revisit_bytes).groupBy("d").agg(F.max("id").alias("response"), F.count("*").alias("rows")).where("rows > 1")
    plan = join_hot(slim, materialize(last, "warc-copies"), ["d"], "rows", "left").select(file.alias("file"), "id", "d", F.coalesce("response", "id").alias("response"))
    folder = path or shared_dir(pages.sparkSession, "warc")
    done = d.withColumn("of", file).groupBy("of").cogroup(plan.groupBy("file")).applyInArrow(_write(folder, compress), "file long, name string, bytes long, records long")
    return folder, materialize(done, "warc-manifest")


def _header(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def _number(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


class _Source:
    """Bytes of an archive from ``base`` on, read further as they are asked for."""

    def __init__(self, folder: str, name: str, base: int, size: int, total: int):
        fs, p = _fs(folder)
        self.file = fs.open_input_file(f"{p}/{name}")
        self.file.seek(base)
        self.base, self.total = base, total
        self.data = self.file.read(size)

    def upto(self, end: int) -> bool:
        """Whether the archive has bytes up to ``end``, which are then held."""
        if end > self.total:
            return False
        need = end - self.base - len(self.data)
        if need > 0:
            self.data += self.file.read(max(need, 1 << 16))
        return end - self.base <= len(self.data)


def _plain_at(src: _Source, at: int) -> tuple[int, bytes, bytes] | None:
    """(offset after the record, header, payload) of an uncompressed record at offset ``at``."""
    size = 1 << 12
    while True:
        src.upto(min(src.total, at + size))
        cut = src.data.find(b"\r\n\r\n", at - src.base)
        if cut >= 0 or at + size >= src.total:
            break
        size *= 4
    if cut < 0:
        return None
    head = src.data[at - src.base : cut]
    n = _header(head).get("content-length", "")
    if not n.isdigit():
        return None
    body = src.base + cut + 4
    end = body + int(n) + 4
    if not src.upto(end) or src.data[end - 4 - src.base : end - src.base] != b"\r\n\r\n":
        return None
    return end, head, src.data[body - src.base : end - 4 - src.base]


def _gzip_at(src: _Source, at: int) -> tuple[int, bytes, bytes] | None:
    """The same of a record that is one gzip member."""
    d, out, pos = zlib.decompressobj(31), [], at
    try:
        while not d.eof:
            if pos >= src.total:
                return None
            src.upto(min(src.total, pos + (1 << 14)))
            part = src.data[pos - src.base : pos - src.base + (1 << 14)]
            if not out and not part:
                return None
            out.append(d.decompress(part))
            pos += len(part)
    except zlib.error:
        return None
    data = b"".join(out)
    head, found, rest = data.partition(b"\r\n\r\n")
    n = _header(head).get("content-length", "")
    if not data.startswith(PLAIN) or not found or not n.isdigit() or len(rest) != int(n) + 4:
        return None
    return pos - len(d.unused_data), head, rest[:-4]


def candidates(folder: str, name: str, lo: int, hi: int, total: int, compress: bool):
    """(offset, successor, header, payload) of each candidate record that begins in [lo, hi)."""
    magic = GZIP if compress else PLAIN
    src = _Source(folder, name, lo, min(hi + len(magic), total) - lo, total)
    at = src.data.find(magic)
    while 0 <= at < hi - lo:
        got = (_gzip_at if compress else _plain_at)(src, lo + at)
        if got:
            yield lo + at, *got
        at = src.data.find(magic, at + 1)


def _scan(folder: str, block_bytes: int, compress: bool):
    fields = [f.strip().split(" ") for f in RECORD.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in fields])

    def run(batches):
        for b in batches:
            for file, name, block, total in zip(*(b.column(c).to_pylist() for c in ("file", "name", "block", "bytes")), strict=True):
                lo = block * block_bytes
                hi = min(total, lo + block_bytes)
                rows = []
                for at, succ, head, payload in candidates(folder, name, lo, hi, total, compress):
                    h = _header(head)
                    digest = h.get("warc-payload-digest", "").rpartition(":")[2]
                    kind = h.get("warc-type", "")
                    size, sound = h.get("x-payload-length", ""), True
                    if kind == "response":
                        own = base32_sha1(payload)
                        digest, sound, size = own, own == digest, str(len(payload))
                    rows.append([file, block, at, succ, succ, _number(h.get("warc-record-id")), kind, int(size) if size.isdigit() else None, digest, _number(h.get("warc-refers-to")), h.get("warc-target-uri"), sound])
                place = {r[2]: r for r in rows}
                for r in reversed(rows):  # contracted: where the chain from here leaves the block
                    nxt = place.get(r[3])
                    r[4] = nxt[4] if nxt else r[3]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _follow():
    """Records of a block that the chain from its entry reaches."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        entries = right.column("offset").to_pylist()
        if not entries or not left.num_rows:
            return left.slice(0, 0)
        at = {o: (k, s) for k, (o, s) in enumerate(zip(left.column("offset").to_pylist(), left.column("succ").to_pylist(), strict=True))}
        pick, o = [], min(entries)
        while o in at:
            k, o = at[o]
            pick.append(k)
        return left.take(pa.array(pick, pa.int64()))

    return run


def read_archives(folder: str, manifest: DataFrame, compress: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The records that the chains reach: page_id, record_type, payload_bytes, payload_digest, refers_to, url, sound.

    ``sound``: a response's payload has the digest that its header states.
    """
    spark = manifest.sparkSession
    blocks = manifest.where("bytes > 0").select("file", "name", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block_bytes))).alias("block"))
    parts = max(1, blocks.count())  # tasks are bounded, so that a task scans several blocks, one after another, of very large stores
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(blocks.repartition(max(least, min(parts, 10_000)), "file", "block").mapInArrow(_scan(folder, block_bytes, compress), RECORD), "warc-candidates")
    most = manifest.agg(F.max("bytes")).first()[0] or 0
    rounds = int(np.ceil(np.log2(most // block_bytes + 2)))
    jump = found.select("file", "offset", "exit")
    reach = manifest.where("bytes > 0").select("file", F.lit(0).cast("long").alias("offset"))
    for k in range(rounds):
        step = reach.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reach = reach.unionByName(step).distinct()
        if k + 1 < rounds:
            far = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("to"))
            jump = materialize(jump.join(far, ["file", "exit"], "left").select("file", "offset", F.coalesce("to", "exit").alias("exit")), "warc-jumps")
            reach = materialize(reach, "warc-reached")
    entry = reach.select(F.col("file").alias("f"), F.floor(F.col("offset") / block_bytes).cast("long").alias("b"), "offset")
    kept = found.groupBy("file", "block").cogroup(entry.groupBy("f", "b")).applyInArrow(_follow(), found.schema)
    return kept.select("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "sound")


def op10_warc_archives(spark, sf_dir):
    """Write all ``pages`` to archives and read them back."""
    folder, manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")
