"""Token ids in binary shards with a minimal perfect hash index.

A store is a folder of shards; each shard holds the ids of a contiguous range of document ids, in ascending order:

``shard-N-A.ids``  the payload: nothing but ids, little-endian unsigned integers of 2 or 4 bytes (by vocabulary size).
``shard-N-A.mph``  the index, little-endian: magic ``LMPH1\\n\\0\\0``; u64 keys n, u64 buckets m, u64 bytes of an id; i32[m]
                 displacements; u32[n] fingerprints; u64[n] places (in ids), u64[n] lengths.

A key's slot is found in constant time: its bucket's displacement d says either the slot itself (-d - 1) or
the seed of the hash that gives it; the fingerprint stored there tells keys that are not in the shard.
A key is a document id and the ordinal of its row among rows that repeat the id (0 for the first).

Files bear the name of the task attempt that writes them, and a manifest (one row per shard), which is what readers start
from, names those of the attempt whose result Spark took.  So a task that is repeated, after the loss of an executor or beside
a slow one, neither meets files of another attempt nor leaves half a file that is read.

Cases: null or empty text is the end id alone; rows with a null id are left out, as they have no key; rows that
repeat an id are stored one after another, ordered by their ids' bytes; an empty table gives an empty manifest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import materialize, shared_dir, tune
from .encoders import encoder, runs

MAGIC = b"LMPH1\n\0\0"
U64 = np.uint64
SHARD_ROWS, SHARD_BYTES = 8192, 24 << 20


def key_hash(keys: np.ndarray, ordinals: np.ndarray, seed: int | np.ndarray = 0) -> np.ndarray:
    """64-bit hash of (document id, ordinal) under a seed."""
    x = keys.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15) + ordinals.astype(U64) * U64(0xD1342543DE82EF95)
    return K.mix(K.mix(x) + np.asarray(seed).astype(U64) * U64(0xA24BAED4963EE407))


def build_mph(keys: np.ndarray, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slot of each key): a bijection of the keys to 0..n-1, about four keys a bucket."""
    n = len(keys)
    m = max(1, (n + 3) // 4)
    bucket = (key_hash(keys, ordinals) % U64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = np.searchsorted(bucket[order], np.arange(m + 1))
    size = np.diff(first)
    disp, slot, taken = np.zeros(m, np.int32), np.full(n, -1, np.int64), np.zeros(n, bool)
    for b in np.argsort(-size, kind="stable"):
        if size[b] < 2:
            break
        own = order[first[b] : first[b + 1]]
        seed = 1
        while True:  # 64 seeds at a time
            seeds = np.arange(seed, seed + 64)
            at = (key_hash(keys[own][:, None], ordinals[own][:, None], seeds[None, :]) % U64(n)).astype(np.int64)
            free = ~taken[at].any(0)
            for k in np.flatnonzero(free):
                if len(np.unique(at[:, k])) == len(own):
                    break
            else:
                seed += 64
                if seed > 1 << 30:
                    raise RuntimeError("no displacement: keys repeat")
                continue
            disp[b], slot[own], taken[at[:, k]] = seeds[k], at[:, k], True
            break
    ones = np.flatnonzero(size == 1)
    free = np.flatnonzero(~taken)[: len(ones)]
    slot[order[first[ones]]] = free
    disp[ones] = -free - 1
    return disp, slot


def fingerprints(keys: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    return (key_hash(keys, ordinals, 1 << 40) >> U64(32)).astype(np.uint32)


class Index:
    """One shard's index; ``find`` gives (place, length) in ids, length -1 for keys that are not there."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an index")
        n, m, self.width = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
        a = 32
        self.n, self.m = n, m
        self.disp = np.frombuffer(data, "<i4", m, a)
        a += 4 * m
        self.prints = np.frombuffer(data, "<u4", n, a)
        a += 4 * n
        self.place = np.frombuffer(data, "<u8", n, a).astype(np.int64)
        self.length = np.frombuffer(data, "<u8", n, a + 8 * n).astype(np.int64)

    def find(self, keys: np.ndarray, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.n:
            return np.zeros(len(keys), np.int64), np.full(len(keys), -1)
        d = self.disp[(key_hash(keys, ordinals) % U64(self.m)).astype(np.int64)].astype(np.int64)
        slot = np.where(d < 0, -d - 1, (key_hash(keys, ordinals, np.maximum(d, 0)) % U64(self.n)).astype(np.int64))
        hit = self.prints[slot] == fingerprints(keys, ordinals)
        return self.place[slot], np.where(hit, self.length[slot], -1)


def index_bytes(keys: np.ndarray, ordinals: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    n = len(keys)
    disp, slot = build_mph(keys, ordinals)
    place = np.cumsum(lengths) - lengths
    prints, p, q = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u8")
    prints[slot], p[slot], q[slot] = fingerprints(keys, ordinals), place, lengths
    return MAGIC + np.asarray([n, len(disp), width], "<u8").tobytes() + disp.astype("<i4").tobytes() + prints.tobytes() + p.tobytes() + q.tobytes()


def _fs(path: str):
    from pyarrow import fs

    for other in ("s3a://", "s3n://"):
        if path.startswith(other):
            path = "s3://" + path.removeprefix(other)
    return fs.FileSystem.from_uri(path)


def write_file(folder: str, name: str, data: bytes) -> None:
    f, p = _fs(folder)
    f.create_dir(p, recursive=True)
    with f.open_output_stream(f"{p}/{name}") as out:
        out.write(data)


def read_file(folder: str, name: str, start: int = 0, size: int | None = None) -> bytes:
    f, p = _fs(folder)
    with f.open_input_file(f"{p}/{name}") as src:
        src.seek(start)
        return src.read() if size is None else src.read(size)


def _encode(path: str, end: int, dtype: str, bounds: np.ndarray):
    schema = pa.schema([("shard", pa.int64()), ("id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        enc, width = encoder(path), np.dtype(dtype).itemsize
        for batch in runs(batches):
            values, first = enc.encode(batch.column("text"), end)
            shard = np.maximum(np.searchsorted(bounds, np.asarray(batch.column("id")), "right") - 1, 0)
            for lo, hi in _strides(first * width):
                data = values[first[lo] : first[hi]].astype(dtype)
                ids = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(((first[lo : hi + 1] - first[lo]) * width).astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(shard[lo:hi], pa.int64()), batch.column("id").slice(lo, hi - lo), ids], schema=schema)

    return run


def _strides(ends: np.ndarray, most: int = 16 << 20):
    """(first, end) of runs of rows of about ``most`` bytes; ``ends``: bytes before each row, and in all."""
    lo, n = 0, len(ends) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def _ordinals(ids: np.ndarray) -> np.ndarray:
    """Of ascending ids: the place of each among its equals."""
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    at = np.flatnonzero(new)
    return np.arange(len(ids)) - at[np.cumsum(new) - 1] if len(ids) else np.zeros(0, np.int64)


def _write(folder: str, width: int):
    def run(table: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        shard = table.column("shard")[0].as_py()
        table = table.sort_by([("id", "ascending"), ("ids", "ascending")]).combine_chunks()
        keys, ids = np.asarray(table.column("id")), table.column("ids").chunk(0)
        off = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
        lengths = np.diff(off) // width
        payload = memoryview(ids.buffers()[2])[off[0] : off[-1]]
        file = f"shard-{shard}-{TaskContext.get().taskAttemptId()}"
        write_file(folder, f"{file}.ids", payload)
        write_file(folder, f"{file}.mph", index_bytes(keys, _ordinals(keys), lengths, width))
        return pa.table({"shard": [shard], "file": [file], "n_docs": [len(keys)], "n_tokens": [int(lengths.sum())], "crc32": [zlib.crc32(payload)]})

    return run


def shard_bounds(docs: DataFrame, rows: int = SHARD_ROWS, size: int = SHARD_BYTES) -> np.ndarray:
    """Ascending first ids of shards of about ``rows`` documents and ``size`` bytes of text at most: one number a shard comes to the driver.

    Ids are sorted by range in Spark; only ids and lengths move.  A range of long texts is cut where its running sum of
    bytes passes ``size``.  Rows that repeat an id fall in one shard.
    """
    from pyspark.sql import Window as W

    ids = docs.select("id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n")).where("id is not null")
    total = ids.agg(F.count("*").alias("rows"), F.sum("n").alias("bytes")).first()
    parts = max(1, -(-total["rows"] // rows), -(-(total["bytes"] or 0) // size))
    dealt = ids.repartitionByRange(parts, "id").withColumn("p", F.spark_partition_id())
    before = F.coalesce(F.sum("n").over(W.partitionBy("p").orderBy("id").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    low = dealt.select("p", "id", F.floor(before / size).alias("k")).groupBy("p", "k").agg(F.min("id").alias("b"))
    return np.sort(np.asarray([r["b"] for r in low.collect()], np.int64))


def write_store(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", rows: int = SHARD_ROWS, path: str | None = None, size: int = SHARD_BYTES) -> tuple[str, np.ndarray, DataFrame]:
    """Encode and write; returns (folder, first ids of the shards, manifest: shard, file, n_docs, n_tokens, crc32)."""
    import json

    tune(docs.sparkSession)
    spec = json.load(open(tokenizer, encoding="utf-8"))
    most = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
    width = 2 if most < 1 << 16 else 4
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    bounds = shard_bounds(d, rows, size)
    folder = path or shared_dir(docs.sparkSession, "id-store")
    coded = d.mapInArrow(_encode(tokenizer, end_id, f"<u{width}", bounds), "shard long, id long, ids binary")
    manifest = materialize(coded.groupBy("shard").applyInArrow(_write(folder, width), "shard long, file string, n_docs long, n_tokens long, crc32 long"), "id-store-manifest")
    return folder, bounds, manifest


def _lookup(folder: str, ids_out: bool):
    def run(table: pa.Table) -> pa.Table:
        keys = np.sort(np.asarray(table.column("id")))
        file, base = table.column("file")[0].as_py(), table.column("base")[0].as_py()
        index = Index(read_file(folder, f"{file}.mph"))
        data = read_file(folder, f"{file}.ids")
        place, length = index.find(keys, _ordinals(keys))
        if (length < 0).any():
            raise KeyError(f"{int((length < 0).sum())} ids are not in {file}")
        crc, raw = [], []
        for p, n in zip(place.tolist(), length.tolist(), strict=True):
            part = np.frombuffer(data, f"<u{index.width}", n, p * index.width).astype("<u4").tobytes()
            crc.append(zlib.crc32(part))
            if ids_out:
                raw.append(part)
        out = {"id": keys, "start": place + base, "n_tokens": length, "ids_crc32": pa.array(crc, pa.int64())}
        return pa.table(out | ({"ids": pa.array(raw, pa.binary())} if ids_out else {}))

    return run


def read_store(keys: DataFrame, folder: str, bounds: np.ndarray, manifest: DataFrame, ids: bool = False) -> DataFrame:
    """Look up every row of ``keys`` (column id) in the store: id, start, n_tokens, ids_crc32, with ``ids`` the ids.

    The n-th row with an id finds the n-th stored row of it.  An id that is not in the store raises KeyError.
    """
    from pyspark.sql import Window as W

    # one row a shard: the running sum is over the manifest, not over documents
    base = manifest.withColumn("base", F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)))
    base = base.select("shard", "file", F.coalesce("base", F.lit(0)).alias("base"))

    def place(batches):
        for b in batches:
            i = np.asarray(b.column("id"))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.maximum(np.searchsorted(bounds, i, "right") - 1, 0), pa.int64())], names=["id", "shard"])

    at = keys.select("id").where("id is not null").mapInArrow(place, "id long, shard long").join(base, "shard")
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "start", "n_tokens", "ids_crc32")] + [T.StructField("ids", T.BinaryType())] * ids)
    return at.groupBy("shard").applyInArrow(_lookup(folder, ids), kind)


def op4_perfect_hash_ids(spark, sf_dir):
    """Write the ids of all ``documents`` and read them back through the index."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, bounds, manifest = write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)
    keys = docs.select(F.col("doc_id").cast("long").alias("id"))
    return read_store(keys, folder, bounds, manifest).withColumnRenamed("id", "doc_id")
