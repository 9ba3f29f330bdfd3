"""Byte-level BPE over a corpus: each distinct pre-token is encoded once, in one global shuffle.

1. Each task splits its texts into pre-tokens.  A run of texts becomes one *chunk*: the texts as positions in the
   chunk's own list of distinct pre-tokens, and that list.
2. Pre-tokens are dealt by a hash of themselves to shards (a chunk's share of a shard moves as one compressed row), and
   each distinct one is encoded once by the ranks.  There is a shard for each ``SHARD_BYTES`` of text, so that what all chunks have
   in one shard stays within some MB, however large the corpus.
3. The ids go back to the chunk, and texts are put together again by position.

Words thus move once per chunk that holds them, whatever their frequency; no word, however common, makes a large
group: it has one row a chunk.  Chunks are runs of rows of one scan task, of bounded bytes.
Decoding looks ids up in the table of token bytes, whose size is that of the vocabulary.

Cases: null or empty text has no ids; null ids and rows that repeat an id pass through, one result a row;
an empty table gives an empty result; other columns are not kept.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tune

CHUNK_BYTES, SHARD_BYTES = 24 << 20, 16 << 20
_CORES: dict[str, object] = {}


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _core(path: str, pattern: str):
    if path not in _CORES:
        import tiktoken

        _CORES[path] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
    return _CORES[path]


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


class _Units(dict):
    """The pre-token numbers, as bytes, of a unit that begins with a space, or None where no cut is safe there."""

    def __init__(self, numbers: _Numbers, findall):
        self.numbers, self.findall = numbers, findall

    def __missing__(self, unit):
        s = unit
        if not s or s[0].isspace() or s[-1].isspace():
            got = None
        else:
            got = np.fromiter(map(self.numbers.__getitem__, self.findall(" " + s)), np.int32).tobytes()
        self[unit] = got
        return got


def _pack(parts: list[bytes]) -> bytes:
    """Byte strings as one compressed blob: their number, their lengths, their bytes."""
    import zstandard

    sizes = np.fromiter(map(len, parts), "<u4", len(parts)).tobytes()
    return zstandard.ZstdCompressor(3).compress(np.asarray([len(parts)], "<u4").tobytes() + sizes + b"".join(parts))


def _unpack(blob: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist(), strict=False)] if n else []


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers with their low bytes together, and so on, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(3).compress(x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _numbers(blob: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def _shard_of(words: list[bytes], shards: int) -> np.ndarray:
    """The shard of each word."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)) % np.uint64(shards)


def _split(pattern: str, part: str, chunk_bytes: int, shards: int):
    """part: "texts" or "words", the two sides of the chunks; both number the same pre-tokens in the same way."""
    if part == "texts":
        schema = pa.schema([("chunk", pa.int64()), ("id", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("codes", pa.binary()), ("shards", pa.binary())])
    else:
        schema = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("words", pa.binary())])

    def run(batches):
        import regex

        findall = regex.compile(pattern).findall
        base, count = TaskContext.get().partitionId() << 24, 0
        numbers = _Numbers()
        units = _Units(numbers, findall)
        ids: list = []
        codes: list[bytes] = []
        size = 0

        def flush():
            nonlocal numbers, units, ids, codes, size, count
            chunk = base + count
            words = [w.encode() for w in numbers]
            shard = _shard_of(words, shards)
            if part == "texts":
                n = [len(c) // 4 for c in codes]
                blobs = _planes(np.frombuffer(b"".join(codes), np.int32)), _planes(shard.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([ids], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in blobs)], schema=schema)
            else:
                order = np.argsort(shard, kind="stable")
                which, first = np.unique(shard[order], return_index=True)
                cut = [*first.tolist(), len(order)]
                blobs = [_pack([words[i] for i in order[a:b].tolist()]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(blobs), pa.int64()), pa.array(which.astype(np.int64)), pa.array(blobs, pa.binary())], schema=schema)
            count += 1
            numbers = _Numbers()
            units = _Units(numbers, findall)
            ids, codes, size = [], [], 0

        for batch in batches:
            doc = batch.column("id").to_pylist()
            text = batch.column("text")
            for r, i in enumerate(doc):
                t = text[r].as_py() or ""
                p = t.split(" ")
                tail = p[1:] if part == "texts" else dict.fromkeys(p[1:])
                got = list(map(units.__getitem__, tail))
                whole = None in got or len(p) > 1 and (not p[0] or p[0][-1].isspace())
                head = np.fromiter(map(numbers.__getitem__, findall(t if whole else p[0])), np.int32)
                ids.append(i)
                if part == "texts":
                    codes.append(head.tobytes() if whole else head.tobytes() + b"".join(got))
                size += len(t)
                if size >= chunk_bytes:
                    yield from flush()
        if ids:
            yield from flush()

    return run


def _encode_words(path: str, pattern: str):
    """One shard: each distinct word is encoded once, for all the chunks that hold it."""

    def run(table: pa.Table) -> pa.Table:
        single = _core(path, pattern)._core_bpe.encode_single_piece
        known: dict[bytes, bytes] = {}
        out = []
        for blob in table.column("words").to_pylist():
            words = _unpack(blob)
            for w in words:
                if w not in known:
                    known[w] = np.asarray(single(w), "<u4").tobytes()
            out.append(_pack([known[w] for w in words]))
        return pa.table({"of": table.column("chunk"), "shard": table.column("shard"), "ids": pa.array(out, pa.binary())})

    return run


def _assemble(path: str, full: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        table = token_bytes(path)
        got = {s: blob for s, blob in zip(right.column("shard").to_pylist(), right.column("ids").to_pylist(), strict=True)}
        byte_of = table.__getitem__
        out: dict[str, list] = {"id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        for row in left.to_pylist():
            shard = _numbers(row["shards"])
            order = np.argsort(shard, kind="stable").tolist()
            word: list = [b""] * len(order)
            for k, x in zip(order, (x for s in np.unique(shard).tolist() for x in _unpack(got[s])), strict=True):
                word[k] = x
            get = word.__getitem__
            codes = _numbers(row["codes"]).tolist()
            a = 0
            for i, n in zip(row["id"], row["n"], strict=True):
                raw = b"".join(map(get, codes[a : a + n]))
                a += n
                text = b"".join(map(byte_of, np.frombuffer(raw, "<u4").tolist()))
                out["id"].append(i), out["n_tokens"].append(len(raw) // 4)
                if full:
                    out["ids"].append(raw), out["decoded"].append(text)
                else:
                    out["ids_sha256"].append(hashlib.sha256(raw).hexdigest()), out["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
        names = ("ids", "decoded") if full else ("ids_sha256", "decoded_sha256")
        kind = pa.binary() if full else pa.string()
        return pa.table({"id": pa.array(out["id"], pa.int64()), "n_tokens": pa.array(out["n_tokens"], pa.int64())} | {n: pa.array(out[n], kind) for n in names})

    return run


_TABLES: dict[str, list[bytes]] = {}


def token_bytes(path: str) -> list[bytes]:
    """The table of token bytes by id; ids that are not in the file are empty."""
    if path not in _TABLES:
        have = ranks(path)
        table = [b""] * (max(have.values()) + 1)
        for b, i in have.items():
            table[i] = b
        _TABLES[path] = table
    return _TABLES[path]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True, chunk_bytes: int = CHUNK_BYTES, stable: bool = False, shards: int | None = None) -> DataFrame:
    """Encode each text and decode the ids again: id, n_tokens and ids (little-endian u32), decoded (bytes).

    With ``full=False`` the SHA-256 of ids and of decoded bytes stand in their place.  Texts are read twice and must
    come in the same partitions and order each time, as files do: say so with ``stable``, else they are written first.
    """
    tune(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    d = d if stable else materialize(d, "bpe-input")
    if not shards:
        size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    texts = d.mapInArrow(_split(pattern, "texts", chunk_bytes, shards), "chunk long, id array<long>, n array<long>, codes binary, shards binary")
    words = d.mapInArrow(_split(pattern, "words", chunk_bytes, shards), "chunk long, shard long, words binary")
    coded = words.groupBy("shard").applyInArrow(_encode_words(vocabulary, pattern), "of long, shard long, ids binary")
    names = "ids binary, decoded binary" if full else "ids_sha256 string, decoded_sha256 string"
    out = texts.groupBy("chunk").cogroup(coded.groupBy("of")).applyInArrow(_assemble(vocabulary, full), f"id long, n_tokens long, {names}")
    return out.withColumnRenamed("id", id_col)


def decode(ids: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``ids`` with the bytes that each row's little-endian u32 ids stand for (null stays null)."""

    def run(batches):
        get = token_bytes(vocabulary).__getitem__
        for b in batches:
            got = [None if x is None else b"".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], names=[*b.schema.names, out_col])

    from pyspark.sql import types as T

    return ids.mapInArrow(run, T.StructType([*ids.schema.fields, T.StructField(out_col, T.BinaryType())]))


def op7_byte_bpe(spark, sf_dir):
    """Encode and decode all ``documents``."""
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, full=False, stable=True)
