"""Phrase collocations: word n-grams counted in tries of burstable hash containers, scored by their weakest cut.

1. A task turns words into ids of its own and keeps, for each language, a shallow trie: under each first word a hash
   container of the phrases that begin with it.  A container of more than ``BURST`` entries bursts into one container a
   second word.
2. Beyond ``ENTRIES`` entries the task spills whole subtrees, the largest first, as sorted runs: the run's words in byte order and
   the phrases as numbers over them.  A run belongs to one prefix partition, which the phrase's first word tells.
3. Runs are written, and their entries counted by partition.  Partitions of more than ``HOT`` times the mean (of a very common
   first word) are cut by a hash of the rest of the phrase, each run once, so that no task merges more than a few times the mean.
4. A partition's runs are merged: they are sorted, and sums below ``least`` end there.
5. Parts of a candidate are at least as frequent as it is, so the scores are joins of what is left; keys of very many candidates are
   broadcast.  Products are decimals of 38 digits.

Result per language (null: ``und``): the first ``top`` phrases with rank, a (occurrences), l and r (of the parts of the lowest-scoring
cut), n (all words) and score.

Cases: a null or empty text has no words; rows that repeat an id, null ids and other columns do not matter; an empty table
gives no rows; ties are ordered by score, a and the phrase's bytes; a very long text is cut at word ends by nothing but the batch
it comes in, which holds it whole.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from .common import join_hot, join_small, materialize, tune

#: Entries of a container before it bursts, entries and words that a task holds before it spills.
BURST, ENTRIES, WORDS = 4096, 1 << 20, 1 << 19
#: Bytes of text a prefix partition, and how many times the mean a partition may hold before it is cut.
PART_BYTES, HOT = 8 << 20, 3
BITS = 21
MASK = (1 << BITS) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", 10, 11, 12, 13]] = True
_BREAK = _STOP.copy()
_BREAK[[9, 32]] = True


def words_and_pieces(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all rows as binary values, and a number for the piece that each stands in."""
    buf = LOWER[buf]
    stop, word = _STOP[buf], ~_BREAK[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[off[:-1][off[:-1] < len(buf)]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    values = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(buf[word])])
    return values, np.cumsum(stop)[starts] + np.searchsorted(off, starts, "right") if len(starts) else starts


def ngram_counts(ids: np.ndarray, piece: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed phrases of 1 to ``longest`` words that stay in a piece, in order, and how often each stands there."""
    keys = [ids << 2 * BITS]
    for n in range(2, longest + 1):
        m = len(ids) - n + 1
        if m > 0:
            k = sum(ids[j : j + m] << BITS * (2 - j) for j in range(n))
            keys.append(k[piece[:m] == piece[n - 1 :]])
    return np.unique(np.concatenate(keys), return_counts=True)


class Burst(dict):
    """What a container becomes: second word to container."""


class Trie:
    """Counts of phrases by first word, as hash containers that burst."""

    def __init__(self, burst: int = BURST):
        self.root: dict[int, dict] = {}
        self.size, self.burst = 0, burst

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """``keys``: packed phrases in order."""
        first = keys >> 2 * BITS
        begin = np.flatnonzero(np.diff(first, prepend=-1))
        rest, counts = (keys & (1 << 2 * BITS) - 1).tolist(), counts.tolist()
        for f, a, b in zip(first[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True):
            node = self.root.get(f)
            if node is None:
                node = self.root[f] = dict(zip(rest[a:b], counts[a:b], strict=True))
                self.size += b - a
            elif type(node) is dict:
                self.size -= len(node)
                have = node.get
                for k, c in zip(rest[a:b], counts[a:b], strict=True):
                    node[k] = have(k, 0) + c
                self.size += len(node)
            else:
                for k, c in zip(rest[a:b], counts[a:b], strict=True):
                    under = node.setdefault(k >> BITS, {})
                    self.size += k not in under
                    under[k] = under.get(k, 0) + c
            if type(node) is dict and len(node) > self.burst:
                wide = self.root[f] = Burst()
                for k, c in node.items():
                    wide.setdefault(k >> BITS, {})[k] = c

    def subtrees(self) -> list[tuple[int, int]]:
        """(entries, first word) of each, the largest first."""
        return sorted(((len(n) if type(n) is dict else sum(map(len, n.values())), f) for f, n in self.root.items()), reverse=True)

    def take(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whole subtrees of ``least`` entries or more together, out of the trie: first words, packed rests and counts."""
        first, size, keys, counts, got = [], [], [], [], 0
        for n, f in self.subtrees():
            if got >= least:
                break
            node = self.root.pop(f)
            for part in (node,) if type(node) is dict else node.values():
                keys.extend(part)
                counts.extend(part.values())
            first.append(f)
            size.append(n)
            got += n
        self.size -= got
        return np.repeat(np.array(first, np.int64), size), np.array(keys, np.int64), np.array(counts, np.int64)


def _pack(x: np.ndarray) -> bytes:
    """64-bit numbers, compressed byte position by byte position."""
    return pa.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<i8").ravel()


RUN = pa.schema([("lang", pa.string()), ("part", pa.int64()), ("slice", pa.int64()), ("entries", pa.int64()), ("words", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])
RUN_SQL = "lang string, part long, slice long, entries long, words binary, keys binary, counts binary"


def _run(level: list[np.ndarray], count: np.ndarray, words: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """One sorted run: ``level`` has the places of the first, second and third words in ``words`` (in byte order), from 1; 0 is none."""
    own = np.unique(np.concatenate(level))
    own = own[own > 0]
    a, b, c = (np.where(x > 0, np.searchsorted(own, x) + 1, 0) for x in level)
    m = len(own) + 1
    return len(count), b" ".join(words[own - 1]), _pack(np.diff((a * m + b) * m + c, prepend=0)), _pack(count)


def _runs(lang: str, taken: tuple[np.ndarray, ...], vocabulary: list[bytes], partition: np.ndarray):
    first, rest, count = taken
    level = [first, rest >> BITS, rest & MASK]
    used = np.unique(np.concatenate(level))
    used = used[used > 0]
    words = np.empty(len(used), object)
    words[:] = [vocabulary[i - 1] for i in used.tolist()]
    order = sorted(range(len(used)), key=words.__getitem__)
    rank = np.zeros(len(vocabulary) + 1, np.int64)
    rank[used[order]] = np.arange(1, len(used) + 1)
    part, words = partition[first], words[order]
    level = [rank[x] for x in level]
    at = np.lexsort((*level[::-1], part))
    part = part[at]
    begin = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(begin, [*begin[1:], len(part)], strict=True):
        yield (lang, int(part[a]), 0, *_run([x[at[a:b]] for x in level], count[at[a:b]], words))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RUN, strict=True)], schema=RUN)


def _count(parts: int, longest: int, entries: int, burst: int, most_words: int):
    """Texts to sorted runs; part -1 has in ``entries`` how many words a language has."""

    def run(batches):
        tries: dict[str, Trie] = {}
        ids: dict[bytes, int] = {}
        vocabulary: list[bytes] = []
        total: dict[str, int] = {}

        def spill(least: int | None):
            """Of the largest trie ``least`` entries at least, or all of all tries, whose word ids then start anew."""
            partition = np.array([0, *(crc32(w) % parts for w in vocabulary)], np.int64)
            for lang, t in [max(tries.items(), key=lambda x: x[1].size)] if least else tries.items():
                taken = t.take(least or t.size)
                rows = list(_runs(lang, taken, vocabulary, partition)) if len(taken[2]) else []
                for k in range(0, len(rows), 64):
                    yield _batch(rows[k : k + 64])
            if not least:
                tries.clear(), ids.clear(), vocabulary.clear()

        for batch in batches:
            lang = pc.fill_null(batch.column("lang"), "und")
            for name in pc.unique(lang).to_pylist():
                for _, _, buf, off in K.pieces(batch.column("text").filter(pc.equal(lang, name))):
                    values, piece = words_and_pieces(buf, off)
                    if not len(values):
                        continue
                    total[name] = total.get(name, 0) + len(values)
                    d = values.dictionary_encode()
                    if len(vocabulary) + len(d.dictionary) > most_words:
                        yield from spill(None)
                    local = np.empty(len(d.dictionary), np.int64)
                    for j, w in enumerate(d.dictionary.to_pylist()):
                        i = ids.get(w)
                        if i is None:
                            vocabulary.append(w)
                            i = ids[w] = len(vocabulary)
                        local[j] = i
                    t = tries.setdefault(name, Trie(burst))
                    t.add(*ngram_counts(local[np.asarray(d.indices)], piece, longest))
                    while sum(x.size for x in tries.values()) > entries:
                        yield from spill(entries // 2)
        yield from spill(None)
        if total:
            yield _batch([(k, -1, 0, n, b"", b"", b"") for k, n in total.items()])

    return run


def _decode(words: bytes, keys: bytes, n: int) -> tuple[list[bytes], list[np.ndarray]]:
    own = words.split(b" ")
    m = len(own) + 1
    k = np.cumsum(_unpack(keys, n))
    return own, [k // (m * m), k // m % m, k % m]


def _cut(batches):
    """Runs in ``slices`` by a hash of the words after the first; of one word alone, slice 0."""
    for batch in batches:
        for r in batch.to_pylist():
            words, level = _decode(r["words"], r["keys"], r["entries"])
            count = _unpack(r["counts"], r["entries"])
            h = np.array([0, *map(crc32, words)], np.uint64)
            at = np.where(level[1] > 0, K.mix(h[level[1]] * np.uint64(31) + h[level[2]]) % np.uint64(r["slices"]), np.uint64(0)).astype(np.int64)
            own = np.empty(len(words), object)
            own[:] = words
            rows = []
            for s in np.unique(at).tolist():
                pick = at == s
                rows.append((r["lang"], r["part"], s, *_run([x[pick] for x in level], count[pick], own)))
            yield _batch(rows)


MERGED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("a", pa.int64())])


def _merge(least: int):
    """All runs of one partition to its phrases that stand ``least`` times or more."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        read = [_decode(r["words"], r["keys"], r["entries"]) for r in rows]
        code = pa.array([w for own, _ in read for w in own], pa.binary()).dictionary_encode()
        order = pc.sort_indices(code.dictionary)
        words = code.dictionary.take(order)
        place = np.empty(len(order), np.int64)
        place[np.asarray(order)] = np.arange(1, len(order) + 1)
        place, level, start = place[np.asarray(code.indices)], [[], [], []], 0
        for own, three in read:
            new = np.concatenate([np.zeros(1, np.int64), place[start : start + len(own)]])
            start += len(own)
            for k in range(3):
                level[k].append(new[three[k]])
        a, b, c = (np.concatenate(x) for x in level)
        count = np.concatenate([_unpack(r["counts"], r["entries"]) for r in rows])
        if len(words) <= MASK:
            key = (a << 2 * BITS) | (b << BITS) | c
            at = np.argsort(key, kind="stable")  # merges the sorted runs
            new = np.diff(key[at], prepend=-1) != 0
        else:
            at = np.lexsort((c, b, a))
            new = np.any([np.diff(x[at], prepend=-1) != 0 for x in (a, b, c)], axis=0)
        begin = np.flatnonzero(new)
        total = np.add.reduceat(count[at], begin)
        often = total >= least
        pick, total = at[begin[often]], total[often]
        words = [w.decode("utf-8", "replace") for w in words.to_pylist()] if len(pick) else []
        three = list(zip(a[pick].tolist(), b[pick].tolist(), c[pick].tolist(), strict=True))
        phrase = [" ".join(words[i - 1] for i in t if i) for t in three]
        n = len(pick)
        return pa.table([pa.array([rows[0]["lang"]] * n, pa.string()), pa.array(phrase, pa.string()), pa.array([sum(map(bool, t)) for t in three], pa.int32()), pa.array(total, pa.int64())], schema=MERGED)

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, part_bytes: int = PART_BYTES, entries: int = ENTRIES, burst: int = BURST, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of the phrases of 1 to ``longest`` (2 or 3) words that stand ``least`` times or more, and (lang, n)."""
    if longest not in (2, 3):
        raise ValueError("longest must be 2 or 3")
    tune(docs.sparkSession)
    d = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    runs = materialize(d.mapInArrow(_count(parts, longest, entries, burst, words), RUN_SQL), "phrase-runs")
    total = runs.where("part < 0").groupBy("lang").agg(F.sum("entries").alias("n"))
    held = runs.where("part >= 0")
    key = ["lang", "part"]
    sizes = materialize(held.groupBy(*key).agg(F.sum("entries").alias("all")), "phrase-parts")
    mean = sizes.agg(F.sum("all") / F.lit(parts)).first()[0] or 1
    hot = sizes.where(F.col("all") > HOT * mean).select(*key, F.ceil(F.col("all") / mean).alias("slices"))
    d = join_small(held, hot, key, "left")
    cold = d.where("slices is null").drop("slices")
    cut = d.where("slices is not null").mapInArrow(_cut, RUN_SQL)
    merged = cold.unionByName(cut).groupBy("lang", "part", "slice").applyInArrow(_merge(least), "lang string, phrase string, size int, a long")
    return materialize(merged, "phrase-counts"), materialize(total, "phrase-totals")


def _looked_up(d: DataFrame, f: DataFrame, key: str, value: str) -> DataFrame:
    """``d`` with ``value``, the occurrences of the phrase in column ``key``."""
    on = ["lang", key]
    need = d.groupBy(*on).agg(F.count("*").alias("w"))
    have = f.select("lang", F.col("phrase").alias(key), F.col("a").alias(value))
    return join_hot(d, materialize(have.join(need, on), f"phrase-{key}"), on, "w")


def _part(w: Column, start, n) -> Column:
    return F.array_join(F.slice(w, start, n), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, **bounds) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score); see the module's docstring.

    A candidate goes where a longer one that holds it has ``share`` percent of its occurrences or more.
    """
    f, total = phrase_counts(docs, text_col, lang_col, longest, least, **bounds)
    w, size = F.split("phrase", " "), F.col("size")
    cand = f.where("size > 1")
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(w, 1, F.col("k")).alias("left"), _part(w, F.col("k") + 1, size - F.col("k")).alias("right"))
    cuts = materialize(_looked_up(cuts, f, "left", "l"), "phrase-cuts")
    cuts = _looked_up(cuts, f, "right", "r")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"num": big("a") * big("a") * F.lit(1000000).cast("decimal(7,0)"), "den": big("l") * big("r")})
    low = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("num div den").cast("long").alias("score"), "k", "l", "r")).alias("m"))
    low = low.select("lang", "phrase", "a", "m.score", "m.l", "m.r")
    inner = cand.where("size > 2").withColumn("n_", F.explode(F.sequence(F.lit(2), size - 1))).withColumn("s_", F.explode(F.sequence(F.lit(1), size - F.col("n_") + 1)))
    inner = inner.select("lang", _part(w, F.col("s_"), F.col("n_")).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = low.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    for by in (["lang", "salt"], ["lang"]):
        kept = kept.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return join_small(kept.drop("salt"), total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir):
    """The first 2,000 phrases of 2 or 3 words of each language of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
