"""Substring deduplication with repeated-phrase automata.

A window is ``window`` consecutive words of one document.  Each word that a window covers whose word sequence also
starts in a document with a smaller id is removed; windows are judged on the input, not on what is left.

How, in three passes over the texts:

1. *Propose.*  Of every window the smallest-hashed phrase of ``phrase`` words is noted (winnowing), about one phrase in
   fourteen positions.  Equal windows note equal phrases, so that a window that recurs holds a phrase that recurs.
2. *Confirm and locate.*  The documents are dealt into bounded shards by a hash of their id.  For each shard an
   Aho-Corasick automaton is compiled from the phrases that recur in the corpus and occur in the shard, and each
   document of the shard streams through it, which finds every occurrence by its characters.  Windows around an
   occurrence are hashed; a minimum per hash gives the first document of each.
3. *Remove.*  Shards with windows that start in an earlier document mark the words that those cover.

Documents whose word sequence equals that of a document with a smaller id never reach steps 2 and 3: each of their windows starts
there, so that all their words go, if they have ``window`` words at all.  What moves between tasks is, but for the
texts themselves, one row per (phrase, document) and one per (window, shard), so that a passage that very many
documents share meets no single task with all its copies.

Cases: null or empty text has no words and stays as it is; null ids are neither sources nor changed; rows that repeat
an id are all judged, and are no sources for each other; texts of fewer words than a window lose nothing;
other columns, whatever their names, pass through.  Equality of windows is that of 64-bit hashes of them.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import materialize, tune

_PHRASES = "__kind int, __shard long, __h long, __h2 long, __id long, __n long"
U64 = np.uint64
SHARD_BYTES = 8 << 20


def _frame(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


def _whole(word: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the word sequence of each text."""
    n = np.diff(first).astype(U64)
    whole = []
    for which in (0, 1):
        up, down = K.powers(len(word) + 1, which)
        total = np.concatenate([np.zeros(1, U64), np.cumsum(word * up[: len(word)])])
        whole.append(K.mix((total[first[1:]] - total[first[:-1]]) * down[first[:-1]] + n))
    return whole


def _propose(window: int, phrase: int):
    names = ("__kind", "__shard", "__h", "__h2", "__id", "__n")
    schema = pa.schema([("__kind", pa.int32())] + [(n, pa.int64()) for n in names[1:]])

    def run(batches):
        for batch in batches:
            ids_all = batch.column("__id")
            known = ~np.asarray(ids_all.is_null())
            ids_all = np.asarray(ids_all.fill_null(0))
            shard_all = np.asarray(batch.column("__shard"))
            for lo, hi, buf, off in K.pieces(batch.column("__text")):
                starts, ends, first = K.spans(buf, off)
                ids, shard, ok = ids_all[lo:hi], shard_all[lo:hi], known[lo:hi]
                n = np.diff(first)
                word = K.byte_hashes(buf, starts, ends)
                whole = _whole(word, first)
                pick = ok & (n >= window)
                yield _frame({"__kind": np.zeros(pick.sum(), np.int32), "__shard": shard[pick], "__h": whole[0][pick].view(np.int64), "__h2": whole[1][pick].view(np.int64), "__id": ids[pick], "__n": n[pick]}, schema)
                at, row = K.inside(first, window)
                if not len(at):
                    continue
                low = K.sliding_min(K.ngrams(word, phrase), window - phrase + 1)[at]
                new = np.ones(len(at), bool)
                new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
                new &= ok[row]
                h, row = low[new], row[new]
                # once per phrase and text; in place of the id stands the text's digest, as copies of a text are settled otherwise
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                one = np.ones(len(h), bool)
                one[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, row = h[one], row[one]
                m = len(h)
                yield _frame({"__kind": np.ones(m, np.int32), "__shard": shard[row], "__h": h.view(np.int64), "__h2": np.zeros(m, np.int64), "__id": (whole[0][row] >> U64(16)).view(np.int64), "__n": np.zeros(m, np.int64)}, schema)

    return run


def _keep(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int, gone: np.ndarray | None) -> bytes:
    if gone is None:
        return b" ".join(buf[starts[lo] : ends[hi - 1]].tobytes().split()) if hi > lo else b""
    raw = buf[starts[lo] : ends[hi - 1]].tobytes().split() if hi > lo else []
    return b" ".join([w for w, g in zip(raw, gone, strict=True) if not g])


def _finish(table: pa.Table, rows: list[int], n_words: list[int], removed: list[int], kept: list[bytes], digest: bool, out: pa.Schema, kind: int) -> pa.Table:
    """Result rows: the input's columns with the text replaced, and the counts.  A text that loses nothing stays as it is."""
    part = table.take(pa.array(rows, pa.int64()))
    old = part.column("__text")
    changed = pa.array([r > 0 for r in removed], pa.bool_())
    new = pa.array([k.decode() for k in kept] if not digest else [None] * len(rows), pa.string())
    made = {
        "__kind": pa.array([kind] * len(rows), pa.int32()),
        "__n_words": pa.array(n_words, pa.int64()),
        "__n_removed": pa.array(removed, pa.int64()),
        "__sha": pa.array([hashlib.sha256(k).hexdigest() for k in kept] if digest else [None] * len(rows), pa.string()),
    }
    if not digest:
        made["__text"] = pa.chunked_array([pa.compute.if_else(changed, new, old.cast(pa.string()).combine_chunks() if old.num_chunks != 1 else old.cast(pa.string()).chunk(0))]) if rows else old
    return _conform(part, made, out)


def _conform(part: pa.Table, made: dict, out: pa.Schema) -> pa.Table:
    n = part.num_rows
    cols = []
    for f in out:
        if f.name in made:
            c = made[f.name]
        elif f.name in part.column_names:
            c = part.column(f.name)
        else:
            c = pa.nulls(n, f.type)
        cols.append(c.cast(f.type) if not isinstance(c, pa.ChunkedArray) or c.type != f.type else c)
    return pa.Table.from_arrays(cols, schema=out)


def _locate(window: int, phrase: int, digest: bool, out: pa.Schema):
    """Pass 2 on one shard: left its documents, right the recurring phrases and the copies in it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        kinds, hs = np.asarray(right.column("__kind")), np.asarray(right.column("__h"))
        copy_ids = np.asarray(right.column("__id"))[kinds == 0].tolist()
        copies = set(copy_ids)
        digests = set(zip(copy_ids, hs[kinds == 0].tolist(), np.asarray(right.column("__h2"))[kinds == 0].tolist(), np.asarray(right.column("__n"))[kinds == 0].tolist(), strict=True))
        wanted = np.unique(hs[kinds == 1].view(U64))
        ids_col = left.column("__id")
        ids = ids_col.to_pylist()
        # all rows of an id are here: where it has several, the text tells which are copies
        several = {i for i, k in Counter(ids).items() if k > 1} & copies
        done: tuple[list, list, list, list] = ([], [], [], [])
        later, win = [], []
        parts = []
        automaton, seen = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), set()
        for lo, hi, buf, off in K.pieces(left.column("__text")) if len(wanted) else ():
            starts, ends, first = K.spans(buf, off)
            at, row = K.inside(first, phrase)
            if not len(at):
                continue
            h = K.ngrams(K.byte_hashes(buf, starts, ends), phrase)[at]
            k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            hit = wanted[k] == h
            for i, x in zip(at[hit].tolist(), h[hit].tolist(), strict=True):
                if x not in seen:
                    seen.add(x)
                    automaton.add_word(b" ".join(buf[starts[i] : ends[i + phrase - 1]].tobytes().split()).decode() + " ")
        if seen:
            automaton.make_automaton()
        for lo, hi, buf, off in K.pieces(left.column("__text")):
            starts, ends, first = K.spans(buf, off)
            windows = noted = whole = None
            for r in range(lo, hi):
                a, b = int(first[r - lo]), int(first[r - lo + 1])
                n, i = b - a, ids[r]
                copy = i in copies
                if i in several:
                    if whole is None:
                        whole = [x.view(np.int64) for x in _whole(K.byte_hashes(buf, starts, ends), first)]
                    copy = (i, int(whole[0][r - lo]), int(whole[1][r - lo]), n) in digests
                if copy:
                    done[0].append(r), done[1].append(n), done[2].append(n if n >= window else 0), done[3].append(b"")
                    continue
                raw = buf[starts[a] : ends[b - 1]].tobytes().split() if n else []
                flat = b" ".join(raw)
                found = None
                if seen and n >= window and i is not None:
                    text = flat.decode() + " "
                    found = [e for e, _ in automaton.iter(text)]
                if found:
                    # an occurrence begins at a word or not at all: check its first character's place
                    size = np.fromiter((len(w.decode()) for w in raw), np.int64, n) + 1
                    end_at = np.cumsum(size) - 1  # of the space after each word
                    last = np.searchsorted(end_at, np.asarray(found))
                    last = last[(end_at[np.minimum(last, n - 1)] == np.asarray(found)) & (last >= phrase - 1)]
                    begin = last - phrase + 1
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, np.maximum(begin + phrase - window, 0), 1)
                    np.add.at(cover, begin + 1, -1)
                    near = np.flatnonzero(np.cumsum(cover)[: n - window + 1] > 0)
                    if noted is None:
                        noted = K.sliding_min(K.ngrams(K.byte_hashes(buf, starts, ends), phrase), window - phrase + 1)
                    # a window that recurs has noted a phrase that recurs
                    mine = noted[a + near]
                    near = near[wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine]
                    if len(near):
                        if windows is None:
                            windows = K.ngrams(K.byte_hashes(buf, starts, ends), window)
                        win.append((windows[a + near], np.full(len(near), i, np.int64)))
                        later.append(r)
                        continue
                done[0].append(r), done[1].append(n), done[2].append(0), done[3].append(flat)
        parts.append(_finish(left, *done, digest, out, 0))
        if later:
            parts.append(_conform(left.take(pa.array(later, pa.int64())), {"__kind": pa.array([1] * len(later), pa.int32())}, out))
            h, i = np.concatenate([x for x, _ in win]), np.concatenate([x for _, x in win])
            order = np.lexsort((i, h))
            h, i = h[order], i[order]
            begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            ends_ = np.concatenate([begins[1:], [len(h)]]) - 1
            m = len(begins)
            shard = left.column("__shard")[0].as_py()
            made = {"__kind": pa.array([2] * m, pa.int32()), "__shard": pa.array([shard] * m, pa.int64()), "__h": pa.array(h[begins].view(np.int64)), "__id": pa.array(i[begins]), "__most": pa.array(i[ends_])}
            parts.append(pa.Table.from_arrays([made[f.name] if f.name in made else pa.nulls(m, f.type) for f in out], schema=out))
        return pa.concat_tables(parts)

    return run


def _remove(window: int, digest: bool, out: pa.Schema):
    """Pass 3 on one shard: left the documents with candidate windows, right the windows that start earlier."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        h, g = np.asarray(right.column("__h")).view(U64), np.asarray(right.column("__first"))
        order = np.argsort(h)
        h, g = h[order], g[order]
        ids = left.column("__id").to_pylist()
        done: tuple[list, list, list, list] = ([], [], [], [])
        for lo, hi, buf, off in K.pieces(left.column("__text")):
            starts, ends, first = K.spans(buf, off)
            w = K.ngrams(K.byte_hashes(buf, starts, ends), window)
            for r in range(lo, hi):
                a, b = int(first[r - lo]), int(first[r - lo + 1])
                gone = None
                if len(h) and b - a >= window:
                    mine = w[a : b - window + 1]
                    k = np.minimum(np.searchsorted(h, mine), len(h) - 1)
                    at = np.flatnonzero((h[k] == mine) & (g[k] < ids[r]))
                    if len(at):
                        cover = np.zeros(b - a + 1, np.int64)
                        cover[at] += 1
                        np.add.at(cover, at + window, -1)
                        gone = np.cumsum(cover)[:-1] > 0
                done[0].append(r), done[1].append(b - a), done[2].append(int(gone.sum()) if gone is not None else 0), done[3].append(_keep(buf, starts, ends, a, b, gone))
        return _finish(left, *done, digest, out, 0)

    return run


def _shard(id_col: str, shards: int):
    return F.coalesce(F.pmod(F.xxhash64(id_col), F.lit(int(shards))), F.lit(0)).cast("long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, phrase: int = 25, digest: bool = False, shards: int | None = None) -> DataFrame:
    """``docs`` without the words that an earlier document's window covers, with ``n_words`` and ``n_removed``.

    The kept words of a changed text are joined by one space.  With ``digest`` the result has the id, the two
    counts and ``kept_sha256`` of the kept words joined by one space, and no text.  ``n_words`` and
    ``n_removed`` replace columns of these names.  ``shards``: by default one for each 8 MB of text.
    """
    if not 0 < phrase <= window:
        raise ValueError("a phrase must be shorter than a window")
    spark = docs.sparkSession
    tune(spark)
    base = docs.select(id_col, text_col) if digest else docs
    keep = [(f"__c{i}", c) for i, c in enumerate(base.columns) if c not in (id_col, text_col, "n_words", "n_removed")]
    d = base.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), *(F.col(f"`{c}`").alias(a) for a, c in keep))
    if shards is None:
        size = d.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
        shards = max(1, size // SHARD_BYTES)
    d = d.withColumn("__shard", _shard("__id", shards))

    proposed = materialize(d.select("__id", "__shard", "__text").mapInArrow(_propose(window, phrase), _PHRASES), "repeats-phrases", by="__kind")
    whole, seen = proposed.where("__kind = 0"), proposed.where("__kind = 1")
    first = whole.groupBy("__h", "__h2", "__n").agg(F.min("__id").alias("__least"), F.max("__id").alias("__most")).where("__least < __most").drop("__most")
    copies = whole.join(first, ["__h", "__h2", "__n"]).where("__id > __least").select(F.lit(0).alias("__kind"), "__shard", "__h", "__h2", "__id", "__n")
    recurring = seen.groupBy("__h").agg(F.min("__id").alias("__least"), F.max("__id").alias("__most")).where("__least < __most").select("__h")
    phrases = seen.join(recurring, "__h").select("__shard", "__h").distinct().select(F.lit(1).alias("__kind"), "__shard", "__h", *(F.lit(0).cast("long").alias(c) for c in ("__h2", "__id", "__n")))
    known = copies.unionByName(phrases).withColumnRenamed("__shard", "__dealt")

    fields = [f for f in d.schema.fields] + [T.StructField(n, t) for n, t in (("__n_words", T.LongType()), ("__n_removed", T.LongType()), ("__sha", T.StringType()), ("__h", T.LongType()), ("__most", T.LongType()), ("__kind", T.IntegerType()))]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    located = materialize(d.groupBy("__shard").cogroup(known.groupBy("__dealt")).applyInArrow(_locate(window, phrase, digest, arrow), schema), "repeats-located", by="__kind")
    # one shuffle for the minimum and the join, which both read all of it: no column is nullable, as a filter on one side alone would part them;
    # a window has one row a shard at most, and the shard follows from the id
    value = {c: F.coalesce(c, F.lit(0)) for c in ("__h", "__id", "__most")}
    windows = located.where("__kind = 2").select(value["__h"].alias("__h"), value["__id"].alias("__id"), value["__most"].bitwiseXOR(value["__id"]).alias("__more")).repartition("__h")
    starts = windows.groupBy("__h").agg(F.min("__id").alias("__first"), F.max(F.col("__id").bitwiseXOR(F.col("__more"))).alias("__last")).where("__first < __last").select("__h", "__first")
    back = windows.join(starts, "__h").where(F.col("__first") < F.col("__id").bitwiseXOR(F.col("__more"))).select(_shard("__id", shards).alias("__dealt"), "__h", "__first")
    pending = located.where("__kind = 1").select(*d.columns)
    rest = pending.groupBy("__shard").cogroup(back.groupBy("__dealt")).applyInArrow(_remove(window, digest, arrow), schema)
    done = located.where("__kind = 0").select(*schema.names).unionByName(rest)
    if digest:
        return done.select(F.col("__id").alias(id_col), F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.col("__sha").alias("kept_sha256"))
    names = {id_col: "__id", text_col: "__text"} | {c: a for a, c in keep}
    return done.select(*(F.col(names[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns if c in names), F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"))


def op2_repeated_phrases(spark, sf_dir):
    """Repeated passages of 50 words over all ``documents``."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
