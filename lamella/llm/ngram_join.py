"""N-gram Jaccard join by MinHash banding.

Two documents are linked when the Jaccard similarity of their sets of ``n``-word shingles is at least ``threshold``.

1. Each text gets a 128-bit digest of its set of shingles and ``bands`` hashes of ``rows`` minima each.  Band and row
   counts are chosen so that a pair at the threshold shares a band with probability ``recall`` or more.
2. Texts with equal sets are one class; only the class's first document goes on, so that copies cost nothing.
3. A shuffle on band hashes makes buckets.  Each member of a bucket is linked to the bucket's smallest (never all pairs), and
   the connected components of these links hold every candidate pair.
4. Pairs are verified on the full sets where they meet: in their component, or, where a component of loosely joined texts has more
   pairs than its buckets have, bucket by bucket, each pair in the first band that it shares.  So the work follows the candidate
   pairs and not the square of a component.  Components and buckets of more than ``block`` members or many shingles are split
   into blocks, each pair of blocks in one task.  Sets are compared by merging, or as a matrix product where most pairs are
   candidates.  What leaves a task is a count per document and a spanning forest of the verified links, not the pairs.
5. Connected components of the verified links are the classes of near duplicates.

Result per document: id, ``class_id`` (smallest id of the connected near duplicates), ``copy_of`` (smallest id with the
same shingle set), ``n_links`` (documents that are linked to it and differ from it in their sets, one counted for each
distinct set), ``n_shingles``.

Cases: a text of fewer than ``n`` words has its whole word sequence as its one shingle; a null or empty text
has none and is linked to nothing (class_id and copy_of are its own id); rows with a null id are left out, as they
cannot be named in a result; rows that repeat an id are documents of their own where their sets differ, and one where they do not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import connected_components, join_hot, materialize, tune

U64 = np.uint64
#: Members and shingles of a block, and members and shingles that one task verifies, about.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
TASK_MEMBERS, TASK_SHINGLES = 2048, 1 << 22


def choose_bands(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands of ``rows`` rows with which a pair at ``threshold`` shares a band with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, row after row in ascending order, and each row's first place among them."""
    starts, ends, first = K.spans(buf, off)
    word = K.byte_hashes(buf, starts, ends)
    at, row = K.inside(first, n)
    h = K.ngrams(word, n)[at] if len(at) else np.zeros(0, U64)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        up, down = K.powers(len(word) + 1)
        total = np.concatenate([np.zeros(1, U64), np.cumsum(word * up[: len(word)])])
        own = K.mix((total[first[short + 1]] - total[first[short]]) * down[first[short]] + count[short].astype(U64))
        h, row = np.concatenate([h, own]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(off)))


def _sign(n: int, bands: int, rows: int):
    rng = np.random.default_rng(20240229)
    mul = rng.integers(0, 1 << 63, bands * rows, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.int64).astype(U64)
    schema = pa.schema([("id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for lo, hi, d, size, h, first in _digested(batch.column("text"), n):
                m, full = hi - lo, np.flatnonzero(size)
                sig = np.zeros((m, bands), U64)
                if len(full):
                    begin = first[full]
                    for b in range(bands):
                        acc = np.full(len(full), b + 1, U64)
                        for k in range(b * rows, (b + 1) * rows):
                            low = np.minimum.reduceat(h * mul[k] + add[k], begin)
                            acc = K.mix(acc * U64(31) + low)
                        sig[full, b] = acc
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * bands), pa.array(sig.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, m), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), pa.array(size.astype(np.int64)), lists], schema=schema)

    return run


def _digests(h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two hashes of each set, given where the sets begin; none is empty."""
    return np.stack([np.add.reduceat(K.mix(h + U64(1)), begin), np.bitwise_xor.reduceat(K.mix(h ^ U64(0x5851F42D4C957F2D)), begin) + size.astype(U64)])


def _digested(column: pa.Array, n: int):
    """(first row, end row, digests, sizes, shingles, first shingle of each row) of runs of texts."""
    for lo, hi, buf, off in K.pieces(column):
        h, first = shingle_sets(buf, off, n)
        size = np.diff(first)
        full = np.flatnonzero(size)
        d = np.zeros((2, hi - lo), U64)
        if len(full):
            d[:, full] = _digests(h, first[full], size[full])
        yield lo, hi, d, size, h, first


def _sets(n: int):
    """The shingles of each row whose text has the digest that is asked for."""
    schema = pa.schema([("node", pa.int64()), ("bands", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            want = np.stack([np.asarray(batch.column(c)).view(U64) for c in ("d1", "d2")])
            for lo, hi, d, _, h, first in _digested(batch.column("text"), n):
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
                out = pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in ("node", "bands")] + [lists], schema=schema)
                yield out.filter(pa.array((d == want[:, lo:hi]).all(0)))

    return run


def _candidates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (one hash per band) share a band."""
    out = np.zeros((len(a), len(b)), bool)
    for k in range(a.shape[1]):
        out |= a[:, k][:, None] == b[:, k][None, :]
    return out


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], ask: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a's and b's sets where ``ask`` holds."""
    out = np.zeros(ask.shape, np.int64)
    if ask.sum() * 16 > ask.size and ask.size >= 1024:
        ids = np.concatenate(a + b)
        row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in a + b])
        terms, code, n = np.unique(ids, return_inverse=True, return_counts=True)
        column = np.cumsum(n > 1) - 1
        code_kept = n[code] > 1
        code, row = column[code[code_kept]], row[code_kept]
        width = int((n > 1).sum())
        total = np.zeros(ask.shape, np.float32)
        for lo in range(0, width, 4096):  # a strip of columns at a time
            pick = (code >= lo) & (code < lo + 4096)
            m = np.zeros((len(a) + len(b), min(4096, width - lo)), np.float32)
            m[row[pick], code[pick] - lo] = 1
            total += m[: len(a)] @ m[len(a) :].T
        return np.where(ask, total.astype(np.int64), 0)
    for i, j in zip(*np.nonzero(ask), strict=True):
        x, y = (a[i], b[j]) if len(a[i]) <= len(b[j]) else (b[j], a[i])
        k = np.minimum(np.searchsorted(y, x), len(y) - 1)
        out[i, j] = int((y[k] == x).sum())
    return out


def _verify(threshold: float):
    """All groups of one bucket: (count per document) and (spanning links), told apart by ``b`` being null."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key = pd.DataFrame({c: np.asarray(table.column(c)) for c in ("unit", "band", "p", "q", "block", "node")})
        ids = key["node"].to_numpy()

        def lists(name):
            c = table.column(name)
            c = c.chunk(0) if c.num_chunks else None
            off = np.asarray(c.offsets)
            return off - off[0], np.asarray(c.flatten())

        so, sv = lists("shingles")
        bo, bv = lists("bands")
        sv = sv.view(U64)
        width = int(bo[1] - bo[0]) if len(bo) > 1 else 0
        bands = bv.reshape(-1, width)
        out_a, out_b, out_n = [], [], []
        for (_, band, p, q), rows in key.groupby(["unit", "band", "p", "q"]).indices.items():
            block = key["block"].to_numpy()[rows]
            left = np.sort(rows[block == p])
            right = left if p == q else np.sort(rows[block == q])
            if not len(left) or not len(right):
                continue
            # in a bucket, whose members share its band, a pair counts where they share no band before it
            ask = _candidates(bands[left], bands[right]) if band < 0 else ~_candidates(bands[left, :band], bands[right, :band])
            if p == q:
                ask &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
            size_l, size_r = so[left + 1] - so[left], so[right + 1] - so[right]
            ask &= np.minimum(size_l[:, None], size_r) >= threshold * np.maximum(size_l[:, None], size_r) - 1e-9
            both = _overlaps([sv[so[i] : so[i + 1]] for i in left], [sv[so[i] : so[i + 1]] for i in right], ask)
            union = size_l[:, None] + size_r[None, :] - both
            hit = ask & (both >= threshold * union - 1e-9)
            for rows_, n in ((left, hit.sum(1)), (right, hit.sum(0))):
                pos = np.flatnonzero(n)
                out_a += ids[rows_[pos]].tolist()
                out_b += [None] * len(pos)
                out_n += n[pos].tolist()
            parent = {}

            def root(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i, j in zip(*np.nonzero(hit), strict=True):
                x, y = int(ids[left[i]]), int(ids[right[j]])
                rx, ry = root(x), root(y)
                if rx != ry:
                    parent[max(rx, ry)] = min(rx, ry)
                    out_a.append(x), out_b.append(y), out_n.append(0)
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "n": pa.array(out_n, pa.int64())})

    return run


def _nodes(signed: DataFrame) -> tuple[DataFrame, bool]:
    """``signed`` with ``node``, which is the id, or a hash where an id repeats with another set; and whether any id repeats."""
    repeats = signed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    if not repeats:
        return signed.withColumn("node", F.col("id")), False
    key = ["id", "d1", "d2", "n_shingles"]
    own = signed.select(*key).distinct().withColumn("k", F.row_number().over(W.partitionBy("id").orderBy(*key[1:])))
    own = own.select(*key, F.when(F.col("k") == 1, F.col("id")).otherwise(F.xxhash64(*key)).alias("node"))
    return materialize(signed.dropDuplicates(key).join(own, key), "join-nodes"), True


def units(banded: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Where candidate pairs meet: (node, n_shingles, unit, band, blocks, block) of each member, and (node) of all candidates.

    A unit is a component (band -1) or a bucket of a band.
    """
    at = banded.select("node", "n_shingles", F.posexplode("bands").alias("band", "h"))
    buckets = at.groupBy("band", "h").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("m"), F.sum("n_shingles").alias("total"))
    buckets = materialize(buckets.where("lead < last").drop("last"), "join-buckets")
    edges = join_hot(at, buckets.select("band", "h", "lead", "m"), ["band", "h"], "m").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    comps = materialize(connected_components(edges, "join-candidates"), "join-components")
    size = comps.join(banded.select("node", "n_shingles"), "node").groupBy("component").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("total"))
    of = buckets.join(comps.withColumnRenamed("node", "lead"), "lead")
    cost = of.groupBy("component").agg(F.sum(F.col("m") * F.col("m")).alias("cost"))
    size = materialize(size.join(cost, "component").withColumn("whole", (F.col("m") <= block) | (F.col("m") * F.col("m") <= F.col("cost"))), "join-sizes")
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("long").alias("blocks")
    known = comps.join(banded.select("node", "n_shingles"), "node")
    by_component = join_hot(materialize(known, "join-known"), size.where("whole").select("component", blocks, "m"), ["component"], "m").select("node", "n_shingles", F.col("component").alias("unit"), F.lit(-1).alias("band"), "blocks")
    loose = materialize(of.join(size.where("not whole").select("component"), "component").select("band", "h", "m", blocks), "join-loose")
    by_bucket = join_hot(at, loose, ["band", "h"], "m").select("node", "n_shingles", F.col("h").alias("unit"), "band", "blocks")
    every = by_component.unionByName(by_bucket)
    return materialize(every.withColumn("block", F.pmod(F.xxhash64("node", "band"), F.col("blocks"))), "join-units"), comps.select("node")


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float, rows: int, block: int) -> tuple[DataFrame, bool]:
    """(id, d1, d2, n_shingles, node, copy_of, class_id, n_links, leads) of each document, and whether ids repeat."""
    tune(docs.sparkSession)
    bands = choose_bands(threshold, recall, rows)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    signed, repeats = _nodes(materialize(d.mapInArrow(_sign(n, bands, rows), "id long, d1 long, d2 long, n_shingles long, bands array<long>"), "join-signed"))
    slim = signed.drop("bands")
    digest = ["d1", "d2", "n_shingles"]
    firsts = slim.where("n_shingles > 0").groupBy(*digest).agg(F.min(F.struct("id", "node")).alias("f"), F.count("*").alias("k")).where("k > 1")
    firsts = materialize(firsts.select(*digest, F.col("f.id").alias("copy_of"), F.col("f.node").alias("head"), "k"), "join-copies")
    classes = join_hot(slim, firsts, digest, "k", "left").withColumns({"copy_of": F.coalesce("copy_of", "id"), "head": F.coalesce("head", "node")})
    classes = materialize(classes, "join-classes")
    heads = classes.where("node = head and n_shingles > 0").select("node")
    banded = materialize(signed.join(heads, "node", "left_semi"), "join-heads")
    every, candidates = units(banded, block)

    text = d.join(banded.join(candidates, "node", "left_semi").select("id", "node", "d1", "d2", "bands"), "id")
    sets = text.mapInArrow(_sets(n), "node long, bands array<long>, shingles array<long>")
    sets = materialize(sets.dropDuplicates(["node"]) if repeats else sets, "join-sets")
    work = every.agg(F.sum("blocks").alias("members"), F.sum(F.col("blocks") * F.col("n_shingles")).alias("shingles")).first()
    tasks = max(1, int(work["members"] or 0) // TASK_MEMBERS, int(work["shingles"] or 0) // TASK_SHINGLES)
    pairs = every.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.select("node", "unit", "band", "block", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"))
    pairs = pairs.withColumn("task", F.pmod(F.xxhash64("unit", "band", "p", "q"), F.lit(tasks))).join(sets, "node")
    found = materialize(pairs.groupBy("task").applyInArrow(_verify(threshold), "a long, b long, n long"), "join-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("head")).agg(F.sum("n").alias("n_links"))
    near = connected_components(found.where("b is not null").select("a", "b"), "join-near").select(F.col("node").alias("head"), F.col("component").alias("label"))
    out = classes.join(counts, "head", "left").join(near, "head", "left").withColumn("label", F.coalesce("label", "head"))
    if repeats:
        out = materialize(out, "join-labelled")
        lead = out.groupBy("label").agg(F.min(F.struct("id", *digest)).alias("f"))
        out = out.join(lead, "label").withColumns({"class_id": F.col("f.id"), "leads": F.struct("id", *digest) == F.col("f")}).drop("f")
    else:  # nodes are ids
        out = out.withColumns({"class_id": F.least("label", "copy_of"), "leads": F.col("id") == F.least("label", "copy_of")})
    return out.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")), repeats


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999, rows: int = 5, block: int = BLOCK) -> DataFrame:
    """(id, class_id, copy_of, n_links, n_shingles) for each document; see the module's docstring."""
    out, _ = _classes(docs, id_col, text_col, n, threshold, recall, rows, block)
    return out.select(F.col("id").alias(id_col), "class_id", "copy_of", "n_links", "n_shingles")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999, rows: int = 5, block: int = BLOCK) -> DataFrame:
    """Of each class the document with the smallest id, one row of it; those with a null id stay."""
    out, repeats = _classes(docs, id_col, text_col, n, threshold, recall, rows, block)
    if not repeats:
        return docs.join(out.where("not leads").select(F.col("id").alias(id_col)), id_col, "left_anti").select(*docs.columns)

    row = docs.where(F.col(id_col).isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kind = T.StructType([*row.schema.fields, T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())])

    def digests(batches):
        for b in batches:
            for lo, hi, d, *_ in _digested(b.column("text"), n):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x.view(np.int64)) for x in d)], names=[*part.schema.names, "d1", "d2"])

    kept = row.mapInArrow(digests, kind).join(out.where("leads").select("id", "d1", "d2"), ["id", "d1", "d2"], "left_semi")
    kept = kept.groupBy("id", "d1", "d2").agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def op5_ngram_jaccard_join(spark, sf_dir):
    """Near duplicates of all ``documents``: five-word shingles, similarity 0.8 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
