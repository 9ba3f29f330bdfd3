"""Near duplicates by bottom-k sketches from one hash function.

1. Each text gets a 128-bit digest of its set of lower-cased word shingles and its ``k`` least shingle hashes.  Texts
   with equal sets are one class; only the class's first document goes on.
2. A pair at the threshold shares at least ``overlap`` of its retained values but for a probability below 1e-6 (five
   deviations).  Values are ordered by how many sketches retain them, rare ones first: two such sketches share one of the first
   ``size - overlap + 1`` values of each.  The inverted lists of these values hold every candidate pair, and a passage that very many
   documents share hardly makes lists, as its documents have rarer values.
3. Each list first compares its members with its smallest only: the union sketch estimates the similarity, full sets decide.
   Components of these links get labels.
4. Members of lists that still hold several labels are compared pair by pair within tasks, in blocks: in their component of such
   lists, or, where its lists have fewer pairs than it has, in the first list that a pair shares.  Overlaps of retained values and the union
   sketch filter, full sets decide, as matrix products where most pairs are candidates.  Only a spanning forest of the links leaves a
   task.  So a group of near copies costs what its members cost; what remains to compare shares rare values and is not linked.
5. Connected components of all links are the result.

Result per document: id, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept`` (it is its own).

Sets are equal, and shingles are, when 64-bit hashes of theirs are (128 bits for sets).

Cases: a text of fewer than ``n`` words has its whole word sequence as its one shingle; a null or empty text has none and is
linked with nothing; rows with a null id are left out, as no result can name them; rows that repeat an id give one row each, with the
component of the texts that bear the id; other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .collocations import LOWER
from .common import connected_components, join_hot, materialize, tune
from .ngram_join import _digests, _overlaps, shingle_sets

#: Retained values; members of a block, and rows and shingles of a task, about.
KEEP, BLOCK, BLOCK_SHINGLES = 32, 1024, 1 << 20
TASK_ROWS, TASK_SHINGLES = 2048, 1 << 22
DIGEST = ["d1", "d2", "n_shingles"]


def least_overlap(k: int, least: int) -> int:
    """Retained values that a pair of ``least`` percent shares at least, by five deviations."""
    p = least / 100
    return max(1, int(k * p - 5 * np.sqrt(k * p * (1 - p))))


def _digested(column: pa.Array, n: int):
    """(first row, end row, digests, sizes, shingles, first shingle of each row) of runs of lower-cased texts."""
    for lo, hi, buf, off in K.pieces(column):
        h, first = shingle_sets(LOWER[buf], off, n)
        size = np.diff(first)
        full = np.flatnonzero(size)
        d = np.zeros((2, hi - lo), np.uint64)
        if len(full):
            d[:, full] = _digests(h, first[full], size[full])
        yield lo, hi, d, size, h, first


def _lists(first: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))


def _sketch(n: int, k: int):
    names = ["id", "d1", "d2", "n_shingles", "sketch"]

    def run(batches):
        for batch in batches:
            for lo, hi, d, size, h, first in _digested(batch.column("text"), n):
                few = np.minimum(size, k)
                at = np.concatenate([np.zeros(1, np.int64), np.cumsum(few)])
                pick = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], few)  # a row's hashes are in order
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), pa.array(size.astype(np.int64)), _lists(at, h[pick])], names=names)

    return run


def _full_sets(n: int):
    def run(batches):
        for batch in batches:
            want = np.stack([np.asarray(batch.column(c)).view(np.uint64) for c in ("d1", "d2")])
            for lo, hi, d, _, h, first in _digested(batch.column("text"), n):
                out = pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in ("node", "sketch", "prefix")] + [_lists(first, h)], names=["node", "sketch", "prefix", "shingles"])
                yield out.filter(pa.array((d == want[:, lo:hi]).all(0)))

    return run


def union_shares(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """How many of the k least values of both sketches of each pair of rows stand in both; sketches are padded with the largest value."""
    none = np.iinfo(np.uint64).max
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    same = np.zeros(both.shape, bool)
    same[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != none)
    rank = np.cumsum(~same, axis=1)
    return (same & (rank <= k)).sum(1)


class _Rows:
    """The columns of a task's rows."""

    def __init__(self, table: pa.Table, k: int):
        table = table.combine_chunks()
        self.column = {c: table.column(c).to_numpy() for c in table.column_names if not pa.types.is_list(table.schema.field(c).type)}
        self.off, self.values = self._parts(table, "shingles")
        so, sv = self._parts(table, "sketch")
        size = np.diff(so)
        self.sketch = np.full((len(size), k), np.iinfo(np.uint64).max, np.uint64)
        row = np.repeat(np.arange(len(size)), size)
        self.sketch[row, np.arange(len(row)) - np.repeat(so[:-1], size)] = sv
        self.prefix = self._parts(table, "prefix")
        self.size, self.kept, self.k = np.diff(self.off), size, k

    @staticmethod
    def _parts(table, name):
        c = table.column(name).chunk(0)
        off = np.asarray(c.offsets).astype(np.int64)
        return off - off[0], np.asarray(c.flatten()).view(np.uint64)

    def shingles(self, i: int) -> np.ndarray:
        return self.values[self.off[i] : self.off[i + 1]]

    def likely(self, i: np.ndarray, j: np.ndarray, least: int, overlap: int) -> np.ndarray:
        """Pairs whose sizes and union sketch allow ``least`` percent."""
        a, b = self.size[i], self.size[j]
        ok = np.minimum(a, b) * 100 >= least * np.maximum(a, b)
        at = np.flatnonzero(ok)
        need = np.maximum(1, np.minimum(self.kept[i[at]], self.kept[j[at]]) * overlap // self.k)
        ok[at] = union_shares(self.sketch[i[at]], self.sketch[j[at]], self.k) >= need
        return ok

    def retained(self, i: int) -> np.ndarray:
        return self.sketch[i, : self.kept[i]]

    def alike(self, i: int, j: int, least: int) -> bool:
        x, y = self.shingles(i), self.shingles(j)
        if len(x) > len(y):
            x, y = y, x
        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        return 100 * both >= least * (len(x) + len(y) - both)

    def first_shared(self, i: int, j: int) -> int:
        off, values = self.prefix
        return int(np.intersect1d(values[off[i] : off[i + 1]], values[off[j] : off[j + 1]]).min())


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINKS)


def _against_lead(least: int, overlap: int, k: int):
    """Each unit (lead, block): links of its members with the lead."""

    def run(table: pa.Table) -> pa.Table:
        r = _Rows(table, k)
        node, lead, block = (r.column[c] for c in ("node", "lead", "block"))
        order = np.lexsort((node != lead, block, lead))  # a unit's lead comes first
        new = np.flatnonzero((np.diff(lead[order], prepend=lead[order[0]] - 1) != 0) | (np.diff(block[order], prepend=-1) != 0))
        head = np.repeat(order[new], np.diff([*new, len(order)]))
        pick = (node[order] != lead[order]) & (node[head] == lead[order])
        i, j = head[pick], order[pick]
        ok = r.likely(i, j, least, overlap)
        return _links([(int(node[y]), int(node[x])) for x, y in zip(i[ok], j[ok], strict=True) if r.alike(x, y, least)])

    return run


def _within_units(least: int, overlap: int, k: int, strip: int = 256):
    """Each unit (a component or a list, and a pair of its blocks): a spanning forest of the links between members of different labels."""

    def run(table: pa.Table) -> pa.Table:
        r = _Rows(table, k)
        node, label, block, unit, whole = (r.column[c] for c in ("node", "label", "block", "unit", "whole"))
        p, q = r.column["p"], r.column["q"]
        key = (unit, whole.astype(np.int64), p, q)
        order = np.lexsort((node, *key[::-1]))
        new = np.flatnonzero(np.any([np.diff(x[order], prepend=x[order[0]] - 1) != 0 for x in key], axis=0))
        out, parent = [], {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for rows in np.split(order, new[1:]):
            first = rows[0]
            same = p[first] == q[first]
            left = rows[block[rows] == p[first]]
            right = left if same else rows[block[rows] == q[first]]
            for at in range(0, len(left), strip):
                i = left[at : at + strip]
                ask = label[i][:, None] != label[right][None, :]
                if same:
                    ask &= node[i][:, None] < node[right][None, :]
                a, b = r.size[i][:, None], r.size[right][None, :]
                ask &= np.minimum(a, b) * 100 >= least * np.maximum(a, b)
                if not ask.any():
                    continue
                need = np.maximum(1, np.minimum(r.kept[i][:, None], r.kept[right][None, :]) * overlap // k)
                ask &= _overlaps([r.retained(x) for x in i], [r.retained(x) for x in right], ask) >= need
                x, y = np.nonzero(ask)
                for lo in range(0, len(x), 1 << 16):
                    u, v = x[lo : lo + (1 << 16)], y[lo : lo + (1 << 16)]
                    ask[u, v] = union_shares(r.sketch[i[u]], r.sketch[right[v]], k) >= need[u, v]
                if not whole[first]:  # in a list only the pairs whose first shared list it is
                    own = int(np.int64(unit[first]).view(np.uint64))
                    for u, v in zip(*np.nonzero(ask), strict=True):
                        ask[u, v] = r.first_shared(i[u], right[v]) == own
                both = _overlaps([r.shingles(u) for u in i], [r.shingles(v) for v in right], ask)
                for u, v in zip(*np.nonzero(ask & (100 * both >= least * (a + b - both))), strict=True):
                    s, t = int(label[i[u]]), int(label[right[v]])
                    m, n = root(s), root(t)
                    if m != n:
                        parent[max(m, n)] = min(m, n)
                        out.append((s, t))
        return _links(out)

    return run


def _tasks(units: DataFrame) -> int:
    work = units.agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("shingles")).first()
    return max(1, work["rows"] // TASK_ROWS, (work["shingles"] or 0) // TASK_SHINGLES)


def _prefixes(heads: DataFrame, overlap: int, k: int) -> DataFrame:
    """(node, prefix): the rarest retained values of each sketch that another sketch retains too."""
    at = heads.select("node", F.explode("sketch").alias("value"))
    often = materialize(at.groupBy("value").agg(F.count("*").alias("df")).where("df > 1").withColumn("w", F.col("df")), "sketch-values")
    shared = join_hot(at, often, ["value"], "w").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("l"))  # k values at most
    size = F.size("sketch")
    length = size - F.greatest(F.lit(1), F.floor(size * overlap / k)) + 1 - (size - F.size("l"))  # values of one sketch come first
    d = heads.join(shared, "node").withColumn("m", length.cast("int")).where("m > 0")
    return d.select("node", "n_shingles", F.transform(F.slice("l", F.lit(1), F.col("m")), lambda e: e["value"]).alias("prefix"))


def links(heads: DataFrame, text: DataFrame, n: int, least: int, k: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join what is linked of ``heads`` (node, d1, d2, n_shingles, sketch); ``text`` (id, text) has each head's."""
    overlap = least_overlap(k, least)
    prefix = materialize(_prefixes(heads, overlap, k), "sketch-prefixes")
    at = prefix.select("node", "n_shingles", F.explode("prefix").alias("value"))
    lists = materialize(at.groupBy("value").agg(F.min("node").alias("lead"), F.count("*").alias("m")).where("m > 1"), "sketch-lists")
    listed = materialize(join_hot(at, lists, ["value"], "m"), "sketch-listed")
    nodes = listed.select("node").distinct()
    known = heads.select("node", *DIGEST, "sketch").join(prefix.select("node", "prefix"), "node").join(nodes, "node", "left_semi")
    sets = text.join(known.withColumn("id", F.col("node")), "id").select("node", "sketch", "prefix", "d1", "d2", "text").mapInArrow(_full_sets(n), "node long, sketch array<long>, prefix array<long>, shingles array<long>")
    sets = materialize(sets.dropDuplicates(["node"]), "sketch-sets")

    edges = materialize(listed.where("node <> lead").select("node", "lead", "n_shingles").distinct(), "sketch-edges")
    leads = edges.groupBy("lead").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / block))
    leads = materialize(leads.join(prefix.select(F.col("node").alias("lead"), F.col("n_shingles").alias("own")), "lead"), "sketch-leads")
    spread = lambda c, key: F.pmod(F.xxhash64(key), F.col(c))
    members = join_hot(edges, leads, ["lead"], "m").select("node", "lead", "n_shingles", spread("blocks", "node").alias("block"))
    own = leads.select(F.col("lead").alias("node"), "lead", F.col("own").alias("n_shingles"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    units = materialize(members.unionByName(own), "sketch-units")
    dealt = units.withColumn("task", F.pmod(F.xxhash64("lead", "block"), F.lit(_tasks(units)))).drop("n_shingles").join(sets, "node")
    near = materialize(dealt.groupBy("task").applyInArrow(_against_lead(least, overlap, k), "a long, b long"), "sketch-stars")

    label = materialize(connected_components(near, "sketch-labels"), "sketch-labels")
    labelled = materialize(listed.join(label, "node", "left").withColumn("label", F.coalesce("component", "node")).select("node", "n_shingles", "value", "label"), "sketch-labelled")
    several = labelled.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("lead"), F.count("*").alias("m"), F.sum("n_shingles").alias("total")).where("lo < hi")
    several = materialize(several.select("value", "lead", "m", "total"), "sketch-several")
    rest = materialize(join_hot(labelled, several.select("value", "lead", F.col("m").alias("w")), ["value"], "w"), "sketch-rest")
    comps = materialize(connected_components(rest.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")), "sketch-candidates"), "sketch-candidates")
    members = rest.select("node", "n_shingles", "label").distinct().join(comps, "node")
    size = members.groupBy("component").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("total"))
    cost = several.join(comps.withColumnRenamed("node", "lead"), "lead").groupBy("component").agg(F.sum(F.col("m") * F.col("m")).alias("cost"))
    size = materialize(size.join(cost, "component").withColumn("whole", (F.col("m") <= block) | (F.col("m") * F.col("m") <= F.col("cost"))), "sketch-sizes")
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("long").alias("blocks")
    members = materialize(members, "sketch-members")
    by_component = join_hot(members, size.where("whole").select("component", blocks, "m"), ["component"], "m").select("node", "n_shingles", "label", F.col("component").alias("unit"), F.lit(1).alias("whole"), "blocks")
    loose = several.join(comps.withColumnRenamed("node", "lead"), "lead").join(size.where("not whole").select("component"), "component", "left_semi")
    by_list = join_hot(rest, materialize(loose.select("value", blocks, "m"), "sketch-loose"), ["value"], "m").select("node", "n_shingles", "label", F.col("value").alias("unit"), F.lit(0).alias("whole"), "blocks")
    every = by_component.unionByName(by_list).withColumn("block", spread("blocks", "node"))
    every = every.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    every = materialize(every.select("node", "n_shingles", "label", "unit", "whole", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")), "sketch-pairs")
    dealt = every.withColumn("task", F.pmod(F.xxhash64("unit", "whole", "p", "q"), F.lit(_tasks(every)))).drop("n_shingles").join(sets, "node")
    far = materialize(dealt.groupBy("task").applyInArrow(_within_units(least, overlap, k), "a long, b long"), "sketch-links")
    return near.unionByName(far)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, least: int = 85, k: int = KEEP, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each document; links have 100 * intersection >= ``least`` * union."""
    tune(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    signed = materialize(d.mapInArrow(_sketch(n, k), "id long, d1 long, d2 long, n_shingles long, sketch array<long>"), "sketches")
    firsts = signed.where("n_shingles > 0").groupBy(*DIGEST).agg(F.min("id").alias("head"), F.count("*").alias("k"))
    firsts = materialize(firsts, "sketch-classes")
    slim = signed.drop("sketch")
    classes = materialize(join_hot(slim, firsts.where("k > 1"), DIGEST, "k", "left").withColumn("head", F.coalesce("head", "id")), "sketch-heads")
    repeats = slim.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    heads = signed.join(classes.where("id = head and n_shingles > 0").select("id", *DIGEST), ["id", *DIGEST], "left_semi")
    heads = materialize(heads.dropDuplicates(["id", *DIGEST]) if repeats else heads, "sketch-distinct")
    if repeats:  # an id with several texts that lead a class: each is a node of its own, tied together by the id
        heads = materialize(heads.withColumn("node", F.xxhash64("id", *DIGEST)), "sketch-nodes")
    else:
        heads = heads.withColumn("node", F.col("id"))
    text = d
    if repeats:
        text = d.join(heads.select("id", "node"), "id").select(F.col("node").alias("id"), "text")
    found = links(heads.select("node", *DIGEST, "sketch"), text, n, least, k, block)
    if repeats:
        name = heads.select("node", "id")
        found = found.join(name.select(F.col("node").alias("a"), F.col("id").alias("x")), "a").join(name.select(F.col("node").alias("b"), F.col("id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # rows of one id are one document in the result
    same = classes.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    comp = connected_components(found.unionByName(same) if repeats else found, "sketch-components").select(F.col("node").alias("head"), F.col("component"))
    out = classes.join(comp, "head", "left").withColumn("component_id", F.coalesce("component", "head"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op12_bottomk_near_duplicates(spark, sf_dir):
    """Near duplicates of all ``documents``: three-word shingles of lower-cased texts, similarity 0.85 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
