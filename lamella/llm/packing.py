"""Vector best-fit packing of token sequences.

Each document's ids, and an end id, are cut into pieces of at most ``tokens`` ids only where the document is longer.  Pieces
are then placed by decreasing length: of the open sequences whose residual capacities (tokens, documents, attention
cost: the sum of squared lengths) hold the piece, the best fit is taken, by the smallest weighted norm of what would
be left or by the largest weighted dot product of piece and residual.  A sequence of full length opens and closes at once.

Every task first packs the pieces of its own partition.  The pieces of sequences that are left below ``FILLED`` are then
dealt at random to tasks of at most about ``ROWS`` pieces, which pack them anew; what is below it again goes on to the next
round, until all of the rest met in one task or a round saves less than a hundredth of its sequences.  So
the number of sequences hardly depends on how the input is split, and no task sees all pieces.

Cases: null or empty text is the end id alone; null ids pass through, pieces of the same id in rows that repeat it are
numbered per row; other columns are not kept.  Sequence numbers are unique, not consecutive.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tune
from .encoders import encoder, runs

#: Share of a sequence's tokens from which it is not packed anew, and pieces of one task that packs anew.
FILLED, ROWS = 0.99, 20_000
#: Of the registered uses: of sequences that leave about as many tokens, the one with more documents and more attention cost
WEIGHTS = (1.0, 1 / 64, 1 / 64)


def best_fit(lengths: np.ndarray, caps: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.0, 0.0), score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece.  ``caps`` and ``weights``: tokens, documents, attention cost.

    Open sequences are kept by their residuals, tokens first, so that those of one state are looked at once.  Looking goes
    from the tightest token residual on, and ends where tokens alone make a worse score than the best one found.
    """
    if score not in ("norm", "dot"):
        raise ValueError(f"score {score!r}")
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    bins, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, offset
    c0, c1, c2 = int(caps[0]), int(caps[1]), caps[2]
    w0, w1, w2 = weights
    least = sizes[order[-1]]
    open_: list[dict[tuple, list[int]]] = [{} for _ in range(c0 + 1)]  # by token residual: (documents, attention) to sequences
    held = made = 0  # ``held``: bit r is set where residual r has sequences
    low1, low2 = c1, c2  # the least residuals that any sequence has had
    for i in order:
        size = sizes[i]
        cost = size * size
        if size > c0 or c1 < 1 or cost > c2:
            raise ValueError("a piece is larger than a sequence")
        best, at = float("inf"), None
        left = held >> size << size
        if score == "norm":
            bound = w1 * (max(0, low1 - 1) / c1) ** 2 + w2 * (max(0, low2 - cost) / c2) ** 2
            while left:
                bit = left & -left
                r = bit.bit_length() - 1
                tokens = w0 * ((r - size) / c0) ** 2
                if tokens + bound >= best:
                    break
                for state in open_[r]:
                    d, a = state
                    if d >= 1 and a >= cost:
                        worth = tokens + w1 * ((d - 1) / c1) ** 2 + w2 * ((a - cost) / c2) ** 2
                        if worth < best:
                            best, at = worth, (r, state)
                left ^= bit
        else:
            while left:
                r = left.bit_length() - 1
                tokens = w0 * r * size / (c0 * c0)
                if -(tokens + w1 / c1 + w2 * cost / c2) >= best:
                    break
                for state in open_[r]:
                    d, a = state
                    if d >= 1 and a >= cost:
                        worth = -(tokens + w1 * d / (c1 * c1) + w2 * a * cost / (c2 * c2))
                        if worth < best:
                            best, at = worth, (r, state)
                left ^= 1 << r
        if at is None:
            r, (d, a), name = c0, (c1, c2), made
            made += 1
        else:
            r, (d, a) = at
            own = open_[r][at[1]]
            name = own.pop()
            if not own:
                del open_[r][at[1]]
                if not open_[r]:
                    held ^= 1 << r
        bins[i], offset[i] = name, c0 - r
        r, d, a = r - size, d - 1, a - cost
        if r >= least and d >= 1 and a >= least * least:  # else closed: nothing that is to come fits
            open_[r].setdefault((d, a), []).append(name)
            held |= 1 << r
            low1, low2 = min(low1, d), min(low2, a)
    return bins, offset


def _pack(path: str, end: int, tokens: int, documents: int, attention: float, weights: tuple, score: str, ids_out: bool):
    schema = [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(schema + [("ids", pa.binary())] * ids_out)

    def run(batches):
        enc = encoder(path)
        parts, raw = [], []
        for batch in runs(batches):
            got, first = enc.encode(batch.column("text"), end)
            size = np.diff(first)
            pieces = -(-size // tokens)
            doc = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * tokens
            length = np.minimum(tokens, size[doc] - start)
            at = first[doc] + start
            flat = memoryview(got).cast("B")
            cut = [flat[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            crc = np.fromiter(map(zlib.crc32, cut), np.int64, len(cut))
            if ids_out:
                raw += map(bytes, cut)
            parts.append((batch.column("id").take(pa.array(doc)), piece, start, length, crc))
        if not parts:
            return
        doc = pa.concat_arrays([p[0] for p in parts])
        piece, start, length, crc = (np.concatenate([p[k] for p in parts]) for k in range(1, 5))
        bins, offset = best_fit(length, (tokens, documents, attention), weights, score)
        bins += TaskContext.get().partitionId() << 40
        cols = [doc, pa.array(piece, pa.int32()), *map(pa.array, (start, length, crc, bins, offset))] + [pa.array(raw, pa.binary())] * ids_out
        yield from pa.Table.from_arrays(cols, schema=schema).to_batches(max_chunksize=4096 if ids_out else 1 << 16)

    return run


def _again(caps: tuple, weights: tuple, score: str, turn: int):
    """Packs the pieces of one task anew."""

    def run(table: pa.Table) -> pa.Table:
        bins, offset = best_fit(np.asarray(table.column("length")), caps, weights, score)
        bins = -1 - (bins + (turn << 55) + (table.column("task")[0].as_py() << 32))  # below zero: never a sequence of the first packing
        for name, c in (("sequence_id", bins), ("offset", offset)):
            table = table.set_column(table.column_names.index(name), name, pa.array(c))
        return table.drop_columns(["task"])

    return run


def _repack(pieces: DataFrame, caps: tuple, weights: tuple, score: str, rows: int) -> DataFrame:
    """``pieces`` with those of part-filled sequences packed together, wherever they were made.

    Ends when one task has packed all that is left, or when a turn has saved less than a hundredth of the part-filled sequences.
    """
    kind = pieces.schema
    now, out, turn, tasks, was = pieces, None, 0, 0, 0
    while True:
        fill = now.groupBy("sequence_id").agg(F.sum("length").alias("n"))
        low = fill.where(F.col("n") < FILLED * caps[0]).select("sequence_id")
        open_ = now.join(low, "sequence_id", "left_semi")
        state = open_.agg(F.count("*").alias("n"), F.countDistinct("sequence_id").alias("m")).first()
        # ``m`` counts the sequences that are still part-filled: some of those dealt are full now, or none were saved
        if turn > 250:
            raise RuntimeError("packing: part-filled sequences fall without end")
        if state["m"] < 2 or tasks == 1 or turn and state["m"] > 0.99 * was:
            return now if out is None else out.unionByName(now)
        full = now.join(low, "sequence_id", "left_anti").select(*kind.names)
        out = full if out is None else out.unionByName(full)
        tasks, turn = -(-state["n"] // rows), turn + 1
        was = state["m"]
        dealt = open_.select(*kind.names, F.pmod(F.xxhash64("sequence_id", "offset", F.lit(turn)), F.lit(tasks)).alias("task"))
        now = materialize(dealt.groupBy("task").applyInArrow(_again(caps, weights, score, turn), kind), "packing-again")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, tokens: int = 2048, documents: int | None = None, attention: float | None = None, weights: tuple = (1.0, 0.0, 0.0), score: str = "norm", id_col: str = "doc_id", text_col: str = "text", ids: bool = False, rows: int = ROWS) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and with ``ids`` its little-endian ids.

    ``documents`` and ``attention`` bound a sequence's pieces and its sum of squared lengths; None is the
    loosest bound that ``tokens`` leaves, so that tokens alone bind.  ``rows``: pieces of a task that packs anew, about.
    """
    tune(docs.sparkSession)
    documents = documents or tokens
    attention = attention or float(tokens) * tokens
    if attention < tokens * tokens:  # the longest piece must fit an empty sequence
        tokens_piece = int(attention**0.5)
        raise ValueError(f"attention cost {attention} is below that of one full piece; use at most {tokens_piece} tokens")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kind = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * ids
    made = materialize(d.mapInArrow(_pack(tokenizer, end_id, tokens, documents, attention, tuple(weights), score, ids), kind), "packing-pieces")
    return _repack(made, (tokens, documents, attention), tuple(weights), score, rows).withColumnRenamed("id", id_col)


def op8_best_fit_packing(spark, sf_dir):
    """All ``documents`` in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), weights=WEIGHTS)
