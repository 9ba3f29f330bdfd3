"""Quality rules: base counts, then robust multivariate outliers of each (language, source).

The statistics of a text are transformed to features: log of the words' mean length, logit-like square roots of the
shares of symbols, repeated lines and repeated words, and the log of the number of words.  For each group of (lang,
source), each language and all texts the minimum covariance determinant estimate is found over all texts that pass the
base rules, by concentration steps from three deterministic starts: the coordinate medians with robust scales, mean and covariance
of all texts, and the medians with the covariance of spatial signs.  From each, mean and covariance of the ``h`` share of texts
nearest by Mahalanobis distance are taken again and again, until the determinant falls no more; the least determinant counts.
The covariance is corrected for consistency, and texts whose squared distance exceeds the chi-squared quantile ``1 - tail``
are rejected.

Estimates are shrunk, a group's towards its language's, that towards that of all texts, and that towards ``FLOOR``: each counts
as many texts as it has, what it is drawn to counts ``prior``.  So a group of any size is judged, a small one
by its language for the most part; there is no size at which the method sets in.

Each step is one aggregation of counts, sums and products per group and fine step of the logarithm of the distance (combined
before the shuffle, so that a group with a third of all rows costs some hundred rows a task); the nearest share is cut off at
one of these steps, not by sorting a group.  To the variance of a feature that is (nearly) the same in the ``h`` share of a group's texts
the square of ``floor`` is added: features that are zero for all clean texts must not make the first non-zero one an
outlier.  It fades as the spread grows to a tenth of it; beyond, only a ridge of a thousandth of it is left.  The
addition is set before the first step, so that the steps let the determinant fall.

Cases: null or empty text has no words, zero counts and fails the base rules; null lang or source is a group of its
own; null ids and rows that repeat are judged row by row; other columns pass through, of the same name as a
result's they are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import SMALL_ROWS, join_small, materialize, tune

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: standard deviation of each feature where a group shows none: one that is small beside the range that clean texts may have
FLOOR = (1.0, 0.15, 0.06, 0.12, 0.15)
P = len(FLOOR)
U64 = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
STEP = 32  # distance steps per doubling
#: fall of the logarithm of the determinant below which it counts as none
TOL = 1e-3
X, M = ([f"{c}{i}" for i in range(P)] for c in "xm")
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
V = [f"v{i}{j}" for i, j in PAIRS]


def count_texts(column: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of each text of an Arrow column."""
    out = {c: [] for c in COUNTS}
    for lo, hi, buf, off in K.pieces(column):
        n = hi - lo
        starts, ends, first = K.spans(buf, off)
        row = K.row_of(first)
        out["n_words"].append(np.diff(first))

        def per_row(mark, off=off):
            total = np.concatenate([[0], np.cumsum(mark)])
            return total[off[1:]] - total[off[:-1]]

        # code points in words: bytes that neither are white space nor continue a character
        out["word_chars"].append(per_row(~K._SPACE[buf] & ((buf & 0xC0) != 0x80)))
        out["n_symbols"].append(per_row(_SYMBOL[buf]))
        # lines with a word that equal an earlier one
        ends_line = np.flatnonzero(buf == 10)
        a = np.unique(np.concatenate([off[:-1][off[:-1] < len(buf)], ends_line + 1, [0]])) if len(buf) else np.zeros(0, np.int64)
        a = a[a < len(buf)]
        b = np.append(a[1:], len(buf))
        b = np.where(buf[b - 1] == 10, b - 1, b) if len(b) else b
        line_row = np.searchsorted(off, a, "right") - 1
        has = np.searchsorted(starts, b) > np.searchsorted(starts, a)
        a, b, line_row = a[has], b[has], line_row[has]
        key = K.mix(K.byte_hashes(buf, a, b) + line_row.astype(U64) * U64(0x9E3779B97F4A7C15)) if len(a) else np.zeros(0, U64)
        _, place = np.unique(key, return_index=True)
        dup = np.ones(len(a), bool)
        dup[place] = False
        out["n_dup_lines"].append(np.bincount(line_row[dup], minlength=n))
        # words in three-word windows that the text holds twice or more
        at, r3 = K.inside(first, 3)
        cover = np.zeros(len(row) + 3, bool)
        if len(at):
            g = K.ngrams(K.byte_hashes(buf, starts, ends), 3)[at]
            key = K.mix(g + r3.astype(U64) * U64(0x9E3779B97F4A7C15))
            order = np.argsort(key)
            k = key[order]
            same = k[1:] == k[:-1]
            twice = np.zeros(len(k), bool)
            twice[1:] |= same
            twice[:-1] |= same
            hit = at[order[twice]]
            for j in range(3):
                cover[hit + j] = True
        out["n_repeat_words"].append(np.bincount(row[cover[: len(row)]], minlength=n))
    return {c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in out.items()}


def with_counts(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the five counts and ``base_failed``."""
    tune(docs.sparkSession)
    new = (*COUNTS, "base_failed")
    kept = [c for c in docs.columns if c not in new and (keep_text or c != text_col)]
    read = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType())])

    def run(batches):
        for b in batches:
            got = count_texts(b.column("__text"))
            n, r = got["n_words"], got["n_repeat_words"]
            failed = (n < 50) | (100 * r > 50 * n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(got[c]) for c in COUNTS), pa.array(failed)], names=[*kept, *new])

    return read.mapInArrow(run, schema)


def features() -> list:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [F.log(n), F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]


def chi2_quantile(p: float, df: int) -> float:
    """By bisection on the regularised lower incomplete gamma function."""

    def cdf(x):
        a, x = df / 2, x / 2
        term = total = 1 / a
        for k in range(1, 2000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-17:
                break
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0

    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def consistency(h: float, df: int) -> float:
    """What the covariance of the nearest ``h`` share of ``df`` normal features is short by."""
    q = chi2_quantile(h, df)
    lo, hi = 1e-9, 1 - 1e-12
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_quantile(mid, df + 2) < q else (lo, mid)
    return h / lo


def square(upper: np.ndarray) -> np.ndarray:
    """The symmetric matrix of ``PAIRS``."""
    out = np.zeros((P, P))
    for (i, j), v in zip(PAIRS, upper, strict=True):
        out[i, j] = out[j, i] = v
    return out


def upper(matrix: np.ndarray) -> list[float]:
    return [float(matrix[i, j]) for i, j in PAIRS]


def estimate(n: float, s: np.ndarray, ss: np.ndarray, added: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse covariance and the covariance's log determinant from sums and sums of products; ``added``: to the variances."""
    mean = s / n
    cov = factor * (ss / n - np.outer(mean, mean)) + np.diag(added)
    unit = np.sqrt(np.diag(cov))
    value, vector = np.linalg.eigh(cov / np.outer(unit, unit))
    value = np.maximum(value, 1e-9)
    return mean, (vector / value) @ vector.T / np.outer(unit, unit), float(np.log(value).sum() + 2 * np.log(unit).sum())


#: an estimate of one group from one start: flat numbers, so that distances are plain arithmetic
_STATE = "g string, s int, " + ", ".join(f"{c} double" for c in (*M, *V, "det", *(f"a{i}" for i in range(P)))) + ", df int, done boolean"
_NAMES = [f.split()[0] for f in _STATE.split(", ")]
_ADDED = [f"a{i}" for i in range(P)]


def _fit(factors: tuple[float, ...], least: float):
    """Sums of each group and start, beside what they were picked by, to the next estimate: ``done`` where the determinant falls no
    more and the old one stays.  ``factors``: for consistency, by the number of features that show a spread."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                added = np.asarray([r[a] for a in _ADDED])
                m, inv, det = estimate(float(r["n"]), np.asarray([r[f"s{i}"] for i in range(P)]), square([r[f"q{i}{j}"] for i, j in PAIRS]), added, factors[r["df"]])
                if det < r["det"] - least:
                    r |= dict(zip(M, m, strict=True)) | dict(zip(V, upper(inv), strict=True)) | {"det": det}
                else:
                    r["done"] = True
                out.append([r[n] for n in _NAMES])
            yield pd.DataFrame(out, columns=_NAMES)

    return run


def _starts():
    """Sums over all texts of a group to its three starts."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                middle, added, var = (np.asarray([x[k] for x in r["e"]], float) for k in ("m", "added", "var"))
                unit, total = np.sqrt(var), np.asarray([r[f"s{i}"] for i in range(P)])
                signs = square([r[f"u{i}{j}"] for i, j in PAIRS]) * np.outer(unit, unit) * P
                of_all = estimate(r["n"], total, square([r[f"q{i}{j}"] for i, j in PAIRS]), added, 1.0)
                for k, (m, inv) in enumerate(((middle, np.diag(1 / var)), of_all[:2], (middle, estimate(r["n"], 0 * total, signs, added, 1.0)[1]))):
                    out.append([r["g"], k, *m, *upper(inv), float("inf"), *added, r["df"], False])
            yield pd.DataFrame(out, columns=_NAMES)

    return run


def distance2(x: list[str], m: list[str], v: dict[tuple[int, int], str]):
    """Squared Mahalanobis distance."""
    d = [F.col(a) - F.col(b) for a, b in zip(x, m, strict=True)]
    inner = [sum((2 * F.col(v[i, j]) * d[j] for j in range(i + 1, P)), F.col(v[i, i]) * d[i]) for i in range(P)]
    return sum((d[i] * inner[i] for i in range(1, P)), d[0] * inner[0])


def _sums():
    """Aggregates of count, sums and sums of products."""
    return [F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(X)), *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS)]


def _begin(rows: DataFrame, h: float, floor: tuple[float, ...]) -> DataFrame:
    """(g, e, df): for each feature of a group its median, what is added to its variance and the variance of its ``h`` share about the
    median, from counts of values in steps of a fiftieth of the floor."""
    long = rows.select("g", F.posexplode(F.array(*X)).alias("i", "v"))
    size = F.array(*[F.lit(f / 50) for f in floor])
    counts = materialize(long.groupBy("g", "i", F.floor(F.col("v") / size[F.col("i")]).cast("long").alias("b")).agg(F.count("*").alias("k")), "mcd-counts")
    w = W.partitionBy("g", "i")
    half = counts.withColumn("upto", F.sum("k").over(w.orderBy("b"))).withColumn("all", F.sum("k").over(w)).where("2 * upto >= all")
    middle = half.groupBy("g", "i").agg(F.min("b").alias("mid"))
    apart = counts.join(middle, ["g", "i"]).groupBy("g", "i", "mid", F.abs(F.col("b") - F.col("mid")).alias("far")).agg(F.sum("k").alias("k"))
    apart = apart.withColumn("upto", F.sum("k").over(w.orderBy("far"))).withColumn("all", F.sum("k").over(w)).where(F.col("upto") >= F.col("all") * h)
    each = apart.groupBy("g", "i", "mid").agg(F.min("far").alias("far"))
    unit = F.array(*[F.lit(float(f)) for f in floor])[F.col("i")]
    added = F.pow(unit * F.greatest(F.lit(1e-3), 1 - F.col("far") / 5), F.lit(2.0))  # five of the steps are a tenth of the floor
    each = each.select("g", "i", ((F.col("mid") + 0.5) * size[F.col("i")]).alias("m"), added.alias("added"), (F.pow(F.col("far") * size[F.col("i")], F.lit(2.0)) + added).alias("var"), (F.col("far") * 2 >= 5).cast("int").alias("own"))
    return materialize(each.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "m", "added", "var"))).alias("e"), F.sum("own").cast("int").alias("df")), "mcd-begin")


def mcd(rows: DataFrame, h: float = 0.75, steps: int = 100, floor: tuple[float, ...] = FLOOR) -> DataFrame:
    """(g, m0.., v00.., det) of each group ``g`` of features x0..: mean, and of the inverse covariance the entries of ``PAIRS``.

    The covariance is corrected for consistency at the normal distribution.  Each start takes steps until its determinant falls no
    more; where ``steps`` do not suffice for one, RuntimeError is raised.
    """
    factors = tuple(consistency(h, max(df, 1)) for df in range(P + 1))
    begin = _begin(rows, h, floor)
    small = begin.count() * 3 <= SMALL_ROWS
    near = F.broadcast if small else lambda d: d
    z = [(F.col(x) - F.col("e")[i]["m"]) / F.sqrt(F.col("e")[i]["var"]) for i, x in enumerate(X)]
    signed = rows.join(near(begin), "g").select("g", *X, *(a.alias(f"z{i}") for i, a in enumerate(z)))
    signed = signed.withColumn("zz", F.greatest(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0")), F.lit(1e-12)))
    first = signed.groupBy("g").agg(*_sums(), *(F.sum(F.col(f"z{i}") * F.col(f"z{j}") / F.col("zz")).alias(f"u{i}{j}") for i, j in PAIRS))
    now, found = materialize(first.join(begin, "g").mapInPandas(_starts(), _STATE), "mcd-start"), []
    w = W.partitionBy("g", "s")
    for _ in range(steps):
        # squared distance under each start's estimate, in steps of its logarithm
        d2 = distance2(X, M, dict(zip(PAIRS, V, strict=True)))
        scored = rows.join(near(now.select("g", "s", *M, *V)), "g").select("g", "s", *X, F.floor(F.log2(F.greatest(d2, F.lit(1e-9))) * STEP).cast("int").alias("step"))
        by_step = scored.groupBy("g", "s", "step").agg(*_sums())
        by_step = by_step.withColumns({"before": F.sum("n").over(w.orderBy("step")) - F.col("n"), "all": F.sum("n").over(w)}).where(F.col("before") < F.ceil(F.col("all") * h))
        sums = by_step.groupBy("g", "s").agg(*(F.sum(c).alias(c) for c in ("n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in PAIRS))))
        now = materialize(sums.join(now, ["g", "s"]).mapInPandas(_fit(factors, TOL), _STATE), "mcd-step")
        found.append(now.where("done"))
        now = now.where("not done")
        if now.isEmpty():
            break
    else:
        raise RuntimeError(f"mcd: no fixpoint after {steps} steps")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    best = out.groupBy("g").agg(F.min_by(F.struct(*M, *V, "det"), F.struct("det", "s")).alias("b"))
    return materialize(best.select("g", "b.*"), "mcd-found")


def shrunk(n: float, mean, cov, other: tuple[np.ndarray, np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray]:
    """An estimate of ``n`` texts drawn to another one that counts ``prior`` texts."""
    a = n / (n + prior)
    return a * np.asarray(mean, float) + (1 - a) * other[0], a * np.asarray(cov, float) + (1 - a) * other[1]


def _settle(prior: float, floor: tuple[float, ...]):
    """Each group's estimate, drawn to its language's and to that of all."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                at = np.asarray([r[f"{m}_top"] for m in M]), np.diag(np.square(floor))
                for level in ("top", "mid", "own"):
                    cov = np.linalg.inv(square([r[f"{v}_{level}"] for v in V]))
                    at = shrunk(float(r[f"n_{level}"]), [r[f"{m}_{level}"] for m in M], cov, at, prior)
                out.append([r["own"], *at[0], *upper(np.linalg.inv(at[1]))])
            yield pd.DataFrame(out, columns=["__own", *(f"__{c}" for c in (*M, *V))])

    return run


def judge(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", prior: float = 100.0, h: float = 0.75, tail: float = 1e-5) -> DataFrame:
    """``docs`` (with the five counts and base_failed) with ``distance2`` and ``kept``."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) if c in docs.columns else F.lit("null") for c in (lang_col, source_col))
    levels = {"own": F.concat_ws("\u0001", F.lit("own"), lang, source), "mid": F.concat_ws("\u0001", F.lit("lang"), lang), "top": F.lit("all")}
    good = docs.where("not base_failed").select(*(c.alias(n) for n, c in levels.items()), *(c.alias(x) for x, c in zip(X, features(), strict=True)))
    sizes = materialize(good.groupBy(*levels).agg(F.count("*").alias("n_own")), "mcd-groups")
    fit = mcd(materialize(good.select(F.explode(F.array(*levels)).alias("g"), *X), "mcd-rows"), h)
    groups = sizes.withColumns({f"n_{n}": F.sum("n_own").over(W.partitionBy(n)) for n in ("mid", "top")})
    for n in levels:
        groups = groups.join(fit.select(F.col("g").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in (*M, *V))), n)
    params = materialize(groups.mapInPandas(_settle(prior, FLOOR), "__own string, " + ", ".join(f"__{c} double" for c in (*M, *V))), "mcd-params")
    scored = docs.drop("distance2", "kept").withColumns({"__own": levels["own"]} | {f"__{x}": c for x, c in zip(X, features(), strict=True)})
    d2 = distance2([f"__{x}" for x in X], [f"__{m}" for m in M], {k: f"__{v}" for k, v in zip(PAIRS, V, strict=True)})
    scored = join_small(scored, params, "__own", "left").withColumn("distance2", F.when(~F.col("base_failed"), d2))
    kept = ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= chi2_quantile(1 - tail, P))
    return scored.withColumn("kept", kept).drop("__own", *(f"__{c}" for c in (*X, *M, *V)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The counts and verdict of each row, without its text: id, lang, source, counts, base_failed, distance2, kept."""
    named = [c for c in (id_col, "lang", "source") if c in docs.columns]
    counted = materialize(with_counts(docs.select(*named, text_col), text_col, keep_text=False), "quality-counts")
    return judge(counted, **options)


def keep_good(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(text_col).alias("__t"), *[F.col(c) for c in ("lang", "source") if c in names])
    counted = materialize(with_counts(d, "__t", keep_text=False), "quality-rows")
    return judge(counted, **options).where("kept").select("__row.*")


def op3_robust_outliers(spark, sf_dir):
    """Counts and verdicts of all ``documents``."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *COUNTS, "base_failed", "kept", "distance2")
