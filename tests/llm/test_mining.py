"""Collocations, bottom-k near duplicates and centroid clustering against brute force, with awkward cases."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lamella.llm import bottomk, centroids, collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "a", "A b", ",.;", "é È x\ty\x0bz", "w " * 3000, "日本 語 " * 40, "q\x00r s", "A b, a B. a b\na b"]


def rows(seed=5, n=80):
    rng = random.Random(seed)
    vocab = [f"W{i}" if i % 9 == 0 else f"w{i}" for i in range(30)]
    out = []
    for i in range(n):
        t = " ".join(rng.choices(vocab, k=rng.choice([2, 40, 120])))
        t = t.replace("w7 ", "w7, ").replace("w8 ", "w8\n")
        out.append((i, t + " New York City." * (i % 5), [None, "en", "de", "und"][i % 4], i))
    return out + [(n + i, t, "en" if i % 2 else None, i) for i, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, score int").repartition(3).cache()


def mined(data, least, share, top, longest=3):
    f, n = {}, Counter()
    for _, text, lang, *_ in data:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in cand.items():
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items())
            if not inside:
                score, _, left, right = min((int(Fraction(1000000 * a * a, c[p[:k]] * c[p[k:]])), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"entries": 300, "burst": 8, "words": 60, "part_bytes": 2000}])
def test_collocations(docs, bounds):
    want = mined(rows(), 4, 50, 25)
    assert len({r[0] for r in want}) == 3 and any(r[2].count(" ") == 2 for r in want)
    got = sorted(map(tuple, collocations.collocations(docs, least=4, top=25, **bounds).collect()))
    assert got == want


def test_collocations_of_two_words(docs):
    assert sorted(map(tuple, collocations.collocations(docs, least=6, share=101, longest=2).collect())) == mined(rows(), 6, 101, 2000, 2)


def test_collocations_of_nothing(docs):
    assert collocations.collocations(docs.where("false")).count() == 0
    assert collocations.collocations(docs.where("text is null or text = ''")).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(docs, longest=4)


def test_hot_first_word_is_cut(spark):
    """A first word with a third of all phrases: its partition is merged in slices, and nothing is lost."""
    data = [(i, f"hot x{i % 400} y{i % 7} . " * 3 + f"cold{i % 50} z{i % 60} hot x{i % 400}", "en") for i in range(1200)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)
    f, total = collocations.phrase_counts(d, least=3, part_bytes=3000)
    c = Counter()
    for _, t, _ in data:
        for piece in t.split("."):
            w = piece.split()
            for k in (1, 2, 3):
                c.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    assert {r.phrase: r.a for r in f.collect()} == {p: a for p, a in c.items() if a >= 3}
    assert total.first().n == sum(len(t.replace(".", " ").split()) for _, t, _ in data)


def test_trie_bursts_and_spills_whole_subtrees():
    rng = np.random.default_rng(1)
    t, want = collocations.Trie(burst=16), Counter()
    for _ in range(5):
        keys, counts = np.unique(rng.integers(1, 9, 400) << 42 | rng.integers(0, 20, 400) << 21 | rng.integers(0, 3, 400), return_counts=True)
        t.add(keys, counts)
        want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert t.size == len(want) and any(type(n) is collocations.Burst for n in t.root.values())
    got, sizes = Counter(), dict((f, n) for n, f in t.subtrees())
    while t.size:
        first, rest, count = t.take(100)
        for f in set(first.tolist()):
            assert (first == f).sum() == sizes[f] and f not in t.root
        got.update(dict(zip((first << 42 | rest).tolist(), count.tolist(), strict=True)))
    assert got == want


def sets_of(text, n=3):
    w = (text or "").translate(LOW).encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def reach(ids, sets, least=85):
    """Smallest id reachable of each row."""
    group = list(range(len(ids)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if ids[i] == ids[j] or a and b and 100 * len(a & b) >= least * len(a | b):
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    low = {}
    for i in range(len(ids)):
        low[root(i)] = min(ids[i], low.get(root(i), ids[i]))
    return [low[root(i)] for i in range(len(ids))]


def near_rows(seed=2):
    """Copies, chains of edits, groups that share a passage, and one group with a third of all rows."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(900)]
    base = [rng.choices(vocab, k=rng.choice([4, 30, 150, 400])) for _ in range(20)]
    passage = rng.choices(vocab, k=60)
    out = []
    for i in range(150):
        w = list(base[0] if i % 3 == 0 else base[rng.randrange(20)])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(["NEW", "edit", "other"])
        if i % 7 == 0:
            w = rng.choices(vocab, k=80) + passage
        out.append((i * 3 % 151, " ".join(w)))
    return out + [(200 + i, t) for i, t in enumerate(ODD)]


@pytest.mark.parametrize("block", [1024, 4])
def test_bottomk(spark, block):
    data = near_rows()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, n_shingles int, node string").repartition(4)
    sets = [sets_of(t) for _, t in data]
    want = dict(zip((i for i, _ in data), reach([i for i, _ in data], sets), strict=True))
    assert 5 < len(set(want.values())) < len(want) - 20
    got = bottomk.near_duplicates(d, block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == sorted((i, len(s), want[i], want[i] == i) for (i, _), s in zip(data, sets, strict=True))


def test_bottomk_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    data = [(9, a), (9, b), (4, b), (7, a + " end"), (7, a + " end"), (2, c), (2, None), (11, c.upper()), (None, a), (None, None)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    held = [(i, t) for i, t in data if i is not None]
    low = reach([i for i, _ in held], [sets_of(t) for _, t in held])
    got = sorted(map(tuple, bottomk.near_duplicates(d).collect()))
    assert got == sorted((i, len(sets_of(t)), m, m == i) for (i, t), m in zip(held, low, strict=True))
    assert bottomk.near_duplicates(d.where("false")).count() == 0


def test_union_sketch():
    rng = np.random.default_rng(0)
    none = np.iinfo(np.uint64).max
    for _ in range(50):
        a, b = (set(rng.integers(0, 60, rng.integers(1, 30)).tolist()) for _ in range(2))
        k = 8
        row = lambda s: np.array([sorted(s)[:k] + [none] * (k - len(sorted(s)[:k]))], np.uint64)
        want = sum(x in a and x in b for x in sorted(a | b)[:k])
        assert bottomk.union_shares(row(a), row(b), k)[0] == want


def clustered(data, k, rounds):
    v = {i: np.array([int(np.floor(64 * float(np.float32(x)))) for x in e], object) for i, e in data if e is not None and len(e) == 4 and all(x is not None and np.isfinite(x) for x in e)}
    c = [v[i] for i in sorted(v, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:k]]

    def nearest(x):
        return min(range(len(c)), key=lambda j: (sum((x - c[j]) ** 2), j))

    for _ in range(rounds):
        own = {i: nearest(x) for i, x in v.items()}
        for j in range(len(c)):
            mine = [v[i] for i in v if own[i] == j]
            if mine:
                c[j] = sum(mine) // len(mine)
    own = {i: nearest(x) for i, x in v.items()}
    dist = {i: int(sum((x - c[own[i]]) ** 2)) for i, x in v.items()}
    by = Counter()
    for i, j in own.items():
        by[j] += dist[i]
    return sorted((i, own[i], dist[i], by[own[i]], sum(dist.values()), hashlib.sha256(",".join(map(str, c[own[i]])).encode()).hexdigest()) for i in v)


@pytest.mark.parametrize("rounds", [0, 1, 3, 8])
def test_clusters(spark, rounds):
    rng = np.random.default_rng(4)
    data = [(i, (rng.normal(0, 0.1, 4) + (i % 6) * 0.7).astype(np.float32).tolist()) for i in range(240)] + [(300 + i, [0.5] * 4) for i in range(30)]
    data += [(400, None), (401, [1.0]), (402, [1.0, None, 0.0, 0.0]), (403, [float("nan")] * 4), (404, [float("inf"), 0.0, 0.0, 0.0]), (405, [])]
    d = spark.createDataFrame([(i, e, 7) for i, e in data], "vec_id long, embedding array<float>, cluster int").repartition(4)
    got = centroids.inertias(*centroids.cluster(d, k=7, rounds=rounds, dims=4))
    assert sorted(map(tuple, got.collect())) == clustered(data, 7, rounds)


def test_clusters_of_few_vectors(spark):
    d = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.1, 0.2]), (None, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = centroids.inertias(*centroids.cluster(d, dims=2)).collect()
    assert [(r.cluster, r.distance) for r in got] == [(0, 0), (0, 0)]
    assert centroids.inertias(*centroids.cluster(d.limit(1), dims=2)).count() == 1
    assert centroids.inertias(*centroids.cluster(d.where("false"), dims=2)).count() == 0


def test_only_due_vectors_are_popped():
    drift = np.array([1.0, 0.0])
    assert centroids.due(np.array([0, 0, 1, 1, 0]), np.array([0.5, 1.5, 0.5, 0.0, 1.0]), drift).tolist() == [0, 3, 4]
