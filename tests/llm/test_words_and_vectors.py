"""Spelling variants, centroid clustering and lattice dedup against plain versions of themselves."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from glosswright.llm import centroids, lattice_dedup, spelling_variants

WORD_SCHEMA = "doc_id long, text string, word string, n long, k long, tag int, wid long, form string, root string, best string"
VECTOR_SCHEMA = "vec_id long, embedding array<double>, label int, v string, s string, cluster int, id long, k long, digest string, copies long"
ONE_LETTER = ["haus", "maus", "", None]


# ---- spelling variants ----------------------------------------------------------------------------------------------


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain_counts(data):
    n = Counter()
    for i, t in data:
        for run in map(lower, re.findall("[A-Za-zÀ-ÿ]+", t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(data):
    n = plain_counts(data)
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}
    root = {}
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return Counter((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root[w]) for w in n)


def word_data():
    rng = random.Random(3)
    letters = "abcdeé×ÿ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(30)] + ["aaaaa", "aaaaaa", "bbbbbbb", "ababab"]

    def slip(w):
        i, k = rng.randrange(len(w)), rng.random()
        return w[:i] + w[i + 1 :] if k < 0.3 else w[:i] + rng.choice(letters) + w[i + (k < 0.7) :]

    def word():
        w = rng.choice(stems)
        while len(w) > 1 and rng.random() < 0.5:
            w = slip(w)
        return rng.choice([w, w, w.upper(), w.title()])

    sep = [" ", ", ", "’", "\n", " Ā ", "語", "'", "1", " ", "Ł"]
    data = [(i, "".join(word() + rng.choice(sep) for _ in range(rng.randint(0, 120)))) for i in range(250)]
    data += [data[7]] * 40 + [(None, data[8][1]), (None, data[8][1]), (900, None), (None, None), (901, ""), (902, " ,. 123 語")]
    long = "".join(rng.choice(letters) for _ in range(3000))
    data += [(1000 + i, w) for i in range(3) for w in (long, long[:1500] + long[1501:], long[:-1] + "z", "y" * 5000, "y" * 5001, "x " * 40000)]
    return data


def rows_of(spark, data, schema, parts=3):
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in data], schema).repartition(parts)


def test_spelling_variants(spark, monkeypatch):
    data = word_data()
    df = rows_of(spark, data, WORD_SCHEMA)
    want = plain_variants(data)
    assert sum(1 for w in want if w[3]) > 50 and any(w[5] != w[3] for w in want if w[3])
    for flush in (spelling_variants.FLUSH, 7):
        monkeypatch.setattr(spelling_variants, "FLUSH", flush)
        assert Counter(tuple(r) for r in spelling_variants.variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect()) == want
    assert spelling_variants.variants(rows_of(spark, [], WORD_SCHEMA)).count() == 0
    assert spelling_variants.variants(rows_of(spark, [(1, None), (None, "")], WORD_SCHEMA)).count() == 0


def test_slices(monkeypatch):
    text = " ".join(t for _, t in word_data()[:60] if t)
    want = [w.encode() for w in map(lower, re.findall("[A-Za-zÀ-ÿ]+", text))]
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(spelling_variants, "SLICE", size)
        assert [w for some in spelling_variants.runs(text) for w in some] == want


def test_colliding_keys_link_nothing(spark, monkeypatch):
    data = word_data()[:120]
    monkeypatch.setattr(spelling_variants, "_mixed", lambda x, salt: x % np.uint64(5))  # nearly every key collides
    words = sorted(plain_counts(data))
    key, tag, of = spelling_variants.deletion_keys(words)
    order = np.argsort(key, kind="stable")
    live = order[spelling_variants.shared(key[order], tag[order])]
    n = plain_counts(data)
    got = Counter()
    for i, k, _, _ in spelling_variants.linked(tag[live].tolist(), [words[j] for j in of[live]], [n[words[j]] for j in of[live]], of[live].tolist()):
        got[words[i]] += k
    assert got == {w: k for w in words if (k := sum(one_edit(w, v) for v in words))}


def test_deletion_hashes():
    words = ["hallo", "hall", "halo", "hello", "aaaa", "aaa", "été", "x" * 300, "x" * 299]
    key, tag, of = spelling_variants.deletion_keys(words)
    rest = {}
    for k, t, i in zip(key.tolist(), tag.tolist(), of.tolist(), strict=True):
        w = words[i]
        at = t if t >= 0 else -2 - t
        left = w if t == spelling_variants.ITSELF else w[:at] + w[at + 1 :]
        assert rest.setdefault(k, (t if t >= 0 else None, len(w) if t >= 0 else None, left)) == (t if t >= 0 else None, len(w) if t >= 0 else None, left)
    assert len(set(rest.values())) == len(rest)
    assert sum(1 for t, i in zip(tag, of, strict=True) if i == 4 and t < -1) == 1  # aaaa has one deletion


# ---- centroid clustering --------------------------------------------------------------------------------------------


def vector_data(n=400, size=64, seed=5):
    rng = random.Random(seed)
    mids = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    out = [(i, [rng.gauss(m, 0.3) for m in rng.choice(mids)]) for i in range(n)]
    out += [(n + i, list(out[3][1])) for i in range(60)] + [out[4], out[4], (4, out[9][1]), (None, out[5][1]), (None, out[6][1])]
    bad = list(out[7][1])
    out += [(9000, None), (9001, bad[:-1]), (9002, [*bad, 1.0]), (9003, [None, *bad[1:]]), (9004, [math.nan, *bad[1:]]), (9005, [*bad[1:], -math.inf]), (9006, [0.0] * size), (9007, []), (None, None)]
    return out


def plain_clusters(data, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in data if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda: [min((far(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        at = place()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, a) in zip(kept, at, strict=True) if a == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return Counter((i, a, d) for (i, _), (d, a) in zip(kept, place(), strict=True)), cents


def test_centroids(spark):
    data = vector_data()
    want, cents = plain_clusters(data)
    for parts in (1, 7):
        got, found, measured = centroids.cluster(rows_of(spark, data, VECTOR_SCHEMA, parts))
        assert found == cents
        assert Counter(tuple(r) for r in got.collect()) == want
    n = sum(want.values())
    assert all(n <= m < 0.6 * 8 * n for m in measured)  # most distances are never measured


@pytest.mark.parametrize("data", [[], [(1, None)], vector_data()[:3], [vector_data()[0]] * 20])
def test_few_vectors(spark, data):
    want, cents = plain_clusters(data)
    got, found, _ = centroids.cluster(rows_of(spark, data, VECTOR_SCHEMA))
    assert found == cents and Counter(tuple(r) for r in got.collect()) == want


def test_huge_components(spark):
    data = [(i, [s * x for x in v]) for i, v in vector_data()[:40] if v for s in (1e6, -1e6)]
    want, cents = plain_clusters(data)
    got, found, _ = centroids.cluster(rows_of(spark, data, VECTOR_SCHEMA))
    assert found == cents and Counter(tuple(r) for r in got.collect()) == Counter({(i, a, min(d, centroids.MOST)): c for (i, a, d), c in want.items()})
    data = [(i, [1e300 * x for x in v]) for i, v in vector_data()[:10]]
    assert max(r["distance"] for r in centroids.cluster(rows_of(spark, data, VECTOR_SCHEMA), k=2)[0].collect()) == centroids.MOST


def test_screening_changes_nothing():
    rng = np.random.RandomState(2)
    for scale in (3, 300, 1 << 26):
        x = rng.randint(-scale, scale, size=(500, 64))
        x[100:200] = x[0]
        c = [*x[:6].tolist(), x[0].tolist(), [v + 1 for v in x[0].tolist()]]
        d = ((x[:, None, :] - np.array(c)[None]) ** 2).sum(axis=2)
        a, got, measured = centroids.nearest(x, *centroids.compressed(x, 8), c)
        assert (a == d.argmin(axis=1)).all() and (got == d.min(axis=1)).all() and measured <= d.size


# ---- lattice dedup --------------------------------------------------------------------------------------------------


def test_lattice_points_are_nearest():
    rng = np.random.RandomState(0)
    x = rng.normal(scale=2, size=(300, 8))
    home = lattice_dedup.decoded(x)
    assert ((2 * home).round() == 2 * home).all() and (home.sum(axis=1) % 2 == 0).all()
    assert len(lattice_dedup.NEIGHBOURS) == 240 and np.allclose((lattice_dedup.NEIGHBOURS**2).sum(axis=1), 2)
    next_to = home[:, None] + lattice_dedup.NEIGHBOURS[None]
    assert (((x - home) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - next_to) ** 2).sum(axis=2) + 1e-9).all()
    assert (((x - home) ** 2).sum(axis=1) <= 1 + 1e-9).all()  # the covering radius
    assert (lattice_dedup.decoded(home) == home).all() and (lattice_dedup.decoded(lattice_dedup.NEIGHBOURS) == lattice_dedup.NEIGHBOURS).all()


def cosine_pair(rng, n, cos, size=64):
    x = lattice_dedup.unit(rng.normal(size=(n, size)))
    z = rng.normal(size=(n, size))
    z -= (z * x).sum(axis=1)[:, None] * x
    return x, cos * x + math.sqrt(1 - cos * cos) * lattice_dedup.unit(z)


def test_recall_of_the_index():
    rng = np.random.RandomState(3)
    meet = lambda a, b: (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean()
    for cos, least in ((0.9, 0.95), (0.93, 0.985), (0.96, 0.999)):
        x, y = cosine_pair(rng, 4000, cos)
        assert meet(lattice_dedup.keys(x), lattice_dedup.keys(y)) >= least
    x, y = cosine_pair(rng, 20000, 0.0)
    assert meet(lattice_dedup.keys(x), lattice_dedup.keys(y)) < 0.002


def near_data(seed=6):
    rng = np.random.RandomState(seed)
    base = lattice_dedup.unit(rng.normal(size=(150, 64)))
    out = [v.tolist() for v in base]
    for i in range(300):  # spread groups, one of them large, and a chain
        v = base[i % 20 if i % 2 else 0] + rng.normal(scale=0.035, size=64)
        out.append((v * rng.uniform(0.1, 9)).tolist())
    at = base[30]
    for _ in range(25):
        at = lattice_dedup.unit((at + rng.normal(scale=0.05, size=64))[None])[0]
        out.append(at.tolist())
    data = list(enumerate(out))
    data += [(1000 + i, out[5]) for i in range(70)] + [data[3], (4, out[90]), (None, out[6]), (None, rng.normal(size=64).tolist())]
    data += [(2000, None), (2001, [0.0] * 64), (2002, [math.nan] * 64), (2003, [None, *out[5][1:]]), (2004, [math.inf, *out[5][1:]]), (2005, out[5][:-1]), (2006, out[5][:-1]), (2007, []), (2008, [-0.0, *out[5][1:]]), (2009, [0.0, *out[5][1:]]), (2010, [1e-300 * x for x in out[7]]), (None, None)]
    return data


def plain_links(data, cosine=0.9):
    ok = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n, near = len(data), []
    u = [lattice_dedup.unit(np.array([v]))[0] if ok(v) else None for _, v in data]
    for i in range(n):
        for j in range(i):
            if u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine:
                near.append((i, j))
    return near


def plain_dedup(data, near):
    n = len(data)
    count, root = Counter(x for p in near for x in p), list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        root[find(a)] = find(b)
    low = {}
    for i in range(n):
        if data[i][0] is not None:
            low[find(i)] = min(low.get(find(i), data[i][0]), data[i][0])
    return Counter((data[i][0], count[i], low.get(find(i))) for i in range(n))


def test_lattice_dedup(spark):
    data = near_data()
    near = plain_links(data)
    got = lattice_dedup.near_dedup(rows_of(spark, data, VECTOR_SCHEMA), tables=40, block=16)  # so many tables find all
    assert Counter(tuple(r) for r in got.select("vec_id", "n_links", "component_id").collect()) == plain_dedup(data, near)
    links = sum(r["n_links"] for r in lattice_dedup.near_dedup(rows_of(spark, data, VECTOR_SCHEMA)).collect())
    assert 2 * len(near) >= links >= 0.97 * 2 * len(near)


def test_no_vectors(spark):
    assert lattice_dedup.near_dedup(rows_of(spark, [], VECTOR_SCHEMA)).count() == 0
    assert [tuple(r) for r in lattice_dedup.near_dedup(rows_of(spark, [(3, None)], VECTOR_SCHEMA)).collect()] == [(3, 0, 3)]
