import random
import re

import numpy as np
import pytest

from metrolith.llm import jaccard_join as J


def shingles(text, size):
    w = [x.translate({k: k + 32 for k in range(65, 91)}) for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent):
    """(doc_id, n_shingles, component_id, n_links) of each row, None as (True, 0)."""
    sets = [shingles(t, size) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[top(i)] = top(j)
                links[i] += 1
                links[j] += 1
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(plain((d, len(sets[i]), least[top(i)], links[i])) for i, (d, _) in enumerate(rows))


def plain(r):
    return (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0, r[3])


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünï", "THE", "the"]
    common = [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(3)]
    rows = [(None, "a b c d e f"), (5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "ONE"), (10, "one two"), (8, "one")]
    n = 20
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 9, 15, 30, 60, 200]))]
        for _ in range(rng.choice([1, 2, 3, 14])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((n, " ".join(w)))
            n += 1
    for _ in range(40):  # texts of shared passages mostly
        rows.append((n, " ".join(rng.sample(common, 2)) + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))))
        n += 1
    return rows


@pytest.mark.parametrize("size, percent, block", [(4, 85, 200_000), (5, 80, 6)])
def test_equals_brute_force(spark, size, percent, block):
    rows = corpus(size)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, cls string, n long")
    assert sorted(map(plain, J.near_duplicates(df, size, percent, block).collect())) == brute(rows, size, percent)


def near_copies(n, words, edits, seed):
    """Texts that differ from one another in up to ``edits`` words each."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize("blocks", [(2048, 1 << 20, 20_000), (40, 5000, 50)])
def test_large_group_of_near_copies(spark, blocks, monkeypatch):
    """Links inside a group are counted, never listed: rows stay in proportion."""
    monkeypatch.setattr(J, "BLOCK_SETS", blocks[0])
    monkeypatch.setattr(J, "BLOCK_SHINGLES", blocks[1])
    rows = near_copies(300, 150, 9, 1)
    rng = random.Random(2)
    for k in range(150):  # many texts with one common passage, short enough to be in prefixes
        rows.append((1000 + k, "this very line stands in many of the texts that follow here " + " ".join(f"x{rng.randrange(60)}" for _ in range(rng.randint(0, 9)))))
    made = []

    class Watched(J.Scratch):
        def written(self, df, label):
            out = super().written(df, label)
            if label in ("stars", "visits", "meet", "links"):
                made.append((label, out.count()))
            return out

    monkeypatch.setattr(J, "Scratch", Watched)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(plain, J.near_duplicates(df, 4, 85, blocks[2]).collect()))
    want = brute(rows, 4, 85)
    assert got == want
    linked = sum(r[-1] for r in want) // 2
    assert linked > 3000
    if blocks[0] > len(rows):
        assert all(n < 6 * len(rows) for _, n in made), made


def test_long_texts_and_repeated_rows(spark):
    rng = random.Random(5)
    long = [f"w{rng.randrange(5000)}" for _ in range(30_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-300])), (3, " ".join(long[9000:]))] + [(4, "just the same row again")] * 5 + [(None, "just the same row again"), (9, "same " * 500), (10, "same " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(plain, J.near_duplicates(df, 4, 85).collect())) == brute(rows, 4, 85)


def test_link_matrix_equals_loops():
    rng = np.random.default_rng(0)
    base = rng.choice(1 << 40, 400, False).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(300, 400), False), rng.choice(1 << 40, rng.integers(0, 20)).astype(np.uint64)])) for _ in range(60)]
    want = np.array([[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets])
    got = J.link_matrix(sets, sets, 80)
    np.fill_diagonal(got, True)
    assert (got == want).all() and (J.link_matrix(sets[:7], sets[7:], 80) == want[:7, 7:]).all()
    assert 60 < want.sum() < 3600


def test_empty(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_first_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(3, text, "a"), (1, text + " x", "b"), (2, "other words stand here alone", "c")], "doc_id long, text string, source string")
    kept = J.keep_first(df)
    assert sorted(r[0] for r in kept.collect()) == [1, 2] and kept.columns == df.columns
    assert J.keep_first(df.limit(0)).count() == 0


def test_keep_first_goes_by_rows_not_by_ids(spark):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(3, text, 1, 0), (5, text + " x", 2, 0), (5, "quite another text of this id", 3, 0), (None, text + " y", 4, 0), (None, other, 5, 0), (None, other, 6, 0), (7, other + " z", 7, 0), (8, None, 8, 0), (8, None, 9, 0), (None, "alone without any id at all", 10, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls int, keep int")
    assert sorted(r["cls"] for r in J.keep_first(df).collect()) == [1, 3, 7, 8, 9, 10]


def test_boundary_is_the_cheapest():
    sizes = {7: 100, 20: 100, 60: 100}
    light = J.boundary(sizes, 50.0, 85)
    assert light >= 20  # long lists make enumeration cheaper
    assert J.boundary(sizes, 0.01, 85) < 20
