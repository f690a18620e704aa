import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from metrolith.llm import substring_dedup as D
from metrolith.llm.common import text_buffer, words


def brute(rows, size=13):
    w = [[x for x in re.split("[\x20\x09-\x0d]+", t or "") if x] for _, t in rows]
    first = {}
    for (d, _), x in zip(rows, w):
        if d is not None:
            for i in range(len(x) - size + 1):
                k = tuple(x[i : i + size])
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), x in zip(rows, w):
        gone = set()
        if d is not None:
            for i in range(len(x) - size + 1):
                if first[tuple(x[i : i + size])] < d:
                    gone |= set(range(i, i + size))
        kept = " ".join(v for i, v in enumerate(x) if i not in gone)
        out.append((d, len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    voc = ["a", "b", "the", "é", " x"] + [f"w{i}" for i in range(60)]
    passages = [[rng.choice(voc) for _ in range(rng.choice([12, 13, 14, 30, 90]))] for _ in range(6)] + [["a"] * 40, ["a", "b"] * 20]
    rows = [(None, " ".join(passages[3])), (-3, None), (-2, ""), (-1, " \n\t")]
    for d in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(voc) for _ in range(rng.randint(1, 40))]
        rows.append((d, rng.choice([" ", "  ", "\n"]).join(w)))
    return rows + [rows[10], (rows[12][0], rows[13][1])]


@pytest.mark.parametrize("seed, block", [(1, 4 << 20), (2, 200)])
def test_equals_brute_force(spark, seed, block):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, block int, key string")
    got = sorted(map(tuple, D.deduplicate(df, block_bytes=block).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert D.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def symbols(texts, rounds):
    buf, at = text_buffer(pa.array([" ".join(t) for t in texts]))
    _, _, h, first = words(buf, at)
    out = []
    s = D.Symbols(h, first)
    for k in range(rounds):
        s.round(k)
        out.append((s, s.name.copy(), s.at.copy(), s.lo.copy(), s.hi.copy(), s.made.copy(), first))
    return out


def test_equal_windows_have_equal_symbols_where_their_support_is_inside():
    """What the method promises, whatever stands around the windows; runs included."""
    rng = random.Random(5)
    made = 0
    for _ in range(400):
        w = [rng.choice("abcdefgh") for _ in range(30) for _ in range(rng.choice([1, 1, 1, 2, 3]))][:24]
        around = [[[rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))] for _ in range(2)] for _ in range(2)]
        both = [a + w + b for a, b in around]
        for s, name, at, lo, hi, new, first in symbols(both, 3):
            inside = []
            for d in range(2):
                x = int(first[d]) + len(around[d][0])
                keep = new & (lo >= x) & (hi < x + len(w))
                inside.append(sorted(zip((at[keep] - x).tolist(), name[keep].tolist(), (lo[keep] - x).tolist(), (hi[keep] - x).tolist())))
            assert inside[0] == inside[1]
            made += len(inside[0])
    assert made > 2000


def test_runs_and_pairs_are_named_by_what_they_hold():
    for s, name, at, *_ in symbols([["a"] * 7 + ["b"], ["a"] * 6 + ["b"], ["a"] * 7 + ["b"]], 1):
        of = {}
        for n, x, y in zip(name.tolist(), at.tolist(), [*at[1:].tolist(), 23]):
            of.setdefault(n, []).append(y - x)
        assert all(len(set(v)) == 1 for v in of.values()) and len(of) < len(name)


def test_words_are_compared_where_names_collide(spark, monkeypatch):
    """Names only propose: with names of a few bits the result is still exact."""
    rows = corpus(7, 25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    b, e = np.array([0, 2, 5]), np.array([1, 4, 7])
    assert len(set(D.true_names(np.frombuffer(b"a bb bc", np.uint8), b, e, np.array([5, 5, 5], np.uint64)).tolist())) == 3
    said = pa.table({"block": [0, 0], "owner": [1, 1], "text": [" ".join("abcdefghijklmno"), " ".join("abcdefghijklmxo")]})
    regions = pa.table({"block": [0], "doc_id": [1], "text": ["z " + " ".join("abcdefghijklmno")]})
    assert D._unverified(13)(said, regions).column("text").to_pylist() == [" ".join("abcdefghijklmxo")]
    monkeypatch.setattr(D, "_check", lambda h, first, size: np.zeros(D.windows(h, first, size)[0].size, np.uint32))
    got = sorted(map(tuple, D.deduplicate(df, rounds=1).collect()), key=str)
    assert got == brute(rows)


def test_kept_text(spark):
    p = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, p), (2, "x " + p + " y")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in D.deduplicate(df, with_text=True).collect()} == {1: p, 2: "x y"}
