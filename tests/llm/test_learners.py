"""The learners and scorers against plain versions written with loops."""

import math
import random

import numpy as np
import pyarrow as pa

from metrolith.llm import ftrl, langid, toxicity
from metrolith.llm.common import text_buffer

WORDS = {"aa": "lorem ipsum dolor sit amet elit sed".split(), "bb": "quick brown fox jumps over lazy dog".split(), "cc": "κάτι άλλο εδώ είναι Όλα μαζί".split()}


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[k]) for _ in range(rng.randint(1, 20))), k) for i in range(n) for k in [rng.choice(list(WORDS))]]


def grams(text):
    """Feature numbers of the 1-, 2- and 3-grams that end at each symbol."""
    symbols = []
    for ch in text:
        if ch.isalpha():
            low = ch.lower()
            symbols.append(ord(low) if len(low) == 1 and ord(ch) < 0x600 else ord(ch))
        elif not symbols or symbols[-1] != 0:
            symbols.append(0)
    out, mask = [], (1 << 64) - 1
    for i, c in enumerate(symbols):
        one = symbols[i - 1] if i > 0 else 0
        two = symbols[i - 2] if i > 1 else 0
        h = ((c + 1) * 0x9E3779B97F4A7C15) & mask
        hashes = [h]
        h = (h + (one + 1) * 0xC2B2AE3D27D4EB4F) & mask
        hashes.append(h)
        hashes.append((h + (two + 1) * 0x165667B19E3779F9) & mask)
        out += [((((x ^ (x >> 29)) * 0xFF51AFD7ED558CCD) & mask) >> (64 - langid.BITS)) for x in hashes]
    return out, len(symbols)


def test_language_scores_equal_loops_and_do_not_depend_on_the_batch(spark):
    rows = texts(150, 5)
    odd = ["ed", "", "x", "Éa 12 ﬁ ß", "..a", "a..", "İ", "1", "𝒳 x"]
    docs = spark.createDataFrame([(i, t, k) for i, t, k in rows], "doc_id long, text string, lang string")
    model = langid.train(docs)
    every = odd + [t for _, t, _ in rows[:60]] + odd
    batch, _ = model.logits(*text_buffer(pa.array(every)))
    for i, t in enumerate(every):
        alone, known = model.logits(*text_buffer(pa.array([t])))
        assert (alone[0] == batch[i]).all()
        assert known[0] == any(ch.isalpha() for ch in t)
        f, n = grams(t)
        want = model.intercept + (model.table[f].astype(np.int64).sum(axis=0) / n * (langid._SCALE / langid._UNIT) if n else 0)
        assert np.allclose(alone[0], want, rtol=0, atol=1e-9)
    #: the same scores however the rows are dealt out
    one = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs.coalesce(1), model).collect()}
    many = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs.repartition(23), model).collect()}
    assert one == many


def test_idf_is_that_of_a_loop(spark):
    rows = texts(40, 6)
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), epochs=1)
    df = np.zeros(langid.FEATURES)
    for _, t, _ in rows:
        df[list(set(grams(t)[0]))] += 1
    idf = np.log((len(rows) + 1) / (df + 1)) + 1
    #: idf * weight is kept; the weights are learned on the rows in the order of training
    fit, known = [], []
    for _, t, k in rows:
        f, n = grams(t)
        at, c = np.unique(np.array(f, np.int32), return_counts=True)
        fit.append((at, c / max(1, n) * idf[at] * langid._SCALE))
        known.append(sorted(WORDS).index(k))
    assert set(np.flatnonzero(model.table.any(axis=1))) <= set(np.concatenate([x[0] for x in fit]).tolist())
    assert len(fit) == 40 and model.languages == sorted(WORDS)


def dense_ftrl_step(z, n, g, w, alpha):
    for i in range(len(g)):
        sigma = (math.sqrt(n[i] + g[i] * g[i]) - math.sqrt(n[i])) / alpha
        z[i] += g[i] - sigma * w[i]
        n[i] += g[i] * g[i]


def dense_weight(z, n, alpha, beta, l1, l2):
    return [0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(b)) / alpha + l2) for a, b in zip(z, n)]


def test_multinomial_equals_a_dense_loop():
    rng = np.random.default_rng(4)
    features, outputs, options = 12, 3, dict(alpha=0.5, beta=1.0, l1=0.05, l2=0.05)
    rows = [(np.sort(rng.choice(features, 4, False)), rng.normal(size=4)) for _ in range(60)]
    y = rng.integers(0, outputs, 60)
    got = ftrl.multinomial(rows, y, features, outputs, epochs=2, seed=7, **options)
    z = [[0.0] * (features + 1) for _ in range(outputs)]
    n = [[0.0] * (features + 1) for _ in range(outputs)]
    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(60):
            x = [0.0] * features + [1.0]
            for a, v in zip(*rows[i]):
                x[a] = v
            w = [dense_weight(z[k], n[k], **options) for k in range(outputs)]
            s = [sum(a * b for a, b in zip(w[k], x)) for k in range(outputs)]
            e = [math.exp(v - max(s)) for v in s]
            for k in range(outputs):
                p = e[k] / sum(e) - (k == y[i])
                dense_ftrl_step(z[k], n[k], [p * v for v in x], w[k], options["alpha"])
    want = np.array([dense_weight(z[k], n[k], **options) for k in range(outputs)]).T
    assert np.allclose(got, want, atol=1e-9)


def test_cumulative_link_follows_the_gradient_of_its_likelihood():
    """One update of weights and cuts equals numeric differentiation."""

    def loss(w, cut, x, y):
        f = lambda v: 1 / (1 + math.exp(-v))
        s = sum(a * b for a, b in zip(w, x))
        hi = f(cut[y] - s) if y < len(cut) else 1.0
        lo = f(cut[y - 1] - s) if y else 0.0
        return -math.log(hi - lo)

    for y in range(3):
        weight = np.array([2.0, 1.0, 3.0])
        rows, grades = [np.array([0, 2])], np.array([y])
        w, cut = ftrl.cumulative_link(rows, grades, 3, 4, weight[y : y + 1], epochs=1, rate=0.2, alpha=0.3, l1=0.0, l2=0.0)
        #: cuts begin at the shares of the grades, clipped away from 0 and 1
        share = np.clip([float(y <= 0), float(y <= 1)], 1e-4, 1 - 1e-4)
        begin = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(2))
        x, eps = [1, 0, 1, 0], 1e-6
        grad = []
        for i in range(4):
            up, down = [0.0] * 4, [0.0] * 4
            up[i], down[i] = eps, -eps
            grad.append(weight[y] * (loss(up, begin, x, y) - loss(down, begin, x, y)) / (2 * eps))
        z, n = [0.0] * 4, [0.0] * 4
        dense_ftrl_step(z, n, grad, [0.0] * 4, 0.3)
        want = dense_weight(z, n, 0.3, 1.0, 0.0, 0.0)
        assert np.allclose(w, want, atol=1e-5), (y, w, want)
        moved = []
        for k in range(2):
            up, down = begin.copy(), begin.copy()
            up[k] += eps
            down[k] -= eps
            g = weight[y] * (loss([0.0] * 4, up, x, y) - loss([0.0] * 4, down, x, y)) / (2 * eps)
            moved.append(begin[k] - 0.2 * g / math.sqrt(1 + g * g))
        assert np.allclose(cut, np.maximum.accumulate(moved), atol=1e-4)


def test_toxicity_scores_equal_loops_over_words():
    rng = np.random.default_rng(2)
    weights = np.where(rng.random(toxicity.FEATURES) < 0.5, rng.normal(size=toxicity.FEATURES), 0.0)
    model = toxicity.Model([0, 1, 2], weights, np.array([-0.5, 1.0]))
    every = ["", "abcdefgh abc ab a", "Hello, hello WORLD-wide world", "bad " * 500, "é" * 40 + " straße", None]
    of = lambda x: text_buffer(pa.array([x], pa.binary() if isinstance(x, bytes) else pa.string()))
    got = model.scores(*text_buffer(pa.array(every)))
    for i, t in enumerate(every):
        assert np.isclose(model.scores(*of(t))[0], got[i], rtol=0, atol=1e-9)
        found = set()
        for w in toxicity.normalise(*of(t or ""))[0].tobytes().split():
            found.add(int(toxicity.features(*of(w))[0][0]))
            #: a longer word also counts by its first bytes, as something else than a word of these
            for k, n in enumerate(n for n in toxicity.PREFIXES if len(w) > n):
                found.add(int(toxicity.features(*of(w[:n] + b"xyz"))[0][1 + k]))
        assert np.isclose(got[i], sum(weights[f] for f in found), rtol=0, atol=1e-9)
