import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from metrolith.llm import decontaminate, ftrl, langid, licenses, toxicity
from metrolith.llm.common import text_buffer

WORDS = {"aa": "lorem ipsum dolor sit amet elit sed".split(), "bb": "quick brown fox jumps over lazy dog".split(), "cc": "κάτι άλλο εδώ είναι όλα μαζί".split()}


def texts(n, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[k]) for _ in range(rng.randint(3, 30))), k) for i in range(n) for k in [rng.choice(list(WORDS))]]


def test_language_held_out_accuracy(spark):
    rows = texts(400) + [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (None, "lorem ipsum", "aa"), (1003, "lorem " * 60_000, None), (1003, "lorem " * 60_000, None)]
    df = spark.createDataFrame([(i, t, k, 5.0) for i, t, k in rows], "doc_id long, text string, lang string, score double")
    out = langid.predict_held_out(df)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    held = [(k, got[i]) for i, _, k in rows[:400] if got[i].held_out]
    assert len(held) > 40 and np.mean([k == r.lang_pred for k, r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {1000, 1001, 1002}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() > 390


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "lorem", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.predict_held_out(df).collect()] == [("und", 0.0)]
    assert langid.predict_held_out(df.limit(0)).count() == 0


def test_temperature_softens_overconfidence():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 2000)
    logits = rng.normal(size=(2000, 3)) + 1.5 * np.eye(3)[y]
    t1 = ftrl.temperature(logits, y)
    t10 = ftrl.temperature(10 * logits, y)
    assert 8 < t10 / t1 < 12 and ftrl.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_elastic_net_drops_noise():
    rng = np.random.default_rng(1)
    rows = [(np.array([y, *rng.choice(np.arange(2, 200), 5, False)]), np.ones(6)) for y in rng.integers(0, 2, 400)]
    y = np.array([r[0][0] for r in rows])
    w = ftrl.multinomial(rows, y, 200, 2, l1=4.0)
    assert (np.abs(w[:2]).max(axis=1) > 0).all() and (w[2:200] == 0).mean() > 0.8


def test_ordered_grades(spark):
    rng = random.Random(3)
    filler = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(900):
        g = rng.choice([0, 0, 1, 2])
        w = rng.sample(filler, 20) + {0: [], 1: ["bad"], 2: ["bad", "worse"]}[g]
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        marks.append((i, g))
    docs = spark.createDataFrame([(i, t, "x") for i, t in [*rows, (2000, None), (2001, ""), (None, "bad worse")]], "doc_id long, text string, severity string")
    labels = spark.createDataFrame([*marks, (5000, 2), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.grades == [0, 1, 2] and (np.diff(model.cuts) >= 0).all()
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    truth = dict(marks)
    assert np.mean([got[i].grade == truth[i] for i in truth]) > 0.9
    means = [np.mean([got[i].severity for i in truth if truth[i] == g]) for g in range(3)]
    assert means[0] < 0.3 < means[1] < means[2] and got[None].toxic
    alone = (ftrl.grade_probabilities(np.zeros(1), model.cuts) @ np.arange(3))[0]
    assert got[2000].severity == got[2001].severity == alone and not got[2000].toxic
    assert not any(got[i].toxic for i in truth if truth[i] == 0)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train(docs, labels.limit(0)).grades == [0]


def test_grade_probabilities_sum_to_one():
    p = ftrl.grade_probabilities(np.array([-3.0, 0.0, 4.0]), np.array([-1.0, 0.5, 2.0]))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all() and (np.diff(p @ np.arange(4)) > 0).all()


def edit_distance_to_part(a: bytes, b: bytes) -> int:
    d = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return min(d)


def test_decontamination_against_full_alignment(spark):
    rng = random.Random(9)
    voc = ["the", "and", "of", "ing", "tion", "ärger", "est"] + [f"q{i}z" for i in range(50)]
    sentence = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    items = [(i, sentence(rng.choice([10, 25, 60]))) for i in range(12)] + [(50, None), (None, "x" * 60), (51, "tiny"), (52, "")]
    docs = [(1000, None), (1001, ""), (None, sentence(30))]
    for k in range(120):
        text = sentence(rng.randint(0, 60))
        if k % 2:
            t = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, int(len(t) * 0.09))):
                p = rng.randrange(len(t))
                t[p : p + rng.choice([0, 1])] = rng.choice(["", "x", "é"])
            text += " " + "".join(t).upper() + "! " + sentence(10)
        docs.append((k, text))
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, edits int")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    parts = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, slice_bytes=500).collect()}
    assert got == parts
    norm = lambda t: decontaminate.normalise(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tobytes() if t else b""
    ix = decontaminate.build_index(items)
    want = {(i, int(ix.item[s])) for i, t in docs for s in range(len(ix.segments)) if t and edit_distance_to_part(ix.segments[s], norm(t)) <= ix.edits[s]}
    assert got == want and len(want) > 30
    clean = {r.doc_id for r in decontaminate.keep_clean(d, b).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in want}
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), b).count() == 0
    assert decontaminate.keep_clean(d, b.limit(0)).count() == len(docs)


def test_decontamination_of_short_items_and_excerpts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    long = " ".join(word() for _ in range(250))[:1000]
    items = [(1, "What is the capital of France?"), (2, long), (3, "Äb"), (4, "?!"), (5, None)]
    docs = [(1, "so, WHAT is the capital - of France"), (2, "what is the capital of frances"), (3, "xwhat is the capital of france"), (4, "zz äB"), (5, ""), (6, None), (7, "äbc"), (8, "b")]
    want = {(1, 1), (4, 3)}
    for i, (at, n) in enumerate([(100, 200), (0, 64), (1, 64), (333, 70), (458, 100), (935, 64), (501, 151)]):
        docs.append((100 + i, "uuu " + long[at : at + n] + " vvv"))
        want.add((100 + i, 2))
    docs.append((200, long[400:440]))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    assert [(r.begin, r.end, r.edits) for r in found if r.doc_id == 1] == [(4, 35, 0)]
    assert [(r.begin, r.end) for r in found if r.doc_id == 4] == [(3, 6)]
    got = [r for r in found if r.doc_id == 100][0]
    assert got.edits == 0 and got.begin <= 7 and got.end >= 201


def test_repetitive_texts_stay_within_memory(monkeypatch):
    """Tiles find what one tile finds, and a periodic text takes bounded memory."""
    rng = random.Random(6)
    items = [(1, "ab " * 60), (2, "the cat sat on the mat and " * 8), (3, " ".join(str(rng.randrange(10**6)) for _ in range(60)))]
    ix = decontaminate.build_index(items)
    texts = ["ab " * 300, "zz " * 100 + items[1][1] + " yy" * 100, "x" + items[2][1][150:300] + "y " * 500 + items[2][1], "the cat sat on the mat " * 30]
    buf, at = text_buffer(pa.array(texts))
    monkeypatch.setattr(decontaminate, "TILE", 1 << 40)
    want = decontaminate.matches(buf, at, ix)
    monkeypatch.setattr(decontaminate, "TILE", 500)
    assert decontaminate.matches(buf, at, ix) == want and {x[:2] for x in want} >= {(0, 1), (1, 2), (2, 3)}
    monkeypatch.undo()
    buf, at = text_buffer(pa.array(["ab " * 1500]))
    tracemalloc.start()
    found = decontaminate.matches(buf, at, ix)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x[:2] for x in found] == [(0, 1)] and peak < 250e6


def test_clean_rows_do_not_depend_on_slices(spark):
    item = "a benchmark question that nobody should ever train on, number 17"
    other = "some other passage of the benchmark with quite different words, 23"
    rows = [(None, item, 1), (7, "clean", 2), (7, "see " + item, 3), (8, None, 4), (None, "clean", 5), (9, other, 6), (10, "x", 7), (10, "x", 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n int")
    b = spark.createDataFrame([(5, item.upper() + "!"), (3, item), (4, "  " + item), (6, other)], "item_id long, text string")
    for n in (1 << 24, 70):
        assert sorted(r.n for r in decontaminate.keep_clean(d, b, slice_bytes=n).collect()) == [2, 4, 5, 7, 8]
        assert sorted({(r.item_id) for r in decontaminate.contaminated(d, b, slice_bytes=n).collect()}) == [3, 6]


def test_licenses(spark):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    changed = mit.replace("<year> <holder>", "2019 Jane Doe").replace('"', "“").replace("sublicense", "sub-license").upper()
    rows = [(1, mit), (2, changed), (3, changed + " extra"), (4, None), (5, ""), (6, "foo\nReleased under the MIT licence!\nbar\nLicensed under CC BY-NC 4.0."), (7, "no words of that kind"), (None, mit), (1, mit)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    got = sorted(((r.doc_id or 0, r.license_id, r.notice_ids) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([(1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, ""), (5, None, ""), (6, None, "CC-BY-NC-4.0,MIT"), (7, None, ""), (0, "MIT", ""), (1, "MIT", "")], key=str)
    assert licenses.scan(df.limit(0)).count() == 0


BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""


def test_complete_license_texts(spark):
    bsd3 = BSD2.replace("THIS SOFTWARE IS PROV", THIRD + "THIS SOFTWARE IS PROV")
    rows = [(1, "Copyright (c) 2020, Jane Doe\nAll rights reserved.\n\n" + BSD2, "BSD-2-Clause"), (2, "BSD 3-Clause License\n\nCopyright 2021 A\n\n" + bsd3, "BSD-3-Clause"), (3, BSD2 + " more", None)]
    at = "/usr/share/common-licenses/"
    for name, want in (("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(at + name):
            with open(at + name, encoding="utf-8") as f:
                rows.append((10 + len(rows), f.read(), want))
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == {i: want for i, _, want in rows}


def test_known_texts_need_no_fixed_word(spark):
    df = spark.createDataFrame([(1, "Do as you PLEASE!"), (2, "& ©"), (3, "x\nThis work is dedicated to the public  domain under CC0-1.0"), (4, "nothing")], "doc_id long, text string")
    assert [r.license_id for r in licenses.scan(df, [("FREE", "do as you please")]).orderBy("doc_id").collect()] == ["FREE", None, None, None]
    assert [r.license_id for r in licenses.scan(df, [("AND", "and copyright")]).orderBy("doc_id").collect()] == [None, "AND", None, None]
    assert [r.notice_ids for r in licenses.scan(df).orderBy("doc_id").collect()] == ["", "", "CC0-1.0", ""]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t * 3, k, "s", len(t)) for i, t, k in texts(60, 4)]
    long = " ".join(random.Random(1).choice(WORDS["bb"]) + str(i) for i in range(80))
    item = "a benchmark question that nobody should ever train on, with numbers 17 and 23"
    rows += [(100, long, "bb", "s", 1), (101, long + " end", "bb", "s", 1), (102, "!!! 123", "bb", "s", 1), (103, long[::-1] + " " + item, "bb", "s", 1), (104, "the quick brown fox mails a@b.org over the lazy dog", "bb", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == names
            path = str(tmp_path / f"out{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert (102 in ids) is False
            if k >= 1:
                assert 100 in ids and 101 not in ids
            assert (103 in ids) == (k < 2)
    final = {r.doc_id: r for r in docs.collect()}
    assert 104 in final and set(final) == ids
    run = {r.doc_id: tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert run == {i: tuple(r) for i, r in final.items()}
