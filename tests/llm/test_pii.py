import hashlib
import math
import re

from metrolith.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(x):
    return re.sub("[^0-9]", "", x)


def luhn(d):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


TEXTS = [
    None, "", "no data", "a@b.c a@b.co_x@y.zz a.b@c @d.e f@g", "x@y.z.w.", "😀 é mail me: é.jo@mail.example.org!", "1.2.3.4 256.1.1.1 001.002.003.004 1.2.3.4.5.6.7.8 999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 0000 0000 0000", "+1 (319) 555-5132 +12345 +44 20 7946 0958 0001 99 + 1 23", "+1.2.3.4.5.6.7.8.9.0.1 call +1-202-555-0143@x.org",
    "9" * 20000, "a" * 20000, "a." * 9000 + "@", "1 " * 9000, "+" * 3000 + "1" * 3000, "-12 34- 5", "4111  1111", "1.1.1.1@2.2.2.2",
]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, "s", 3) for i, t in enumerate(TEXTS)] + [(None, "a@b.c", "s", 1), (1, "", "s", 1)], "doc_id long, text string, spans string, key int")
    got = {(r.doc_id): r for r in pii.find(df).collect()}
    assert pii.find(df).count() == len(TEXTS) + 2
    for i, t in enumerate(TEXTS):
        s = spans(t)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (i, text, got[i].spans)
        assert got[i].spans == text
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[3] == k for x in s) for k in ("email", "ip", "card", "phone")]
    assert got[None].n_email == 1


def test_disclosing_terms(spark):
    rows = [(i, f"text {i} from Zorblatt bob@x.com with thanks") for i in range(4)] + [(10 + i, f"thanks with text from nobody {i}") for i in range(40)] + [(90, "Zorblatt is not here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df, 0.8, 3).collect()}
    assert got[0] == "term:12:20,email:21:30" and got[90] == "" and got[11] == ""
    out = {r.doc_id: r.text for r in pii.redact(df, 0.8, 3).collect()}
    assert out[0] == "text 0 from [TERM] [EMAIL] with thanks" and out[90] == rows[-1][1]


def test_redact_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "en", "mail a@b.c, 4111 1111 1111 1111", 31), (2, "en", None, None), (1, "de", "x", 1), (None, "fr", "a@b.c", 5)], "doc_id long, lang string, text string, n_chars long")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, [("Row",)] and [r for r in spark.createDataFrame([(1, "en", "mail [EMAIL], [CARD]", 20), (2, "en", None, None), (1, "de", "x", 1), (None, "fr", "[EMAIL]", 7)], df.schema).collect()]))
    assert pii.redact(df.limit(0)).count() == 0 and pii.find(df.limit(0)).count() == 0


def test_disclosing_terms_of_whole_documents(spark):
    """Rare entities, distant, short and alphanumeric terms, and rows without the entity, against brute force."""
    far = "the text of this " * 6
    rows = [(1, f"Li {far} a@b.org {far} k9_7 李雷"), (1, f"Li {far} a@b.org {far} k9_7 李雷"), (2, "Li is in the text"), (3, "this Bo c@d.org"), (4, "Bo of e@f.org Bo c@d.org"), (None, None)]
    rows += [(10 + i, f"{far} Common{i % 3}") for i in range(60)]
    term, n = re.compile(r"\w+"), len(rows) - 1  # one row is repeated
    masked, ents = {}, {}
    for d, t in dict(rows).items():
        masked[d], ents[d] = t or "", {(k, t[a:b].lower()) for a, _, b, k in spans(t)}
        for a, _, b, _ in spans(t):
            masked[d] = masked[d][:a] + " " * (b - a) + masked[d][b:]
    words = {d: {x.lower() for x in term.findall(t)} for d, t in masked.items()}
    bad = set()
    for e in set().union(*ents.values()):
        we = sum(e in x for x in ents.values())
        for w in set().union(*(words[d] for d in words if e in ents[d])):
            both, wt = sum(e in ents[d] and w in words[d] for d in words), sum(w in x for x in words.values())
            if math.log(both * n / (we * wt)) >= 0.8 * math.log(n / we):
                bad.add(w)
    assert {"li", "k9_7", "李雷", "bo"} <= bad and not {"the", "common1"} & bad
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), support=1, everywhere=True).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = [(m.start(), 4, m.end(), "term") for m in term.finditer(masked[r.doc_id]) if m[0].lower() in bad]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(want + spans(texts[r.doc_id]))), r
    assert [r.spans for r in got if r.doc_id == 2] == ["term:0:2"]


def masked(t, found):
    out = list(t)
    for a, _, b, _ in found:
        out[a:b] = " " * (b - a)
    return "".join(out)


def brute_terms(rows, threshold, support, everywhere):
    """All spans of each row by the formula, with loops over distinct rows."""
    docs = sorted(set(rows), key=str)
    base = {r: spans(r[1]) for r in docs}
    terms = {r: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", masked(r[1] or "", base[r]))] for r in docs}
    has_e = {r: {(k, (r[1] or "")[a:b].lower()) for a, _, b, k in base[r]} for r in docs}
    has_t = {r: {t for *_, t in terms[r]} for r in docs}
    n = len(docs)
    count = lambda held: {x: sum(x in h for h in held.values()) for h in held.values() for x in h}
    of_e, of_t = count(has_e), count(has_t)
    pairs = set()
    for e, ne in of_e.items():
        for t, nt in of_t.items():
            both = sum(e in has_e[r] and t in has_t[r] for r in docs)
            if both >= support and ne < n and math.log(both * n / (ne * nt)) >= threshold * math.log(n / ne) - 1e-12:
                pairs.add((e, t))
    out = []
    for r in rows:
        flags = {t for e, t in pairs if everywhere or e in has_e[r]}
        every = sorted([(a, k, b, x) for a, k, b, x in base[r]] + [(a, 4, b, "term") for a, b, t in terms[r] if t in flags])
        out.append((r[0], ",".join(f"{x}:{a}:{b}" for a, _, b, x in every)))
    return sorted(out, key=str)


def test_terms_equal_loops_over_the_formula(spark):
    import random

    rng = random.Random(3)
    people = [("Ann", "ann@x.org"), ("Bo", "10.0.0.7"), ("Zoë_9", "4111 1111 1111 1111"), ("Wu", "+1 319 555 5132")]
    rows = [(None, "a b"), (3, None), (4, "")]
    for i in range(60):
        w = [rng.choice("the of and to mail call street house river blue".split()) for _ in range(rng.randint(2, 12))]
        for name, data in people:
            if rng.random() < 0.12:
                w += [name, data] if rng.random() < 0.8 else [data]
            elif rng.random() < 0.03:
                w.append(name)
        rng.shuffle(w)
        rows.append((10 + i, " , ".join(w)))
    rows += [rows[20]] * 30  # repeated rows count as one document
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold, support, everywhere in ((0.8, 3, False), (0.6, 1, True)):
        got = sorted(((r.doc_id, r.spans) for r in pii.find(df, threshold, support, everywhere).collect()), key=str)
        assert got == brute_terms(rows, threshold, support, everywhere)
    assert any("term" in s for _, s in got)


def test_texts_of_very_many_spans(spark):
    text = " ".join(f"user{i}@mail{i % 7}.example.org, and 10.0.{i % 256}.{i // 256}" for i in range(4000))
    df = spark.createDataFrame([(1, text, "en"), (2, "nothing here", "en")], "doc_id long, text string, lang string")
    want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans(text))
    (r,) = [r for r in pii.find(df).collect() if r.doc_id == 1]
    assert r.n_email == r.n_ip == 4000 and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    (out,) = [r.text for r in pii.redact(df).collect() if r.doc_id == 1]
    assert out == ", and ".join(["[EMAIL]"] + ["[IP] [EMAIL]"] * 3999) + ", and [IP]"
