import hashlib

import public_tokenizers as P
import regex

from metrolith.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "hello  world\n\n x", "naïve çédille ñandú ß 😀​", "a" * 9000, ("word " * 3000).strip(), "tab\t and   spaces   \r\n end ", "it's we'll 12345 !!!??", "x" * 5000 + " " + "y\n" * 4000]


def test_parts_encode_like_the_whole():
    enc = bpe.encoder(bpe.ranks(RANKS), P.PATTERN)
    for t in TEXTS:
        t = t or ""
        assert "".join(bpe.safe_parts(t, 50)) == t
        assert [i for p in bpe.safe_parts(t, 50) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)


def test_long_runs_encode_like_the_pattern_s_matches(spark):
    enc = bpe.encoder(bpe.ranks(RANKS), P.PATTERN)
    runs = ["a" + " " * 1_000_000 + "b", "\n" * 300_000, "x y " + "\u3000 \t" * 9000 + "!?", " " * 8192 + "\x1cz" + "\r\n" * 5000 + "  q", "b" * 400_000]
    for t in runs:
        want = [i for piece in regex.findall(P.PATTERN, t) for i in enc._encode_single_piece(piece)]
        assert bpe.encode(t, enc) == want
    df = spark.createDataFrame([(0, runs[0])], "doc_id long, text string")
    (r,) = bpe.digest_documents(df, RANKS).collect()
    assert r.decoded_sha256 == hashlib.sha256(runs[0].encode()).hexdigest() and r.n_tokens == len(bpe.encode(runs[0], enc))


def test_digests_and_round_trip(spark):
    df = spark.createDataFrame([(i if i != 2 else None, t, "n") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "n")], "doc_id long, text string, n_tokens string")
    enc = bpe.encoder(bpe.ranks(RANKS), P.PATTERN)
    want = []
    for i, t in [*enumerate(TEXTS), (3, TEXTS[3])]:
        ids = enc.encode_ordinary(t or "")
        want.append((i if i != 2 else None, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digest_documents(df, RANKS).collect()), key=str) == sorted(want, key=str)
    back = bpe.decode_documents(bpe.encode_documents(df, RANKS), RANKS).collect()
    assert all(bytes(r.bytes).decode() == (r.text or "") for r in back)
    assert bpe.digest_documents(df.limit(0), RANKS).count() == 0
