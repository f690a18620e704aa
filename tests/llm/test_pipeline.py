"""The five stages on odd rows and on an empty table."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep int, row string, cls long"
WORDS = {"aa": "lorem ipsum dolor sit amet elit sed".split(), "bb": "quick brown fox jumps over lazy dog".split()}
ITEM = "a benchmark question that nobody should ever train on, with numbers 17 and 23"


def rows():
    rng = random.Random(2)
    out = [(i, " ".join(rng.choice(WORDS[k]) + str(rng.randrange(99)) for _ in range(40)), k, "s", 1, 0, "r", i) for i in range(40) for k in [rng.choice(list(WORDS))]]
    long = " ".join(rng.choice(WORDS["bb"]) + str(i) for i in range(80))
    out += [(100, long, "bb", "s", 1, 1, "r", 1)] * 3  # repeated rows: one stays
    out += [(None, long + " end", "bb", "s", 1, 2, None, 2), (101, "a null language " + long[::-1], None, None, None, None, None, None)]
    out += [(102, None, "bb", "s", None, 3, "r", 3), (103, "", "bb", "s", 0, 4, "r", 4), (104, "  \n ", "bb", "s", 0, 5, "r", 5)]
    out += [(105, "see: " + ITEM.upper() + "!", "bb", "s", 1, 6, "r", 6), (None, "lorem ipsum " + ITEM, "aa", "s", 1, 7, "r", 7)]
    out += [(105, "the quick brown fox mails a@b.org over the lazy dog", "bb", "s", 51, 8, "r", 8), (106, "lorem " * 30_000, "aa", "s", 1, 9, "r", 9)]
    return out


def stages(spark, data, folder):
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        seen.append(docs.collect())
    return seen


def test_odd_rows_through_all_stages(spark, tmp_path):
    seen = stages(spark, rows(), str(tmp_path))
    kinds = [sorted(r["keep"] for r in s if r["keep"]) for s in seen[:4]]
    assert kinds[0] == [1, 1, 1, 2, 6, 7, 8, 9]  # texts without letters go
    assert kinds[1] == [1, 6, 7, 8, 9]  # of copies the one of an id stays, once
    assert kinds[2] == [1, 8, 9] and kinds[3] == [1, 8, 9]  # by the row's text, not by its id
    mail = [r for r in seen[3] if r["keep"] == 8][0]
    assert mail.text == "the quick brown fox mails [EMAIL] over the lazy dog" and mail.n_chars == len(mail.text)
    assert len(seen[4]) == len(seen[3]) and all(r.n_tokens > 0 for r in seen[4])
    assert {r.doc_id for r in seen[3]} >= set(range(40)) | {100, 101, 105, 106}


def test_empty_table_through_all_stages(spark, tmp_path):
    assert [len(s) for s in stages(spark, [], str(tmp_path))] == [0] * 5
