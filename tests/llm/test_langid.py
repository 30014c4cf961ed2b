import math

import numpy as np
from pyspark.sql import functions as F

from sievework.llm import langid
from sievework.llm.common import remainder

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = langid.op2_word_first_backoff(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    row = found.agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert row.n > 100 and row.a > 0.97 and 0 <= row.low <= row.high <= 1


def test_odd_rows(spark, documents):
    rows = [(i, "the cat and the dog sat there", "en") for i in range(20)] + [(i, "der Hund und die Katze sitzen", "de") for i in range(20, 40)]
    model = langid.fit(langid.training_rows(documents(rows)))
    odd = documents([(1, None), (2, ""), (3, "123 !!! 456"), (4, "Katzen und Hunde " * 5000), (None, "dogs and cats"), (4, "the dog"), (5, "² ½ Ⅷ")])
    got = langid.predict(odd, model, keep=odd.columns)
    assert sorted((str(r.doc_id), r.lang_pred) for r in got.collect()) == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "de"), ("4", "en"), ("5", "und"), ("None", "en")]
    assert set(odd.columns) <= set(got.columns)


def test_without_labels_or_rows(spark, documents):
    df = documents([(1, "some text", None)])
    model = langid.fit(langid.training_rows(df))
    assert [(r.lang_pred, r.score) for r in langid.predict(df, model).collect()] == [("und", 0.0)]
    assert langid.predict(df.limit(0), model).count() == 0


def test_remainder_is_that_of_zlib(spark):
    import zlib

    df = spark.range(50).select("id", remainder(F.col("id"), 4).alias("r"))
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 for r in df.collect())


def test_score_by_hand(spark, documents):
    rows = [(1, "red red red blue", "en"), (2, "rot rot blau blau", "de"), (3, "red rot", "en")]
    model = langid.fit(documents(rows).select("doc_id", "text", "lang"))
    words, grams = model.words.split("\n"), model.grams.split("\n")
    assert set(words) == {"red", "rot", "blau"}
    n = {"red": (0, 4), "rot": (2, 1), "blau": (2, 0)}
    totals = {"de": 4, "en": 6}

    def word(w):
        return [math.log(((n[w][i] if n[w][i] > 1 else 0) + 0.05) / (totals[lang] + 0.05 * len(words))) for i, lang in enumerate(("de", "en"))]

    got = langid.Scorer(langid.Model(*model.parts()))
    assert np.allclose(got.total(["red", "rot"])[0], np.add(word("red"), word("rot")))
    # Of an unseen word the longest known n-gram at each place counts, the floor where there is none.
    place = {g: model.gram_logs[i] for i, g in enumerate(grams)}
    marked, expected = "^rodx$", []
    for at in range(len(marked)):
        expected.append(next((place[marked[at:end]] for end in range(min(at + 4, len(marked)), at, -1) if marked[at:end] in place), model.floor))
    assert np.allclose(got.total(["rodx"])[0], np.mean(expected, axis=0))
    total, count = got.total(["red²rot½", "¼", "red"])
    assert count == 3 and np.allclose(total, np.add(np.add(word("red"), word("red")), word("rot")))
    found = langid.predict(documents([(7, "red ROT rodx!")]), model).collect()[0]
    total = np.add(np.add(word("red"), word("rot")), np.mean(expected, axis=0))
    best = total.max()
    assert found.lang_pred == model.langs[int(total.argmax())] and abs(found.score - 1 / np.exp((total - best) / math.sqrt(3)).sum()) < 1e-9


def test_clashing_columns_stay(spark, documents):
    rows = documents([(1, "the cat", "en"), (2, "der Hund", "de")]).withColumn("score", F.lit("mine")).withColumn("lang_pred", F.lit("mine"))
    got = langid.predict(rows, langid.fit(langid.training_rows(rows)), keep=rows.columns).collect()
    assert {(r.score, r.lang_pred) for r in got} == {("mine", "mine")} and {r._lang_pred for r in got} <= {"de", "en"}
