from pyspark.sql import functions as F

from sievework.llm import toxicity

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op7_noisy_or(spark, DATA).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    better = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert better > 0.85 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_sentences_are_located(spark, documents):
    bad, good = "You are an awful fool. ", "The sky is blue today. Rain may come. "
    rows = [(i, good * 3 + (bad if i % 3 == 0 else "") + good) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(1, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(documents(rows), labels)
    odd = documents([(1, good + bad + good), (2, good * 400), (3, None), (4, ""), (None, bad), (1, good + bad + good)])
    got = toxicity.score_documents(odd, model).collect()
    found = next(r for r in got if r.doc_id == 1)
    assert found.score >= 0.5 and (good + bad + good)[found.offending[0].start : found.offending[0].end].strip() == "You are an awful fool"
    assert next(r for r in got if r.doc_id == 2).score < 0.5 and [r.score for r in got if r.doc_id in (3, 4)] == [0.0, 0.0] and len(got) == 6


def test_one_kind_of_label(spark, documents):
    df = documents([(1, "a b c")])
    model = toxicity.fit(df, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert toxicity.score_documents(df, model).collect()[0].score == 0.0
    assert toxicity.score_documents(df.limit(0), model).count() == 0


def test_noisy_or_by_hand(spark, documents):
    import math
    import re

    model = {"bias": -2.0, "weights": {"awful": 3.0, "awf*": 0.5, "fool": 1.5, "blue": -1.0}}
    texts = ["You awful fool! The sky is blue. Awfully nice.", "blue\nblue blue? fool", "7 8 9", "nothing here. or here"]
    for r in toxicity.score_documents(documents(list(enumerate(texts))), model).collect():
        none = 1.0
        for sentence in re.split(r"[.!?\n]", texts[r.doc_id].lower()):
            words = set(re.findall(r"[a-z]+", sentence))
            if words:
                z = -2.0 + sum(model["weights"].get(f, 0) for w in words for f in [w, *(w[:n] + "*" for n in range(3, min(10, len(w) - 1) + 1))])
                none *= 1 - 1 / (1 + math.exp(-z))
        assert abs(r.score - (1 - none)) < 1e-9


def test_clashing_columns_stay(spark, documents):
    df = documents([(1, "a b")]).withColumn("score", F.lit("mine")).withColumn("offending", F.lit("mine"))
    got = toxicity.score_documents(df, {"bias": 0.0, "weights": {}}, keep=df.columns).collect()[0]
    assert got.score == got.offending == "mine" and got._score == 0.5
