import random

from pyspark.sql import functions as F

from sievework.llm import decontaminate as dc


def test_substitutions_are_tolerated_and_clean_texts_left(spark, documents):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    item = [rng.choice(words) for _ in range(30)]
    changed = [w if i % 9 != 4 else "other" for i, w in enumerate(item)]
    clean = [[rng.choice(words) for _ in range(80)] for _ in range(20)]
    rows = [(i, " ".join(c)) for i, c in enumerate(clean)]
    rows += [(50, "Before, " + " ".join(item).upper() + "! after"), (51, " ".join(clean[0] + changed + clean[1])), (52, None), (53, ""), (54, " ".join(item)), (54, " ".join(item))]
    bench = spark.createDataFrame([(7, " ".join(item), "x"), (7, " ".join(item), "y"), (8, "too short", "x"), (9, None, "x"), (10, "", "x")], "item_id long, text string, doc_id string")
    for few in (2_000_000, 0):
        got = dc.contaminated_pairs(documents(rows), bench, broadcast_rows=few).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == [(50, 7), (51, 7), (54, 7)]
    kept = dc.decontaminate(documents(rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(20), 52, 53]
    assert dc.contaminated_pairs(documents(rows), bench.limit(0)).count() == 0 and dc.contaminated_pairs(documents(rows).limit(0), bench).count() == 0


def test_long_items_are_cut(spark, documents):
    rng = random.Random(6)
    item = [f"t{rng.randrange(2000)}" for _ in range(900)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = dc.contaminated_pairs(documents([(1, " ".join(item[700:760])), (2, "nothing of it " * 30)]), bench).collect()
    assert [(r.doc_id, r.score) for r in got] == [(1, 60)]


def test_short_items_are_found(spark, documents):
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in (1, 2, 3, 5, 7, 8)}
    around = lambda words: "before it " + " ".join(words) + " and after"
    swap = lambda words, k: [*words[:k], "other", *words[k + 1 :]]
    rows = [(n, around(w)) for n, w in items.items()] + [(10, " ".join(items[3]))]
    rows += [(100 * n + k, around(swap(items[n], k))) for n in (5, 7, 8) for k in range(n)]
    rows += [(901, around(items[5][:3])), (902, around(items[2][:1])), (903, None), (904, "")]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")

    def best(a, b):
        return max(sum(1 if x == y else -1 for x, y in zip(a[i:j], b[i:j])) for i in range(len(a)) for j in range(i + 1, len(a) + 1))

    # All copies, and all with one token replaced whose best run reaches three fifths of the item.
    want = [(n, n) for n in items] + [(10, 3)] + [(100 * n + k, n) for n in (5, 7, 8) for k in range(n) if best(items[n], swap(items[n], k)) * 5 >= n * 3]
    for few in (2_000_000, 0):
        got = dc.contaminated_pairs(documents(rows), bench, broadcast_rows=few).collect()
        assert sorted((r.doc_id, r.item_id) for r in got if r.doc_id != 901) == sorted(want)


def test_a_clashing_column_stays(spark, documents):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    df = documents([(1, "so one two three four five six seven eight nine ten eleven twelve thirteen it is"), (2, "nothing of that kind")]).withColumn("bad_id", F.lit(1))
    kept = dc.decontaminate(df, bench).collect()
    assert [(r.doc_id, r.bad_id) for r in kept] == [(2, 1)]


def test_ids_that_repeat_or_are_null(spark, documents):
    """A leak costs no other text of its id; hits don't depend on the order of rows."""
    item = [f"q{i}" for i in range(20)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = [(None, "so " + " ".join(item)), (None, "a clean text"), (3, "fine"), (1, " ".join(item)), (1, " ".join(item[:9]) + " and so on"), (1, "clean too"), (None, None), (4, " ".join(item[:9]))]
    for some in (rows, rows[::-1]):
        for few in (2_000_000, 0):
            got = dc.contaminated_pairs(documents(some), bench, broadcast_rows=few).collect()
            assert sorted((str(r.doc_id), r.item_id, r.score) for r in got) == [("1", 1, 20), ("None", 1, 20)]
        kept = dc.decontaminate(documents(some), bench).collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(d), str(t)) for d, t in rows if not t or " ".join(item) not in t)


def test_a_hit_may_lie_across_stretches(spark, documents):
    item = [f"q{i}" for i in range(14)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = [(n, " ".join(["other"] * n + item + ["more"] * (n % 7))) for n in range(100, 290)]
    assert dc.contaminated_pairs(documents(rows), bench).filter("score = 14").count() == len(rows)
