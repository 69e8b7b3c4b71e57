import corpus_pipeline
from upshot.llm import decontaminate as D

from .conftest import prose

ITEMS = [(0, "When the shop opens Tom has 12 apples and Anna gives him 5 kg more, so how many apples does Tom carry home then"),
         (1, "When the shop opens Tom has 99 apples and Anna gives him 7 kg more, so how many apples does Tom carry home then"),
         (2, prose(70, 40)), (3, None), (4, ""), (5, "two words"), (6, "just six words in this item"), (7, "1 2 3 4 5 6 7 8 9 10 11 12")]
DOCS = [(0, prose(1, 30) + " " + ITEMS[0][1] + " " + prose(2, 30)),
        (1, prose(3, 30) + ". When the shop opens Max has 44 apples and Lena gives him 3 km more, so how many apples does Max carry home then. ok"),
        (2, "When the shop opens Max has 44 apples and Lena gives him 3 kg more, so how many apples does Bob carry home then"),
        (3, prose(4, 50) + "\n" + ITEMS[2][1] + "\n" + prose(5, 9)), (4, prose(6, 300)), (5, None), (6, ""), (7, "1 2 3 4 5 6 7 8 9 10 11 12"),
        (8, "here are just six words in this item indeed"), (9, " ".join(ITEMS[2][1].split()[:9]) + " " + prose(8, 40)), (None, ITEMS[2][1]),
        (3, prose(4, 50) + "\n" + ITEMS[2][1] + "\n" + prose(5, 9)), (11, "two words"), (12, "the " * 4000 + ITEMS[2][1])]


def frames(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in DOCS], "doc_id long, text string, item string, pos int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_templates_catch_other_values(spark):
    docs, items = frames(spark)
    got = {(r["doc_id"], r["item_id"]): r for r in D.matches(docs, items).collect()}
    # 2 breaks off a third of item 0's template by its last name, but the rest is consistent on its own only with Tom = Max
    assert set(got) == {(0, 0), (1, 0), (3, 2), (8, 6), (12, 2), (None, 2)}
    assert got[0, 0]["same_values"] and not got[1, 0]["same_values"] and got[0, 0]["n_items"] == 2
    assert got[3, 2]["share"] == 1.0


def test_slots(spark):
    text = "Then Anna bought 3.5 kg of rice. Rice is 7 dollars, Bob Smith says kg"
    row = spark.createDataFrame([(text,)], "text string").select(D.tokens_of("text").alias("t")) if False else None
    from pyspark.sql import functions as F
    row = spark.createDataFrame([(text,)], "text string").select(D.tokens_of(F.col("text")).alias("t")).select("t", D.canonical(F.col("t")).alias("c")).first()
    assert row["c"] == ["then", D.NAME, "bought", D.NUMBER, D.UNIT, "of", "rice", "rice", "is", D.NUMBER, D.UNIT, D.NAME, D.NAME, "says", "kg"]


def test_shuffle_join_gives_the_same(spark, monkeypatch):
    docs, items = frames(spark)
    want = sorted(map(tuple, D.matches(docs, items).collect()), key=str)
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, D.matches(docs, items).collect()), key=str) == want


def test_clean_documents_stay(spark, tricky, no_rows):
    docs, items = frames(spark)
    assert sorted((r["doc_id"] for r in D.decontaminate(docs, items).collect()), key=str) == sorted([2, 4, 5, 6, 7, 9, 11], key=str)
    assert D.decontaminate(tricky, items).count() == tricky.count()
    assert D.matches(no_rows, items).count() == 0 and D.decontaminate(no_rows, items).columns == no_rows.columns
    assert D.matches(docs, items.where("1 = 0")).count() == 0


def test_a_stricter_sibling_does_not_hide_a_looser_one(spark):
    ask = "Your box holds %d red balls and my box holds %d blue balls so how many balls do both boxes hold"
    items = spark.createDataFrame([(0, ask % (3, 3)), (1, ask % (3, 5)), (2, ask % (8, 9))], "item_id long, text string")
    docs = spark.createDataFrame([(k, prose(k, 20) + ". " + ask % v) for k, v in enumerate([(3, 5), (4, 4), (6, 7)])], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_items"], r["share"], r["same_values"]) for r in D.matches(docs, items).collect()}
    # two equal numbers fill both templates, two different ones only the looser
    assert got == {(0, 1): (2, 1.0, True), (1, 0): (1, 1.0, False), (1, 1): (2, 1.0, False), (2, 1): (2, 1.0, False)}


def test_verbatim_copies_of_items_of_mostly_slots(spark, tmp_path, monkeypatch):
    sums = "Compute 12 + 7 * 31 - 5 / 2 + 18 * 44 - 9 + 63"
    names = "The guests were Anna, Boris, Clara, David, Emil, Frida, Gustav, Hanna, Igor and Jana"
    half = "Each morning the old baker on our street counts the loaves that were left over 31 4 51 6 71 8 91 10 11 12 13 14 15 16 17"
    items = spark.createDataFrame([ITEMS[7], (20, sums), (21, names), (22, sums.replace("63", "64")), (23, half), (24, "7 8 9 10 11")], "item_id long, text string")
    texts = [ITEMS[7][1], prose(1, 20) + ". " + sums + ". " + prose(2, 9), prose(3, 20) + ". " + names, "Compute 1 + 2 * 3 - 4 / 5 + 6 * 8 - 10 + 11",
             names.replace("Clara", "Chloe").replace("Emil", "Ernst").replace("Hanna", "Heidi"), half, prose(5, 40), prose(6, 9) + " 7 8 9 10 11 " + prose(7, 9),
             "2 3 4 5 6 7 8 1 9 10 11"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(0, 7), (0, 24), (1, 20), (1, 22), (2, 21), (5, 23), (7, 24)}
    got = {(r["doc_id"], r["item_id"]): r for r in D.matches(docs, items, verbatim=True).collect()}
    assert set(got) == want and all(got[k]["same_values"] for k in want)
    assert got[0, 7]["share"] == got[1, 20]["share"] == got[2, 21]["share"] == got[5, 23]["share"] == 1.0 > got[1, 22]["share"]
    assert [r["doc_id"] for r in D.decontaminate(docs, items, verbatim=True).orderBy("doc_id").collect()] == [3, 4, 6, 8]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r["doc_id"], r["item_id"]) for r in D.op6(spark, str(tmp_path)).collect()} == want
    assert corpus_pipeline.remove_benchmark(spark, docs, str(tmp_path)).count() == 4
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert {(r["doc_id"], r["item_id"]) for r in D.matches(docs, items, verbatim=True).collect()} == want


def test_equal_values_count_beside_slots_that_do_not_fit(spark):
    numbers = "5 9 2 7 4 8 1 6 3 0 12 13 14 15 16 17"
    text = "Our tall neighbour bought 5 green apples today while we sold 5 %s pears to them" % numbers
    items = spark.createDataFrame([(0, text)], "item_id long, text string")
    docs = spark.createDataFrame([(0, text.replace("bought 5", "bought 6")), (1, numbers), (2, text)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in D.matches(docs, items, verbatim=True).collect()}
    assert set(got) == {0, 1, 2} and got[2]["share"] == 1.0 and got[1]["n_tokens"] == 16


def test_a_shared_preface_tells_nothing_but_full_copies_are_found(spark):
    preface = "Read the following short passage with care and then answer the one question that follows it"
    items = [(k, f"{preface} {prose(500 + k, 14)}") for k in range(40)]
    docs = [(k, f"{prose(900 + k, 12)} {preface} {prose(950 + k, 12)}") for k in range(40)]
    docs += [(100 + k, prose(700 + k, 9) + " " + items[k][1]) for k in range(0, 40, 7)] + [(200, items[3][1].replace(preface, "")), (201, preface)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    # one item is the preface alone: it has no window of its own, and all of its windows count
    for extra, more in (([], set()), ([(99, preface)], {(d, 99) for d, t in docs if preface in t})):
        got = {(r["doc_id"], r["item_id"]): r["share"] for r in D.matches(frame, spark.createDataFrame(items + extra, "item_id long, text string"), verbatim=True).collect()}
        assert set(got) == {(100 + k, k) for k in range(0, 40, 7)} | {(200, 3)} | more
        assert all(got[100 + k, k] == 1.0 for k in range(0, 40, 7))


def test_sql_states_the_registered_rule(spark, tmp_path):
    """Slot-only windows, siblings, shared prefaces, null and repeated ids, in both engines."""
    import duckdb
    sums = "Compute 12 + 7 * 31 - 5 / 2 + 18 * 44 - 9 + 63"
    names = "The guests were Anna, Boris, Clara, David, Emil, Frida, Gustav, Hanna, Igor and Jana"
    ask = "Your box holds %d red balls and my box holds %d blue balls so how many balls do both boxes hold"
    numbers = "5 9 2 7 4 8 1 6 3 0 12 13 14 15 16 17"
    sold = "Our tall neighbour bought 5 green apples today while we sold 5 %s pears to them" % numbers
    preface = "Read the following short passage with care and then answer"
    items = [*ITEMS, (20, sums), (21, names), (22, sums.replace("63", "64")), (24, "7 8 9 10 11"), (25, sold)]
    items += [(30 + k, ask % v) for k, v in enumerate([(3, 3), (3, 5), (8, 9)])] + [(50 + k, f"{preface} {prose(500 + k, 12)}") for k in range(12)] + [(None, prose(70, 40))]
    texts = [sums, prose(1, 9) + ". " + names, numbers, sold, sold.replace("bought 5", "bought 6"), "Compute 1 + 2 * 3 - 4 / 5 + 6 * 8 - 10 + 11", preface, preface + " " + prose(503, 12)]
    texts += [ask % v for v in [(3, 5), (4, 4), (6, 7)]] + [names.replace("Clara", "Chloe")]
    docs = [*DOCS, *((20 + k, t) for k, t in enumerate(texts)), (None, sums), (20, prose(70, 40))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = D.op6(spark, str(tmp_path))
    want = con.execute(D.SQL)
    cols = [c[0] for c in want.description]
    rows = sorted(want.fetchall(), key=str)
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == rows and len(rows) > 20


def test_helper_columns_may_exist(spark):
    docs, items = frames(spark)
    wide = docs.selectExpr("*", "1 key_0", "2 other_0", "3 a", "4 b", "5 _hit")
    assert D.decontaminate(wide, items).columns == wide.columns and D.decontaminate(wide, items).count() == 7
