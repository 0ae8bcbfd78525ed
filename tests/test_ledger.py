"""Answer parsing corner cases, cost, settings hash."""
import hashlib
import json

from pyspark.sql import functions as F

from augeval.operators import ledger


def log_of(spark, texts):
    return spark.createDataFrame([(f"r{i}", i, t) for i, t in enumerate(texts)], "custom_id string, seq long, text string")


def test_parse_pairs(spark):
    texts = ['```json\n[{"smiles": "a", "tg_celsius": 1.5}, {"smiles": "b", "tg_celsius": "7"}]\n```',
             '[{"smiles": "c", "tg_celsius": 2}, 7, "x"]', 'no json here', '[1, 2] trailing [3]',
             '[{"smiles": "d"}]']
    out = {(r["seq"], r["item"]): (r["smiles"], r["tg_celsius"]) for r in ledger.parse_pairs(log_of(spark, texts)).collect()}
    assert out == {(0, 0): ("a", 1.5), (0, 1): ("b", 7.0), (1, 0): ("c", 2.0), (4, 0): ("d", None)}
    valid = [r[0] for r in log_of(spark, texts).select(ledger.pair_validity(None)).collect()]
    assert valid == [True, True, False, False, True]


def test_parse_labels(spark):
    texts = ['{"smiles": "a", "tg_celsius": 12}', '{"smiles": "C\\C", "tg_celsius": -3.5}',
             'prose only', '{"smiles": "a", "tg_celsius": 1}, {"smiles": "b", "tg_celsius": 2}']
    out = {r["seq"]: (r["echoed_smiles"], r["tg_celsius"]) for r in ledger.parse_labels(log_of(spark, texts)).collect()}
    assert out[0] == ("a", 12.0)
    assert out[1] == (None, -3.5)        # malformed JSON: number by pattern
    assert out[2] == (None, None)
    assert out[3] == (None, 1.0)         # two objects are not one JSON value


def test_token_cost(spark):
    df = spark.createDataFrame([(1000000, 0, True), (0, 1000000, False), (123, 456, True)], "i long, o long, b boolean")
    got = [r[0] for r in df.select(ledger.token_cost("i", "o", "b")).collect()]
    assert got == [1.0, 10.0, (123 * 2 + 456 * 10) / 1e6 * 0.5]


def test_settings_hash_matches_python(spark):
    settings = {"seed": 42, "arm": "real", "patience": 3, "n_real": 500}
    expected = hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:12]
    df = spark.createDataFrame([(42, "real", 3, 500)], "seed int, arm string, patience int, n_real int")
    got = df.select(ledger.settings_hash({"seed": ledger.json_int("seed"), "arm": ledger.json_text("arm"),
                                          "patience": ledger.json_int("patience"),
                                          "n_real": ledger.json_int("n_real")})).first()[0]
    assert got == expected


def test_running_sum_matches_window(spark):
    from pyspark.sql import Window
    df = spark.range(5000).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("v"))
    a = ledger.running_sum(df, "seq", "v", "cum")
    b = df.withColumn("cum2", F.sum("v").over(Window.orderBy("seq")))
    assert a.join(b, "seq").filter(F.col("cum") != F.col("cum2")).count() == 0


def test_json_values_as_python_writes_them(spark):
    import json

    from augeval.operators.ledger import json_float, json_text
    texts = ["plain", "é漢😀", 'a"b\\c', "line\nbreak\ttab\r\b\f\x01\x7f", "", "\u2028"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(json_text("t")).collect()
    assert [r[0] for r in got] == [json.dumps(t) for t in texts]
    nums = [3e-05, 0.0001, 1.5, -2.0, 0.0, -0.0, 123456789.125, 1e15, 1e16, 1.25e+22, 1e-300, 0.1, 100.0, 9999999.0, 12345678.9, 5e-324]
    got = spark.createDataFrame([(x,) for x in nums], "x double").select(json_float("x")).collect()
    assert [r[0] for r in got] == [json.dumps(x) for x in nums]


def test_running_sums_over_all_levels_of_ranges(spark):
    import random
    r = random.Random(1)
    keys = sorted({r.choice([1, 1 << 20, 1 << 40, (1 << 62) - 5, -(1 << 50)]) + r.randrange(200_000) for _ in range(800)})
    rows = [(k, r.randrange(9), r.randrange(9), "x") for k in keys]
    d = spark.createDataFrame(rows, "seq long, a long, b long, _other string").repartition(3)
    got = ledger.running_sums(d, "seq", {"a": "cum_a", "b": "cum_b"}).orderBy("seq").collect()
    a = b = 0
    for row, (k, x, y, _) in zip(got, rows, strict=True):
        a, b = a + x, b + y
        assert (row.seq, row.cum_a, row.cum_b, row._other) == (k, a, b, "x")


def test_two_spellings_of_an_entity_are_seen_once(spark):
    rows = [(1, "a b c", 10.0), (2, "B  C a", 20.0), (3, "c b a", 30.0), (3, "x", 900.0), (4, "x", 5.0), (5, None, 5.0), (6, "y z", None), (7, "Y Z", 1.0)]
    pairs = spark.createDataFrame(rows, "seq long, smiles string, tg_celsius double")
    clean = ledger.clean_pairs(pairs, 0.0, 500.0)
    assert sorted(r["first"] for r in ledger.first_requests(clean).collect()) == [1, 4, 7]
    requests = spark.range(10).select(F.col("id").alias("seq"))
    rounds = {r["round"]: (r.n_requests, r.n_new) for r in ledger.yield_by_round(requests, clean, 5).collect()}
    assert rounds == {0: (5, 2), 1: (5, 1)}
    curve = ledger.yield_curve(requests, clean, pairs).orderBy("seq").collect()
    assert [r.cum_distinct for r in curve] == [0, 1, 1, 1, 2, 2, 2, 3, 3, 3] and curve[-1].cum_items == len(rows)
