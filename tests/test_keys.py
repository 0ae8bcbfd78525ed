"""Identity keys: the reference's key cases as token sequences, plus properties of the cycle key."""
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from augeval.functions.keys import add_cycle_key, entity_id, exact_key, numeric_or_null


def keys_of(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    df = df.withColumn("exact_key", exact_key("raw"))
    df = add_cycle_key(df).withColumn("entity_id", entity_id("exact_key", "alt_key"))
    return {r["raw"]: (r["exact_key"], r["alt_key"], r["entity_id"]) for r in df.collect()}


def brute_cycle(tokens):
    if len(tokens) < 3:
        return None
    rots = [tokens[i:] + tokens[:i] for i in range(len(tokens))]
    rev = tokens[::-1]
    rots += [rev[i:] + rev[:i] for i in range(len(rev))]
    return min(" ".join(r) for r in rots)


def test_cuts_match(spark):
    k = keys_of(spark, ["c c o", "c o c", "o c c", "O  C C"])
    alts = {v[1] for v in k.values()}
    assert len(alts) == 1 and None not in alts
    assert len({v[2] for v in k.values()}) == 1          # one entity, either key


def test_no_alt_key_cases(spark):
    k = keys_of(spark, ["c c", "c", "c c o . o", ""])
    assert k["c c"][1] is None            # two tokens: one cut only
    assert k["c"][1] is None              # one token
    assert k["c c o . o"][1] is None      # several fragments
    assert k[""][0] is None               # empty spelling has no key


def test_doubled_unit_not_matched(spark):
    k = keys_of(spark, ["c c o c c o", "c c o"])
    assert k["c c o c c o"][1] != k["c c o"][1]


def test_entity_prefixes_keep_name_spaces_apart(spark):
    k = keys_of(spark, ["a b", "a b c"])
    assert k["a b"][2].startswith("E:") and k["a b c"][2].startswith("R:")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d#1", "ee"]), min_size=1, max_size=6))
def test_cycle_key_matches_brute_force(spark, tokens):
    text = " ".join(tokens)
    variants = [" ".join(tokens[i:] + tokens[:i]) for i in range(len(tokens))] + [" ".join(tokens[::-1])]
    k = keys_of(spark, variants)
    expected = brute_cycle(tokens)
    assert {v[1] for v in k.values()} == {expected}
    assert k[text][1] == expected


def test_numeric_or_null(spark):
    rows = [("12.5",), (" -3 ",), ("1e3",), ("n/a",), ("1d",), ("nan",), ("",), (None,), (".5",)]
    df = spark.createDataFrame(rows, "t string").select("t", numeric_or_null("t").alias("v"))
    got = {r["t"]: r["v"] for r in df.collect()}
    assert got["12.5"] == 12.5 and got[" -3 "] == -3.0 and got["1e3"] == 1000.0 and got[".5"] == 0.5
    assert got["n/a"] is None and got["1d"] is None and got["nan"] is None and got[""] is None and got[None] is None


def test_long_cycle_takes_linear_time(spark):
    import random
    import time
    r = random.Random(2)
    key = {}
    for n in (2_500, 20_000):
        tokens = [r.choice("ab") for _ in range(n)]
        tokens[n // 2:] = tokens[:n - n // 2]                       # long equal stretches
        turned = tokens[n // 3:] + tokens[:n // 3]
        t0 = time.time()
        k = keys_of(spark, [" ".join(tokens), " ".join(turned[::-1])])
        key[n] = (time.time() - t0, {v[1] for v in k.values()})
        assert len(key[n][1]) == 1
    assert key[2_500][1] == {brute_cycle(key[2_500][1].copy().pop().split(" "))}
    assert key[20_000][0] < 8 * 4 * max(key[2_500][0], 0.5)         # quadratic would be 64 times


@pytest.mark.parametrize("name", ["validity_gate", "cycle_key", "entity_id"])
def test_a_filter_on_keys_is_not_rewritten_into_the_spelling(spark, sf, name):
    from augeval.plans.registry import QUERIES, load_all
    load_all()
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if ("Filter" in x or "Join" in x) and "slice(" in x]   # before: made several times for each row


def test_keys_are_made_where_the_row_is_read(spark, sf, monkeypatch):
    from augeval.plans import stages
    written = []
    monkeypatch.setattr(stages, "_KEYED", {})
    plain = stages.cut_lineage
    monkeypatch.setattr(stages, "cut_lineage", lambda df, name: written.append(name) or plain(df, name))
    o = stages.obs_keyed(spark, sf)
    assert written == ["obs-keyed"]   # before: the spellings apart, then joined to all rows
    assert o.where("exact_key is not null and entity_id is null").isEmpty() and o.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
