"""Registered plans: curation, decontamination, set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from augeval.functions.keys import entity_id, exact_key, numeric_or_null
from augeval.operators import curate, holdout
from augeval.plans import roles, stages
from augeval.plans.oracle_roles import avg_rank_sql, corr_sql, with_roles
from augeval.plans.registry import query

SYNSET = "CASE reliability WHEN 'N' THEN 'generated' ELSE 'labeled' END"


@query("merge_duplicates", with_roles("SELECT flag, entity_id, smiles, value FROM merged", "merged"))
def q_merge_duplicates(spark, sf):
    """A1: one row per (flag, entity) with the smallest spelling and median value."""
    return stages.merged(spark, sf)


@query("holdout_anti", with_roles("""
  SELECT s.synthetic_set, s.entity_id, s.smiles, s.value FROM syn s
  WHERE NOT EXISTS (SELECT 1 FROM real r WHERE r.split IN ('test', 'validation') AND r.entity_id = s.entity_id)
""", "syn", "real"))
def q_holdout_anti(spark, sf):
    """Synthetic entities minus held-out (test, validation) entities on either key."""
    real = stages.real(spark, sf)
    held = real.filter(F.col("split").isin("test", "validation"))
    return holdout.decontaminate(stages.syn(spark, sf), held)


@query("match_type", with_roles("SELECT synthetic_set, entity_id, test_match AS match FROM matched", "matched"))
def q_match_type(spark, sf):
    """Exact / alt / null match of each synthetic entity against the test split."""
    real = stages.real(spark, sf)
    m = holdout.match_type(stages.syn_keyed(spark, sf), real.filter(F.col("split") == "test"))
    return m.select("synthetic_set", "entity_id", "match")


# The funnel's rules: name -> (Spark predicate, SQL predicate).
_RULES = {
    "number": (lambda: F.col("value").isNotNull(), "value IS NOT NULL"),
    "key": (lambda: F.col("exact_key").isNotNull(), "exact_key IS NOT NULL"),
    "markers": (lambda: curate.marker_count("exact_key", "#") <= 1, "length(exact_key) - length(replace(exact_key, '#', '')) <= 1"),
    "fragment": (lambda: ~F.col("exact_key").contains("."), "NOT contains(exact_key, '.')"),
    "range": (lambda: F.col("value").between(roles.RANGE_LO, roles.RANGE_HI), "value BETWEEN 1000.0 AND 100000.0"),
}
_HELD = ["test", "validation"]


def _funnel(spark, sf):
    o = stages.obs_keyed(spark, sf).filter(F.col("reliability").isin("N", "R"))
    o = o.withColumn("synthetic_set", F.when(F.col("reliability") == "N", "generated").otherwise("labeled"))
    return curate.cleaning_funnel(o, [(k, p()) for k, (p, _) in _RULES.items()], _matched(spark, sf), _HELD)


def _matched(spark, sf):
    real = stages.real(spark, sf)
    s = stages.syn_keyed(spark, sf)
    s = holdout.match_type(s, real.filter(F.col("split") == "test"), out="test_match")
    return holdout.match_type(s, real.filter(F.col("split") == "validation"), out="validation_match")


_STEPS = ["raw", *_RULES, "distinct_keys", "distinct_entities", *[x for h in _HELD for x in (f"{h}_exact", f"{h}_alt", f"after_{h}")]]
_FUNNEL_BODY = f"""
  SELECT synthetic_set, o.step_order, u.step, u.n FROM (
    UNPIVOT (SELECT * FROM rows_ JOIN ents USING (synthetic_set)) ON {", ".join(f'"{s}"' for s in _STEPS)} INTO NAME step VALUE n) u
  JOIN (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(_STEPS))}) o(step_order, step) ON o.step = u.step
"""
_PASSED = {k: " AND ".join(f"({q})" for _, q in list(_RULES.values())[:i + 1]) for i, k in enumerate(_RULES)}
_FUNNEL_EXTRA = [
    ("rows_", f"""SELECT {SYNSET} AS synthetic_set, count(*) AS raw,
                   {", ".join(f'count_if({q})::BIGINT AS "{k}"' for k, q in _PASSED.items())},
                   count(DISTINCT CASE WHEN {_PASSED['range']} THEN exact_key END) AS distinct_keys,
                   count(DISTINCT CASE WHEN {_PASSED['range']} THEN entity_id END) AS distinct_entities
                 FROM obs_keyed WHERE reliability IN ('N', 'R') GROUP BY 1"""),
    ("ents", """SELECT synthetic_set, count_if(test_match = 'exact')::BIGINT AS test_exact,
                   count_if(test_match = 'alt')::BIGINT AS test_alt,
                   count_if(test_match IS NULL)::BIGINT AS after_test,
                   count_if(test_match IS NULL AND validation_match = 'exact')::BIGINT AS validation_exact,
                   count_if(test_match IS NULL AND validation_match = 'alt')::BIGINT AS validation_alt,
                   count_if(test_match IS NULL AND validation_match IS NULL)::BIGINT AS after_validation
                 FROM matched GROUP BY synthetic_set""")]
_FUNNEL_SQL = with_roles(_FUNNEL_BODY, "obs_keyed", "matched", extra=_FUNNEL_EXTRA)


@query("cleaning_funnel", _FUNNEL_SQL)
def q_cleaning_funnel(spark, sf):
    """A3: rows after each cleaning rule per synthetic set, one pass with cumulative flags."""
    return _funnel(spark, sf)


@query("funnel_removed", with_roles("""
  SELECT synthetic_set, step_order, step, n, lag(n) OVER (PARTITION BY synthetic_set ORDER BY step_order) - n AS removed
  FROM f WHERE NOT regexp_matches(step, '_(exact|alt)$')
""", "obs_keyed", "matched", extra=_FUNNEL_EXTRA + [("f", _FUNNEL_BODY)]))
def q_funnel_removed(spark, sf):
    """Rows removed by each counting step."""
    return curate.funnel_removed(_funnel(spark, sf))


# ---------------------------------------------------------------- row rules and keys

@query("convert_units", with_roles("""
  SELECT order_key, line_no, value * 1.8 + 32.0 AS value_f, [value * 1.8 + 32.0] AS values_f FROM obs_valid
""", "obs_valid"))
def q_convert_units(spark, sf):
    """Affine unit change on a column and inside an array column."""
    v = stages.obs_valid(spark, sf).select("order_key", "line_no", F.col("value").alias("value_f"),
                                          F.array("value").alias("values_f"))
    return curate.affine(v, ["value_f"], 1.8, 32.0, array_cols=["values_f"])


@query("numeric_or_null", with_roles("""
  SELECT order_key, line_no, value_text, value FROM obs_keyed WHERE value IS NOT NULL
""", "obs_keyed"))
def q_numeric_or_null(spark, sf):
    """Value text to double, non-numeric rows dropped."""
    o = roles.obs(spark, sf).select("order_key", "line_no", "value_text")
    return curate.numeric(o, "value_text", out="value")


@query("validity_gate", with_roles("""
  SELECT order_key, line_no, exact_key FROM obs_keyed WHERE exact_key IS NOT NULL
""", "obs_keyed"))
def q_validity_gate(spark, sf):
    """Rows whose key can be computed."""
    o = roles.obs(spark, sf).select("order_key", "line_no", exact_key("raw_key").alias("exact_key"))
    return curate.valid(o, "exact_key")


@query("marker_count_filter", """
  SELECT doc_id, lang FROM documents WHERE length(text) - length(replace(text, '*', '')) = 0
""")
def q_marker_count_filter(spark, sf):
    """Documents with exactly k (here 0) '*' markers."""
    from augeval.session import load
    return curate.markers(load(spark, sf, "documents"), "text", "*", 0).select("doc_id", "lang")


@query("single_fragment_filter", "SELECT doc_id, n_chars FROM documents WHERE NOT contains(text, '.')")
def q_single_fragment_filter(spark, sf):
    """P5: drop texts made of several '.'-separated fragments."""
    from augeval.session import load
    return curate.single_fragment(load(spark, sf, "documents"), "text").select("doc_id", "n_chars")


@query("range_filter", with_roles("""
  SELECT order_key, line_no, value FROM obs_keyed WHERE value BETWEEN 1000.0 AND 100000.0
""", "obs_keyed"))
def q_range_filter(spark, sf):
    """Inclusive range rule."""
    o = curate.numeric(roles.obs(spark, sf).select("order_key", "line_no", "value_text"), "value_text", "value")
    return curate.between(o, "value", roles.RANGE_LO, roles.RANGE_HI).drop("value_text")


@query("exact_key", with_roles("SELECT DISTINCT raw_key, exact_key FROM obs_keyed", "obs_keyed"))
def q_exact_key(spark, sf):
    """Normal form of each distinct spelling."""
    return roles.obs(spark, sf).select("raw_key").distinct().select("raw_key", exact_key("raw_key").alias("exact_key"))


@query("cycle_key", with_roles("SELECT DISTINCT exact_key, alt_key FROM obs_keyed WHERE exact_key IS NOT NULL",
                               "obs_keyed"))
def q_cycle_key(spark, sf):
    """rotation/reversal-invariant key of each distinct exact key."""
    from augeval.functions.keys import add_cycle_key
    e = roles.obs(spark, sf).select(exact_key("raw_key").alias("exact_key")).where("exact_key IS NOT NULL").distinct()
    return add_cycle_key(e)


@query("entity_id", with_roles("SELECT DISTINCT exact_key, entity_id FROM obs_keyed WHERE exact_key IS NOT NULL",
                               "obs_keyed"))
def q_entity_id(spark, sf):
    """Either-key group id of each distinct exact key."""
    from augeval.functions.keys import add_cycle_key
    e = roles.obs(spark, sf).select(exact_key("raw_key").alias("exact_key")).where("exact_key IS NOT NULL").distinct()
    return add_cycle_key(e).select("exact_key", entity_id("exact_key", "alt_key").alias("entity_id"))


_LIST_SQL = "CASE WHEN line_no % 2 = 0 THEN '[' || value_text || ', ' || CAST(n_points AS VARCHAR) || ']' ELSE value_text END"


@query("parse_list_literal", with_roles(f"""
  SELECT order_key, line_no, list_text,
         coalesce(CASE WHEN starts_with(list_text, '[') THEN TRY_CAST(json(TRY_CAST(list_text AS JSON)) AS DOUBLE[]) END,
                  CASE WHEN value IS NOT NULL THEN [value] END) AS vals
  FROM (SELECT *, {_LIST_SQL} AS list_text FROM obs_keyed)
""", "obs_keyed"))
def q_parse_list_literal(spark, sf):
    """S8: '[a, b]' text to array<double>; a row without a list keeps its single numeric value."""
    o = stages.obs_keyed(spark, sf)
    lt = F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("["), F.col("value_text"), F.lit(", "),
                                                     F.col("n_points").cast("string"), F.lit("]"))).otherwise(F.col("value_text"))
    o = o.withColumn("list_text", lt).withColumn("_one", F.col("value"))
    out = curate.measurements(o, "list_text", "_one", out="vals")
    out = out.withColumn("vals", F.when(F.col("list_text").startswith("[") | F.col("value").isNotNull(), F.col("vals")))
    return out.select("order_key", "line_no", "list_text", "vals")


# ---------------------------------------------------------------- joins on the id (J3-J5, J11) and set ops

@query("memorization", with_roles(f"""
  SELECT g.synthetic_set, g.split, g.match, coalesce(n, 0) AS n, CAST(coalesce(n, 0) AS DOUBLE) * 100.0 / u AS percent_of_unique,
         mae, median_ae, spearman, mean_signed_error FROM (
  SELECT synthetic_set, split, match, count(*) AS n,
         CASE WHEN count(*) >= 3 THEN avg(abs(err)) END AS mae,
         CASE WHEN count(*) >= 3 THEN median(abs(err)) END AS median_ae,
         CASE WHEN count(*) >= 3 THEN {corr_sql('rx', 'ry')} END AS spearman,
         CASE WHEN count(*) >= 3 THEN avg(err) END AS mean_signed_error
  FROM (SELECT *, {avg_rank_sql('value', 'synthetic_set, split, match')} AS rx,
                  {avg_rank_sql('real_value', 'synthetic_set, split, match')} AS ry FROM m) rk
  GROUP BY synthetic_set, split, match) st
  RIGHT JOIN (SELECT synthetic_set, u, split, match FROM (SELECT synthetic_set, count(DISTINCT entity_id) AS u FROM syn GROUP BY 1),
              (SELECT DISTINCT split FROM real), (VALUES ('exact'), ('alt'), ('either')) k(match)) g
  ON st.synthetic_set = g.synthetic_set AND st.split = g.split AND st.match = g.match
""", "syn_keyed", "real", extra=[
    ("ex", """SELECT s.synthetic_set, s.entity_id, s.value, r.split, 'exact' AS match FROM syn_keyed s
              JOIN (SELECT DISTINCT split, smiles FROM real) r ON s.exact_key = r.smiles"""),
    ("al", """SELECT s.synthetic_set, s.entity_id, s.value, r.split, 'alt' AS match FROM syn_keyed s
              JOIN (SELECT DISTINCT split, alt_key FROM real WHERE alt_key IS NOT NULL) r ON s.alt_key = r.alt_key
              WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.synthetic_set = s.synthetic_set AND ex.entity_id = s.entity_id
                                AND ex.split = r.split)"""),
    ("k", "SELECT * FROM ex UNION ALL SELECT * FROM al"),
    ("b", "SELECT * FROM k UNION ALL SELECT synthetic_set, entity_id, value, split, 'either' FROM k"),
    ("m", """SELECT b.*, r.value AS real_value, b.value - r.value AS err FROM b
             JOIN real r ON r.split = b.split AND r.entity_id = b.entity_id""")]), digits=8, tie_safe=True)
def q_memorization(spark, sf):
    """Memorization of each synthetic set against each real split, by match kind and 'either'."""
    return holdout.memorization(stages.syn_keyed(spark, sf), stages.real(spark, sf))


@query("any_real_match", with_roles("""
  SELECT synthetic_set, count(*) AS n, count(h.entity_id) AS n_match, count(h.entity_id) / count(*) AS share
  FROM syn s LEFT JOIN (SELECT DISTINCT entity_id FROM real) h ON h.entity_id = s.entity_id
  GROUP BY synthetic_set
""", "syn", "real"))
def q_any_real_match(spark, sf):
    """Synthetic entities matching any real split (either key)."""
    return holdout.any_match(stages.syn(spark, sf), stages.real(spark, sf), by=["synthetic_set"])


@query("union_real_first", with_roles("""
  SELECT entity_id, smiles, value, 'real' AS origin FROM real WHERE split = 'train'
  UNION ALL
  SELECT entity_id, smiles, value, 'generated' AS origin FROM syn s WHERE synthetic_set = 'generated'
    AND NOT EXISTS (SELECT 1 FROM real r WHERE r.split = 'train' AND r.entity_id = s.entity_id)
""", "syn", "real"))
def q_union_real_first(spark, sf):
    """Real training rows plus generated rows whose entity is not among them."""
    r = stages.real(spark, sf).filter(F.col("split") == "train").select(
        "entity_id", "smiles", "value", F.lit("real").alias("origin"))
    g = stages.syn(spark, sf).filter(F.col("synthetic_set") == "generated").select(
        "entity_id", "smiles", "value", F.lit("generated").alias("origin"))
    return holdout.union_prefer_first(r, g)


_TAGGED_SQL = ("SELECT entity_id, split FROM real UNION ALL "
               "SELECT entity_id, synthetic_set AS split FROM syn")


def _tagged(spark, sf):
    r = stages.real(spark, sf).select("entity_id", "split")
    s = stages.syn(spark, sf).select("entity_id", F.col("synthetic_set").alias("split"))
    return r.unionByName(s)


@query("split_leakage", with_roles("""
  SELECT entity_id, count(DISTINCT split) AS n_splits
  FROM (SELECT entity_id, split FROM real UNION ALL SELECT entity_id, 'train' FROM real WHERE split = 'validation')
  GROUP BY entity_id HAVING count(DISTINCT split) > 1
""", "real"))
def q_split_leakage(spark, sf):
    """Entities in more than one real split (the validation entities are planted in train, so that they are found)."""
    r = stages.real(spark, sf).select("entity_id", "split")
    return holdout.split_leakage(r.unionByName(r.where("split = 'validation'").withColumn("split", F.lit("train"))))


@query("pairwise_intersect", with_roles(f"""
  SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_shared
  FROM (SELECT DISTINCT * FROM t) a JOIN (SELECT DISTINCT * FROM t) b ON a.entity_id = b.entity_id AND a.split < b.split
  GROUP BY a.split, b.split
""", "syn", "real", extra=[("t", _TAGGED_SQL)]))
def q_pairwise_intersect(spark, sf):
    """Overlap of every pair of sets / splits."""
    return holdout.pairwise_intersect(_tagged(spark, sf))


@query("union_tagged", with_roles("""
  SELECT entity_id, smiles, value, 'real_' || split AS tag FROM real
  UNION ALL SELECT entity_id, smiles, value, synthetic_set AS tag FROM syn
""", "syn", "real"))
def q_union_tagged(spark, sf):
    """Stack the sets with a source tag."""
    r = stages.real(spark, sf).select("entity_id", "smiles", "value", F.concat(F.lit("real_"), "split").alias("tag"))
    s = stages.syn(spark, sf).select("entity_id", "smiles", "value", F.col("synthetic_set").alias("tag"))
    return r.unionByName(s)


@query("distinct_keys", with_roles("""
  SELECT DISTINCT synthetic_set, alt_key FROM syn_keyed WHERE alt_key IS NOT NULL
""", "syn_keyed"))
def q_distinct_keys(spark, sf):
    """Distinct non-null alt keys per set."""
    return curate.distinct_keys(stages.syn_keyed(spark, sf), "alt_key", by=["synthetic_set"])


# ---------------------------------------------------------------- merges and profiles

@query("merge_measurements", with_roles("""
  SELECT entity_id, min(exact_key) AS smiles, CAST(sum(n_points) AS BIGINT) AS n_points,
         string_agg(DISTINCT source, '/' ORDER BY source) AS sources,
         arg_min(class, exact_key || chr(1) || class) AS class, count(*) AS rows_merged,
         median(value) AS value, stddev_samp(value) AS value_sd, count(value) AS n_values
  FROM obs_valid WHERE reliability = 'A' GROUP BY entity_id
""", "obs_valid"))
def q_merge_measurements(spark, sf):
    """A2: merge of the measured rows with pooled values, summed points, joined tags, first class."""
    v = stages.obs_valid(spark, sf).filter(F.col("reliability") == "A")
    return curate.merge_measurements(v).select("entity_id", "smiles", "n_points", "sources", "class", "rows_merged",
                                               "value", "value_sd", "n_values")


_SETNAME = "CASE reliability WHEN 'A' THEN 'real' WHEN 'N' THEN 'generated' ELSE 'labeled' END"


@query("distribution_stats", with_roles(f"""
  SELECT {_SETNAME} AS set, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min,
         median(value) AS median, max(value) AS max, count_if(n_points >= 2)::BIGINT AS n_multi
  FROM obs_valid GROUP BY 1
""", "obs_valid"))
def q_distribution_stats(spark, sf):
    """Value distribution per set."""
    v = stages.obs_valid(spark, sf)
    v = v.withColumn("set", F.when(F.col("reliability") == "A", "real").when(F.col("reliability") == "N", "generated")
                     .otherwise("labeled"))
    return curate.distribution_stats(v, "value", ["set"], n_col="n_points")


@query("value_counts_topk", """
  SELECT source, n, n / (SELECT count(*) FROM documents) AS share FROM (
    SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5)
""")
def q_value_counts_topk(spark, sf):
    """Top 5 sources of the documents, ties broken by value."""
    from augeval.session import load
    return curate.value_counts_topk(load(spark, sf, "documents"), "source", 5)


@query("label_concentration", """
  SELECT lang, count(DISTINCT n_chars) AS distinct_values, avg(CASE WHEN n_chars = 1000 THEN 1.0 ELSE 0.0 END) AS share_equal,
         count_if(n_chars > 5000)::BIGINT AS n_above, avg(CASE WHEN n_chars > 5000 THEN 1.0 ELSE 0.0 END) AS share_above
  FROM documents GROUP BY lang
""")
def q_label_concentration(spark, sf):
    """Distinct labels, share equal to a value, count and share above a threshold (n_chars as label)."""
    from augeval.session import load
    return curate.label_concentration(load(spark, sf, "documents"), "n_chars", 1000, 5000, by=["lang"])


@query("repeat_spread", with_roles("""
  SELECT max(c) AS max_repeats, median(CASE WHEN c >= 3 THEN sd END) AS median_sd_repeated,
         count_if(c >= 3)::BIGINT AS n_repeated
  FROM (SELECT entity_id, count(*) AS c, stddev_samp(value) AS sd FROM obs_valid GROUP BY entity_id)
""", "obs_valid"))
def q_repeat_spread(spark, sf):
    """Largest repeat count and the spread of repeated entities."""
    return curate.repeat_spread(stages.obs_valid(spark, sf), "entity_id", "value")


@query("category_counts", with_roles("SELECT reliability, source, count(*) AS n FROM obs GROUP BY 1, 2", "obs"))
def q_category_counts(spark, sf):
    """Rows per flag and source."""
    return curate.category_counts(roles.obs(spark, sf), "reliability", "source")


@query("key_coverage", with_roles("""
  SELECT reliability, count(*) AS n, count_if(alt_key IS NULL)::BIGINT AS n_without_alt,
         avg(CASE WHEN alt_key IS NULL THEN 1.0 ELSE 0.0 END) AS share_without_alt
  FROM obs_keyed WHERE exact_key IS NOT NULL GROUP BY reliability
""", "obs_keyed"))
def q_key_coverage(spark, sf):
    """Rows without an alt key per flag."""
    return curate.key_coverage(stages.obs_keyed(spark, sf).filter(F.col("exact_key").isNotNull()),
                               by=["reliability"])
