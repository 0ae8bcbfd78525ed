"""Registered plans: metrics, paired statistics, early stopping, sampling, bootstrap."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from augeval.functions.keys import md5_bucket
from augeval.functions.ranks import average_rank
from augeval.operators import bootstrap, metrics, paired, sampling, similarity
from augeval.plans import roles, stages
from augeval.plans.oracle_roles import avg_rank_sql, corr_sql, with_roles
from augeval.plans.oracle_roles import md5_bucket as md5_bucket_sql
from augeval.plans.q_similarity import _FP_SQL, BITS, RADIUS, SIM_EDGES
from augeval.plans.registry import query
from augeval.session import cut_lineage, load, spread

# Fixed parameters of the evaluation plans.
SEEDS = [1, 2, 3, 4, 5, 6, 7]
MODELS = ["A", "N", "R"]
EDGES = [900.0, 10000.0, 30000.0, 50000.0, 70000.0, 90000.0]
PAIRS = [("N-A", "N", "A"), ("R-A", "R", "A"), ("N-R", "N", "R")]
PATIENCES = [3, 5, 10]
ARMS = ["real", "generated", "labeled"]
RESAMPLES = 200

E = "(y_pred - y_true)"
BASIC_SQL = f"""SELECT run, seed, count(*) AS n, avg(abs{E}) AS mae, sqrt(avg({E} * {E})) AS rmse,
    CASE WHEN var_pop(y_true) * count(*) > 0 THEN 1 - sum({E} * {E}) / (var_pop(y_true) * count(*)) END AS r2,
    avg{E} AS mean_signed_error FROM preds GROUP BY run, seed"""
PAIRS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{l}', '{a}', '{b}')" for l, a, b in PAIRS) + ") p(label, run_a, run_b)"


def _basic(spark, sf):
    return metrics.regression_metrics(roles.preds(spark, sf), with_spearman=False)


@query("regression_metrics", with_roles(f"""
  SELECT run, seed, count(*) AS n, avg(abs{E}) AS mae, sqrt(avg({E} * {E})) AS rmse,
    CASE WHEN var_pop(y_true) * count(*) > 0 THEN 1 - sum({E} * {E}) / (var_pop(y_true) * count(*)) END AS r2,
    avg{E} AS mean_signed_error, {corr_sql('rx', 'ry')} AS spearman
  FROM (SELECT *, {avg_rank_sql('y_true', 'run, seed')} AS rx, {avg_rank_sql('y_pred', 'run, seed')} AS ry FROM preds)
  GROUP BY run, seed
""", "preds"))
def q_regression_metrics(spark, sf):
    """A4: MAE, RMSE, R2, Spearman, signed error per (run, seed)."""
    return metrics.regression_metrics(roles.preds(spark, sf))


@query("run_summary", with_roles("""
  SELECT run, count(DISTINCT seed) AS n_seeds, avg(mae) AS mae_mean, stddev_samp(mae) AS mae_sd,
         avg(rmse) AS rmse_mean, stddev_samp(rmse) AS rmse_sd, avg(r2) AS r2_mean, stddev_samp(r2) AS r2_sd
  FROM m GROUP BY run
""", "preds", extra=[("m", BASIC_SQL)]))
def q_run_summary(spark, sf):
    """A5: mean and SD over seeds of each metric per run."""
    return metrics.run_summary(_basic(spark, sf))


@query("seed_completeness", with_roles("""
  SELECT run, count(DISTINCT seed) AS n_seeds, (SELECT count(DISTINCT seed) FROM p) AS n_all_seeds
  FROM p GROUP BY run HAVING count(DISTINCT seed) < (SELECT count(DISTINCT seed) FROM p)
""", "preds", extra=[("p", "SELECT * FROM preds WHERE NOT (run = 'R' AND seed = 7)")]))
def q_seed_completeness(spark, sf):
    """Runs lacking some seed (run R's last seed is left out of the input, so that one is found)."""
    return metrics.seed_completeness(roles.preds(spark, sf).filter(~((F.col("run") == "R") & (F.col("seed") == 7))))


@query("pivot_seeds", with_roles("SELECT run, " + ", ".join(f"max(CASE WHEN seed = {s} THEN mae END) AS seed_{s}" for s in SEEDS)
                                 + " FROM m GROUP BY run", "preds", extra=[("m", BASIC_SQL)]))
def q_pivot_seeds(spark, sf):
    """Run x seed matrix of the MAE."""
    return metrics.pivot_seeds(_basic(spark, sf), SEEDS)


@query("seed_mean_error", digits=8, tie_safe=True, sql=with_roles(f"""
  SELECT run, entity, avg(abs{E}) AS abs_error, count(*) AS n_seeds FROM preds GROUP BY run, entity
""", "preds"))
def q_seed_mean_error(spark, sf):
    """Per-entity absolute error averaged over seeds."""
    return metrics.seed_mean_error(roles.preds(spark, sf))


@query("average_rank", with_roles(f"""
  SELECT run, seed, entity, {avg_rank_sql('y_true', 'run, seed')} AS rank FROM preds
""", "preds"))
def q_average_rank(spark, sf):
    """Tie-averaged rank of y_true per (run, seed)."""
    return average_rank(roles.preds(spark, sf), "y_true", ["run", "seed"]).select("run", "seed", "entity", "rank")


def _band_case(col: str) -> str:
    parts = [f"WHEN {col} >= {lo!r} AND {col} < {hi!r} THEN '[{lo:g}, {hi:g})'" for lo, hi in zip(EDGES[:-1], EDGES[1:])]
    return "CASE " + " ".join(parts) + " END"


@query("band_join", with_roles(f"SELECT run, seed, entity, {_band_case('y_true')} AS band FROM preds", "preds"))
def q_band_join(spark, sf):
    """Half-open bands from a band table (broadcast range join, table bounded by the parameter)."""
    return metrics.band_join(roles.preds(spark, sf), "y_true", EDGES).select("run", "seed", "entity", "band")


@query("error_by_band", with_roles(f"""
  SELECT band, count(*) AS n, avg(abs{E}) AS mae, avg{E} AS mean_signed_error
  FROM (SELECT *, {_band_case('y_true')} AS band FROM preds) WHERE band IS NOT NULL GROUP BY band
""", "preds"))
def q_error_by_band(spark, sf):
    """N, MAE and signed error per observed band."""
    return metrics.error_by_band(roles.preds(spark, sf), EDGES)


HIGH_SD = 10000.0
_NAME = ["p_name", "p_brand", "p_type", "p_size"]   # an entity's text, whose fingerprint is compared
_NAME_FP_SQL = _FP_SQL.replace("SELECT doc_id", "SELECT entity").replace("SELECT entity, list_filter", "SELECT p_partkey AS entity, list_filter") \
    .replace("documents", "part").replace("lower(text)", f"lower(concat_ws(' ', {', '.join(_NAME)}))")
_SIM_CASE = "CASE " + " ".join(f"WHEN s >= {lo!r} AND s < {hi!r} THEN '[{lo:g}, {hi:g})'" for lo, hi in zip(SIM_EDGES[:-1], SIM_EDGES[1:])) + " END"
_STRATA_EXTRA = [
    ("en", f"SELECT run, entity, avg(abs{E}) AS v FROM preds GROUP BY run, entity"),
    ("te", f"SELECT entity, avg(y_true) AS truth FROM preds WHERE {md5_bucket_sql('entity')} < 10 GROUP BY entity"),
    ("me", "SELECT part_key AS entity, min(reliability) AS reliability, stddev_samp(value) AS sd FROM obs_valid GROUP BY part_key"),
    ("fp", f"SELECT *, {md5_bucket_sql('entity')} < 10 AS test FROM ({_NAME_FP_SQL})"),
    ("si", """SELECT q.entity, coalesce(max(x.s), 0.0) AS s FROM fp q LEFT JOIN (
        SELECT a.entity, CAST(count(*) AS DOUBLE) / (any_value(a.n) + any_value(b.n) - count(*)) AS s
        FROM (SELECT entity, len(bits) AS n, unnest(bits) AS bit FROM fp WHERE test) a
        JOIN (SELECT entity AS ref, len(bits) AS n, unnest(bits) AS bit FROM fp WHERE NOT test) b ON a.bit = b.bit GROUP BY a.entity, b.ref) x
      ON x.entity = q.entity WHERE q.test GROUP BY q.entity"""),
    ("st", f"""SELECT entity, 'band' AS kind, {_band_case('truth')} AS stratum FROM te
      UNION ALL SELECT te.entity, 'reliability', me.reliability FROM te LEFT JOIN me USING (entity)
      UNION ALL SELECT te.entity, 'high_sd', CASE WHEN me.sd > {HIGH_SD} THEN 'high' ELSE 'other' END FROM te LEFT JOIN me USING (entity)
      UNION ALL SELECT te.entity, 'similarity', {_SIM_CASE} FROM te LEFT JOIN si USING (entity)""")]


@query("stratified_error", with_roles(f"""
  SELECT kind, CASE WHEN GROUPING(stratum) = 1 THEN 'all' ELSE stratum END AS stratum, count(*) AS n, {", ".join(f"avg(e_{m}) AS mae_{m}" for m in MODELS)}
  FROM st JOIN (SELECT entity, {", ".join(f"avg(CASE WHEN run = '{m}' THEN v END) AS e_{m}" for m in MODELS)} FROM en GROUP BY entity) USING (entity)
  GROUP BY GROUPING SETS ((kind, stratum), (kind)) HAVING GROUPING(stratum) = 1 OR stratum IS NOT NULL
""", "preds", "obs_valid", extra=_STRATA_EXTRA))
def q_stratified_error(spark, sf):
    """Test entities and MAE per model by value band, reliability, spread of the measurements and similarity to the training
    entities' texts (M1 and J10), with an 'all' row each."""
    test = md5_bucket("entity") < 10
    p = roles.preds(spark, sf)
    t = p.where(test).groupBy("entity").agg(F.avg("y_true").alias("truth"))
    measured = stages.obs_valid(spark, sf).groupBy(F.col("part_key").alias("entity")).agg(
        F.min("reliability").alias("reliability"), F.stddev_samp("value").alias("sd"))
    names = load(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.concat_ws(" ", *[F.col(c).cast("string") for c in _NAME]).alias("name"))
    fp = cut_lineage(similarity.fingerprint(spread(names), "name", BITS, RADIUS).select("entity", "bits"), "name-bits")
    near = similarity.max_tanimoto(fp.where(test), fp.where(~test), "entity", out="s")
    t = t.join(measured, "entity", "left").join(near, "entity", "left")
    kinds = {"band": metrics.band("truth", EDGES), "reliability": F.col("reliability"),
             "high_sd": F.when(F.col("sd") > HIGH_SD, "high").otherwise("other"), "similarity": metrics.band("s", SIM_EDGES)}
    strata = t.select("entity", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("stratum")) for k, c in kinds.items()])).alias("x"))
    return metrics.error_by_strata(metrics.seed_mean_error(p), strata.select("entity", "x.*"), MODELS)


@query("density_histogram", with_roles("""
  SELECT bin, CAST(0.0 + bin * 5000.0 AS DOUBLE) AS bin_lo, count(*) AS n,
         count(*) / ((SELECT count(*) FROM preds WHERE y_true BETWEEN 0.0 AND 100000.0) * 5000.0) AS density
  FROM (SELECT CAST(least(floor((y_true - 0.0) / 5000.0), 19) AS INTEGER) AS bin FROM preds
        WHERE y_true BETWEEN 0.0 AND 100000.0) GROUP BY bin
""", "preds"))
def q_density_histogram(spark, sf):
    """Density per fixed-width bin, last bin closed on the right."""
    return metrics.density_histogram(roles.preds(spark, sf), "y_true", 0.0, 100000.0, 20)


@query("median_error_by_band", with_roles(f"""
  SELECT floor(y_true / 5000.0) * 5000.0 AS band_lo, count(*) AS n, median{E} AS median_error
  FROM preds GROUP BY 1 HAVING count(*) >= 10
""", "preds"))
def q_median_error_by_band(spark, sf):
    """Median signed error per 5000-unit band with 10+ rows."""
    return metrics.median_error_by_band(roles.preds(spark, sf), 5000.0, 10)


@query("prediction_noise", with_roles(f"""
  SELECT a.run, mae_mean, mae_sd, mae_min, mae_max, entity_sd_mean, entity_sd_max FROM
   (SELECT run, avg(m) AS mae_mean, stddev_samp(m) AS mae_sd, min(m) AS mae_min, max(m) AS mae_max
    FROM (SELECT run, seed, avg(abs{E}) AS m FROM preds GROUP BY run, seed) GROUP BY run) a
  JOIN (SELECT run, avg(sd) AS entity_sd_mean, max(sd) AS entity_sd_max
        FROM (SELECT run, entity, stddev_samp(y_pred) AS sd FROM preds GROUP BY run, entity) GROUP BY run) b
  ON a.run = b.run
""", "preds"))
def q_prediction_noise(spark, sf):
    """Spread of the MAE over passes and of each entity's prediction."""
    return metrics.prediction_noise(roles.preds(spark, sf))


_K = repr(2 / math.sqrt(math.pi))


@query("noise_floor", with_roles(f"""
  SELECT quantity, value FROM (
    SELECT 'n_multi' AS quantity, CAST(count_if(multi) AS DOUBLE) AS value FROM per
    UNION ALL SELECT 'median_sd', median(CASE WHEN multi THEN sd END) FROM per
    UNION ALL SELECT 'mean_sd', avg(CASE WHEN multi THEN sd END) FROM per
    UNION ALL SELECT 'expected_diff_median', median(CASE WHEN multi THEN sd END) * {_K} FROM per
    UNION ALL SELECT 'expected_diff_mean', avg(CASE WHEN multi THEN sd END) * {_K} FROM per
    {"".join(f'''UNION ALL SELECT 'mae_inside_{m}', avg(CASE WHEN run = '{m}' AND multi THEN abs_error END) FROM ej
    UNION ALL SELECT 'mae_outside_{m}', avg(CASE WHEN run = '{m}' AND NOT multi THEN abs_error END) FROM ej
    ''' for m in MODELS)})
""", "obs_valid", "preds", extra=[
    ("per", "SELECT part_key AS entity, count(*) >= 2 AS multi, stddev_samp(value) AS sd FROM obs_valid "
            "WHERE reliability = 'A' GROUP BY part_key"),
    ("err", f"SELECT run, entity, avg(abs{E}) AS abs_error FROM preds GROUP BY run, entity"),
    ("ej", "SELECT err.*, per.multi FROM err JOIN per ON per.entity = err.entity")]))
def q_noise_floor(spark, sf):
    """Measurement noise floor of repeated entities and model error inside / outside it."""
    measured = stages.obs_valid(spark, sf).filter(F.col("reliability") == "A").select(
        F.col("part_key").alias("entity"), "value")
    errors = metrics.seed_mean_error(roles.preds(spark, sf))
    return metrics.noise_floor(measured, errors, MODELS)


_OTHERS = [m for m in MODELS if m != "A"]
_TRUTH_SQL = "SELECT r.run, seed, entity, y_true FROM preds, (VALUES " + ", ".join(f"('{m}')" for m in _OTHERS) + ") r(run) WHERE preds.run = 'A'"


def _truth(spark, sf):
    """Run A's truth once for every other run (a fixed list, exploded per row)."""
    t = roles.preds(spark, sf).filter(F.col("run") == "A").drop("run")
    return t.withColumn("run", F.explode(F.array(*[F.lit(m) for m in _OTHERS])))


@query("attach_truth", digits=8, tie_safe=True, sql=with_roles("""
  SELECT t.run, t.seed, t.entity, t.y_true, p.y_pred, avg(abs(p.y_pred - t.y_true)) OVER (PARTITION BY t.run, t.seed) AS mae_usable
  FROM t LEFT JOIN preds p ON p.run = t.run AND p.seed = t.seed AND p.entity = t.entity
""", "preds", extra=[("t", _TRUTH_SQL)]))
def q_attach_truth(spark, sf):
    """Truth left join predictions (null where unusable) with the usable-only MAE."""
    from augeval.operators.evaluate import attach_truth
    pred = roles.preds(spark, sf).select("run", "seed", "entity", "y_pred")
    return attach_truth(_truth(spark, sf).select("run", "seed", "entity", "y_true"), pred, "entity", by=["run", "seed"])


@query("alignment_check", with_roles("""
  SELECT coalesce(a.run, b.run) AS run, coalesce(a.seed, b.seed) AS seed,
         count_if(a.entity IS NOT NULL AND b.entity IS NOT NULL)::BIGINT AS n_both,
         count_if(b.entity IS NULL)::BIGINT AS n_only_a, count_if(a.entity IS NULL)::BIGINT AS n_only_b
  FROM t a FULL OUTER JOIN (SELECT * FROM preds WHERE run <> 'A') b ON a.run = b.run AND a.seed = b.seed AND a.entity = b.entity
  GROUP BY 1, 2
""", "preds", extra=[("t", _TRUTH_SQL)]))
def q_alignment_check(spark, sf):
    """Do two prediction tables hold the same entities (full outer join + one-sided counts)."""
    from augeval.operators.evaluate import alignment_check
    b = roles.preds(spark, sf).filter(F.col("run") != "A")
    return alignment_check(_truth(spark, sf), b, "entity", by=["run", "seed"])


@query("standardize", with_roles("""
  SELECT run, seed, entity, (y_true - m) / s AS z, ((y_true - m) / s) * s + m AS y_back FROM preds
  JOIN (SELECT run, avg(y_true) AS m, stddev_samp(y_true) AS s FROM preds GROUP BY run) USING (run)
""", "preds"))
def q_standardize(spark, sf):
    """P10: z-score by the run's own mean and sample SD, and the inverse."""
    from augeval.operators.evaluate import standardize, unstandardize
    z = standardize(roles.preds(spark, sf), ["run"], "y_true", "z")
    return unstandardize(z, "z", "y_back").select("run", "seed", "entity", "z", "y_back")


@query("restandardize", with_roles("""
  SELECT p.run, b.run AS run_to, seed, entity, ((y_true - a.m) / a.s * a.s + a.m - b.m) / b.s AS z2
  FROM preds p JOIN st a ON a.run = p.run JOIN st b ON b.run <> p.run
""", "preds", extra=[("st", "SELECT run, avg(y_true) AS m, stddev_samp(y_true) AS s FROM preds GROUP BY run")]))
def q_restandardize(spark, sf):
    """Map every score from its run's scale to the scale of every other run, the value unchanged."""
    from augeval.operators.evaluate import restandardize, scale_stats
    p = roles.preds(spark, sf)
    own = scale_stats(p, ["run"], "y_true", "m1", "s1")
    to = own.select(F.col("run").alias("run_to"), F.col("m1").alias("m2"), F.col("s1").alias("s2"))
    runs = F.array(*[F.lit(m) for m in MODELS])
    p = p.withColumn("run_to", F.explode(F.filter(runs, lambda r: r != F.col("run")))).join(own, "run").join(to, "run_to")
    z = F.try_divide(F.col("y_true") - F.col("m1"), F.col("s1"))
    return p.select("run", "run_to", "seed", "entity", restandardize(z, F.col("m1"), F.col("s1"), F.col("m2"), F.col("s2")).alias("z2"))


# ---------------------------------------------------------------- paired statistics

_PAIRED_SQL = f"""SELECT p.label, a.seed, a.mae AS a, b.mae AS b, a.mae - b.mae AS diff
  FROM pairs p JOIN m a ON a.run = p.run_a JOIN m b ON b.run = p.run_b AND b.seed = a.seed"""
_DIFF_EXTRA = [("m", BASIC_SQL), ("pairs", PAIRS_SQL), ("pd", _PAIRED_SQL),
               ("x", f"""SELECT *, avg(diff) OVER (PARTITION BY label) AS mu,
                          {avg_rank_sql('abs(diff)', 'label')} AS rk FROM pd"""),
               ("g", """SELECT label, count(*) AS n, avg(diff) AS mean, stddev_samp(diff) AS sd, min(diff) AS min,
                          max(diff) AS max, count_if(sign(diff) = sign(mu))::BIGINT AS same_sign,
                          max(abs(diff)) AS maxabs, sum(CASE WHEN diff > 0 THEN rk ELSE 0 END) AS wplus,
                          sum(CASE WHEN diff < 0 THEN rk ELSE 0 END) AS wminus, count_if(diff = 0) AS zeros,
                          count(DISTINCT abs(diff)) AS nd FROM x GROUP BY label HAVING count(*) >= 2""")]


def _t_p_sql(t: str, v: str) -> str:
    t, v = f"({t})", f"({v})"
    th = f"atan(abs({t}) / sqrt({v}))"
    c2 = f"pow(cos({th}), 2)"
    ev = (f"sin({th}) * list_sum(list_transform(range(0, ({v} - 2) // 2 + 1), lambda k: exp(coalesce(list_sum("
          f"list_transform(range(1, k + 1), lambda j: ln((2 * j - 1) / (2 * j)))), 0)) * pow({c2}, k)))")
    od = (f"2 / pi() * ({th} + sin({th}) * cos({th}) * list_sum(list_transform(range(0, ({v} - 3) // 2 + 1), lambda k: "
          f"exp(coalesce(list_sum(list_transform(range(1, k + 1), lambda j: ln((2 * j) / (2 * j + 1)))), 0)) * pow({c2}, k))))")
    return (f"greatest(0.0, 1 - CASE WHEN {v} % 2 = 0 THEN {ev} WHEN {v} = 1 THEN 2 * {th} / pi() ELSE {od} END)")


@query("seed_pairs", with_roles("SELECT label, seed, a, b, diff FROM pd", "preds", extra=_DIFF_EXTRA[:3]))
def q_seed_pairs(spark, sf):
    """Runs paired on seed through a pair table."""
    pairs = spark.createDataFrame(PAIRS, "label string, run_a string, run_b string")
    return paired.seed_pairs(_basic(spark, sf), pairs)


def _diff(spark, sf):
    pairs = spark.createDataFrame(PAIRS, "label string, run_a string, run_b string")
    return paired.seed_matched_diff(paired.seed_pairs(_basic(spark, sf), pairs))


@query("seed_matched_diff", with_roles("SELECT label, n, mean, sd, min, max, same_sign FROM g", "preds",
                                       extra=_DIFF_EXTRA))
def q_seed_matched_diff(spark, sf):
    """Per pair n, mean, SD, min, max and same-sign count of the seed-matched differences."""
    return _diff(spark, sf).select("label", "n", "mean", "sd", "min", "max", "same_sign")


@query("paired_t", with_roles(f"""
  SELECT label, CASE WHEN maxabs > 0 AND sd > 0 THEN {_t_p_sql('mean / (sd / sqrt(n))', 'n - 1')} END AS t_p FROM g
""", "preds", extra=_DIFF_EXTRA))
def q_paired_t(spark, sf):
    """Two-sided paired t p-value (closed form for integer df)."""
    return _diff(spark, sf).select("label", "t_p")


_NORMAL_P_SQL = """CASE WHEN abs(z) < 5 THEN greatest(0.0, 1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * abs(z) * list_reduce(
    list_transform(range(101), lambda k: {'k': CAST(k AS DOUBLE), 'term': CAST(1 AS DOUBLE), 'total': CAST(1 AS DOUBLE)}),
    lambda a, x: {'k': x.k, 'term': a.term * z * z / (2 * x.k + 1), 'total': a.total + a.term * z * z / (2 * x.k + 1)}).total)
  WHEN z IS NOT NULL THEN 2 * exp(-z * z / 2) / sqrt(2 * pi()) / list_reduce(
    list_prepend(CAST(abs(z) AS DOUBLE), list_transform(range(1, 61), lambda k: CAST(61 - k AS DOUBLE))), lambda a, k: abs(z) + k / a) END"""
# Entities as pairs: thousands of differences a label, beside the few seeds of the others.
_ENTITY_PAIRS = [(m, "A") for m in MODELS if m != "A"]


@query("wilcoxon", with_roles(f"""
  SELECT label, CASE WHEN n = zeros THEN NULL WHEN exact THEN least(1.0, 2.0 * (
           SELECT count(*) FROM range(0, CASE WHEN exact AND n <= 20 THEN 1::BIGINT << CAST(n AS INTEGER) ELSE 0 END) t(mk)
           WHERE list_sum([(k + 1) * ((mk >> k) & 1) for k in range(CAST(n AS INTEGER))]) <= least(wplus, wminus))
         / pow(2, n)) ELSE {_NORMAL_P_SQL} END AS wilcoxon_p,
         CASE WHEN n = zeros THEN 'all zero' WHEN exact THEN 'exact' ELSE 'normal' END AS wilcoxon_method, n, zeros
  FROM (SELECT *, zeros = 0 AND ties = 0 AND n <= 50 AS exact, (least(wplus, wminus) - m * (m + 1) / 4)
               / sqrt(nullif(m * (m + 1) * (2 * m + 1) / 24 - ties / 48, 0)) AS z FROM sg)
""", "preds", extra=[*_DIFF_EXTRA[:3],
    ("en", f"SELECT run, entity, avg(abs{E}) AS v FROM preds GROUP BY run, entity"),
    ("al", "SELECT label, diff FROM pd UNION ALL SELECT 'entities ' || x.run || ' - A', x.v - y.v FROM en x JOIN en y ON y.run = 'A' AND y.entity = x.entity WHERE x.run <> 'A'"),
    ("sr", f"SELECT *, {avg_rank_sql('abs(diff)', 'label')} AS rk FROM al WHERE diff <> 0"),
    ("sg", """SELECT label, n, zeros, CAST(n - zeros AS DOUBLE) AS m, coalesce(wplus, 0) AS wplus, coalesce(wminus, 0) AS wminus, coalesce(ties, 0) AS ties
              FROM (SELECT label, count(*) AS n, CAST(count_if(diff = 0) AS BIGINT) AS zeros FROM al GROUP BY label)
              LEFT JOIN (SELECT label, sum(CASE WHEN diff > 0 THEN rk ELSE 0 END) AS wplus, sum(CASE WHEN diff < 0 THEN rk ELSE 0 END) AS wminus FROM sr GROUP BY label) USING (label)
              LEFT JOIN (SELECT label, sum(pow(t, 3) - t) AS ties FROM (SELECT label, count(*) AS t FROM sr GROUP BY label, abs(diff)) GROUP BY label) USING (label)""")]))
def q_wilcoxon(spark, sf):
    """A10: signed-rank test of the seed pairs (exact) and of every model against the reference entity by entity (normal)."""
    pairs = spark.createDataFrame(PAIRS, "label string, run_a string, run_b string")
    by_seed = paired.seed_pairs(_basic(spark, sf), pairs).select("label", "diff")
    e = _errors(spark, sf)
    models = spark.createDataFrame([(f"entities {m} - {r}", m, r) for m, r in _ENTITY_PAIRS], "label string, run_a string, run_b string")
    by_entity = paired.seed_pairs(e, models, seed_col="entity", value="v").select("label", "diff")
    return paired.signed_rank(by_seed.union(by_entity)).select("label", "wilcoxon_p", "wilcoxon_method", "n", "zeros")


@query("same_sign_label", with_roles("SELECT label, CAST(same_sign AS VARCHAR) || '/' || CAST(n AS VARCHAR) AS same_sign_label FROM g",
                                     "preds", extra=_DIFF_EXTRA))
def q_same_sign_label(spark, sf):
    """Seeds agreeing with the sign of the mean difference, as k/n."""
    return _diff(spark, sf).select("label", "same_sign_label")


# ---------------------------------------------------------------- early stopping

_HIST_MAP_SQL = ("SELECT *, 250 + 250 * (run % 2) AS n_real, "
                 "CASE (run // 2) % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'generated' ELSE 'labeled' END AS run_arm, "
                 "run // 6 AS run_seed FROM hist")


def _hist_mapped(spark, sf):
    """hist runs as (size, arm, seed) cells of an experiment grid: run r has n_real = 250 + 250 (r % 2),
    arm = ARMS[(r div 2) % 3], seed = r div 6."""
    h = roles.hist(spark, sf)
    arm = F.element_at(F.array(*[F.lit(a) for a in ARMS]), (F.expr("run div 2") % 3 + 1).cast("int"))
    return h.select("*", (250 + 250 * (F.col("run") % 2)).alias("n_real"), arm.alias("run_arm"),
                    F.expr("run div 6").alias("run_seed"))


def _stop_sql(patience: str, keys: str) -> list[tuple[str, str]]:
    return [
        ("h1", f"""SELECT *, min(val_mae) OVER (PARTITION BY {keys} ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
                   FROM hx"""),
        ("h2", "SELECT *, pm IS NULL OR val_mae < pm AS imp FROM h1"),
        ("h3", f"""SELECT *, max(CASE WHEN imp THEN epoch END) OVER (PARTITION BY {keys} ORDER BY epoch
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li FROM h2"""),
        ("st", f"""SELECT {keys}, coalesce(min(CASE WHEN epoch - li >= {patience} THEN epoch END), max(epoch)) AS steps_run
                   FROM h3 GROUP BY {keys}"""),
        ("stop", f"""SELECT {keys}, max(epoch) AS best_epoch, arg_max(val_mae, epoch) AS best_val_mae, arg_max(test_mae, epoch) AS best_test_mae, steps_run
                     FROM h3 JOIN st USING ({keys}) WHERE imp AND epoch <= steps_run GROUP BY {keys}, steps_run""")]


@query("early_stop", with_roles("SELECT run, best_epoch, best_val_mae, steps_run FROM stop", "hist",
                                extra=[("hx", "SELECT * FROM hist")] + _stop_sql("3", "run")))
def q_early_stop(spark, sf):
    """Best epoch when stopping after 3 non-improving epochs (strict improvement)."""
    return paired.early_stop(roles.hist(spark, sf), ["run"], "epoch", "val_mae", 3)


@query("best_step", with_roles("""
  SELECT run, arg_min(epoch, (val_mae, epoch)) AS best_epoch, min(val_mae) AS best_val_mae FROM hist GROUP BY run
""", "hist"))
def q_best_step(spark, sf):
    """First epoch with the smallest metric per run."""
    return paired.best_step(roles.hist(spark, sf), ["run"], "epoch", "val_mae")


@query("steps_to_best", with_roles("""
  SELECT run, best_epoch, best_epoch * CAST(ceil(n_real / 16.0) AS BIGINT) AS steps_to_best
  FROM stop JOIN (SELECT DISTINCT run, 250 + 250 * (run % 2) AS n_real FROM hist) USING (run)
""", "hist", extra=[("hx", "SELECT * FROM hist")] + _stop_sql("3", "run")))
def q_steps_to_best(spark, sf):
    """optimizer steps to the best epoch: epochs x ceil(rows / batch of 16)."""
    st = paired.early_stop(_hist_mapped(spark, sf), ["run", "n_real"], "epoch", "val_mae", 3)
    return st.select("run", "best_epoch", (F.col("best_epoch") * F.ceil(F.col("n_real") / 16.0)).alias("steps_to_best"))


_PAT_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({p})" for p in PATIENCES) + ") p(patience)"
_ABL_EXTRA = [("hm", _HIST_MAP_SQL), ("pt", _PAT_SQL), ("hx", "SELECT * FROM hm, pt")] + \
    _stop_sql("patience", "run, patience, n_real, run_arm, run_seed") + [
    ("cells", """SELECT n_real, patience, run_seed, run_arm, best_test_mae AS mae, best_epoch, steps_run FROM stop"""),
    ("complete", """SELECT n_real, patience, run_seed FROM cells GROUP BY ALL HAVING count(DISTINCT run_arm) = 3"""),
    ("pd", """SELECT a.n_real, a.patience, a.run_arm AS arm, a.run_seed, a.mae AS a, r.mae AS b, r.best_epoch AS e, a.mae - r.mae AS diff
              FROM cells a JOIN cells r ON r.n_real = a.n_real AND r.patience = a.patience AND r.run_seed = a.run_seed
                AND r.run_arm = 'real'
              JOIN complete c ON c.n_real = a.n_real AND c.patience = a.patience AND c.run_seed = a.run_seed
              WHERE a.run_arm <> 'real'"""),
    ("g", """SELECT n_real, patience, arm, count(*) AS seeds, avg(b) AS mae_real_mean, stddev_samp(b) AS mae_real_sd,
                    avg(a) AS mae_arm_mean, stddev_samp(a) AS mae_arm_sd, avg(e) AS best_epoch_real_mean, avg(diff) AS d_mean, stddev_samp(diff) AS d_sd,
                    count_if(sign(diff) = sign(mu))::BIGINT AS same_sign, max(abs(diff)) AS maxabs
             FROM (SELECT *, avg(diff) OVER (PARTITION BY n_real, patience, arm) AS mu FROM pd)
             GROUP BY n_real, patience, arm HAVING count(*) >= 2""")]


def _ablation(spark, sf):
    h = _hist_mapped(spark, sf)
    h = h.withColumn("patience", F.explode(F.array(*[F.lit(p) for p in PATIENCES])))
    keys = ["run", "patience", "n_real", "run_arm", "run_seed"]
    st = paired.early_stop(h, keys, "epoch", "val_mae", "patience", carry=["test_mae"])   # chosen by one, reported by the other
    cells = st.select("n_real", "patience", "run_seed", "run_arm", F.col("best_test_mae").alias("mae"), "best_epoch")
    complete = cells.groupBy("n_real", "patience", "run_seed").agg(F.count_distinct("run_arm").alias("_k")) \
        .filter(F.col("_k") == 3).drop("_k")
    real = cells.filter(F.col("run_arm") == "real").select("n_real", "patience", "run_seed", F.col("mae").alias("b"),
                                                           F.col("best_epoch").alias("e"))
    pd_ = (cells.filter(F.col("run_arm") != "real").join(real, ["n_real", "patience", "run_seed"])
                .join(complete, ["n_real", "patience", "run_seed"])
                .select("n_real", "patience", F.col("run_arm").alias("arm"), "run_seed", F.col("mae").alias("a"), "b", "e",
                        (F.col("mae") - F.col("b")).alias("diff")))
    by = ["n_real", "patience", "arm"]
    d = paired.seed_matched_diff(pd_, by)
    side = pd_.groupBy(*by).agg(F.avg("b").alias("mae_real_mean"), F.stddev_samp("b").alias("mae_real_sd"),
                                F.avg("a").alias("mae_arm_mean"), F.stddev_samp("a").alias("mae_arm_sd"),
                                F.avg("e").alias("best_epoch_real_mean"))
    return d.join(side, by).select(*by, F.col("n").alias("seeds"), "mae_real_mean", "mae_real_sd", "mae_arm_mean",
                                   "mae_arm_sd", "best_epoch_real_mean", F.col("mean").alias("d_mean"), F.col("sd").alias("d_sd"),
                                   "same_sign_label", "t_p")


@query("patience_table", with_roles(f"""
  SELECT n_real, patience, arm, seeds, mae_real_mean, mae_real_sd, mae_arm_mean, mae_arm_sd, best_epoch_real_mean, d_mean, d_sd,
         CAST(same_sign AS VARCHAR) || '/' || CAST(seeds AS VARCHAR) AS same_sign_label,
         CASE WHEN maxabs > 0 AND d_sd > 0 THEN {_t_p_sql('d_mean / (d_sd / sqrt(seeds))', 'seeds - 1')} END AS t_p
  FROM g
""", "hist", extra=_ABL_EXTRA))
def q_patience_table(spark, sf):
    """Patience ablation: per (size, patience, arm) seeds, arm means / SDs, seed-matched difference, p."""
    return _ablation(spark, sf)


@query("gain_lost", with_roles("""
  SELECT a.n_real, a.arm, a.d_mean AS d3, b.d_mean AS d10,
         CASE WHEN a.d_mean <> 0 THEN 1 - b.d_mean / a.d_mean END AS share_lost,
         CASE WHEN l.d_mean <> 0 THEN a.d_mean / l.d_mean END AS ratio_to_labeled
  FROM g a JOIN g b ON b.n_real = a.n_real AND b.arm = a.arm AND b.patience = 10
  JOIN g l ON l.n_real = a.n_real AND l.arm = 'labeled' AND l.patience = 3
  WHERE a.patience = 3
""", "hist", extra=_ABL_EXTRA))
def q_gain_lost(spark, sf):
    """Share of a gain at patience 3 that vanishes at patience 10; ratio of the two arms' gains."""
    t = _ablation(spark, sf).select("n_real", "arm", "patience", "d_mean")
    a = t.filter(F.col("patience") == 3).select("n_real", "arm", F.col("d_mean").alias("d3"))
    b = t.filter(F.col("patience") == 10).select("n_real", "arm", F.col("d_mean").alias("d10"))
    lab = a.filter(F.col("arm") == "labeled").select("n_real", F.col("d3").alias("_dl"))
    j = a.join(b, ["n_real", "arm"]).join(lab, "n_real")
    return j.select("n_real", "arm", "d3", "d10",
                    F.when(F.col("d3") != 0, 1 - F.try_divide(F.col("d10"), F.col("d3"))).alias("share_lost"),
                    F.when(F.col("_dl") != 0, F.try_divide(F.col("d3"), F.col("_dl"))).alias("ratio_to_labeled"))


@query("best_epoch_stats", with_roles("""
  SELECT run_arm, avg(best_epoch) AS best_epoch_mean, avg(steps_run) AS steps_run_mean, max(steps_run) AS steps_run_max
  FROM stop GROUP BY run_arm
""", "hist", extra=[("hm", _HIST_MAP_SQL), ("hx", "SELECT * FROM hm")] + _stop_sql("3", "run, run_arm")))
def q_best_epoch_stats(spark, sf):
    """Mean best epoch, mean and max epochs run per arm (patience 3)."""
    st = paired.early_stop(_hist_mapped(spark, sf), ["run", "run_arm"], "epoch", "val_mae", 3)
    return st.groupBy("run_arm").agg(F.avg("best_epoch").alias("best_epoch_mean"),
                                     F.avg("steps_run").alias("steps_run_mean"), F.max("steps_run").alias("steps_run_max"))


# ---------------------------------------------------------------- splits and samples

_SPLIT_SQL = """SELECT entity_id, CASE WHEN pos <= nt THEN 'test' WHEN pos <= nt + nv THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, round_even(CAST(cnt AS DOUBLE) * 0.2, 0) AS nt, round_even((cnt - round_even(CAST(cnt AS DOUBLE) * 0.2, 0)) * 0.1, 0) AS nv
        FROM (SELECT entity_id, count(*) OVER () AS cnt, row_number() OVER (ORDER BY md5('42|' || entity_id), entity_id) AS pos
              FROM merged WHERE flag = 'A'))"""


def _split(spark, sf):
    m = stages.merged(spark, sf).filter(F.col("flag") == "A").select("entity_id", "value")
    return sampling.seeded_split(m, "entity_id", 42)


@query("seeded_split", with_roles(_SPLIT_SQL, "merged"))
def q_seeded_split(spark, sf):
    """Exact seeded split: round(n x 0.2) test, round(rest x 0.1) validation, in md5 order."""
    return _split(spark, sf).select("entity_id", "split")


@query("split_by_threshold", with_roles("""
  SELECT entity_id, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.28 THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT entity_id, CAST(('0x' || substr(md5('42|' || entity_id), 1, 8)) AS BIGINT) / 4294967296.0 AS u
        FROM merged WHERE flag = 'A')
""", "merged"))
def q_split_by_threshold(spark, sf):
    """W3 (threshold mode): stateless hash-threshold split, no count and no numbering."""
    m = stages.merged(spark, sf).filter(F.col("flag") == "A").select("entity_id")
    return sampling.split_by_threshold(m, "entity_id", 42)


@query("nested_subsets", with_roles(f"""
  SELECT subset, entity_id, position FROM (
    SELECT entity_id, row_number() OVER (ORDER BY md5('43|' || entity_id), entity_id) AS position
    FROM sp WHERE split = 'train') t,
  (VALUES ('n100', 100), ('n250', 250), ('n500', 500), ('full', NULL)) s(subset, size)
  WHERE size IS NULL OR position <= size
""", "merged", extra=[("sp", _SPLIT_SQL)]))
def q_nested_subsets(spark, sf):
    """Nested first-n subsets (100, 250, 500, full) of one seeded order of the training split."""
    tr = _split(spark, sf).filter(F.col("split") == "train").select("entity_id")
    return sampling.nested_subsets(tr, "entity_id", 43, [100, 250, 500])


@query("distinct_sample", """
  SELECT md5(text) AS text_md5, length(text) AS n_chars FROM (SELECT DISTINCT text FROM documents)
  ORDER BY md5('7|' || text) LIMIT 50
""")
def q_distinct_sample(spark, sf):
    """Distinct texts, then exactly 50 in seeded hash order."""
    s = sampling.distinct_sample(load(spark, sf, "documents"), ["text"], 50, 7)
    return s.select(F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


@query("pilot_head", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 10")
def q_pilot_head(spark, sf):
    """First 10 documents in id order."""
    return sampling.pilot_head(load(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 10)


@query("shuffle_labels", with_roles("""
  SELECT a.entity_id, a.value, b.shuffled FROM
    (SELECT entity_id, value, row_number() OVER (ORDER BY md5('0|' || entity_id), entity_id) AS p FROM merged WHERE flag = 'A') a
  JOIN (SELECT value AS shuffled, row_number() OVER (ORDER BY md5('42|' || entity_id), entity_id) AS p
        FROM merged WHERE flag = 'A') b ON a.p = b.p
""", "merged"))
def q_shuffle_labels(spark, sf):
    """Values permuted across entities, fixed per seed."""
    m = stages.merged(spark, sf).filter(F.col("flag") == "A").select("entity_id", "value")
    return sampling.shuffle_labels(m, "entity_id", "value", 42).select("entity_id", "value", "shuffled")


# ---------------------------------------------------------------- bootstrap

_ERR_SQL = "SELECT run, entity, avg(abs(y_pred - y_true)) AS v FROM preds GROUP BY run, entity"
_U60 = "CAST(('0x' || substr(md5('42|' || CAST({a} AS VARCHAR) || '|' || CAST({b} AS VARCHAR)), 1, 15)) AS BIGINT)"


_LEAF = bootstrap.LEAF


def _tree_sql(by: str = "") -> list[tuple[str, str]]:
    """Draws (by, b, position) for the groups of ``ids``: n draws split down a tree of leaves by the binary digits of the sizes' ratio,
    one hashed bit a draw and digit, then dealt inside each leaf."""
    cols, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    u = "CAST(('0x' || substr(md5({}), 1, 15)) AS BIGINT)"
    word = u.format("'42|split|' || b || '|' || lo || '|' || hi || '|' || t.t || '|' || w")
    ones = f"""coalesce(list_sum(list_transform(range((a.o + 59) // 60), lambda w: bit_count({word} &
               CASE WHEN a.o - w * 60 >= 60 THEN 1152921504606846975 ELSE (CAST(1 AS BIGINT) << CAST(a.o - w * 60 AS INTEGER)) - 1 END))), 0)"""
    st = lambda g, o, r: f"{{'g': CAST({g} AS BIGINT), 'o': CAST({o} AS BIGINT), 'r': CAST({r} AS BIGINT), 't': t.t}}"
    left = f"""list_reduce(list_transform(range(61), lambda i: {{'g': CAST(0 AS BIGINT), 'o': c, 'r': least((lo + hi) // 2 * {_LEAF}, n) - lo * {_LEAF}, 't': i}}),
      lambda a, t: CASE WHEN a.o = 0 OR a.r = 0 THEN {st('a.g', 'a.o', 'a.r')}
        WHEN 2 * a.r >= least(hi * {_LEAF}, n) - lo * {_LEAF} THEN {st(f'a.g + a.o - {ones}', ones, f'2 * a.r - (least(hi * {_LEAF}, n) - lo * {_LEAF})')}
        ELSE {st('a.g', f'a.o - {ones}', '2 * a.r')} END).g"""
    return [
        ("tree", f"""SELECT {cols}n, b, CAST(0 AS BIGINT) AS lo, (n + {_LEAF - 1}) // {_LEAF} AS hi, n AS c
           FROM (SELECT {cols}count(*) AS n FROM ids{group}), range(1, {RESAMPLES} + 1) rb(b)
         UNION ALL SELECT {cols}n, b, x.lo, x.hi, x.c FROM (SELECT {cols}n, b, unnest([{{'lo': lo, 'hi': (lo + hi) // 2, 'c': l}}, {{'lo': (lo + hi) // 2, 'hi': hi, 'c': c - l}}]) AS x
           FROM (SELECT *, {left} AS l FROM tree WHERE hi - lo > 1)) WHERE x.c > 0"""),
        ("d", f"""SELECT {cols}b, lo * {_LEAF} + CAST((CAST({u.format("'42|leaf|' || b || '|' || lo || '|' || j")} AS HUGEINT) * least({_LEAF}, n - lo * {_LEAF})) // 1152921504606846976 AS BIGINT) + 1 AS position
          FROM tree, LATERAL range(1, c + 1) rj(j) WHERE hi - lo = 1""")]


def _errors(spark, sf):
    """Absolute error of every run and entity, averaged over all seeds."""
    return metrics.seed_mean_error(roles.preds(spark, sf)).select("run", "entity", F.col("abs_error").alias("v"))


@query("bootstrap_ci", with_roles("""
  SELECT run, mean, ci_lo, ci_hi FROM (SELECT run, avg(v) AS mean FROM e GROUP BY run)
  JOIN (SELECT run, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi
        FROM (SELECT run, b, avg(v) AS m FROM d JOIN nb USING (run, position) GROUP BY run, b) GROUP BY run) USING (run)
""", "preds", extra=[("e", _ERR_SQL), ("ids", "SELECT run, entity FROM e"),
                     ("nb", "SELECT run, v, row_number() OVER (PARTITION BY run ORDER BY md5('42|' || entity), entity) AS position FROM e"),
                     *_tree_sql("run")], recursive=True))
def q_bootstrap_ci(spark, sf):
    """Percentile interval of every run's MAE over 200 md5-drawn resamples."""
    return bootstrap.bootstrap_ci(_errors(spark, sf), "entity", "v", RESAMPLES, 42, by=["run"])


@query("paired_bootstrap", with_roles("""
  SELECT a.run, a.seed, mean_diff, ci_lo, ci_hi, ci_lo > 0 OR ci_hi < 0 AS excludes_zero FROM
    (SELECT run, seed, avg(d) AS mean_diff FROM dd GROUP BY run, seed) a
  JOIN (SELECT run, seed, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi FROM
          (SELECT run, seed, b, avg(dd.d) AS m FROM d JOIN nb USING (position) JOIN dd USING (entity) GROUP BY run, seed, b) GROUP BY run, seed) c
  ON a.run = c.run AND a.seed = c.seed
""", "preds", extra=[
    ("ref", f"SELECT entity, avg(abs{E}) AS r FROM preds WHERE run = 'A' GROUP BY entity"),
    ("dd", f"SELECT run, seed, entity, abs{E} - r AS d FROM preds JOIN ref USING (entity) WHERE run <> 'A'"),
    ("ids", "SELECT entity FROM ref"),
    ("nb", "SELECT entity, row_number() OVER (ORDER BY md5('42|' || entity), entity) AS position FROM ref"),
    *_tree_sql()], recursive=True))
def q_paired_bootstrap(spark, sf):
    """Paired bootstrap of each student run and seed against the reference model, shared draws."""
    p = roles.preds(spark, sf)
    students = p.filter(F.col("run") != "A").select("run", "seed", "entity", F.abs(F.col("y_pred") - F.col("y_true")).alias("abs_error"))
    teacher = metrics.seed_mean_error(p.filter(F.col("run") == "A")).select("entity", "abs_error")
    return bootstrap.paired_bootstrap(students, teacher, "entity", ["run", "seed"], "abs_error", RESAMPLES, 42)


def _poisson_case(u: str) -> str:
    return "CASE " + " ".join(f"WHEN {u} < {c!r} THEN {k}" for k, c in enumerate(bootstrap.POISSON1_CDF)) + f" ELSE {len(bootstrap.POISSON1_CDF)} END"


@query("poisson_bootstrap", with_roles(f"""
  SELECT run, mean, ci_lo, ci_hi FROM (SELECT run, avg(v) AS mean FROM e GROUP BY run) JOIN (
    SELECT run, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi FROM (
      SELECT run, b, CASE WHEN sum(w) <> 0 THEN sum(w * v) / sum(w) END AS m FROM (
        SELECT run, b, v, {_poisson_case('u')} AS w FROM (
          SELECT run, b, v, CAST({_U60.format(a='b', b='entity')} AS DOUBLE) / 1152921504606846976.0::DOUBLE AS u
          FROM e, range(1, {RESAMPLES} + 1) rb(b))) GROUP BY run, b) GROUP BY run) USING (run)
""", "preds", extra=[("e", _ERR_SQL)]))
def q_poisson_bootstrap(spark, sf):
    """One-pass Poisson bootstrap (no join, no numbering)."""
    return bootstrap.poisson_bootstrap(_errors(spark, sf), "entity", "v", RESAMPLES, 42, by=["run"])
