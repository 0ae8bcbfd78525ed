"""Registered plans: fingerprints and similarity."""
from __future__ import annotations

from pyspark.sql import functions as F

from augeval.operators import metrics, similarity
from augeval.plans import roles
from augeval.plans.oracle_roles import with_roles
from augeval.plans.registry import query
from augeval.session import load, spread

# Fixed parameters.
SIM_EDGES = [0.0, 0.4, 0.55, 0.7, 0.85, 1.0001]
QS = [0.05, 0.25, 0.5, 0.75, 0.95]
BITS, RADIUS = 2048, 2

_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_GRAMS = " || ".join(
    f"list_transform(CASE WHEN len(w) >= {k} THEN range(1, len(w) - {k} + 2) ELSE [] END, "
    f"lambda i: array_to_string(w[i : i + {k - 1}], ' '))" for k in range(1, RADIUS + 2))
_FP_SQL = f"""SELECT doc_id, list_sort(list_distinct(list_transform({_GRAMS},
    lambda g: CAST((CAST(('0x' || substr(md5(g), 1, 8)) AS BIGINT) % {BITS}) AS INTEGER)))) AS bits
  FROM (SELECT doc_id, {_TOK} AS w FROM documents)"""

_TANI_SQL = """SELECT b.vec_id, coalesce(max(CAST(c AS DOUBLE) / (a + bb - c)), 0.0) AS max_tanimoto
  FROM (SELECT vec_id FROM bits WHERE is_query) b LEFT JOIN (
    SELECT q.vec_id AS qid, r.vec_id AS rid, any_value(q.a) AS a, any_value(r.b) AS bb, count(*) AS c
    FROM (SELECT vec_id, unnest(bits) AS bit, len(bits) AS a FROM bits WHERE is_query) q
    JOIN (SELECT vec_id, unnest(bits) AS bit, len(bits) AS b FROM bits WHERE NOT is_query) r ON q.bit = r.bit
    GROUP BY 1, 2) p ON p.qid = b.vec_id
  GROUP BY b.vec_id"""


@query("hash_fingerprint", _FP_SQL)
def q_hash_fingerprint(spark, sf):
    """M1: 2048-bit fingerprint (on-bit list) of every whole document from hashed word n-grams up to 3."""
    d = spread(load(spark, sf, "documents").select("doc_id", "text"))
    return similarity.fingerprint(d, "text", BITS, RADIUS).select("doc_id", "bits")


def _tanimoto(spark, sf):
    b = roles.bits(spark, sf)
    return similarity.max_tanimoto(b.filter("is_query"), b.filter("NOT is_query"))


@query("max_tanimoto", with_roles(_TANI_SQL, "bits"))
def q_max_tanimoto(spark, sf):
    """Largest Tanimoto similarity of each query fingerprint to the reference set (bit join)."""
    return _tanimoto(spark, sf)


def _band_case(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} >= {lo!r} AND {col} < {hi!r} THEN '[{lo:g}, {hi:g})'"
                              for lo, hi in zip(SIM_EDGES[:-1], SIM_EDGES[1:])) + " END"


@query("dense_histogram", with_roles(f"""
  SELECT bt.band_order, bt.band, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / (SELECT count(*) FROM t) AS share
  FROM (VALUES {", ".join(f"({i}, '[{lo:g}, {hi:g})')" for i, (lo, hi) in enumerate(zip(SIM_EDGES[:-1], SIM_EDGES[1:])))})
       bt(band_order, band)
  LEFT JOIN (SELECT {_band_case('max_tanimoto')} AS band, count(*) AS n FROM t GROUP BY 1) c ON c.band = bt.band
""", "bits", extra=[("t", _TANI_SQL)]))
def q_dense_histogram(spark, sf):
    """Counts and shares per similarity band, empty bands included."""
    return metrics.dense_histogram(_tanimoto(spark, sf), "max_tanimoto", SIM_EDGES)


@query("quantile_summary", with_roles(f"""
  SELECT {", ".join(f"quantile_cont(max_tanimoto, {q}) AS q{int(round(q * 100)):02d}" for q in QS)},
         avg(CASE WHEN max_tanimoto > 0.7 THEN 1.0 ELSE 0.0 END) AS share_above,
         avg(CASE WHEN max_tanimoto < 0.4 THEN 1.0 ELSE 0.0 END) AS share_below,
         count_if(max_tanimoto >= 0.9999)::BIGINT AS n_identical
  FROM t
""", "bits", extra=[("t", _TANI_SQL)]))
def q_quantile_summary(spark, sf):
    """Exact quantiles, shares above / below thresholds, identical fingerprints."""
    return metrics.quantile_summary(_tanimoto(spark, sf), "max_tanimoto", QS, 0.7, 0.4)


MIN_SIMILARITY = 0.25
_BENCH_FP_SQL = _FP_SQL.replace("doc_id", "item_id").replace("documents", "benchmark")
_NEAR_SQL = f"""SELECT d.doc_id, coalesce(max(s), 0.0) AS max_tanimoto FROM fp d LEFT JOIN (
    SELECT doc_id, s FROM (SELECT q.doc_id, r.item_id, CAST(count(*) AS DOUBLE) / (any_value(q.a) + any_value(r.b) - count(*)) AS s
      FROM (SELECT doc_id, len(bits) AS a, unnest(bits) AS bit FROM fp) q JOIN (SELECT item_id, len(bits) AS b, unnest(bits) AS bit FROM bfp) r ON q.bit = r.bit
      GROUP BY 1, 2) WHERE s >= {MIN_SIMILARITY}) x ON x.doc_id = d.doc_id GROUP BY d.doc_id"""
_NEAR_EXTRA = [("fp", _FP_SQL), ("bfp", _BENCH_FP_SQL)]


def _nearest(spark, sf):
    d = spread(load(spark, sf, "documents").select("doc_id", "text"))
    b = load(spark, sf, "benchmark").select("item_id", "text")
    return similarity.nearest_at_least(similarity.fingerprint(d, "text", BITS, RADIUS), similarity.fingerprint(b, "text", BITS, RADIUS), MIN_SIMILARITY)


@query("nearest_benchmark", with_roles(_NEAR_SQL, extra=_NEAR_EXTRA))
def q_nearest_benchmark(spark, sf):
    """M1 into J10: fingerprint similarity of every document to its nearest benchmark item, exact from 0.25 on."""
    return _nearest(spark, sf)


@query("error_by_similarity", with_roles(f"""
  SELECT CASE WHEN GROUPING(band) = 1 THEN 'all' ELSE band END AS stratum, count(*) AS n, avg(n_chars) AS mean_chars, avg(quality) AS mean_quality
  FROM (SELECT {_band_case('max_tanimoto')} AS band, d.n_chars, l.quality FROM near JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id))
  WHERE band IS NOT NULL GROUP BY ROLLUP (band)
""", extra=[*_NEAR_EXTRA, ("near", _NEAR_SQL)]))
def q_error_by_similarity(spark, sf):
    """M1, J10 and A15 in one: documents by their similarity to the benchmark, with size and label per stratum (rollup)."""
    d = _nearest(spark, sf).join(load(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id") \
        .join(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    d = d.withColumn("band", metrics.band("max_tanimoto", SIM_EDGES)).where("band is not null")
    r = d.rollup("band").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars"), F.avg("quality").alias("mean_quality"),
                             F.grouping("band").alias("_g"))
    return r.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("band")).alias("stratum"), "n", "mean_chars", "mean_quality")
