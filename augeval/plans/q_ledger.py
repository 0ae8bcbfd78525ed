"""Registered plans: the request ledger."""
from __future__ import annotations

from pyspark.sql import functions as F

from augeval.functions.keys import numeric_or_null, seeded_hash
from augeval.functions.text import label_fields
from augeval.operators import ledger
from augeval.plans import roles
from augeval.plans.oracle_roles import keyed, numeric, with_roles
from augeval.plans.registry import query
from augeval.session import cut_lineage, load, scratch_path

# Fixed parameters of the ledger plans.
CLASSES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
HINTS = ["Brand#11", "Brand#22", "Brand#33", "Brand#44", "Brand#55"]      # brands of the part table
VARIANTS = ["F", "O", "P"]                                               # order states
TASKS = ["click", "error", "purchase", "signup", "view"]
ROUND_SIZE = 20
RETRY_LIMIT = 4000
BUDGET_USD = 18.0
EXPECTED_OUT_TOKENS = 50
ROUND_WIDTH = 2500          # request numbers per acquisition round
TG_LO, TG_HI = 0.0, 500.0   # range rule of the log's pairs
SAMPLE_SHARE = 0.3

LOG_COLS = [f.name for f in ledger.LOG_SCHEMA.fields]


def _pos_last(t: str, ch: str) -> str:
    return f"(length({t}) - strpos(reverse({t}), '{ch}') + 1)"


def _slice_sql(t: str, o: str, c: str) -> str:
    return (f"CASE WHEN strpos({t}, '{o}') > 0 AND strpos({t}, '{c}') > 0 AND {_pos_last(t, c)} >= strpos({t}, '{o}') "
            f"THEN substr({t}, strpos({t}, '{o}'), {_pos_last(t, c)} - strpos({t}, '{o}') + 1) END")


_PAIRS_SQL = f"""SELECT custom_id, seq, task, CAST(i AS INTEGER) AS item, json_extract_string(e, '$.smiles') AS smiles,
    {numeric("json_extract_string(e, '$.tg_celsius')")} AS tg_celsius
  FROM (SELECT custom_id, seq, task, i, json_extract(body, '$[' || CAST(i AS VARCHAR) || ']') AS e
        FROM (SELECT *, {_slice_sql('text', '[', ']')} AS body FROM log) v,
        LATERAL range(CASE WHEN json_valid(v.body) THEN CASE WHEN json_type(v.body) = 'ARRAY' THEN CAST(json_array_length(v.body) AS BIGINT) ELSE 0 END ELSE 0 END) t(i)
        WHERE v.body IS NOT NULL AND json_valid(v.body))
  WHERE json_type(e) = 'OBJECT'"""
_VALID_SQL = f"coalesce(json_valid({_slice_sql('text', '[', ']')}), false)"
_LABELS_SQL = f"""SELECT custom_id, seq, task,
    CASE WHEN ok THEN json_extract_string(body, '$.smiles') END AS echoed_smiles,
    {numeric("CASE WHEN ok THEN json_extract_string(body, '$.tg_celsius') WHEN body IS NOT NULL AND raw <> '' THEN raw END")} AS tg_celsius
  FROM (SELECT *, CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' ELSE false END AS ok,
               regexp_extract(text, '"tg_celsius"\\s*:\\s*(-?\\d+(?:\\.\\d+)?)', 1) AS raw
        FROM (SELECT *, {_slice_sql('text', '{', '}')} AS body FROM log))"""
_PLANNED_SQL = ("SELECT printf('req_%04d_%s', user_id, t) AS custom_id, user_id, t AS task FROM (SELECT DISTINCT user_id FROM events "
                "UNION SELECT DISTINCT user_id + 5000 FROM events WHERE user_id % 10 = 0), "
                "(VALUES " + ", ".join(f"('{t}')" for t in TASKS) + ") tk(t)")


def _planned(spark, sf):
    """Planned requests: every user of the events table, and some users that never answered (ids shifted by 5000), ask every
    task (a fixed list, exploded per user)."""
    u = load(spark, sf, "events").select("user_id")
    u = u.union(u.where("user_id % 10 = 0").select(F.col("user_id") + 5000)).distinct()
    u = u.withColumn("task", F.explode(F.array(*[F.lit(t) for t in TASKS])))
    return u.select(F.format_string("req_%04d_%s", "user_id", "task").alias("custom_id"), "user_id", "task")


@query("scan_response_log", with_roles("SELECT * FROM log", "log"))
def q_scan_response_log(spark, sf):
    """The response log written as JSON lines (derived from events), scanned back with its schema."""
    path = scratch_path(spark, "log")
    ledger.write_log(roles.log(spark, sf).select(*LOG_COLS), path)
    return ledger.scan_log(spark, path)


@query("append_log", with_roles("SELECT task, count(*) AS n FROM log GROUP BY task", "log"))
def q_append_log(spark, sf):
    """Append the log in two batches, read it back; counts add up."""
    path = scratch_path(spark, "append")
    log = roles.log(spark, sf).select(*LOG_COLS)
    ledger.append_log(log.filter(F.col("seq") % 2 == 0), path)
    ledger.append_log(log.filter(F.col("seq") % 2 == 1), path)
    return ledger.scan_log(spark, path).groupBy("task").agg(F.count(F.lit(1)).alias("n"))


@query("parse_pair_array", with_roles(_PAIRS_SQL.replace(", task, CAST(i AS INTEGER) AS item", ", CAST(i AS INTEGER) AS item", 1), "log"))
def q_parse_pair_array(spark, sf):
    """object items of each generation answer (outermost [ ... ] as JSON; other items skipped)."""
    return ledger.parse_pairs(roles.log(spark, sf))


@query("parse_label_object", with_roles(_LABELS_SQL.replace(" seq, task,", " seq,", 1), "log"))
def q_parse_label_object(spark, sf):
    """label answers: JSON object fields, else the number by pattern for malformed JSON, else null."""
    return ledger.parse_labels(roles.log(spark, sf))


@query("invalid_response_count", with_roles(f"""
  SELECT task, count(*) AS n_responses, count_if(NOT {_VALID_SQL})::BIGINT AS n_invalid FROM log GROUP BY task
""", "log"))
def q_invalid_response_count(spark, sf):
    """parse failures per task."""
    return ledger.invalid_count(roles.log(spark, sf))


def _list_sql(lst, idx):
    return "[" + ", ".join(f"'{x}'" for x in lst) + f"][{idx}]"


@query("request_grid", with_roles(f"""
  SELECT seq, {_list_sql(CLASSES, f'(seq % {len(CLASSES)}) + 1')} AS class,
         {_list_sql(HINTS, f'((seq // {len(CLASSES)}) % {len(HINTS)}) + 1')} AS hint,
         {_list_sql(VARIANTS, f'((seq // {len(CLASSES) * len(HINTS)}) % {len(VARIANTS)}) + 1')} AS variant
  FROM log
""", "log"))
def q_request_grid(spark, sf):
    """request number -> (class, hint, variant), mixed radix."""
    return ledger.request_grid(roles.log(spark, sf).select("seq"), "seq", [CLASSES, HINTS, VARIANTS],
                               ["class", "hint", "variant"])


@query("render_prompt", """
  SELECT doc_id, 'Summarize the ' || lang || ' document ' || CAST(doc_id AS VARCHAR) || ' from ' || source || ' ('
         || CAST(n_chars AS VARCHAR) || ' characters).' AS prompt FROM documents
""")
def q_render_prompt(spark, sf):
    """fill a prompt template per row."""
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.format_string("Summarize the %s document %d from %s (%d characters).",
                                              "lang", "doc_id", "source", "n_chars").alias("prompt"))


@query("make_ids", with_roles("SELECT seq, printf('gen_%06d', seq) AS request_id FROM log", "log"))
def q_make_ids(spark, sf):
    """zero-padded request ids."""
    return roles.log(spark, sf).select("seq", F.format_string("gen_%06d", "seq").alias("request_id"))


@query("request_number", with_roles("""
  SELECT request_id, CAST(nullif(regexp_extract(request_id, '(\\d+)$', 1), '') AS BIGINT) AS request_number
  FROM (SELECT printf('gen_%06d', seq) AS request_id FROM log)
""", "log"))
def q_request_number(spark, sf):
    """trailing digits of an id as a number."""
    ids = roles.log(spark, sf).select(F.format_string("gen_%06d", "seq").alias("request_id"))
    return ids.select("request_id", F.nullif(F.regexp_extract("request_id", r"(\d+)$", 1), F.lit(""))
                      .cast("bigint").alias("request_number"))


@query("token_cost", with_roles("""
  SELECT seq, CAST(CAST(input_tokens * 2 + output_tokens * 10 AS DECIMAL(38, 6))
                   * (CASE WHEN batch_id IS NOT NULL THEN 0.5 ELSE 1 END) / 1000000 AS DOUBLE) AS cost
  FROM log
""", "log"))
def q_token_cost(spark, sf):
    """F8: USD from tokens, half price when batched (decimal arithmetic)."""
    log = roles.log(spark, sf).withColumn("_b", F.col("batch_id").isNotNull())
    return log.select("seq", ledger.token_cost("input_tokens", "output_tokens", "_b").alias("cost"))


_HASH_SQL = """substr(sha256('{"arm": "' || run_arm || '", "max_epochs": 30, "n_real": ' || CAST(n_real AS VARCHAR)
              || ', "patience": {p}, "seed": ' || CAST(run_seed AS VARCHAR) || '}'), 1, 12)"""
_HMAP = ("SELECT DISTINCT run, 250 + 250 * (run % 2) AS n_real, "
         "CASE (run // 2) % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'generated' ELSE 'labeled' END AS run_arm, run // 6 AS run_seed FROM hist")


def _runs(spark, sf):
    from augeval.plans.q_eval import _hist_mapped
    return _hist_mapped(spark, sf).select("run", "n_real", "run_arm", "run_seed").distinct()


def _hash(p: int):
    return ledger.settings_hash({"arm": ledger.json_text("run_arm"), "max_epochs": F.lit("30"),
                                 "n_real": ledger.json_int("n_real"), "patience": F.lit(str(p)),
                                 "seed": ledger.json_int("run_seed")})


@query("settings_hash", with_roles(f"SELECT run, {_HASH_SQL.replace('{p}', '3')} AS settings_hash FROM rm", "hist",
                                   extra=[("rm", _HMAP)]))
def q_settings_hash(spark, sf):
    """12 hex digits of SHA-256 over sorted-key settings JSON per planned run."""
    return _runs(spark, sf).select("run", _hash(3).alias("settings_hash"))


@query("resume_plan", with_roles(f"""
  SELECT p.run, CASE WHEN l.run IS NULL THEN 'run'
                     WHEN coalesce(l.stored_hash, p.published) = p.current_hash THEN 'skip' ELSE 'conflict' END AS action
  FROM (SELECT run, {_HASH_SQL.replace('{p}', '3')} AS current_hash, {_HASH_SQL.replace('{p}', '3')} AS published FROM rm) p
  LEFT JOIN (SELECT run, CASE run % 4 WHEN 0 THEN NULL WHEN 1 THEN {_HASH_SQL.replace('{p}', '3')}
                                  ELSE {_HASH_SQL.replace('{p}', '10')} END AS stored_hash
             FROM rm WHERE run % 4 <> 3) l ON l.run = p.run
""", "hist", extra=[("rm", _HMAP)]))
def q_resume_plan(spark, sf):
    """Planned runs against the ledger of finished runs: run / skip / conflict by settings hash.

    The ledger fixture: runs r % 4 = 3 are unfinished, r % 4 = 0 have a record without a hash (published
    settings), r % 4 = 1 a record with the current hash, r % 4 = 2 a record made with patience 10."""
    runs = _runs(spark, sf)
    planned = runs.select("run", _hash(3).alias("current_hash"), _hash(3).alias("published_hash"))
    stored = F.when(F.col("run") % 4 == 1, _hash(3)).when(F.col("run") % 4 == 2, _hash(10))
    led = runs.filter(F.col("run") % 4 != 3).select("run", stored.alias("stored_hash"))
    return ledger.resume_plan(planned, led, "run", published_hash=F.col("published_hash")).select("run", "action")


@query("truncated_answers", with_roles(f"""
  SELECT custom_id, seq FROM log WHERE stop_reason = 'max_tokens' AND output_tokens < {RETRY_LIMIT}
""", "log"))
def q_truncated_answers(spark, sf):
    """Answers cut off that are still below the retry token limit."""
    log = roles.log(spark, sf)
    return log.filter((F.col("stop_reason") == "max_tokens") & (F.col("output_tokens") < RETRY_LIMIT)).select(
        "custom_id", "seq")


@query("echo_mismatch", with_roles("""
  SELECT task, count(*) AS n, count_if(NOT (echoed_smiles IS NOT DISTINCT FROM sent))::BIGINT AS n_mismatch
  FROM (SELECT *, 'u' || CAST(CAST(substr(custom_id, 5, 4) AS INTEGER) AS VARCHAR) || ' ' || task AS sent FROM lab)
  GROUP BY task
""", "log", extra=[("lab", _LABELS_SQL)]))
def q_echo_mismatch(spark, sf):
    """Answers whose echoed input differs from what was sent (null-safe)."""
    log = roles.log(spark, sf)
    lab = ledger.parse_labels(log, ["custom_id", "seq", "task"])
    sent = F.concat(F.lit("u"), F.substring("custom_id", 5, 4).cast("int").cast("string"), F.lit(" "), F.col("task"))
    return lab.groupBy("task").agg(F.count(F.lit(1)).alias("n"),
                                   F.count_if(~F.col("echoed_smiles").eqNullSafe(sent)).cast("bigint").alias("n_mismatch"))


@query("latest_response", with_roles("""
  SELECT custom_id, arg_max(seq, (ts, seq)) AS seq, arg_max(stop_reason, (ts, seq)) AS stop_reason FROM log GROUP BY custom_id
""", "log"))
def q_latest_response(spark, sf):
    """The last record per id wins (explicit (ts, seq) order)."""
    return ledger.latest(roles.log(spark, sf))


_DONE_SQL = "SELECT DISTINCT custom_id FROM log WHERE stop_reason = 'end_turn'"


@query("pending_requests", with_roles(f"""
  SELECT custom_id FROM planned WHERE custom_id NOT IN (SELECT custom_id FROM done) ORDER BY custom_id LIMIT {ROUND_SIZE}
""", "log", extra=[("planned", _PLANNED_SQL), ("done", _DONE_SQL)]))
def q_pending_requests(spark, sf):
    """Planned ids without a finished answer, in id order, one round."""
    done = roles.log(spark, sf).filter(F.col("stop_reason") == "end_turn").select("custom_id")
    pend = _planned(spark, sf).join(done, "custom_id", "left_anti")
    return pend.select("custom_id").orderBy("custom_id").limit(ROUND_SIZE)


@query("except_ids", with_roles("""
  SELECT custom_id FROM planned WHERE custom_id NOT IN (SELECT custom_id FROM log)
""", "log", extra=[("planned", _PLANNED_SQL)]))
def q_except_ids(spark, sf):
    """U4: planned minus answered ids."""
    return _planned(spark, sf).select("custom_id").join(roles.log(spark, sf).select("custom_id"), "custom_id",
                                                         "left_anti")


@query("responses_in_sample", with_roles(f"""
  SELECT l.custom_id, l.seq, s.prompt FROM log l JOIN (
    SELECT custom_id, 'Predict the value for u' || CAST(user_id AS VARCHAR) || ' ' || task AS prompt FROM planned
    WHERE CAST(('0x' || substr(md5('7|' || custom_id), 1, 8)) AS BIGINT) / 4294967296.0 < {SAMPLE_SHARE}) s
  ON s.custom_id = l.custom_id
""", "log", extra=[("planned", _PLANNED_SQL)]))
def q_responses_in_sample(spark, sf):
    """Responses whose id is in a seeded sample of the planned requests, with the prompt attached."""
    p = _planned(spark, sf)
    u = F.conv(F.substring(seeded_hash(7, "custom_id"), 1, 8), 16, 10).cast("double") / float(16 ** 8)
    sample = p.filter(u < SAMPLE_SHARE).select(
        "custom_id", F.format_string("Predict the value for u%d %s", "user_id", "task").alias("prompt"))
    log = roles.log(spark, sf).select("custom_id", "seq")
    return log.join(sample, "custom_id")


@query("cost_rollup", with_roles("""
  SELECT coalesce(task, 'total') AS task, count(*) AS requests, count_if(batch_id IS NULL)::BIGINT AS requests_full_price,
         CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
         sum(cost_usd) AS cost_usd,
         CASE WHEN grouping(task) = 1 THEN '' ELSE string_agg(DISTINCT date, '/' ORDER BY date) END AS dates
  FROM log GROUP BY ROLLUP (task)
""", "log"))
def q_cost_rollup(spark, sf):
    """Requests, full-price requests, tokens, cost and dates per task, plus the total row (rollup)."""
    log = roles.log(spark, sf)
    r = log.rollup("task").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("batch_id").isNull()).cast("bigint").alias("requests_full_price"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"), F.array_join(F.array_sort(F.collect_set("date")), "/").alias("_dates"),
        F.grouping("task").alias("_g"))
    return r.select(F.when(F.col("_g") == 1, "total").otherwise(F.col("task")).alias("task"), "requests",
                    "requests_full_price", "input_tokens", "output_tokens", "cost_usd",
                    F.when(F.col("_g") == 1, F.lit("")).otherwise(F.col("_dates")).alias("dates"))


@query("cost_per_clean_row", with_roles(f"""
  SELECT c.task, c.cost_usd, coalesce(k.clean_rows, 0) AS clean_rows,
         CASE WHEN coalesce(k.clean_rows, 0) > 0 THEN c.cost_usd / k.clean_rows * 1000 END AS usd_per_1000_clean
  FROM (SELECT task, sum(cost_usd) AS cost_usd FROM log GROUP BY task) c
  LEFT JOIN (SELECT task, count(*) AS clean_rows FROM pairs WHERE tg_celsius BETWEEN 0.0 AND 500.0 GROUP BY task) k
  ON k.task = c.task
""", "log", extra=[("pairs", _PAIRS_SQL)]))
def q_cost_per_clean_row(spark, sf):
    """USD per 1,000 clean parsed rows per task."""
    log = roles.log(spark, sf)
    clean = ledger.parse_pairs(log, ["custom_id", "seq", "task"]).filter(F.col("tg_celsius").between(0.0, 500.0))
    k = clean.groupBy("task").agg(F.count(F.lit(1)).alias("clean_rows"))
    c = log.groupBy("task").agg(F.sum("cost_usd").alias("cost_usd"))
    j = c.join(k, "task", "left").withColumn("clean_rows", F.coalesce("clean_rows", F.lit(0)))
    return j.withColumn("usd_per_1000_clean", F.when(F.col("clean_rows") > 0,
                                                     F.col("cost_usd") / F.col("clean_rows") * 1000))


@query("budget_guard", with_roles(f"""
  SELECT spent, n_pending, estimate, CAST({BUDGET_USD} AS DOUBLE) AS budget_limit, spent + estimate <= {BUDGET_USD} AS within_budget FROM (
    SELECT spent, n_pending, n_pending * (avg_in * 2 + {EXPECTED_OUT_TOKENS} * 10) / 1000000.0 * 0.5 AS estimate FROM
      (SELECT sum(cost_usd) AS spent, avg(input_tokens) AS avg_in FROM log),
      (SELECT count(*) AS n_pending FROM planned WHERE custom_id NOT IN (SELECT custom_id FROM done)))
""", "log", extra=[("planned", _PLANNED_SQL), ("done", _DONE_SQL)]))
def q_budget_guard(spark, sf):
    """Spent + estimate of the pending requests against the budget limit, as one verdict row."""
    log = roles.log(spark, sf)
    done = log.filter(F.col("stop_reason") == "end_turn").select("custom_id")
    n_pending = _planned(spark, sf).join(done, "custom_id", "left_anti").select(F.count(F.lit(1))).scalar()
    s = log.agg(F.sum("cost_usd").alias("spent"), F.avg("input_tokens").alias("_in"))
    est = n_pending * (F.col("_in") * 2 + EXPECTED_OUT_TOKENS * 10) / 1000000.0 * 0.5
    s = s.select("spent", n_pending.alias("n_pending"), est.alias("estimate"))
    return s.select("spent", "n_pending", "estimate", F.lit(BUDGET_USD).alias("budget_limit"),
                    (F.col("spent") + F.col("estimate") <= BUDGET_USD).alias("within_budget"))


# Clean pairs: a numeric value in range and a name with a key, by entity (either key).
_CLEAN_EXTRA = [("pairs", _PAIRS_SQL), ("ranged", f"SELECT * FROM pairs WHERE smiles IS NOT NULL AND tg_celsius BETWEEN {TG_LO} AND {TG_HI}"),
                ("clean", f"SELECT * FROM ({keyed('ranged', 'smiles')}) WHERE exact_key IS NOT NULL")]


@query("first_seen", with_roles(f"""
  SELECT r.round, r.n_requests, coalesce(f.n_new, 0) AS n_new, coalesce(f.n_new, 0) / r.n_requests AS new_per_request
  FROM (SELECT seq // {ROUND_WIDTH} AS round, count(*) AS n_requests FROM log GROUP BY 1) r
  LEFT JOIN (SELECT first // {ROUND_WIDTH} AS round, count(*) AS n_new FROM
               (SELECT entity_id, min(seq) AS first FROM clean GROUP BY entity_id) GROUP BY 1) f
  ON f.round = r.round
""", "log", extra=_CLEAN_EXTRA))
def q_first_seen(spark, sf):
    """First request number per entity of the clean pairs; new entities per request in each round."""
    log = roles.log(spark, sf)
    return ledger.yield_by_round(log, ledger.clean_pairs(ledger.parse_pairs(log), TG_LO, TG_HI), ROUND_WIDTH)


@query("pairs_per_request", with_roles(f"""
  SELECT v.task, avg(coalesce(c.k, 0)) AS items_per_answer FROM (SELECT * FROM log WHERE {_VALID_SQL}) v
  LEFT JOIN (SELECT seq, count(*) AS k FROM pairs GROUP BY seq) c ON c.seq = v.seq GROUP BY v.task
""", "log", extra=[("pairs", _PAIRS_SQL)]))
def q_pairs_per_request(spark, sf):
    """Mean object items per valid generation answer."""
    log = roles.log(spark, sf)
    valid = log.filter(ledger.pair_validity(log)).select("seq", "task")
    k = ledger.parse_pairs(log).groupBy("seq").agg(F.count(F.lit(1)).alias("k"))
    return valid.join(k, "seq", "left").groupBy("task").agg(F.avg(F.coalesce("k", F.lit(0))).alias("items_per_answer"))


@query("compute_hours", with_roles("""
  SELECT run_arm AS model, sum(val_mae) / 3600.0 AS hours FROM hist JOIN rm USING (run) GROUP BY run_arm
""", "hist", extra=[("rm", _HMAP)]))
def q_compute_hours(spark, sf):
    """Summed run seconds in hours per model (an epoch's value read as its seconds)."""
    from augeval.plans.q_eval import _hist_mapped
    return _hist_mapped(spark, sf).groupBy(F.col("run_arm").alias("model")).agg(
        (F.sum("val_mae") / 3600.0).alias("hours"))


@query("running_total", with_roles("""
  SELECT seq, sum(cost_usd) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_cost FROM log
""", "log"))
def q_running_total(spark, sf):
    """Cumulative cost in request order (prefix sum over levels of ranges, no single-partition window)."""
    return ledger.running_sum(roles.log(spark, sf).select("seq", "cost_usd"), "seq", "cost_usd", "cum_cost").select(
        "seq", "cum_cost")


@query("distinct_curve", with_roles("""
  SELECT seq, new_entities, CAST(sum(new_entities) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_distinct,
         CAST(sum(items) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_items
  FROM (SELECT l.seq, coalesce(n.k, 0) AS new_entities, coalesce(i.k, 0) AS items FROM log l
        LEFT JOIN (SELECT first AS seq, count(*) AS k FROM
                     (SELECT entity_id, min(seq) AS first FROM clean GROUP BY entity_id) GROUP BY first) n
          ON n.seq = l.seq
        LEFT JOIN (SELECT seq, count(*) AS k FROM pairs GROUP BY seq) i ON i.seq = l.seq)
""", "log", extra=_CLEAN_EXTRA))
def q_distinct_curve(spark, sf):
    """Cumulative distinct entities of the clean pairs by request number (steps with none included) beside the no-repeat ideal."""
    log = roles.log(spark, sf)
    # parsed once: the pairs are read for the items and, keyed, for the entities
    pairs = cut_lineage(ledger.parse_pairs(log), "pairs")
    c = ledger.yield_curve(log, ledger.clean_pairs(pairs, TG_LO, TG_HI), pairs)
    return c.select("seq", "new_entities", "cum_distinct", "cum_items")
