"""The request ledger: response log scans, parsing, latest answers, cost, budget, resume plans, yield curves."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augeval.functions.keys import numeric_or_null, with_keys
from augeval.functions.text import is_object, label_fields, pair_items
from augeval.operators.curate import between, valid

LOG_SCHEMA = T.StructType([
    T.StructField("custom_id", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("task", T.StringType()),
    T.StructField("batch_id", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("stop_reason", T.StringType()),
    T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()),
    T.StructField("cost_usd", T.DoubleType()), T.StructField("text", T.StringType())])


# Timestamps keep microseconds in the JSON lines (zone-less for TIMESTAMP_NTZ).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
TS_NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def scan_log(spark, path: str, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """JSON-lines response log with a declared schema (no inference); every line is kept."""
    return (spark.read.schema(schema).option("timestampFormat", TS_FORMAT)
            .option("timestampNTZFormat", TS_NTZ_FORMAT).json(path))


def write_log(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("timestampFormat", TS_FORMAT).option("timestampNTZFormat", TS_NTZ_FORMAT).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append records as JSON lines (new files in the folder; earlier lines are never rewritten)."""
    write_log(df, path, "append")


def parse_pairs(log: DataFrame, keys: Sequence[str] = ("custom_id", "seq")) -> DataFrame:
    """One row per object item of each valid generation answer: keys, item, smiles, tg_celsius (double or null).
    Items that are not objects are skipped; absent fields are null."""
    items = log.select(*keys, pair_items(F.col("text")).alias("_items"))
    ex = items.select(*keys, F.posexplode("_items").alias("item", "_v")).filter(is_object(F.col("_v")))
    return ex.select(*keys, "item", F.try_variant_get("_v", "$.smiles", "string").alias("smiles"),
                     numeric_or_null(F.try_variant_get("_v", "$.tg_celsius", "string")).alias("tg_celsius"))


def pair_validity(log: DataFrame) -> Column:
    return pair_items(F.col("text")).isNotNull()


def parse_labels(log: DataFrame, keys: Sequence[str] = ("custom_id", "seq")) -> DataFrame:
    """One row per label answer: keys, echoed_smiles, tg_celsius (null when unparsable)."""
    echoed, value = label_fields(F.col("text"))
    return log.select(*keys, echoed.alias("echoed_smiles"), numeric_or_null(value).alias("tg_celsius"))


def invalid_count(log: DataFrame, by: Sequence[str] = ("task",)) -> DataFrame:
    """Responses and parse failures per group."""
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("n_responses"),
                                F.count_if(~pair_validity(log)).cast("bigint").alias("n_invalid"))


def clean_pairs(pairs: DataFrame, lo: float, hi: float, name: str = "smiles", value: str = "tg_celsius") -> DataFrame:
    """Parsed pairs that pass the rules (a numeric value in [lo, hi], a name with a key), with exact_key, alt_key and entity_id.

    Keys are computed once per distinct spelling and joined back."""
    p = between(pairs, value, lo, hi).where(F.col(name).isNotNull())
    keys = with_keys(p.select(name).distinct(), name)
    return valid(p.join(keys, name), "exact_key")


def first_requests(pairs: DataFrame, entity: str = "entity_id", order: str = "seq") -> DataFrame:
    """(entity, first): the first request number of every entity."""
    return pairs.groupBy(entity).agg(F.min(order).alias("first"))


def yield_by_round(requests: DataFrame, pairs: DataFrame, width: int, entity: str = "entity_id", order: str = "seq") -> DataFrame:
    """Per round of ``width`` request numbers: requests, entities first seen in it, and those per request."""
    f = first_requests(pairs, entity, order).groupBy(F.floor(F.col("first") / width).alias("round")).agg(F.count(F.lit(1)).alias("n_new"))
    r = requests.groupBy(F.floor(F.col(order) / width).alias("round")).agg(F.count(F.lit(1)).alias("n_requests"))
    j = r.join(f, "round", "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    return j.select("round", "n_requests", "n_new", (F.col("n_new") / F.col("n_requests")).alias("new_per_request"))


def yield_curve(requests: DataFrame, pairs: DataFrame, items: DataFrame, entity: str = "entity_id", order: str = "seq") -> DataFrame:
    """By request number (those that bring nothing included): new entities, distinct entities so far, and all items so far."""
    new = first_requests(pairs, entity, order).groupBy(F.col("first").alias(order)).agg(F.count(F.lit(1)).alias("new_entities"))
    n = items.groupBy(order).agg(F.count(F.lit(1)).alias("items"))
    steps = requests.select(order).join(new, order, "left").join(n, order, "left").fillna(0, ["new_entities", "items"])
    return running_sums(steps, order, {"new_entities": "cum_distinct", "items": "cum_items"})


def latest(log: DataFrame, id_col: str = "custom_id", order: Sequence[str] = ("ts", "seq"),
           cols: Sequence[str] = ("seq", "stop_reason")) -> DataFrame:
    """Last record per id wins (partial aggregation with ``max_by`` on an explicit order; no window)."""
    rec = F.struct(*[F.col(c) for c in cols])
    key = F.struct(*[F.col(c) for c in order])
    return log.groupBy(id_col).agg(F.max_by(rec, key).alias("_r")).select(id_col, "_r.*")


def request_grid(df: DataFrame, n_col: str, lists: Sequence[Sequence[str]], names: Sequence[str]) -> DataFrame:
    """Request number -> one item of each list, mixed radix (the first list turns fastest)."""
    out, radix = df, 1
    for lst, name in zip(lists, names):
        arr = F.array(*[F.lit(x) for x in lst])
        idx = (F.floor(F.col(n_col) / radix) % len(lst) + 1).cast("int")
        out = out.withColumn(name, F.element_at(arr, idx))
        radix *= len(lst)
    return out


def token_cost(input_tokens, output_tokens, batched, price_in: float = 2.0, price_out: float = 10.0,
               batch_factor: float = 0.5) -> Column:
    """USD from tokens; half price when batched. Exact decimal arithmetic, returned as double."""
    i = F.col(input_tokens).cast("decimal(20,0)")
    o = F.col(output_tokens).cast("decimal(20,0)")
    full = (i * F.lit(price_in).cast("decimal(10,4)") + o * F.lit(price_out).cast("decimal(10,4)")) / F.lit(1000000)
    f = F.when(F.col(batched), F.lit(batch_factor).cast("decimal(4,2)")).otherwise(F.lit(1).cast("decimal(4,2)"))
    return (full * f).cast("double")


def json_text(c) -> Column:
    """A string column as a JSON string literal in plain ASCII: short escapes, and \\uXXXX (UTF-16 units) for all else outside
    0x20-0x7E."""
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    short = F.create_map(*[F.lit(x) for pair in (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"),
                                                 ("\b", "\\b"), ("\f", "\\f")) for x in pair])

    def one(ch):
        code = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        units = F.when(F.length(code) == 8, F.concat(F.lit("\\u"), F.substring(code, 1, 4), F.lit("\\u"), F.substring(code, 5, 4))) \
            .otherwise(F.concat(F.lit("\\u"), code))
        return F.coalesce(F.try_element_at(short, ch), F.when(ch.rlike("[\\x20-\\x7E]"), ch).otherwise(units))
    plain = c.rlike(r'\A[\x20\x21\x23-\x5B\x5D-\x7E]*\z')
    body = F.when(plain, c).otherwise(F.array_join(F.transform(F.split(c, ""), one), ""))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def json_float(c) -> Column:
    """A double as JSON text in Python's form: shortest digits, positional from 1e-4 to below 1e16, else like 3e-05."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    size = F.abs(c)   # the fewest digits that give the number back
    written = [F.format_string(f"%.{k}E", size) for k in range(17)]
    s = F.coalesce(*[F.when(w.try_cast("double") == size, w) for w in written], size.cast("string"))
    mantissa = F.substring_index(s, "E", 1)
    power = F.coalesce(F.when(F.contains(s, F.lit("E")), F.substring_index(s, "E", -1).try_cast("int")), F.lit(0))
    whole, part = F.substring_index(mantissa, ".", 1), F.when(F.contains(mantissa, F.lit(".")), F.substring_index(mantissa, ".", -1)).otherwise(F.lit(""))
    digits = F.concat(whole, part)
    lead = F.length(digits) - F.length(F.ltrim(digits, F.lit("0")))
    d = F.rtrim(F.ltrim(digits, F.lit("0")), F.lit("0"))
    point = F.length(whole) + power - lead            # digits before the point
    n = F.length(d)
    positional = (F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), d))
                   .when(point >= n, F.concat(d, F.repeat(F.lit("0"), point - n), F.lit(".0")))
                   .otherwise(F.concat(F.substr(d, F.lit(1), point), F.lit("."), F.substr(d, point + 1))))
    e = point - 1
    sci = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise(F.lit("")),
                   F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    text = F.when(c == 0, F.lit("0.0")).when((e < -4) | (e >= 16), sci).otherwise(positional)
    text = F.concat(F.when((c < 0) | (c.cast("string") == "-0.0"), F.lit("-")).otherwise(F.lit("")), text)
    return (F.when(c.isNull(), F.lit("null")).when(F.isnan(c), F.lit("NaN")).when(c == float("inf"), F.lit("Infinity"))
             .when(c == float("-inf"), F.lit("-Infinity")).otherwise(text))


def json_int(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), F.lit("null")).otherwise(c.cast("bigint").cast("string"))


def settings_hash(settings: dict[str, Column]) -> Column:
    """First 12 hex digits of SHA-256 over the settings as sorted-key JSON text in the layout of Python's
    ``json.dumps(sort_keys=True)``: '{"a": 1, "b": "x"}'. Values are JSON texts (``json_text`` / ``json_int`` / ``json_float``)."""
    parts = []
    for i, k in enumerate(sorted(settings)):
        parts += [F.lit(("" if i == 0 else ", ") + f'"{k}": '), settings[k]]
    return F.substring(F.sha2(F.concat(F.lit("{"), *parts, F.lit("}")), 256), 1, 12)


def resume_plan(planned: DataFrame, ledger: DataFrame, id_col: str, current: str = "current_hash",
                stored: str = "stored_hash", published_hash: Column | None = None) -> DataFrame:
    """Planned runs against the finished-run ledger: 'run' (absent), 'skip' (same settings hash; a record without
    a hash counts as the published settings) or 'conflict'."""
    j = planned.join(ledger.select(id_col, stored, F.lit(True).alias("_done")), id_col, "left")
    eff = F.coalesce(F.col(stored), published_hash) if published_hash is not None else F.col(stored)
    action = F.when(F.col("_done").isNull(), "run").when(eff == F.col(current), "skip").otherwise("conflict")
    return j.withColumn("action", action).drop("_done")


RANGE_BITS = 16      # order keys of a range, as a power of two; four levels of ranges cover a long


def running_sums(df: DataFrame, order_col: str, sums: dict[str, str]) -> DataFrame:
    """Prefix sums in the order of a whole-number column: ``sums`` names an output for each value column.

    A scan over levels of ranges: the order key without its last 16 bits is a row's range, a range's range drops 16 more.
    A window holds one range (at most 65,536 order keys below, 65,536 ranges further up), and each level adds
    what stands before its range on the next, so nothing is ordered in one partition whatever the table's size."""
    vals = list(sums)
    upto = [F.sum(c) for c in vals]

    def before(ranges: DataFrame, level: int) -> DataFrame:
        """(_r, totals) -> (_r, what stands before each range)."""
        parent = F.shiftright("_r", RANGE_BITS) if level < 64 // RANGE_BITS - 1 else F.col("_r") % 1  # the last: one parent
        r = ranges.withColumn("_p", parent)
        w = Window.partitionBy("_p").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        out = r.select("_r", "_p", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_before_{c}") for c in vals])
        if level == 64 // RANGE_BITS - 1:
            return out.drop("_p")
        above = before(r.groupBy(F.col("_p").alias("_r")).agg(*[s.alias(c) for s, c in zip(upto, vals, strict=True)]), level + 1)
        above = above.select(F.col("_r").alias("_p"), *[F.col(f"_before_{c}").alias(f"_above_{c}") for c in vals])
        return out.join(above, "_p").select("_r", *[(F.col(f"_before_{c}") + F.col(f"_above_{c}")).alias(f"_before_{c}") for c in vals])

    d = df.withColumn("_r", F.shiftright(F.col(order_col).cast("long"), RANGE_BITS))
    offsets = before(d.groupBy("_r").agg(*[s.alias(c) for s, c in zip(upto, vals, strict=True)]), 1)
    w = Window.partitionBy("_r").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[F.sum(c).over(w).alias(f"_own_{c}") for c in vals]).join(offsets, "_r")
    return d.select(*df.columns, *[(F.col(f"_own_{c}") + F.col(f"_before_{c}")).alias(out) for c, out in sums.items()])


def running_sum(df: DataFrame, order_col: str, value_col: str, out: str) -> DataFrame:
    """``running_sums`` of one column."""
    return running_sums(df, order_col, {value_col: out})
