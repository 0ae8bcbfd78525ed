"""Mixing sources to target weights by a Pfair schedule. DataFrame functions only.

Every source is cut into blocks of ``block_docs`` documents. Weights are whole numbers n_i of slots in a cycle of ``cycle`` slots.
Block j of a source in a cycle (j = 1 .. n_i) may not run before slot floor((j - 1) * cycle / n_i) and must have run
by slot ceil(j * cycle / n_i). One slot runs one block: of the blocks released, the one with the earliest deadline (ties:
the smaller source name). All windows can be met, as the n_i add up to the cycle, so that while a source has blocks left its
count stays within one block of its share after every slot. A source that has run out leaves its slots empty; the
others keep their proportions. No document is dropped or repeated.

More than ``cycle`` sources get a longer cycle of G * ``cycle`` slots, SLOTS a source or more: the shares are laid end to end by source and
cut into G groups of ``cycle`` slots each; every group has its own cycle as above, and the groups take turns, so slot t of group g is
slot t * G + g, and windows are whole turns of G slots. A source that reaches over several groups has a piece in each, whose windows are those of
the piece. Up to ``cycle`` sources there is one group.

Only the cycle is scheduled step by step (a fold over ``cycle`` slots of a group's row, bounded by parameters); every document's slot
follows by arithmetic. Documents are numbered within a source by their md5 order: 4,096 md5 buckets a source, a
window in each bucket, and offsets from the bucket counts, so a hot source is spread over 4,096 windows.

Cases: a null source counts as the source named ''; a null id is numbered as the text 'null'; rows that repeat an id
are separate documents; an empty table gives no rows; other columns stay, but those named like
a column of the schedule give way to it."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augeval.session import cut_lineage

BLOCK_DOCS = 32
CYCLE = 1000
SLOTS = 10          # slots a source of a cycle of several groups, on average
BROADCAST_SLOTS = 100_000
ROOT_SCALE = 1000   # weights are floor(ROOT_SCALE * sqrt(documents of the source))


def weights(counts: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """(src, n) document counts -> (src, share): whole slots in a cycle, in proportion to the square root of n.

    One slot for each source, the rest by largest remainder (ties: the smaller name). A row a source, so few rows."""
    every, ranked = Window.partitionBy(), Window.orderBy(F.desc("rest"), "src")
    root = F.floor(F.sqrt(F.col("n").cast("double")) * ROOT_SCALE).cast("long")
    w = counts.select("src", root.alias("w")).withColumn("total", F.sum("w").over(every)) \
        .withColumn("k", F.count("*").over(every))
    free = F.lit(cycle) - F.col("k")
    w = w.withColumn("free", F.when(free >= 0, free).otherwise(F.raise_error(F.lit("more sources than slots in a cycle")).cast("long")))
    w = w.withColumn("base", 1 + F.expr("(w * free) div total")).withColumn("rest", F.expr("(w * free) % total"))
    w = w.withColumn("left", F.lit(cycle) - F.sum("base").over(every)).withColumn("rank", F.row_number().over(ranked))
    return w.select("src", (F.col("base") + (F.col("rank") <= F.col("left")).cast("long")).alias("share"))


def cycle_slots(shares: DataFrame, cycle: int = CYCLE, groups: int = 1) -> DataFrame:
    """(src, share) -> one row a slot of the cycle of ``groups`` * ``cycle`` slots: src, share, j, slot, release, deadline."""
    by = ["g"] if groups > 1 else []
    if by:
        upto = F.sum("share").over(Window.orderBy("src"))  # a row a source
        s = shares.withColumn("to", upto).withColumn("from", F.col("to") - F.col("share"))
        s = s.withColumn("g", F.explode(F.expr(f"sequence(`from` div {cycle}, (`to` - 1) div {cycle})")))
        shares = s.select("g", "src", F.expr(f"least(`to`, (g + 1) * {cycle}) - greatest(`from`, g * {cycle})").alias("share"))
    row = shares.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("src", "share"))).alias("s")).where("size(s) > 0")
    step = f"""
      aggregate(sequence(0, {cycle - 1}),
        named_struct('next', transform(s, x -> 1L), 'runs', cast(array() as array<struct<i:int,j:bigint>>)),
        (st, t) -> transform(array(array_min(transform(
            filter(sequence(0, size(s) - 1), i -> st.next[i] <= s[i].share
                   and ((st.next[i] - 1) * {cycle}) div s[i].share <= t),
            i -> named_struct('deadline', (st.next[i] * {cycle} + s[i].share - 1) div s[i].share, 'i', i)))),
          p -> named_struct('next', transform(st.next, (v, i) -> v + if(i = p.i, 1L, 0L)),
                            'runs', concat(st.runs, array(named_struct('i', p.i, 'j', st.next[p.i])))))[0]).runs"""
    slots = row.select(*by, "s", F.posexplode(F.expr(step)).alias("slot", "run"))
    out = slots.select(*by, F.expr("s[run.i].src").alias("src"), F.expr("s[run.i].share").alias("share"),
                       F.col("run.j").alias("j"), F.col("slot").cast("long").alias("slot"))
    out = out.withColumn("release", F.expr(f"((j - 1) * {cycle}) div share")) \
        .withColumn("deadline", F.expr(f"(j * {cycle} + share - 1) div share"))
    if by:
        out = out.select("src", *[(F.col(c) * groups + (F.col("g") if c == "slot" else 0)).alias(c) for c in ("slot", "release", "deadline")])
        out = out.withColumn("share", F.count("*").over(Window.partitionBy("src"))) \
            .withColumn("j", F.row_number().over(Window.partitionBy("src").orderBy("slot")).cast("long"))
    return out.select("src", "share", "j", "slot", "release", "deadline")


def schedule(docs: DataFrame, block_docs: int = BLOCK_DOCS, cycle: int = CYCLE) -> DataFrame:
    """All columns and rows of ``docs`` (doc_id, source) plus block, slot, release, deadline, place (order in the block)."""
    names = [c for c in docs.columns]
    hidden = ["_src", "_md5", "_bucket", "_content", "_from", "_n", "_j"]
    if set(hidden) & set(names):
        raise ValueError(f"columns {hidden} are used by the schedule")
    out_names = ["block", "slot", "release", "deadline", "place"]
    d = docs.select([c for c in names if c not in out_names]) \
        .withColumn("_src", F.coalesce(F.col("source").cast("string"), F.lit(""))) \
        .withColumn("_md5", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))) \
        .withColumn("_bucket", F.conv(F.substring("_md5", 1, 3), 16, 10).cast("int")) \
        .withColumn("_content", F.xxhash64(*[c for c in names if c not in ("doc_id", *out_names)]))
    counts = cut_lineage(d.groupBy("_src", "_bucket").agg(F.count("*").alias("_n")), "mixing-counts")
    n_src = counts.select("_src").distinct().count()
    groups = 1 if n_src <= cycle else -(-SLOTS * n_src // cycle)
    turn = groups * cycle
    upto = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_from", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    table = cycle_slots(weights(counts.groupBy(F.col("_src").alias("src")).agg(F.sum("_n").alias("n")), turn), cycle, groups)
    if groups > 1:
        table = cut_lineage(table, "mixing-cycle")
    small = F.broadcast if turn <= BROADCAST_SLOTS else lambda t: t
    within = Window.partitionBy("_src", "_bucket").orderBy("_md5", "doc_id", "_content")
    n = d.join(starts.drop("_n"), ["_src", "_bucket"]) \
        .withColumn("_n", F.col("_from") + F.row_number().over(within) - 1) \
        .withColumn("block", F.expr(f"_n div {block_docs}")).withColumn("place", F.expr(f"_n % {block_docs}"))
    shares = table.groupBy("src").agg(F.max("share").alias("share"))
    # Both are bounded by the cycle: at most one row a slot.
    n = n.join(small(shares.select(F.col("src").alias("_src"), F.col("share").alias("_share"))), "_src")
    n = n.withColumn("_j", F.expr("block % _share + 1")).withColumn("_turn", F.expr("block div _share"))
    t = table.select(F.col("src").alias("_src"), F.col("j").alias("_j"), F.col("slot").alias("_slot"),
                     F.col("release").alias("_release"), F.col("deadline").alias("_deadline"))
    n = n.join(small(t), ["_src", "_j"])
    start = F.col("_turn") * turn
    return n.select(*[c for c in names if c not in out_names], "block", (start + F.col("_slot")).alias("slot"),
                    (start + F.col("_release")).alias("release"), (start + F.col("_deadline")).alias("deadline"), "place")
