"""Quality rules as a bitmask ledger.

Every rule is evaluated once. The ledger stores one row a document: its measurements and ``bits``, where bit b is set if
rule b fails. A policy is a named version: a mask of the rules that it applies; changing a policy reads the ledger only.
Ablations come from bitwise aggregation of the distinct bit patterns (at most 2 to the number of rules).

Cases: a null or empty text has no words: all measurements 0, the rules on shares hold, ``few_words`` fails. Long texts are
whole. Rows are independent, so ties and repeated rows each get their own row; other columns are ignored; an empty
table gives an empty ledger."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augeval.llm.textops import ngram_hash, segment_sum, set_batches, span_hash, text_chunks, words_of

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
# Rule name -> SQL condition of a failure over the measurements; the order gives the bits.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "capitals": "2 * n_upper > n_upper + n_lower",
}
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "base": BASE,
    "v1": tuple(RULES),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower"]
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_LOWER = np.zeros(256, bool)
_IS_LOWER[97:123] = True


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _again(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes of one chunk: (equals an earlier one of its text, has an equal in its text)."""
    order = np.lexsort((h, doc))  # stable: equal ones stay in text order
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    any_equal = same.copy()
    any_equal[:-1] |= same[1:]
    later, twin = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order], twin[order] = same, any_equal
    return later, twin


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Measurements of the texts of a chunk."""
    docs = len(offs) - 1
    w = words_of(buf, offs)
    head = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=head[1:])
    out = {"n_words": np.diff(w.first), "word_chars": segment_sum(head[w.ends] - head[w.starts], w.first)}
    for name, table in (("n_symbols", _IS_SYMBOL), ("n_upper", _IS_UPPER), ("n_lower", _IS_LOWER)):
        out[name] = segment_sum(table[buf].astype(np.int64), offs)
    lines = words_of(buf, offs, _NEWLINE)
    inside = np.searchsorted(w.starts, lines.ends) > np.searchsorted(w.starts, lines.starts)
    ls, le, ld = lines.starts[inside], lines.ends[inside], lines.doc[inside]
    later, _ = _again(span_hash(buf, ls, le), ld)
    out["n_lines"] = np.bincount(ld, minlength=docs)
    out["n_dup_lines"] = np.bincount(ld[later], minlength=docs)
    grams = ngram_hash(span_hash(buf, w.starts, w.ends), WINDOW)
    own = w.doc[:len(grams)]
    at = np.flatnonzero(np.arange(len(grams)) + WINDOW <= w.first[1:][own]) if len(grams) else np.zeros(0, np.int64)
    _, twin = _again(grams[at], own[at])
    cover = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(cover, at[twin], 1)
    np.add.at(cover, at[twin] + WINDOW, -1)
    out["n_repeat_words"] = segment_sum((np.cumsum(cover)[:-1] > 0).astype(np.int64), w.first)
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, the measurements, bits."""
    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                m = measure(buf, offs)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *[pa.array(m[k].astype(np.int64)) for k in MEASURES]],
                                                 names=["doc_id", *MEASURES])
    set_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = d.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in MEASURES))
    failed = " + ".join(f"if({rule}, {bit(name)}L, 0L)" for name, rule in RULES.items())
    return rows.withColumn("bits", F.expr(failed))


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """Ledger rows plus base_failed and kept under a policy version; bits are compared, nothing is measured again."""
    return rows.withColumn("base_failed", F.col("bits").bitwiseAND(F.lit(mask("base"))) != 0) \
        .withColumn("kept", F.col("bits").bitwiseAND(F.lit(mask(policy) | mask("base"))) == 0)


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """One row a rule of the policy: documents that fail it, and those that only this rule removes."""
    m = mask(policy)
    patterns = rows.groupBy(F.col("bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).alias("bit")) for r in POLICIES[policy]])).alias("r")
    p = patterns.select("bits", "n", rules)
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return p.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"))
