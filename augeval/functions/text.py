"""Response-text parsing and formatting as Column expressions (JSON via VARIANT; no Python parser per row)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the number pattern read after the value field when a label answer is not valid JSON.
LABEL_NUMBER_PATTERN = r'"tg_celsius"\s*:\s*(-?\d+(?:\.\d+)?)'


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def first_last_slice(text, open_ch: str, close_ch: str) -> Column:
    """Text from the first ``open_ch`` to the last ``close_ch``; null when either is missing or out of order."""
    t = _col(text)
    start = F.instr(t, open_ch)
    after_last = F.substring_index(t, close_ch, -1)          # text after the last close_ch (all of t if none)
    last = F.length(t) - F.length(after_last)                 # 1-based position of the last close_ch, 0 if none
    ok = (start > 0) & (last > 0) & (last >= start)
    return F.when(ok, t.substr(start, last - start + 1))


def strict_json(body) -> Column:
    """Parse a text that must hold exactly ONE JSON value (null otherwise).

    ``parse_json`` stops after the first complete value and ignores what follows ('{..}, {..}' parses); inside
    brackets the same text must be a one-element array, so trailing content makes it invalid, as for a strict
    parser."""
    wrapped = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), _col(body), F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(wrapped) == 1, F.element_at(wrapped, 1))


def pair_items(text) -> Column:
    """Generation answer -> array<variant> of its items, or null when the answer is invalid (no brackets or
    not valid JSON between them). Non-object items stay in the array and are dropped by the caller."""
    body = first_last_slice(text, "[", "]")
    return F.try_variant_get(strict_json(body), "$", "array<variant>")


def is_object(v) -> Column:
    return F.schema_of_variant(_col(v)).startswith("OBJECT")


def label_fields(text) -> tuple[Column, Column]:
    """Label answer -> (echoed text, value text). Valid JSON object between the first '{' and the last '}': its
    fields; malformed JSON: the number after the value field by pattern, echo null; no braces: both null."""
    body = first_last_slice(text, "{", "}")
    parsed = strict_json(body)
    obj = parsed.isNotNull() & is_object(parsed)
    raw = F.regexp_extract(_col(text), LABEL_NUMBER_PATTERN, 1)
    echoed = F.when(obj, F.try_variant_get(parsed, "$.smiles", "string"))
    value = (F.when(obj, F.try_variant_get(parsed, "$.tg_celsius", "string"))
              .when(body.isNotNull() & (raw != ""), raw))
    return echoed, value


def signed_fixed(x, digits: int = 2) -> Column:
    """Signed fixed-point text ('+1.25', '-0.40'); zero has no sign. Half-even rounding before formatting."""
    r = F.bround(_col(x), digits)
    body = F.format_string(f"%.{digits}f", F.abs(r))
    return F.when(r > 0, F.concat(F.lit("+"), body)).when(r < 0, F.concat(F.lit("-"), body)).otherwise(body)


def p_text(p, floor: float = 0.001, digits: int = 3) -> Column:
    """p-value text: '<0.001' below the floor, else fixed-point."""
    p = _col(p)
    return F.when(p.isNull(), F.lit("")).when(p < floor, F.lit(f"<{floor:g}")).otherwise(
        F.format_string(f"%.{digits}f", F.bround(p, digits)))


def mean_sd_text(m, s, digits: int = 2) -> Column:
    """'m ± s' with half-even rounding."""
    return F.format_string(f"%.{digits}f ± %.{digits}f", F.bround(_col(m), digits), F.bround(_col(s), digits))
