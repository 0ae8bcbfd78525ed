"""The role tables as DuckDB SQL (common table expressions), for the oracle side of every check.

Each entry mirrors a function of ``roles``; ``with_roles(sql, ...)`` prepends the CTEs a statement needs.
"""
from __future__ import annotations

ROLE_SQL: dict[str, str] = {}
ROLE_DEPS: dict[str, list[str]] = {}


def role(name: str, sql: str, deps: list[str] | None = None) -> None:
    ROLE_SQL[name] = sql
    ROLE_DEPS[name] = deps or []


role("obs", r"""
  SELECT order_key, line_no, part_key,
         CASE WHEN reliability = 'R' THEN upper(array_to_string(toks, '  ')) ELSE array_to_string(toks, ' ') END AS raw_key,
         value_text, n_points, reliability, source, class
  FROM (
    SELECT l_orderkey AS order_key, l_linenumber AS line_no, l_partkey AS part_key,
           CASE WHEN _n = 2 THEN _t ELSE list_concat(_t[(l_linenumber % _n) + 1 : _n], _t[1 : l_linenumber % _n]) END AS toks,
           CASE WHEN l_linenumber = 7 AND l_discount = 0.1 THEN 'n/a'
                ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) END AS value_text,
           CAST(l_quantity AS INTEGER) AS n_points, l_returnflag AS reliability, l_linestatus AS source, p_type AS class
    FROM (
      SELECT *, len(_t) AS _n FROM (
        SELECT l.*, p.p_type,
               list_concat(string_split(lower(p.p_name), ' '),
                           CASE WHEN p.p_size % 5 = 0 THEN [] ELSE [lower(p.p_brand), lower(p.p_type)] END,
                           CASE WHEN l.l_returnflag <> 'A' AND l.l_partkey % 10 < 3 THEN [lower(l.l_linestatus)] ELSE [] END) AS _t
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)))
""")

# keys: exact = collapsed blanks, trimmed, lower; alt = min rotation of tokens or reversed tokens (3+ tokens, no '.')
KEYED = r"""
  SELECT *, coalesce('R:' || alt_key, 'E:' || exact_key) AS entity_id FROM (
    SELECT *, CASE WHEN exact_key IS NOT NULL AND len(string_split(exact_key, ' ')) >= 3 AND NOT contains(exact_key, '.') THEN
                list_min(list_concat(
                  list_transform(range(len(string_split(exact_key, ' '))), lambda i:
                    array_to_string(list_concat(string_split(exact_key, ' ')[i + 1 : len(string_split(exact_key, ' '))],
                                                string_split(exact_key, ' ')[1 : i]), ' ')),
                  list_transform(range(len(string_split(exact_key, ' '))), lambda i:
                    array_to_string(list_concat(list_reverse(string_split(exact_key, ' '))[i + 1 : len(string_split(exact_key, ' '))],
                                                list_reverse(string_split(exact_key, ' '))[1 : i]), ' '))))
              END AS alt_key
    FROM (SELECT *, nullif(lower(trim(regexp_replace({raw}, '\s+', ' ', 'g'))), '') AS exact_key FROM {src}))
"""

NUMERIC = r"""CASE WHEN regexp_full_match(CAST({c} AS VARCHAR), '\s*[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?\s*')
               THEN TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE) END"""


def keyed(src: str, raw: str = "raw_key") -> str:
    return KEYED.format(src=src, raw=raw)


def numeric(c: str) -> str:
    return NUMERIC.format(c=c)


def md5_bucket(c: str, buckets: int = 100) -> str:
    return f"(CAST(('0x' || substr(md5(CAST({c} AS VARCHAR)), 1, 8)) AS BIGINT) % {buckets})"


# obs with keys and numeric value, the rows that pass rules 1-4 are flagged by the callers
role("obs_keyed", f"SELECT *, {numeric('value_text')} AS value FROM ({keyed('obs')})", ["obs"])
role("obs_valid", """
  SELECT * FROM obs_keyed WHERE value IS NOT NULL AND exact_key IS NOT NULL AND value BETWEEN 1000.0 AND 100000.0
""", ["obs_keyed"])
role("merged", """
  SELECT reliability AS flag, entity_id, min(exact_key) AS smiles, median(value) AS value
  FROM obs_valid GROUP BY reliability, entity_id
""", ["obs_valid"])
role("real", f"""
  SELECT entity_id, smiles, value, alt_key, split FROM (
    SELECT m.entity_id, m.smiles, m.value, k.alt_key,
           CASE WHEN b < 10 THEN 'test' WHEN b < 14 THEN 'validation' ELSE 'train' END AS split
    FROM (SELECT *, {md5_bucket('entity_id')} AS b FROM merged WHERE flag = 'A') m
    JOIN (SELECT DISTINCT exact_key, alt_key FROM obs_keyed) k ON k.exact_key = m.smiles)
  WHERE split IS NOT NULL
""", ["merged", "obs_keyed"])
role("syn", """
  SELECT CASE flag WHEN 'N' THEN 'generated' ELSE 'labeled' END AS synthetic_set, entity_id, smiles, value
  FROM merged WHERE flag IN ('N', 'R')
""", ["merged"])

role("log", r"""
  SELECT printf('req_%04d_%s', user_id, event_type) AS custom_id, event_id AS seq, ts, event_type AS task,
         batch_id, strftime(ts, '%Y-%m-%d') AS date, 'model-a' AS model,
         CASE WHEN value > 200 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason,
         k AS input_tokens, out_tok AS output_tokens,
         CAST(k * 2 + out_tok * 10 AS DOUBLE) * (CASE WHEN batch_id IS NOT NULL THEN 0.5 ELSE 1.0 END)::DOUBLE / 1000000.0::DOUBLE AS cost_usd,
         CASE event_id % 5
           WHEN 0 THEN '```json' || chr(10) || '[' || obj1 || ', ' || '{"smiles": "' || nm || ' b", "tg_celsius": "' || CAST(k AS VARCHAR) || '"}' || ']' || chr(10) || '```'
           WHEN 1 THEN 'Answer: ' || obj1
           WHEN 2 THEN '{"smiles": "C' || chr(92) || 'C' || nm || '", "tg_celsius": ' || v || '}'
           WHEN 3 THEN 'I cannot give a reliable value for this one.'
           ELSE '[' || obj1 || ', 7]' END AS text
  FROM (
    SELECT *, '{"smiles": "' || nm || '", "tg_celsius": ' || v || '}' AS obj1 FROM (
      SELECT *, 'u' || CAST(user_id AS VARCHAR) || ' ' || event_type AS nm,
             CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) AS v,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
             CAST(floor(value * 10) AS BIGINT) AS out_tok,
             CASE WHEN event_type <> 'error' THEN 'b' || strftime(ts, '%Y%m%d') END AS batch_id
      FROM events))
""")

role("preds", """
  SELECT l_returnflag AS run, l_linenumber AS seed, l_partkey AS entity, avg(l_extendedprice) AS y_true,
         avg(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS y_pred
  FROM lineitem GROUP BY l_returnflag, l_linenumber, l_partkey
""")

role("hist", """
  SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS epoch,
         value AS val_mae, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS test_mae, event_type AS arm, event_id
  FROM events
""")

role("bits", """
  SELECT vec_id, list_filter(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN i - 1 END), lambda b: b IS NOT NULL) AS bits,
         label, vec_id % 5 = 0 AS is_query
  FROM embeddings
""")

role("docs", "SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in ROLE_DEPS[n]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_roles(sql: str, *names: str, extra: list[tuple[str, str]] | None = None, recursive: bool = False) -> str:
    """``WITH`` the named roles (and their dependencies), then optional extra CTEs (``recursive``: some refer to themselves), then ``sql``."""
    ctes = [f"{n} AS ({ROLE_SQL[n]})" for n in _order(list(names))]
    ctes += [f"{n} AS ({s})" for n, s in (extra or [])]
    return ("WITH " + "RECURSIVE " * recursive + ",\n".join(ctes) + "\n" + sql) if ctes else sql

role("syn_keyed", """
  SELECT s.*, s.smiles AS exact_key, k.alt_key FROM syn s
  JOIN (SELECT DISTINCT exact_key, alt_key FROM obs_keyed) k ON k.exact_key = s.smiles
""", ["syn", "obs_keyed"])
role("matched", """
  SELECT s.synthetic_set, s.entity_id,
    CASE WHEN EXISTS (SELECT 1 FROM real r WHERE r.split = 'test' AND r.smiles = s.exact_key) THEN 'exact'
         WHEN EXISTS (SELECT 1 FROM real r WHERE r.split = 'test' AND r.alt_key = s.alt_key) THEN 'alt' END AS test_match,
    CASE WHEN EXISTS (SELECT 1 FROM real r WHERE r.split = 'validation' AND r.smiles = s.exact_key) THEN 'exact'
         WHEN EXISTS (SELECT 1 FROM real r WHERE r.split = 'validation' AND r.alt_key = s.alt_key) THEN 'alt' END AS validation_match
  FROM syn_keyed s
""", ["syn_keyed", "real"])


def avg_rank_sql(value: str, part: str) -> str:
    """Tie-averaged rank as a window expression (the oracle may use plain windows)."""
    p = f"PARTITION BY {part}" if part else ""
    return (f"(rank() OVER ({p} ORDER BY {value}) + (count(*) OVER ({p}{', ' if part else 'PARTITION BY '}{value}) - 1) / 2.0)")


def corr_sql(x: str, y: str) -> str:
    return (f"CASE WHEN var_pop({x}) > 0 AND var_pop({y}) > 0 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END")
