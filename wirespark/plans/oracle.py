"""The queries' SQL for DuckDB, written apart from the Spark expressions."""

from __future__ import annotations


def nbit(v: str, n: str | int) -> str:
    return f"CASE WHEN ({n}) <= 0 THEN '' ELSE lpad(bin(CAST({v} AS BIGINT)), CAST({n} AS INTEGER), '0') END"


def width(n: str) -> str:
    return f"CASE WHEN ({n}) <= 1 THEN 0 ELSE length(bin(CAST(({n}) - 1 AS BIGINT))) END"


def uint(n: str) -> str:
    n = f"CAST({n} AS BIGINT)"
    k = f"((length(bin({n})) + 6) // 7)"
    return f"array_to_string(list_transform(range(0, {k}), lambda i: lpad(bin((({n} >> CAST(7 * i AS BIGINT)) & 127) + CASE WHEN i < {k} - 1 THEN 128 ELSE 0 END), 8, '0')), '')"


def sint(n: str) -> str:
    return f"(CASE WHEN ({n}) < 0 THEN '1' ELSE '0' END || {uint(f'(CASE WHEN ({n}) < 0 THEN -({n}) - 1 ELSE ({n}) END)')})"


def codes(s: str) -> str:
    return f"coalesce(array_to_string(list_transform(string_split({s}, ''), lambda c: {uint('unicode(c)')}), ''), '')"


def text(s: str, more: int = 0) -> str:
    return f"({uint(f'length({s}) + {more}')} || {codes(s)})"


def collapse(s: str) -> str:
    return f"trim(regexp_replace(regexp_replace({s}, '[\\t\\n\\r]', ' ', 'g'), ' +', ' ', 'g'), ' ')"


def packed(bits: str) -> str:
    """Hexadecimal text of a bit string filled up with zeros."""
    even = f"rpad({bits}, CAST((length({bits}) + 7) // 8 * 8 AS INTEGER), '0')"
    bit = lambda k: f"CAST(substr({even}, i + {k}, 1) AS INTEGER) * {1 << (3 - k)}"
    return f"array_to_string(list_transform(range(1, length({even}), 4), lambda i: upper(to_hex({' + '.join(bit(k) for k in range(4))}))), '')"


def charset(s: str, members: str) -> str:
    n = len(members)
    at = f"list_position([{', '.join(f'chr({ord(c)})' for c in members)}], c)"
    return f"array_to_string(list_transform(string_split({s}, ''), lambda c: CASE WHEN {at} > 0 THEN {nbit(f'{at} - 1', n.bit_length())} ELSE {nbit(str(n), n.bit_length())} || {uint('unicode(c)')} END), '')"


STRINGS = "SELECT conv_id AS doc_id, 2 * turn AS seq, 'role' AS ctx, role AS value FROM conversations UNION ALL SELECT conv_id, 2 * turn + 1, 'text', text FROM conversations"


def table(source: str) -> str:
    """Value table over a relation (doc_id, seq, ctx, value)."""
    return f"""
WITH v AS ({source}),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY seq) AS n, first_value(ctx) OVER (PARTITION BY doc_id, value ORDER BY seq) AS first_ctx FROM v),
g AS (SELECT *, CASE WHEN n = 1 AND value <> '' THEN 1 ELSE 0 END AS new FROM f),
s AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gs,
  coalesce(sum(new) OVER (PARTITION BY doc_id, ctx ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ls FROM g),
t AS (SELECT doc_id, seq, ctx, value, CASE WHEN n = 1 OR value = '' THEN 'miss' WHEN first_ctx IS NOT DISTINCT FROM ctx THEN 'local' ELSE 'global' END AS hit,
  CAST(gs AS BIGINT) AS global_size, CAST(ls AS BIGINT) AS local_size, CAST(first_value(gs) OVER w AS BIGINT) AS global_id, CAST(first_value(ls) OVER w AS BIGINT) AS local_id
  FROM s WINDOW w AS (PARTITION BY doc_id, value ORDER BY seq))
"""


VALUE_BITS = f"CASE hit WHEN 'local' THEN '00000000' || {nbit('local_id', width('local_size'))} WHEN 'global' THEN '00000001' || {nbit('global_id', width('global_size'))} ELSE {uint('length(value) + 2')} || {codes('value')} END"


def events(relation: str, key: str, root: str, fields: list[str]) -> str:
    """Event rows of a table whose fields aren't null."""
    rows = ["(0, 'SD', NULL, NULL)", f"(1, 'SE', '{root}', NULL)"]
    for i, f in enumerate(fields):
        rows += [f"({2 + 3 * i}, 'SE', '{f}', NULL)", f"({3 + 3 * i}, 'CH', NULL, CAST({f} AS VARCHAR))", f"({4 + 3 * i}, 'EE', '{f}', NULL)"]
    k = 2 + 3 * len(fields)
    rows += [f"({k}, 'EE', '{root}', NULL)", f"({k + 1}, 'ED', NULL, NULL)"]
    return " UNION ALL ".join(f"SELECT CAST({key} AS BIGINT) AS doc_id, CAST({x[0]} AS BIGINT) AS seq, {x[1]} AS event, {x[2]} AS local, {x[3]} AS value FROM {relation}" for x in (r[1:-1].split(", ", 3) for r in rows))


#: The bounded value table (4 values of at most 200 characters), row after row: values, their contexts and places, the next slot.
BOUNDED = f"""
WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM ({STRINGS})),
r AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS ctx, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS hit, CAST(-1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS size,
    CAST([] AS VARCHAR[]) AS vals, CAST([] AS VARCHAR[]) AS own, CAST([] AS BIGINT[]) AS place, CAST(0 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS n_role, CAST(0 AS BIGINT) AS n_text FROM (SELECT DISTINCT doc_id FROM v)
  UNION ALL
  SELECT doc_id, k, seq, ctx, value,
    CASE WHEN spot IS NULL THEN 'miss' WHEN own[spot] = ctx THEN 'local' ELSE 'global' END,
    CAST(CASE WHEN spot IS NULL THEN -1 WHEN own[spot] = ctx THEN place[spot] ELSE spot - 1 END AS BIGINT),
    CAST(CASE WHEN spot IS NULL THEN 0 WHEN own[spot] = ctx THEN (CASE ctx WHEN 'role' THEN n_role ELSE n_text END) ELSE len(vals) END AS BIGINT),
    CASE WHEN NOT new THEN vals WHEN len(vals) < 4 THEN list_append(vals, value) ELSE list_transform(vals, lambda x, i: CASE WHEN i = slot + 1 THEN value ELSE x END) END,
    CASE WHEN NOT new THEN own WHEN len(vals) < 4 THEN list_append(own, ctx) ELSE list_transform(own, lambda x, i: CASE WHEN i = slot + 1 THEN ctx ELSE x END) END,
    CASE WHEN NOT new THEN place WHEN len(vals) < 4 THEN list_append(place, n) ELSE list_transform(place, lambda x, i: CASE WHEN i = slot + 1 THEN n ELSE x END) END,
    CAST(CASE WHEN new THEN (slot + 1) % 4 ELSE slot END AS BIGINT), CAST(n_role + (new AND ctx = 'role')::INT AS BIGINT), CAST(n_text + (new AND ctx = 'text')::INT AS BIGINT)
  FROM (SELECT r.doc_id, v.k, v.seq, v.ctx, v.value, r.vals, r.own, r.place, r.slot, r.n_role, r.n_text, CASE v.ctx WHEN 'role' THEN r.n_role ELSE r.n_text END AS n, nullif(list_position(r.vals, v.value), 0) AS spot,
    coalesce(list_position(r.vals, v.value), 0) = 0 AND v.value <> '' AND length(v.value) <= 200 AS new FROM r JOIN v ON v.doc_id = r.doc_id AND v.k = r.k + 1))
SELECT doc_id, seq, ctx, value, hit, id, size FROM r WHERE k > 0
"""
