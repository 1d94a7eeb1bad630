"""Queries of grammars: transitions, second levels, representations."""

from __future__ import annotations

from wirespark.operators import grammar as G
from wirespark.operators import representation as R
from wirespark.plans import oracle as O
from wirespark.plans.registry import query, table
from wirespark.sources.codec import Options


def _columns(table_name: str) -> str:
    """(place, name) of a table's columns in SQL."""
    return f"SELECT CAST(ordinal_position - 1 AS BIGINT) AS i, column_name AS c FROM information_schema.columns WHERE table_name = '{table_name}'"


@query(f"""WITH c AS ({_columns('orders')}), n AS (SELECT count(*) AS n FROM c), s AS (SELECT CAST(unnest(range(0, n + 1)) AS BIGINT) AS state, n FROM n), w AS (SELECT state, n, CAST(unnest(range(state, n + 1)) AS BIGINT) AS too FROM s)
SELECT 'order' AS grammar, state, CAST(too - state AS BIGINT) AS code, CAST({O.width('n + 1 - state')} AS BIGINT) AS width, CASE WHEN too = n THEN 'EE' ELSE 'SE' END AS event, c.c AS local, CASE WHEN too < n THEN too + 1 END AS next FROM w LEFT JOIN c ON c.i = w.too""")
def strict_transitions(spark, d):
    """The strict grammar of a table's rows: all its columns are optional."""
    return G.transitions(spark, table(spark, d, "orders").schema, "order")


def _transitions(strict: bool) -> str:
    """All columns optional and simple, so states are known: right after the start (-1) and in the start tag (0) as in the content (1000 + 2 i)."""
    escape = "0" if strict else "1"
    second = "0" if strict else "CASE phase WHEN 'first' THEN 6 WHEN 'start' THEN 4 ELSE 2 END"
    simple = "0" if strict else "CASE phase WHEN 'first' THEN 7 - ends WHEN 'start' THEN 5 - ends ELSE 3 - ends END"
    empty = "0" if strict else "CASE phase WHEN 'first' THEN 6 WHEN 'start' THEN 4 ELSE 2 END"
    return f"""WITH c AS ({_columns('nation')}), n AS (SELECT count(*) AS n FROM c),
s AS (SELECT -1 AS state, 0 AS i, 'first' AS phase, n FROM n UNION ALL SELECT 0, 0, 'start', n FROM n UNION ALL SELECT 1000 + 2 * i, i, 'content', n FROM (SELECT unnest(range(0, n + 1)) AS i, n FROM n)),
w AS (SELECT *, unnest(range(i, n + 1)) AS too FROM s),
top AS (SELECT 'nation' AS grammar, state, phase, too - w.i AS code, n + 1 - w.i + {escape} AS ways, CASE WHEN too = n THEN 'EE' ELSE 'SE' END AS event, c.c AS local, CASE WHEN too < n THEN 1000 + 2 * (too + 1) END AS next, {second} AS second FROM w LEFT JOIN c ON c.i = w.too),
done AS (SELECT 'nation' AS grammar, 999 AS state, 'content' AS phase, 0 AS code, 1 + {escape} AS ways, 'EE' AS event, NULL AS local, CAST(NULL AS BIGINT) AS next, {'0' if strict else '2'} AS second),
fields AS (SELECT 'nation/' || c AS g FROM c),
leaf AS (SELECT g AS grammar, state, phase, 0 AS code, 1 + {escape} AS ways, CASE WHEN state = 999 THEN 'EE' ELSE 'CH' END AS event, NULL AS local, CASE WHEN state <> 999 THEN 999 END AS next, {simple.replace('ends', '(state = 999)::INT')} AS second FROM fields, (VALUES (-1, 'first'), (0, 'start'), (1000, 'content'), (999, 'content')) p(state, phase)),
nil AS (SELECT g || '#nil' AS grammar, state, phase, 0 AS code, 1 + {escape} AS ways, 'EE' AS event, NULL AS local, NULL AS next, {empty} AS second FROM (SELECT g FROM fields UNION ALL SELECT 'nation'), (VALUES (-1, 'first'), (0, 'start'), (1000, 'content')) p(state, phase))
SELECT grammar, CAST(state AS BIGINT) AS state, phase, CAST(code AS BIGINT) AS code, CAST({O.width('ways')} AS BIGINT) AS width, event, local, CAST(next AS BIGINT) AS next, CAST(second AS BIGINT) AS second FROM (SELECT * FROM top UNION ALL SELECT * FROM done UNION ALL SELECT * FROM leaf UNION ALL SELECT * FROM nil)"""


@query(_transitions(False))
def schema_transitions(spark, d):
    """The grammars of a table's rows that aren't strict: first level, and how much stands behind the escape."""
    return G.schema_transitions(spark, table(spark, d, "nation").schema, "nation", Options())


@query(_transitions(True))
def schema_transitions_strict(spark, d):
    return G.schema_transitions(spark, table(spark, d, "nation").schema, "nation", Options(strict=True))


_MISC = "CASE WHEN comments OR pis THEN ['CM/PI'] ELSE [] END"
_INNER = f"['SE', 'CH'] || CASE WHEN dtd THEN ['ER'] ELSE [] END || {_MISC}"
_NS_SC = "CASE WHEN prefixes THEN ['NS'] ELSE [] END || CASE WHEN self_contained THEN ['SC'] ELSE [] END"
_EE = "CASE WHEN has_end THEN [] ELSE ['EE'] END"


@query(f"""WITH b AS (SELECT false AS x UNION ALL SELECT true), o AS (SELECT b1.x AS has_end, b2.x AS castable, b3.x AS nillable, b4.x AS strict, b5.x AS dtd, b6.x AS prefixes, b7.x AS self_contained, b8.x AS comments, b9.x AS pis
FROM b b1, b b2, b b3, b b4, b b5, b b6, b b7, b b8, b b9 WHERE NOT (b4.x AND (b5.x OR b6.x OR b7.x OR b8.x OR b9.x))),
g AS (SELECT *, unnest(['first', 'start', 'content', 'built-in start', 'built-in content', 'document', 'fragment', 'end']) AS grammar FROM o),
l AS (SELECT *, CASE grammar WHEN 'document' THEN CASE WHEN dtd THEN ['DT'] ELSE [] END || {_MISC} WHEN 'fragment' THEN {_MISC} WHEN 'end' THEN {_MISC}
WHEN 'first' THEN CASE WHEN strict THEN (CASE WHEN castable THEN ['xsi:type', 'xsi:nil'] WHEN nillable THEN ['xsi:nil'] ELSE [] END) ELSE {_EE} || ['xsi:type', 'xsi:nil', 'AT', 'AT-BAD'] || {_NS_SC} || {_INNER} END
WHEN 'start' THEN CASE WHEN strict THEN [] ELSE {_EE} || ['AT', 'AT-BAD'] || {_INNER} END WHEN 'content' THEN CASE WHEN strict THEN [] ELSE {_EE} || {_INNER} END
WHEN 'built-in start' THEN ['EE', 'AT'] || {_NS_SC} || {_INNER} ELSE {_INNER} END AS events FROM g),
e AS (SELECT *, unnest(range(0, len(events))) AS code FROM l), t AS (SELECT *, CASE WHEN events[code + 1] <> 'CM/PI' THEN [events[code + 1]] ELSE (CASE WHEN comments THEN ['CM'] ELSE [] END || CASE WHEN pis THEN ['PI'] ELSE [] END) END AS names FROM e)
SELECT grammar, has_end, castable, nillable, strict, dtd, prefixes, self_contained, comments, pis, CAST(code AS BIGINT) AS code, CAST({O.width('len(events)')} AS BIGINT) AS width, names[i] AS event, CASE WHEN events[code + 1] = 'CM/PI' THEN CAST(i - 1 AS BIGINT) END AS third FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM t)""")
def second_levels(spark, d):
    return G.second_levels(spark)


_TYPES = {"string": ["string", "anySimpleType", "normalizedString", "token", "language", "Name", "NMTOKEN", "NCName", "ID", "IDREF", "ENTITY", "anyURI", "QName", "NOTATION", "duration", "IDREFS", "ENTITIES", "NMTOKENS"], "integer": ["integer", "long", "int", "short", "negativeInteger", "nonPositiveInteger"], "double": ["float", "double"]}
_OWN = ["byte", "unsignedByte", "nonNegativeInteger", "positiveInteger", "unsignedLong", "unsignedInt", "unsignedShort", "base64Binary", "hexBinary", "boolean", "dateTime", "time", "date", "gYearMonth", "gYear", "gMonthDay", "gDay", "gMonth", "decimal"]


@query("SELECT t AS type, r AS representation, CASE r WHEN 'integer' THEN 'decimal' ELSE CASE WHEN t IN ('byte', 'unsignedByte', 'nonNegativeInteger', 'positiveInteger', 'unsignedLong', 'unsignedInt', 'unsignedShort') THEN 'decimal' ELSE r END END AS changed FROM (VALUES " + ", ".join([*(f"('{t}', '{r}')" for r, ts in _TYPES.items() for t in ts), *(f"('{t}', '{t}')" for t in _OWN)]) + ") v(t, r)")
def representations(spark, d):
    """Representations of the built-in types, by default and under a map that makes integers decimals."""
    names = [*R.DEFAULTS, *R.BASES]
    return spark.createDataFrame([(n, R.resolve(n, {}), R.resolve(n, {"integer": "decimal"})) for n in names], "type string, representation string, changed string")
