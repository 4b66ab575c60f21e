"""DuckDB SQL for the rows of registered queries, where SQL can express them.

These are plain readings of the contracts, not of the operators: all windows, all pairs,
all matches.
"""

from __future__ import annotations

SUBSTRINGS = """
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS nr, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT nr, s, substr(h, 2 * s + 1, 200) AS t FROM (SELECT nr, h, unnest(range(greatest(length(h) // 2 - 99, 0))) AS s FROM d)
), r AS (
  SELECT nr, s FROM (SELECT nr, s, row_number() OVER (PARTITION BY t ORDER BY nr, s) AS k FROM w) WHERE k > 1
), i AS (
  SELECT nr, s, sum(fresh) OVER (PARTITION BY nr ORDER BY s) AS run
  FROM (SELECT nr, s, CASE WHEN s - lag(s) OVER (PARTITION BY nr ORDER BY s) <= 100 THEN 0 ELSE 1 END AS fresh FROM r)
), g AS (
  SELECT nr, run, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY nr, run
), p AS (
  SELECT d.nr, d.doc_id, d.h, coalesce(list(a ORDER BY a) FILTER (a IS NOT NULL), []) AS a, coalesce(list(b ORDER BY a) FILTER (a IS NOT NULL), []) AS b
  FROM d LEFT JOIN g USING (nr) GROUP BY d.nr, d.doc_id, d.h
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(list_sum(b) - list_sum(a), 0) AS BIGINT) AS n_removed, len(a) AS n_spans,
  sha256(unhex(array_to_string([substr(h, 2 * (CASE WHEN k = 0 THEN 0 ELSE b[k] END) + 1,
    2 * ((CASE WHEN k = len(a) THEN length(h) // 2 ELSE a[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE b[k] END))) FOR k IN range(len(a) + 1)], ''))) AS kept_sha256
FROM p
"""

SEARCH = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE [w[i + 1:i + 4] FOR i IN range(len(w) - 3)] END) AS t FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT e.a, e.b FROM e JOIN n AS x ON x.doc_id = e.a JOIN n AS y ON y.doc_id = e.b WHERE 100 * e.c >= 85 * (x.n + y.n - e.c)
), r AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM documents AS d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""


def _matches(kind: str, rank: int, pattern: str, valid: str, extra: str = "0.0") -> str:
    """Spans (doc_id, s, rank, kind, e, x) of a pattern's matches m that are valid; g is the gap before one."""
    p = pattern.replace("'", "''")
    return f"""
SELECT doc_id, s, {rank} AS rank, '{kind}' AS kind, s + length(m) AS e, {extra} AS x FROM (
  SELECT doc_id, ms[k] AS m, gs[k] AS g, CAST(coalesce(list_sum([length(y) FOR y IN gs[1:k]]), 0) + coalesce(list_sum([length(y) FOR y IN ms[1:k - 1]]), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS k FROM (
    SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS ms, regexp_split_to_array(t, '{p}') AS gs FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))
) WHERE {valid}"""


def _digest(spans: list[str], counted: list[str], base: int, more: str = "") -> str:
    """Counts by kind, the hash of the base spans and all spans, of each document."""
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in counted)
    one, order = "kind || ':' || s || ':' || e", "ORDER BY s, rank, e"
    return f"""
WITH x AS ({' UNION ALL '.join(spans)})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' {order}) FILTER (rank < {base}), '')) AS base_sha256,
  coalesce(string_agg({one}, ',' {order}) FILTER (kind IS NOT NULL), '') AS spans{more}
FROM documents AS d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id
"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN i % 2 = 0 THEN substr({_DIGITS}, length({_DIGITS}) - i, 1)::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr({_DIGITS}, length({_DIGITS}) - i, 1)::INT + 1] END FOR i IN range(length({_DIGITS}))]) % 10 = 0"
_CODE = "replace(m, ' ', '')"
_MOD97 = f"CAST(array_to_string([CASE WHEN substr({_CODE}, (i + 4) % length({_CODE}) + 1, 1) >= 'A' THEN (ascii(substr({_CODE}, (i + 4) % length({_CODE}) + 1, 1)) - 55)::VARCHAR ELSE substr({_CODE}, (i + 4) % length({_CODE}) + 1, 1) END FOR i IN range(length({_CODE}))], '') AS HUGEINT) % 97 = 1"


def _score(prior: float, words: str) -> str:
    return rf"least(1.0::DOUBLE, {prior}::DOUBLE + CASE WHEN regexp_matches(lower(right(g, 40)), '\b({words})\b') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)"


PII = _digest(
    [
        _matches("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", _score(0.9, "e-?mail|mail|contact|correo|courriel")),
        _matches("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len([y FOR y IN string_split(m, '.') IF length(ltrim(y, '0')) > 3 OR ltrim('0' || ltrim(y, '0'))::INT > 255]) = 0", _score(0.6, "ip|host|server|address|client")),
        _matches("card", 2, r"[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}", _score(0.7, "card|visa|credit|karte|tarjeta|carte")),
        _matches("phone", 3, r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15", _score(0.6, "phone|tel|call|mobile|fax")),
        _matches("iban", 4, r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", _MOD97, _score(0.8, "iban|account|konto|cuenta|compte")),
    ],
    ["email", "ip", "card", "phone"],
    4,
    ", max(x) AS top_score",
)

SECRETS = _digest(
    [
        _matches("assign", 0, r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?(?:[A-Za-z0-9+/_.=-]+)""", r"""length(regexp_extract(m, '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 8"""),
        _matches("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 16"),
        _matches("hex", 2, "[0-9a-f]+", "length(m) >= 32"),
        _matches("pem", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
        _matches("github", 4, "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
        _matches("slack", 5, "xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
        _matches("google", 6, "AIza[A-Za-z0-9_-]{35}", "true"),
        _matches("jwt", 7, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "regexp_matches(coalesce(right(g, 1), ''), '^[^A-Za-z0-9_-]?$')"),
    ],
    ["assign", "access", "hex"],
    3,
)



def _rounds(inverse: bool, table: str, columns: str) -> str:
    """Swap-or-not rounds over (x, n, salt) of a table, one common table expression for each."""
    out, before = [], table
    for k, r in enumerate(range(16, 0, -1) if inverse else range(1, 17)):
        a, b = f"((salt % 2147483647 * (48271 + {r}) + {r * r}) % 2147483647 + 1)", f"((salt // 1073741824 % 2147483647 * (48271 - {r}) + {r}) % 2147483647)"
        bit = f"((y % 2147483647 * {a} % 2147483647 + y // 2147483648 * 48271 % 2147483647 + {b}) % 2147483647 * 48271 % 2147483647 // 65536 % 2)"
        name = f"{table}_{k}"
        out.append(f"{name} AS (SELECT {columns}, n, salt, CASE WHEN {bit} = 1 THEN m ELSE x END AS x FROM (SELECT *, greatest(x, m) AS y FROM (SELECT *, ((({a} * 2147483647 + {b}) % n - x) % n + n) % n AS m FROM {before})))")
        before = name
    return ", ".join(out)


def _digest60(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), '') AS id, doc_id IS NULL AS no_id, coalesce('=' || source, '') AS origin, coalesce({_digest60("text")}, 0) AS text_hash
  FROM documents
), g0 AS (
  SELECT origin, source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY origin, source
), g1 AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 3 * source_size AS cap FROM g0
), g2 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM g1
), g AS (
  SELECT *, least(cap::DOUBLE, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight, cap::DOUBLE)) AS target FROM g2
), w AS (
  SELECT *, want - whole * source_size AS rest FROM (
    SELECT origin, source_size, (source_size + 63) // 64 AS n, CAST(round(target) AS BIGINT) AS want, CAST(round(target) AS BIGINT) // source_size AS whole FROM g WHERE source_size > 0 AND round(target) > 0)
), p AS (
  SELECT origin, n * 64 - source_size AS lacks, rest, whole, n, {_digest60("origin || ':' || whole || ':0'")} AS salt, n - 1 AS x FROM w
), {_rounds(True, "p", "origin, lacks, rest, whole")}, k AS (
  SELECT *, (rest + CASE WHEN x < (rest + 63) // 64 THEN lacks ELSE 0 END + 63) // 64 AS part FROM p_15
), c AS (
  SELECT origin, n, whole * n + part AS n_slots,
    CASE WHEN rest > 0 THEN (CASE WHEN x = part - 1 THEN 64 - lacks ELSE 64 END) - (part * 64 - CASE WHEN x < part THEN lacks ELSE 0 END - rest) ELSE 64 END AS kept FROM k
), s0 AS (
  SELECT origin, n, n_slots, kept, unnest(range(n_slots)) AS slot FROM c
), s AS (
  SELECT origin, CASE WHEN slot = n_slots - 1 THEN kept ELSE 64 END AS kept, n, {_digest60("origin || ':' || slot // n || ':0'")} AS salt, slot % n AS x FROM s0
), {_rounds(False, "s", "origin, kept")}, o AS (
  SELECT d.*, {_digest60("id || ':' || text_hash")} AS place, (n_docs + 999) // 1000 AS buckets, g.source_size, g.target FROM d JOIN g USING (origin)
), a AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY origin ORDER BY place % buckets, place, no_id, id, text_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_ FROM o WHERE size > 0
), b AS (
  SELECT origin, id, no_id, text_hash, at_, size, unnest(range(at_ // 64, (at_ + size - 1) // 64 + 1)) AS block FROM a
), t AS (
  SELECT b.origin, b.id, b.no_id, b.text_hash, sum(greatest(0, least(least(at_ + size, (block + 1) * 64) - greatest(at_, block * 64), kept - (greatest(at_, block * 64) - block * 64)))) AS words
  FROM b JOIN s_15 AS s ON s.origin = b.origin AND s.x = b.block GROUP BY ALL
)
SELECT doc_id, size, source_size, target, CAST(coalesce(words, 0) AS BIGINT) AS taken
FROM o LEFT JOIN t USING (origin, id, no_id, text_hash)
"""

#: The others learn, walk markup or chain windows; they are tested against plain versions and held-out rows.
ORACLE_SQL: dict[str, str] = {"op1_substrings": SUBSTRINGS, "op2_search": SEARCH, "op3_jaccard": JACCARD, "op5_pii": PII, "op7_secrets": SECRETS, "op9_mixing": MIXING}
