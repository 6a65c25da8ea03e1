"""The text queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

from .divergence import MIN_DOCS, SCALE, TERM, TERM_RANKS
from .license_scan import CONTAINMENT, SHINGLE, TEMPLATES, _class, python_words
from .mixing import KEY_HEX, ROUNDING, SEED
from .quality import RULES, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]"

_RULES = """rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))"""

OP10 = rf"""WITH {_RULES},
u AS (SELECT row_number() OVER () AS i, page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
m AS (SELECT i, h || p AS rule, verdict, row_number() OVER (PARTITION BY i ORDER BY length(h || p) DESC, length(p) DESC, verdict DESC, h || p DESC) AS r FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (i)"""


def _op4() -> str:
    stops = sorted({x for v in STOP_WORDS.values() for x in v})
    stops = ", ".join(f"'{x}'" for x in stops)
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END"
    value = {
        "n_words": "n_words",
        "mean_word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_word_ratio": ratio("stops", "n_words"),
        "upper_ratio": ratio("uppers", "(uppers + lowers)"),
        "mark_word_ratio": ratio("marks", "n_words"),
        "ellipsis_line_ratio": ratio("ellipses", "lines"),
        "bullet_line_ratio": ratio("bullets", "lines"),
        "dup_line_ratio": ratio("n_dup_lines", "lines"),
        "repeat_word_ratio": ratio("n_repeat_words", "n_words"),
    }
    failed = []
    for r in RULES:
        test = [f"{value[r.metric]} < {r.low}"] * (r.low is not None) + [f"{value[r.metric]} > {r.high}"] * (r.high is not None)
        failed.append(f"CASE WHEN {' OR '.join(test)} THEN '{r.name}' END")
    return rf"""WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT i, doc_id, t, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
tri AS (SELECT i, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS x FROM (SELECT i, w, unnest(range(1, len(w) - 1)) AS k FROM w WHERE len(w) >= 3)),
rep AS (SELECT i, k FROM (SELECT i, k, count(*) OVER (PARTITION BY i, x) AS n FROM tri) WHERE n >= 2),
cov AS (SELECT i, count(DISTINCT k + o) AS n FROM rep, range(3) r(o) GROUP BY i),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) AS lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS stops,
  length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS uppers, length(regexp_replace(t, '\P{{Ll}}', '', 'g')) AS lowers, len(list_filter(w, lambda x: NOT regexp_matches(x, '[\p{{L}}\p{{N}}]'))) AS marks,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…){_SPACE}*$'))) AS ellipses, len(list_filter(l, lambda x: regexp_matches(x, '^{_SPACE}*[-*•·]{_SPACE}'))) AS bullets FROM w LEFT JOIN cov USING (i)),
f AS (SELECT *, list_filter([{', '.join(failed)}], lambda x: x IS NOT NULL) AS failed, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed_rules FROM f"""


OP6 = rf"""WITH d AS (SELECT row_number() OVER () AS i, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
k AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || size), 1, {KEY_HEX}))::UBIGINT AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT *, level <= cap / weight AS fits FROM l),
h AS (SELECT *, (SELECT arg_min(level, cap / weight) FROM g WHERE fits) AS share FROM g),
t AS (SELECT source, source_size, CASE WHEN fits THEN least(share * weight, cap) ELSE cap END AS target FROM h),
o AS (SELECT k.*, source_size, target, ceil(target - {ROUNDING})::BIGINT AS budget, sum(size) OVER (PARTITION BY k.source ORDER BY key, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, count(*) OVER (PARTITION BY k.source, key, size) AS n FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, pass * source_size + upto AS served FROM o, range(3) r(pass)),
f AS (SELECT *, CASE WHEN served >= budget THEN 1.0::DOUBLE ELSE served / target END AS finish, CASE WHEN size > 0 THEN greatest(0, least(size, floor((budget - served) / n + size)::BIGINT)) ELSE 0 END AS words FROM q),
c AS (SELECT *, sum(words) OVER (ORDER BY finish, key, pass, size, source NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words * n AS before, (SELECT sum(source_size) FROM t) AS total FROM f)
SELECT doc_id, source, size, source_size, target, sum(greatest(0, least(words, floor((total - before) / n)::BIGINT)))::BIGINT AS taken FROM c GROUP BY i, doc_id, source, size, source_size, target"""


def _op8() -> str:
    rows = [(name, len(w) - SHINGLE + 1, w) for name, text in TEMPLATES.items() if len(w := python_words(text)) >= SHINGLE]
    values = ", ".join(f"('{name}', {_class(n)}, {w!r})" for name, n, w in rows)
    cut = lambda w: f"list_distinct(list_transform(range(1, len({w}) - {SHINGLE - 2}), lambda i: array_to_string({w}[i:i + {SHINGLE - 1}], ' ')))"
    return rf"""WITH t AS (SELECT license, m, unnest({cut('w')}) AS x, len({cut('w')}) AS n FROM (VALUES {values}) v(license, m, w)),
d AS (SELECT doc_id, row_number() OVER () AS i, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}](?:[^\x20\x09-\x0D]*[\p{{L}}\p{{N}}])?') AS w FROM documents),
s AS (SELECT doc_id, i, k - 1 AS k, len(w) - {SHINGLE - 1} AS total, array_to_string(w[k:k + {SHINGLE - 1}], ' ') AS x FROM (SELECT doc_id, i, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS k FROM d WHERE len(w) >= {SHINGLE})),
h AS (SELECT doc_id, i, k, total, license, m, n, t.x FROM s JOIN t ON s.x = t.x),
v AS (SELECT doc_id, i, license, n, k, m, x, unnest([k // (2 * m) - 1, k // (2 * m)]) AS j, ceil(greatest(total - (3 * m - 1), 0) / (2 * m)) AS last FROM h),
c AS (SELECT doc_id, i, license, j, count(DISTINCT x) / any_value(n) AS c FROM v WHERE j >= 0 AND j <= last AND k < 2 * j * m + 3 * m - 1 GROUP BY ALL)
SELECT doc_id, license, max(c) AS containment, count(DISTINCT j) AS n_windows FROM c WHERE c >= {CONTAINMENT} GROUP BY 1, 2"""


#: Levels that the SQL of the manifest unrolls (8**7 leaves a tree).
_LEVELS = 7


def _op12() -> str:
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([part("doc_id"), part("source"), part("lang"), part("n_chars"), part(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        "table_(t) AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))",
        "c AS (SELECT row_number() OVER () AS i, *, CASE WHEN doc_id IS NULL THEN NULL ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END AS crc FROM documents, table_)",
        f"d AS (SELECT i, doc_id, lang, {leaf('text')} AS leaf, CASE WHEN crc % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS other FROM c)",
        "l0 AS (SELECT lang AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf, i) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, leaf AS digest, i FROM d)",
        "p0 AS (SELECT l0.i, tree, pos, '' AS proof, other AS node FROM l0 JOIN d USING (i))",
    ]

    def climb(nodes: str, path: str, level: int) -> None:
        """The levels above ``nodes`` and, along them, the siblings of the rows of ``path``."""
        for k in range(level, level + _LEVELS):
            ctes.append(f"b{k} AS (SELECT tree, pos // 8 AS pos, any_value(n) AS n, list(digest ORDER BY pos) AS run FROM {nodes} GROUP BY 1, pos // 8)")
            left, right = "array_to_string(run[:p.pos % 8], '')", "array_to_string(run[p.pos % 8 + 2:], '')"
            ctes.append(f"p{k} AS (SELECT p.i, p.tree, p.pos // 8 AS pos, CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof, CASE WHEN n = 1 THEN node ELSE sha256({left} || node || {right}) END AS node FROM {path} p JOIN b{k} b ON p.tree IS NOT DISTINCT FROM b.tree AND p.pos // 8 = b.pos)")
            ctes.append(f"l{k} AS (SELECT tree, pos, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS digest FROM b{k})")
            nodes, path = f"l{k}", f"p{k}"

    climb("l0", "p0", 1)
    end = _LEVELS
    ctes.append(f"t0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, digest, tree AS lang FROM l{end})")
    ctes.append(f"q0 AS (SELECT i, 0 AS tree, t0.pos, proof, node, digest AS subroot FROM p{end} p JOIN t0 ON p.tree IS NOT DISTINCT FROM t0.lang)")
    climb("t0", "q0", end + 1)
    top = 2 * _LEVELS
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = digest AS verified FROM d JOIN (SELECT i, subroot FROM q0) USING (i) JOIN p{top} USING (i) CROSS JOIN l{top}"


OP13 = rf"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
m AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM m GROUP BY 1, 2 HAVING count(DISTINCT i) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.n AS all_n, count(m.i) AS n FROM g JOIN k USING (lang) LEFT JOIN m ON m.lang = g.lang AND m.source = g.source AND m.term = k.term GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(all_n) OVER (PARTITION BY lang, source) AS all_total, count(*) OVER (PARTITION BY lang, source) AS v FROM c),
p AS (SELECT lang, source, term, n, (1 + {SCALE}::HUGEINT * (n + 1) // (total + v))::BIGINT AS p, (1 + {SCALE}::HUGEINT * (all_n + 1) // (all_total + v))::BIGINT AS q FROM s),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= {TERM_RANKS}"""


ORACLE_SQL: dict[str, str] = {"op4_quality": _op4(), "op6_mixing": OP6, "op8_licenses": _op8(), "op10_url_filter": OP10, "op12_merkle": _op12(), "op13_divergence": OP13}
