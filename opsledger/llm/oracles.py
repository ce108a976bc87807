"""DuckDB SQL of the operators that SQL can express, written from their contracts."""

from __future__ import annotations

import math

from opsledger.llm.license_scan import PHRASES, TEMPLATES, template_words

_SPACED = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, COALESCE(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{_SPACED}') AS ws FROM d),
triples AS (SELECT rid, i, ws[i:i + 2] AS g FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w) x),
again AS (SELECT rid, i FROM triples QUALIFY COUNT(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, COUNT(DISTINCT i + k) AS n FROM again, range(3) v(k) GROUP BY rid),
lines AS (SELECT rid, COUNT(*) AS n, COUNT(*) - COUNT(DISTINCT l) AS dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) x WHERE regexp_matches(l, '{_SPACED}') GROUP BY rid),
stats AS (
  SELECT d.doc_id, d.source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, COALESCE(lines.n, 0) AS n_lines,
    COALESCE(dup, 0) AS n_dup_lines, COALESCE(covered.n, 0) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > word_chars AS f2,
    10 * n_dup_lines > 3 * n_lines AS f3, n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) AS f4 FROM stats),
failures AS (
  SELECT source, rule, COUNT(*) AS n, COUNT(*) FILTER (failed) AS k
  FROM (SELECT source, unnest([1, 2, 3, 4]) AS rule, unnest([base_failed, f2, f3, f4]) AS failed FROM judged) x GROUP BY ALL),
means AS (SELECT rule, SUM(k) / SUM(n) AS m, SUM(n) AS n, COUNT(*) AS hosts FROM failures GROUP BY rule),
spreads AS (SELECT rule, m, SUM(f.n * (k / f.n - m) ** 2) / means.n - m * (1 - m) * hosts / means.n AS v
  FROM failures f JOIN means USING (rule) GROUP BY rule, m, means.n, hosts),
priors AS (SELECT rule, m, if(v <= 0, 1000, least(greatest(m * (1 - m) / v - 1, 1), 1000)) AS strength FROM spreads),
hosts AS (SELECT source, bool_or((k + m * strength) / (n + strength) > 0.9) AS bad FROM failures JOIN priors USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept,
  bad AS host_rejected
FROM judged JOIN hosts ON judged.source IS NOT DISTINCT FROM hosts.source"""


def license_scan(containment: float = 0.85) -> str:
    sets = [(label, sorted(set(template_words(text)))) for label, text in TEMPLATES]
    span = max(len(template_words(text)) for _, text in TEMPLATES)
    template_rows = ", ".join(f"({i}, '{label}', {len(ws)}, {math.ceil(containment * len(ws) - 1e-9)}, {ws})" for i, (label, ws) in enumerate(sets))
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
phrases(p, label) AS (VALUES {phrases}),
places AS (
  SELECT rid, i - 1 AS pos, label FROM (SELECT rid, ws, unnest(generate_series(1, len(ws))) AS i FROM d) x, phrases
  WHERE ws[i] = p[1] AND ws[i:i + len(p) - 1] = p),
base AS (SELECT rid, COUNT(*) AS n, MIN(pos) AS first_word, MAX(pos) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY rid),
templates(id, label, size, need, ws) AS (VALUES {template_rows}),
shared AS (
  SELECT rid, i // {span} - back AS block, id, COUNT(DISTINCT w) AS common
  FROM (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d) x
    JOIN (SELECT id, unnest(ws) AS w FROM templates) y USING (w), range(2) r(back)
  WHERE i // {span} >= back GROUP BY ALL),
found AS (SELECT rid, list(DISTINCT label) AS labels, MAX(common / size) AS best FROM shared JOIN templates USING (id) WHERE common >= need GROUP BY rid)
SELECT doc_id, len(d.ws) AS n_words, COALESCE(base.n, 0) AS n_base, first_word, last_word,
  COALESCE(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  COALESCE(array_to_string(list_sort(list_distinct(list_concat(base.labels, found.labels))), ','), '') AS labels,
  if(base.n > 0, 1.0, COALESCE(best, 0.0))::DOUBLE AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)"""


MINHASH_FOREST = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS ws FROM documents),
sets AS (
  SELECT DISTINCT doc_id, if(len(ws) < 5, ws, ws[i:i + 4]) AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0) x),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id
    JOIN sizes m ON m.doc_id = x.doc_id JOIN sizes n ON n.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, m.n, n.n HAVING 100 * COUNT(*) >= 75 * (m.n + n.n - COUNT(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, COALESCE(n, 0) AS n_shingles, COALESCE(r.root, doc_id) AS component_id, COALESCE(r.root, doc_id) = doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a, MIN(b) AS root FROM reach GROUP BY a) r ON r.a = d.doc_id"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS w
  FROM (SELECT doc_id, h, unnest(range(greatest(len(h) // 2 - 99, 0))) AS i FROM d) x),
repeats AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
stepped AS (SELECT doc_id, i, COALESCE(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true) AS opens FROM repeats),
numbered AS (SELECT doc_id, i, COUNT(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM stepped),
runs AS (SELECT doc_id, run, MIN(i) AS lo, MAX(i) + 100 AS hi FROM numbered GROUP BY doc_id, run),
parts AS (SELECT doc_id, lo, hi, COALESCE(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS prev FROM runs),
cut AS (
  SELECT doc_id, SUM(hi - lo) AS n_removed, COUNT(*) AS n_spans, MAX(hi) AS last,
    string_agg(substr(h, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) AS head
  FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, COALESCE(n_removed, 0)::BIGINT AS n_removed, COALESCE(n_spans, 0) AS n_spans,
  sha256(unhex(COALESCE(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

MERKLE_MANIFEST = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars, COALESCE(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || COALESCE(strlen(source) || ':' || source, '-')
      || COALESCE(strlen(lang) || ':' || lang, '-') AS head, COALESCE(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: if(x % 2 = 1, xor(x // 2, 3988292384::BIGINT), x // 2))) AS inverted
  FROM documents),
leaves AS (
  SELECT doc_id, lang, row_number() OVER w - 1 AS pos, COUNT(*) OVER (PARTITION BY lang) AS total,
    sha256(head || COALESCE(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || COALESCE(strlen((n_chars + m)::VARCHAR) || ':' || (n_chars + m), '-') || tail) AS now
  FROM (SELECT *, if(xor(inverted, 4294967295) % 7 = 0, 1, 0) AS m FROM fields) f WINDOW w AS (PARTITION BY lang ORDER BY doc_id)),
tree(lang, level, pos, total, node) AS (
  SELECT lang, 0, pos, total, leaf FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, (ANY_VALUE(total) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE total > 1
  GROUP BY lang, level, pos // 2),
subroots AS (
  SELECT lang, node AS subroot, level AS height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, COUNT(*) OVER () AS total
  FROM tree WHERE total = 1),
top(level, pos, total, node) AS (
  SELECT 0, pos, total, subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (ANY_VALUE(total) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE total > 1
  GROUP BY level, pos // 2),
nodes AS (
  SELECT 0 AS part, * FROM tree WHERE total > 1 UNION ALL SELECT 1, NULL, level, pos, total, node FROM top WHERE total > 1),
steps AS (
  SELECT l.doc_id, s.node, p % 2 AS odd,
    row_number() OVER (PARTITION BY l.doc_id ORDER BY n.part, n.level) AS k
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang
    JOIN (SELECT DISTINCT part, lang, level FROM nodes) n ON n.part = 1 OR n.lang IS NOT DISTINCT FROM l.lang
    CROSS JOIN LATERAL (SELECT if(n.part = 0, l.pos, r.pos) >> n.level AS p) q
    LEFT JOIN nodes s ON s.part = n.part AND s.lang IS NOT DISTINCT FROM n.lang AND s.level = n.level AND s.pos = xor(p, 1)),
walk(doc_id, k, node) AS (
  SELECT doc_id, 0::BIGINT, now FROM leaves
  UNION ALL
  SELECT w.doc_id, s.k, sha256(if(odd = 1, COALESCE(s.node, '') || w.node, w.node || COALESCE(s.node, '')))
  FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.k = w.k + 1),
ends AS (SELECT doc_id, arg_max(node, k) AS folded_root FROM walk GROUP BY doc_id),
proofs AS (SELECT doc_id, sha256(COALESCE(string_agg(node, '' ORDER BY k), '')) AS proof_sha256 FROM steps GROUP BY doc_id)
SELECT doc_id, leaf, subroot, (SELECT node FROM top WHERE total = 1) AS root, COALESCE(proof_sha256, sha256('')) AS proof_sha256, folded_root,
  folded_root = (SELECT node FROM top WHERE total = 1) AS verified, l.pos AS lang_pos
FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id)"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, if(vec_id % 7 = 0, (label + 1) % 10, label) AS label, [floor(256 * c::DOUBLE) for c in embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id, score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 80 * p.score AND 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 5"""


def llm_oracles() -> dict[str, str]:
    return {"op2_suffix_dedup": SUFFIX_DEDUP, "op4_minhash_forest": MINHASH_FOREST, "op8_license_scan": license_scan(),
            "op10_quality_rules": QUALITY_RULES, "op11_merkle_manifest": MERKLE_MANIFEST, "op13_hard_negatives": HARD_NEGATIVES}
