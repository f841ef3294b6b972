"""DuckDB SQL for the operators that SQL can express, over the same whole tables."""

from __future__ import annotations

from lexis.llm import infill, quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[\x20\x09-\x0D]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


def _words(text: str, stops: str) -> str:
    return f"list_filter(string_split_regex({text}, '{stops}'), lambda x: x <> '')"


LINE_DEDUP = f"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, i, line, {_words("line", _BLANK)} AS w FROM l),
j AS (SELECT doc_id, i, w, array_to_string(w, ' ') AS k, len(w) AS n FROM w WHERE len(w) >= 5),
f AS (SELECT k, any_value(w) AS w, any_value(n) AS n, min(struct_pack(d := doc_id, i := i)) AS pos FROM j GROUP BY k),
v AS (
  SELECT k, pos, n, p, n - 1 AS m, array_to_string(list_concat(w[:p - 1], w[p + 1:]), ' ') AS v
  FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM f WHERE n >= 10)),
near AS (
  SELECT DISTINCT a.k FROM v a JOIN (SELECT n, p, v, min(pos) AS pos FROM v GROUP BY n, p, v) b
    ON a.n = b.n AND a.p = b.p AND a.v = b.v AND b.pos < a.pos
  UNION SELECT DISTINCT a.k FROM v a JOIN f b ON b.n >= 10 AND a.v = b.k AND b.pos < a.pos
  UNION SELECT DISTINCT b.k FROM v a JOIN f b ON b.n >= 10 AND a.v = b.k AND a.pos < b.pos),
s AS (
  SELECT j.doc_id, j.i, struct_pack(d := j.doc_id, i := j.i) > f.pos AS exact, near.k IS NOT NULL AS near
  FROM j JOIN f USING (k) LEFT JOIN near ON near.k = j.k),
c AS (SELECT doc_id, count(*) AS n_judged, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near AND NOT exact) AS n_near FROM s GROUP BY doc_id),
o AS (
  SELECT w.doc_id, count(*) FILTER (len(w.w) > 0) AS n_lines,
         coalesce(string_agg(w.line, chr(10) ORDER BY w.i) FILTER (NOT coalesce(s.exact OR s.near, false)), '') AS kept
  FROM w LEFT JOIN s ON s.doc_id = w.doc_id AND s.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_judged, 0) AS n_judged, coalesce(n_exact, 0) AS n_exact,
       coalesce(n_near, 0) AS n_near, coalesce(n_judged > 0 AND n_exact + n_near = n_judged, false) AS only_copies,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id) WHERE d.doc_id IS NOT NULL"""


CROSS_ENTROPY = f"""
WITH d AS (SELECT doc_id, {_words(_low("text"), _BETWEEN)} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM d),
p AS (SELECT doc_id, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), '<s>') AS a, w AS b FROM t),
g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
n AS (SELECT a, b, count(*)::DOUBLE AS every, count(g.doc_id)::DOUBLE AS target FROM p LEFT JOIN g USING (doc_id) GROUP BY a, b),
z AS (SELECT greatest(sum(target), 1) / sum(every) AS f, (SELECT count(DISTINCT w) + 2 FROM t) AS width FROM n),
m AS (SELECT a, b, target AS t, every * f AS e FROM n, z),
single AS (SELECT b, (sum(t) + 1) / ((SELECT sum(t) FROM m) + (SELECT width FROM z)) AS t,
                  (sum(e) + 1) / ((SELECT sum(e) FROM m) + (SELECT width FROM z)) AS e FROM m GROUP BY b),
before AS (SELECT a, sum(t) AS t, sum(e) AS e FROM m GROUP BY a),
loss AS (SELECT m.a, m.b, -log2((m.t + 50 * s.t) / (o.t + 50)) AS t, -log2((m.e + 50 * s.e) / (o.e + 50)) AS e
         FROM m JOIN single s USING (b) JOIN before o USING (a)),
r AS (SELECT doc_id, avg(loss.t) AS t, avg(loss.e) AS e FROM p JOIN loss USING (a, b) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_tokens, round(r.t, 6) AS loss_target, round(r.e, 6) AS loss_background, round(r.t - r.e, 6) AS score
FROM d LEFT JOIN r USING (doc_id)"""


def _quality_sql() -> str:
    counts = ", ".join("length(t) - length(regexp_replace(t, '{}', '', 'g')) AS n_{}".format(p.replace("'", "''"), n) for n, p in quality.CHAR_CLASSES.items())
    named = [f"n_{n}" for n in quality.CHAR_CLASSES]
    common = ", ".join("len(list_filter(low, lambda x: x = '{}'))".format(w) for w in quality.COMMON_WORDS)
    listed = ", ".join(f"'{w}'" for w in quality.COMMON_WORDS)

    def sums(name: str, n: int) -> str:
        return "[" + ", ".join(f"sum({name}[{i}])" for i in range(1, n + 1)) + "]"

    def distance(p: str, n: str, q: str, size: int) -> str:
        share, ref = f"({p}[i] / {n})", f"({q}[i] / list_sum({q}))"
        term = (f"(CASE WHEN {share} > 0 THEN {share} * log2(2 * {share} / ({share} + {ref})) ELSE 0 END"
                f" + CASE WHEN {ref} > 0 THEN {ref} * log2(2 * {ref} / ({share} + {ref})) ELSE 0 END)")
        return f"CASE WHEN {n} > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, {size + 1}), lambda i: {term})) / 2, 0)) ELSE 1 END"

    k, m = len(named) + 1, len(quality.COMMON_WORDS) + 1
    (cb, cs), (wb, ws) = quality.CLASS_BOUND, quality.WORD_BOUND
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_words("t", _BLANK)} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, {counts} FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
h AS (
  SELECT w.doc_id, lang, len(w) AS n_words, length(t) AS n_chars, length(t) - n_blank AS word_chars, n_symbol AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
         [length(t) - {" - ".join(named)}, {", ".join(named)}]::DOUBLE[] AS classes, list_transform(w, lambda x: lower(x)) AS low
  FROM w LEFT JOIN cov USING (doc_id)),
c AS (SELECT * EXCLUDE (low), [n_words - len(list_filter(low, lambda x: list_contains([{listed}], x))), {common}]::DOUBLE[] AS common FROM h),
ref AS (SELECT lang, {sums("classes", k)} AS qc, {sums("common", m)} AS qw FROM c WHERE lang IS NOT NULL GROUP BY lang),
s AS (SELECT c.doc_id, ref.lang, {distance("classes", "n_chars", "qc", k)} AS dc, {distance("common", "n_words", "qw", m)} AS dw FROM c, ref),
best AS (SELECT doc_id, dc, dw FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dc + dw, lang) = 1),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c LEFT JOIN best USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(dc <= {cb} + {cs} / sqrt(n_words) AND dw <= {wb} + {ws} / sqrt(n_words), false) AS kept
FROM f"""


JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_low("text"), _BLANK)} AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words(_low("text"), _BETWEEN)} AS w FROM documents),
b AS (SELECT item_id, {_words(_low("text"), _BETWEEN)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, s, dw.n, item_id FROM dw JOIN win ON win.n = dw.n AND win.k = dw.k),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""


SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM d WHERE n >= 100)),
r AS (SELECT doc_id, s FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
e AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM e),
q AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY ALL),
k AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM q
      UNION ALL SELECT d.doc_id, coalesce(max(q.b), 0), any_value(d.n) FROM d LEFT JOIN q USING (doc_id) GROUP BY d.doc_id),
t AS (SELECT k.doc_id, sha256(unhex(string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a))) AS kept_sha256 FROM k JOIN d USING (doc_id) GROUP BY k.doc_id),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM q GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)"""

QUALITY = _quality_sql()


def _infill_sql() -> str:
    h = ", ".join(f"('0x' || substr(g, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    marked = " OR ".join(f"contains(t, '{m}')" for m in (infill.PREFIX, infill.SUFFIX, infill.MIDDLE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{infill.SALT}' || coalesce(doc_id::VARCHAR, '')) AS g FROM documents),
c AS (SELECT *, length(t) AS n, {h} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR {marked} OR h3 % 100 >= {infill.ARRANGED_PERCENT} THEN 'plain'
                  WHEN h4 % 100 < {infill.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{infill.PREFIX}' || pre || '{infill.SUFFIX}' || suf || '{infill.MIDDLE}' || mid
              ELSE '{infill.SUFFIX}' || suf || '{infill.PREFIX}' || pre || '{infill.MIDDLE}' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


FILL_IN_MIDDLE = _infill_sql()
