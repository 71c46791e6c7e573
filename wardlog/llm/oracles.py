"""SQL for the registered queries that SQL can express."""

from wardlog.llm.secrets import KINDS, PATTERNS, REACH

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(column):
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


def words(column, gaps):
    return f"[x FOR x IN string_split_regex({lowered(column)}, '{gaps}') IF x <> '']"


BLANK = r"[\x20\x09-\x0D]+"
NO_TERM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words("text", BLANK)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""


def quoted(pattern):
    return "'" + pattern.replace("'", "''") + "'"


def parts_of(kind):
    pattern, _, group, least, role, weak = PATTERNS[kind]
    mixed = "" if kind != "random" else (
        " AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')"
    )
    return f"""
SELECT doc_id, {KINDS.index(kind)} AS kind, e - length(m) AS s, e, {role} AS role, {weak} AS weak FROM (
  SELECT doc_id, ms[i] AS m, vs[i] AS v,
    list_sum([length(x) FOR x IN ps[1:i]]) + list_sum([length(x) FOR x IN ms[1:i]]) AS e
  FROM (
    SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, string_split_regex(t, {quoted(pattern)}) AS ps, regexp_extract_all(t, {quoted(pattern)}) AS ms,
        regexp_extract_all(t, {quoted(pattern)}, {group}) AS vs
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    )
  )
) WHERE length(v) >= {least}{mixed}"""


NAMES = "[" + ", ".join(f"'{kind}'" for kind in KINDS) + "]"
OP2 = f"""
WITH found AS ({" UNION ALL ".join(parts_of(kind) for kind in KINDS)}),
parts AS (
  SELECT * FROM found f
  WHERE NOT weak OR NOT EXISTS (SELECT 1 FROM found b WHERE b.doc_id = f.doc_id AND NOT b.weak AND b.s < f.e AND f.s < b.e)
),
near AS (
  SELECT w.doc_id, w.kind, w.s, w.e, w.role, bool_or(o.role = 0) AS ident, bool_or(o.role = 1) AS secret
  FROM parts w JOIN parts o ON o.doc_id = w.doc_id AND o.role <> w.role AND o.s - w.e <= {REACH} AND w.s - o.e <= {REACH}
  WHERE w.weak GROUP BY ALL
),
spans AS (
  SELECT doc_id, kind, s, e FROM parts WHERE NOT weak UNION ALL
  SELECT doc_id, kind, s, e FROM near WHERE (role = 0 AND secret) OR (role = 1 AND ident) OR (role = 2 AND ident AND secret)
),
told AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex,
    string_agg({NAMES}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
    string_agg({NAMES}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN told USING (doc_id)
"""

OP3 = f"""
WITH d AS (SELECT doc_id, {words("text", NO_TERM)} AS w FROM documents),
i AS (SELECT item_id, {words("text", NO_TERM)} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[k:k + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)
),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
hits AS (
  SELECT p.doc_id, p.k, iw.l, iw.item_id
  FROM (SELECT DISTINCT l FROM iw) ls JOIN p ON p.k + ls.l - 1 <= len(p.w)
  JOIN iw ON iw.l = ls.l AND iw.g = array_to_string(p.w[p.k:p.k + ls.l - 1], ' ')
),
hit_words AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS x FROM hits) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {5 * g + 1}, 5))::INT >> {shift}) & 31) + 1)::INT, 1)"
    for g in range(8) for shift in (15, 10, 5, 0)
)
OP10 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, {LETTERS} AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to
FROM q
"""

OP12 = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lowered("text")}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents
),
w AS (SELECT lang, [x FOR x IN string_split_regex(p, '[\\x20\\x09]+') IF x <> ''] AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT *, unnest(range(1, 6)) AS k FROM places) WHERE i + k - 1 <= len(w)
),
f AS (SELECT lang, g, count(*)::HUGEINT AS f FROM grams GROUP BY lang, g),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 100),
cuts AS (
  SELECT c.lang, c.g, a, n, x.f AS l, y.f AS r, k, (1000 * a * n) // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c) c JOIN n USING (lang)
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:len(c.g)]
),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT lang, g[i:j] AS g, a
  FROM (SELECT lang, g, a, i, unnest(range(i, len(g) + 1)) AS j FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM c))
  WHERE j - i + 1 < len(g)
),
kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM inside s WHERE s.lang = low.lang AND s.g = low.g AND 100 * s.a >= 100 * low.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
  array_to_string(g, ' ') AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


def drawn(k):
    return f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"


OP13 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
    sha256('7:' || doc_id) AS h FROM documents
),
c AS (
  SELECT *, len(u) AS n, least({drawn(0)} % (len(u) + 1), {drawn(1)} % (len(u) + 1)) AS lo,
    greatest({drawn(0)} % (len(u) + 1), {drawn(1)} % (len(u) + 1)) AS hi,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {drawn(2)} % 100 >= 100 AS plain,
    {drawn(3)} % 100 < 50 AS spm FROM d
),
p AS (
  SELECT *, coalesce(array_to_string(u[1:lo], ''), '') AS pre, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS mid,
    coalesce(array_to_string(u[hi + 1:n], ''), '') AS suf FROM c
)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(pre)::BIGINT END AS prefix_chars,
  CASE WHEN NOT plain THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
    ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

ORACLES = {
    "op1_ngram_jaccard_join": OP1,
    "op2_secret_scans": OP2,
    "op3_decontamination": OP3,
    "op10_warc": OP10,
    "op12_collocations": OP12,
    "op13_fill_in_middle": OP13,
}
