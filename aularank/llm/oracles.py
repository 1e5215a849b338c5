"""DuckDB SQL for the corpus queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def _times(x: str, mark: str) -> str:
    return f"(length({x}) - length(replace({x}, '{mark}', ''))) // {len(mark)}"


_ESCAPES = " + ".join(_times("text", m) for m in ("\\", "#", "</"))
_ROLE_ESCAPES = " + ".join(_times("role", m) for m in ("\\", "#", ":", "</"))

CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(role) + length(text) + {_ROLE_ESCAPES} + {_ESCAPES}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def urls(paths: tuple, patterns: tuple) -> str:
    """Host, path, longest rule, then the patterns in order."""
    fits = {}
    for rule, _ in paths:
        host, slash, path = rule.partition("/")
        fits[rule] = f"((host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{slash + path}'))"
    longest = sorted(paths, key=lambda r: (-len(r[0]), r[0]))
    rule = " ".join(f"WHEN {fits[r]} THEN '{r}'" for r, _ in longest)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in paths)
    verdict += " " + " ".join(f"WHEN regexp_matches(low, '{p.regex}') THEN '{p.verdict}'" for p in patterns)
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS mark FROM pages),
b AS (SELECT page_id, {_low('url')} AS low, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, low, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM b),
d AS (SELECT page_id, low, {_low('h')} AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM c),
e AS (SELECT *, CASE {rule} ELSE NULL END AS rule FROM d)
SELECT page_id, host, path, rule, CASE {verdict} ELSE 'allow' END AS verdict FROM e
"""


def _shingles(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM {table}"""


_WORDS = "regexp_extract_all(" + _low("coalesce(text, '')") + r", '[a-z0-9\x{80}-\x{10FFFF}]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS iid, min(item_id) AS item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL GROUP BY text),
ds AS ({_shingles('d', 'rid, doc_id')}),
s AS ({_shingles('i', 'iid, item_id')}),
n AS (SELECT iid, count(*) AS n_shingles FROM s GROUP BY iid)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM (
  SELECT rid, doc_id, iid, item_id, count(*) AS n_found FROM ds JOIN s USING (s) GROUP BY rid, doc_id, iid, item_id) JOIN n USING (iid)
WHERE n_found >= ceil(0.8 * n_shingles - 1e-9)
"""


NEGATIVES = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM r AS a, r AS b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

_BREAKS = r"[.,;:!?\n\x0B\f\r]"

COLLOCATIONS = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_low("coalesce(text, '')")}, '{_BREAKS}')) AS piece FROM documents),
w AS (
  SELECT row_number() OVER () AS k, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM piece),
t AS (
  SELECT k, lang, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE len(words) > 0),
total AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
f AS (
  SELECT lang, z AS words, array_to_string(words[i:i + z - 1], ' ') AS phrase, count(*) AS f
  FROM t, (SELECT unnest([1, 2, 3, 4]) AS z) WHERE i + z - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 30),
c AS (
  SELECT lang, words, phrase, f AS a, unnest(range(1, words)) AS k, string_split(phrase, ' ') AS v FROM f WHERE words > 1),
s AS (
  SELECT c.lang, c.words, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM c JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.v[:c.k], ' ')
         JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.v[c.k + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1),
inside AS (
  SELECT lang, phrase, max(f) AS most FROM (
    SELECT lang, f, array_to_string(v[i:i + z - 1], ' ') AS phrase
    FROM (SELECT lang, f, words, string_split(phrase, ' ') AS v FROM f WHERE words > 2),
         (SELECT unnest([2, 3]) AS z), (SELECT unnest([1, 2, 3]) AS i) WHERE z < words AND i + z - 1 <= words)
  GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase,
       s.a, s.l, s.r, total.n, CAST(s.score AS BIGINT) AS score
FROM s JOIN total USING (lang) LEFT JOIN inside USING (lang, phrase)
WHERE inside.most IS NULL OR 100::HUGEINT * inside.most < 80::HUGEINT * s.a
QUALIFY rank <= 2000
"""
