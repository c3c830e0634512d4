"""DuckDB SQL for the operators that SQL expresses on whole tables in reasonable time."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Each string of 50 bytes as 100 hexadecimal digits, with the smallest document in which it begins.
OP1 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
x AS (SELECT doc_id, p, lag(p) OVER o AS before FROM w JOIN f USING (s) WHERE first < doc_id WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
g AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM x),
r AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, run),
c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS left_end FROM r),
k AS (SELECT c.doc_id, string_agg(substr(h, 2 * left_end + 1, 2 * (a - left_end)), '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS removed, count(*) AS spans FROM c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || CASE WHEN kept IS NULL THEN h ELSE substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0d]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s), x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = n.doc_id"""

OP3 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.vec_id WHERE r.c < e.b)
SELECT v.vec_id, coalesce(n, 0) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a) k ON k.vec_id = v.vec_id JOIN (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id) m ON m.vec_id = v.vec_id"""


def op6() -> str:
    """TF-IDF cosine and inheritance, from the templates of the operator."""
    from .licenses import TEMPLATES, _python_terms

    rows = ", ".join(f"('{k}', '{w}')" for k, v in TEMPLATES.items() for w in _python_terms(v))
    return f"""WITH t AS (SELECT license, term, count(*) AS c FROM (VALUES {rows}) x(license, term) GROUP BY ALL), vocabulary AS (SELECT DISTINCT term FROM t),
p AS (SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://', ''), '[?#].*$', ''), '^(.*)/[^/]*$', 1) AS directory,
  regexp_split_to_array(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\s*\\n\\s*') AS units FROM pages),
u AS (SELECT page_id, row_number() OVER () AS u, unit FROM (SELECT page_id, unnest(units) AS unit FROM p) WHERE regexp_matches(unit, '(?i)licen[sc]|copyright|\\brights\\b|public domain|\\bspdx\\b')),
w AS (SELECT u, term, count(*) AS c FROM (SELECT u, unnest(string_split(regexp_replace(regexp_replace(lower(unit), '[^a-z0-9.\\-]+', ' ', 'g'), '[.\\-]+( |$)', ' ', 'g'), ' ')) AS term FROM u) WHERE term <> '' GROUP BY ALL),
n AS (SELECT count(*) AS n FROM u), df AS (SELECT v.term, ln((n + 1) / (count(w.u) + 1)) + 1 AS idf FROM vocabulary v CROSS JOIN n LEFT JOIN w ON w.term = v.term GROUP BY v.term, n),
un AS (SELECT u, sqrt(sum((c * coalesce(idf, ln(n + 1) + 1)) ** 2)) AS norm FROM w CROSS JOIN n LEFT JOIN df ON df.term = w.term GROUP BY u),
tn AS (SELECT license, sqrt(sum((c * idf) ** 2)) AS norm FROM t JOIN df USING (term) GROUP BY license),
s AS (SELECT w.u, t.license, sum(w.c * t.c * idf * idf) / any_value(un.norm) / any_value(tn.norm) AS score FROM w JOIN t ON t.term = w.term JOIN df ON df.term = w.term JOIN un ON un.u = w.u JOIN tn ON tn.license = t.license GROUP BY ALL),
b AS (SELECT page_id, s.u, max((round(score, 12), license)) AS own FROM s JOIN u ON u.u = s.u GROUP BY ALL),
o AS (SELECT page_id, coalesce(max(own) FILTER (WHERE struct_extract(own, 2) <> 'Proprietary'), max(own)) AS own FROM b WHERE struct_extract(own, 1) >= 0.6 GROUP BY page_id),
k AS (SELECT p.page_id, directory, own FROM p LEFT JOIN o ON o.page_id = p.page_id),
h AS (SELECT directory AS above, max(own) AS held FROM k WHERE own IS NOT NULL AND directory IS NOT NULL GROUP BY directory),
a AS (SELECT page_id, arg_max(above, length(above)) AS above, arg_max(held, length(above)) AS held FROM k JOIN h ON k.directory = above OR starts_with(k.directory, above || '/') WHERE own IS NULL GROUP BY page_id)
SELECT k.page_id, directory, coalesce(struct_extract(own, 2), struct_extract(held, 2)) AS license, round(coalesce(struct_extract(own, 1), struct_extract(held, 1)), 6) AS score, CASE WHEN own IS NULL THEN above END AS inherited_from FROM k LEFT JOIN a ON a.page_id = k.page_id"""


_LEVEL = "length(regexp_replace(regexp_extract(x, '^((?:[ \\t]*>)*)', 1), '[ \\t]', '', 'g'))"
_WORDS = "trim(regexp_replace(lower(regexp_replace(x, '^((?:[ \\t]*>)*)', '')), '\\s+', ' ', 'g'))"
_SENTENCES = "string_split(regexp_replace(words, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10))"


def _quote(column: str, mark: str) -> str:
    return f"coalesce('{mark}' || replace({column}, chr(10), chr(10) || '{mark}') || chr(10), '')"


def _passages(lines: str) -> str:
    """Runs of neighbouring lines of one level, up to a blank one, as one text."""
    return f"""SELECT conv_id, turn, role, text, level, string_agg(words, ' ' ORDER BY k) AS words FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn, role, text ORDER BY k) AS run FROM
  (SELECT *, CASE WHEN words = '' OR level IS DISTINCT FROM lag(level) OVER o OR lag(words) OVER o = '' THEN 1 ELSE 0 END AS new FROM {lines} WINDOW o AS (PARTITION BY conv_id, turn, role, text ORDER BY k))) WHERE words <> '' GROUP BY conv_id, turn, role, text, level, run"""


OP10 = f"""WITH RECURSIVE p AS (SELECT conv_id, turn, regexp_replace(min(text), '(.{{40,60}}) ', '\\1' || chr(10), 'g') AS text FROM conversations GROUP BY conv_id, turn),
c AS (SELECT DISTINCT c.conv_id, c.turn, c.role, {_quote('b.text', '> > ')} || {_quote('a.text', '> ')} || coalesce(c.text, '') AS text FROM conversations c
  LEFT JOIN p a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN p b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
l AS (SELECT conv_id, turn, role, text, k, lines[k] AS x, {_LEVEL.replace('x,', 'lines[k],')} AS level, {_WORDS.replace('x,', 'lines[k],')} AS words FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT *, regexp_split_to_array(text, '\\r?\\n') AS lines FROM c))),
own AS (SELECT * FROM l WHERE level = 0), t AS (SELECT c.*, trim(coalesce(o.clean, '')) AS clean FROM c LEFT JOIN (SELECT conv_id, turn, role, text, string_agg(x, chr(10) ORDER BY k) AS clean FROM own GROUP BY ALL) o USING (conv_id, turn, role, text)),
ps AS ({_passages('l')}),
q AS (SELECT conv_id, turn, level, unnest({_SENTENCES}) AS words FROM ps WHERE level > 0),
s AS (SELECT conv_id, turn, unnest({_SENTENCES}) AS words FROM ps WHERE level = 0 UNION ALL SELECT conv_id, turn, words FROM own),
f AS (SELECT conv_id, words, min(turn) AS source FROM s WHERE words <> '' GROUP BY conv_id, words HAVING length(words) >= 12 OR min(turn) = max(turn)),
k AS (SELECT q.conv_id, q.turn, level, source, sum(length(words)) AS chars FROM q JOIN f USING (conv_id, words) WHERE source < q.turn GROUP BY ALL),
b AS (SELECT conv_id, turn, count(*) AS n_links, arg_max(source, (-level, chars, source)) AS reply_to FROM k GROUP BY ALL),
r(conv_id, turn, thread) AS (SELECT DISTINCT conv_id, turn, turn FROM c WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM b) UNION ALL SELECT b.conv_id, b.turn, r.thread FROM b JOIN r ON r.conv_id = b.conv_id AND r.turn = b.reply_to),
m AS (SELECT t.conv_id, t.turn, t.role, clean, reply_to, coalesce(n_links, 0) AS n_links, thread, (t.turn - thread) // 64 AS part FROM t LEFT JOIN b USING (conv_id, turn) JOIN r USING (conv_id, turn))
SELECT conv_id, thread, part, 0 AS slice, CAST(count(*) AS INT) AS n_messages, CAST(sum(n_links) AS INT) AS n_links, coalesce(string_agg(turn || '<' || reply_to, ' ' ORDER BY turn, role, clean) FILTER (WHERE reply_to IS NOT NULL), '') AS replies,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || clean || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn, role, clean) AS formatted FROM m GROUP BY conv_id, thread, part"""

#: Lines by their keys; a key's lines stay in the largest of its documents.
OP12 = f"""WITH l AS (SELECT doc_id, a[p] AS x, p FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))),
k AS (SELECT doc_id, p, x, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT k.doc_id, p, x, coalesce(k.doc_id <> last, false) AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id"""
