"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from quire.llm.common import UPPER
from quire.llm.licenses import BASE_RARE, RARE, library

MIXED_ROWS = r"""
sized AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM sources),
capped AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS full_at FROM weighed),
levels AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM capped) - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
chosen AS (SELECT full_at AS first_at, level FROM levels WHERE level < full_at ORDER BY full_at, level LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN (SELECT count(*) FROM chosen) = 0 OR full_at < (SELECT first_at FROM chosen) THEN cap ELSE least(cap, w * (SELECT level FROM chosen)) END AS target FROM levels),
taken AS (SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('20250601:' || CASE WHEN nth > 0 THEN nth || ':' ELSE '' END || coalesce(s.doc_id::VARCHAR, '') || ':' || coalesce(s.text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS drawn
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text, source) - 1 AS nth FROM sized) s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT *, (floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM taken)
"""

TOP_K = """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT uid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM v),
p AS (SELECT a.uid, a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.uid <> b.uid AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

LINE_COPIES = r"""
doc AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {docs}),
ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1)::BIGINT AS i FROM doc),
wd AS (SELECT doc_id, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))::BIGINT AS w FROM ln UNION ALL SELECT doc_id, 0, 0 FROM doc),
cu AS (SELECT doc_id, i, w, sum(w) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS cum FROM wd),
fw AS (SELECT doc_id, i + 1 AS s, min(i) OVER (PARTITION BY doc_id ORDER BY cum RANGE BETWEEN {words} FOLLOWING AND UNBOUNDED FOLLOWING) AS e FROM cu),
bw AS (SELECT doc_id, max(i) OVER (PARTITION BY doc_id ORDER BY cum RANGE BETWEEN UNBOUNDED PRECEDING AND {words} PRECEDING) + 1 AS s, i AS e FROM cu),
wi AS (SELECT DISTINCT doc_id, s, e FROM (SELECT * FROM fw UNION ALL SELECT * FROM bw) WHERE s IS NOT NULL AND e >= s),
nm AS (SELECT wi.doc_id, s, e, array_to_string(ls[s:e], chr(10)) AS body FROM wi JOIN doc USING (doc_id)),
lt AS (SELECT *, row_number() OVER (PARTITION BY body, e - s ORDER BY doc_id, s) AS nth FROM nm),
cut AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM lt WHERE nth > 1),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM ln ANTI JOIN cut USING (doc_id, i) GROUP BY doc_id)
"""


def line_copies(words: int) -> str:
    """The documents without later copies of runs of at least so many words."""
    lost = "(coalesce(len(ls), 0) - coalesce(n, 0))::BIGINT AS n_deleted"
    return "WITH " + LINE_COPIES.format(docs="documents", words=words) + f"SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t, '') END AS text, coalesce(len(ls), 0)::BIGINT AS n_lines, {lost} FROM doc d LEFT JOIN kept USING (doc_id)"


def _words(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEMPLATES = ", ".join(f"({n}, '{t.label}', {t.base}, {t.key_at}, {_words(t.key)}, {_words(t.words)})" for n, t in enumerate(library()))
LICENSES = rf"""
WITH w AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t(t, label, base, key_at, key, words) AS (VALUES {_TEMPLATES}),
tw AS (SELECT t, base, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM t),
vocab AS (SELECT DISTINCT word FROM tw),
tok AS (SELECT u, word, i FROM (SELECT u, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w) SEMI JOIN vocab USING (word)),
files AS (SELECT word, count(DISTINCT u) AS n FROM tok GROUP BY 1),
void AS (SELECT DISTINCT t FROM (SELECT t, unnest(key) AS word FROM t) ANTI JOIN files USING (word)),
rare AS (SELECT t, word FROM (SELECT t, word, base, row_number() OVER (PARTITION BY t ORDER BY n, word) AS r FROM (SELECT DISTINCT t, base, word FROM tw ANTI JOIN void USING (t)) JOIN files USING (word)) WHERE r <= CASE WHEN base THEN {BASE_RARE} ELSE {RARE} END),
post AS (SELECT t, word, pos FROM tw SEMI JOIN rare USING (t, word)),
need AS (SELECT t, CASE WHEN base THEN count(*) ELSE greatest(1, (2 * count(*) + 4) // 5) END AS need FROM post JOIN t USING (t) GROUP BY t, base),
vote AS (SELECT u, t, start FROM (SELECT u, t, i - pos AS start, count(*) AS n FROM tok JOIN post USING (word) GROUP BY ALL) JOIN need USING (t) WHERE n >= need),
m AS (SELECT u, ws, t.*, start FROM vote JOIN w USING (u) JOIN t USING (t) WHERE start + key_at >= 0 AND ws[start + key_at + 1 : start + key_at + len(key)] = key),
s AS (SELECT u, label, base, start + key_at AS i, list_sum(list_transform(range(0, len(words)), lambda j: CASE WHEN start + j >= 0 AND ws[start + j + 1] = words[j + 1] THEN 1 ELSE 0 END))::DOUBLE / len(words) AS score FROM m),
g AS (SELECT u, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word, list_sort(list(DISTINCT label) FILTER (base)) AS b, list_sort(list(DISTINCT label)) AS l, max(score) AS score FROM s GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(b, ','), '') AS base_labels, coalesce(array_to_string(l, ','), '') AS labels, round(coalesce(score, 0.0::DOUBLE), 6) AS score FROM w LEFT JOIN g USING (u)
"""

SQL: dict[str, str] = {
    "op5_license_scan": LICENSES,
    "op1_line_dedup": line_copies(50),
    "line_dedup_any_run": line_copies(1),
    "op6_norm_buckets": TOP_K,
    "op7_mixing_sources": "WITH " + MIXED_ROWS.format(docs="documents") + "SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed",
}
