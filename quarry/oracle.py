"""Fragments of DuckDB SQL that say the text semantics independently of the Column functions."""

from __future__ import annotations

from .functions.stem import stem_sql
from .functions.text import CITATION, QUESTION_WORDS, STOPWORDS

STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
QWORDS = "(" + ", ".join(f"'{w}'" for w in QUESTION_WORDS) + ")"


def fold(t: str) -> str:
    return f"lower(strip_accents({t}))"


def words(t: str) -> str:
    return rf"list_transform(regexp_extract_all({fold(t)}, '[\p{{L}}\p{{N}}]+(?:[''’]\p{{L}}+)?'), lambda x: regexp_replace(x, '[''’].*$', ''))"


def content(t: str) -> str:
    return rf"list_filter({words(t)}, lambda x: (len(x) > 1 OR regexp_matches(x, '^\p{{Nd}}')) AND x NOT IN {STOP})"


def index_tokens(t: str) -> str:
    return rf"regexp_extract_all({fold(t)}, '[\p{{L}}\p{{N}}]+')"


def distinct_in_order(a: str) -> str:
    return f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"


def paragraphs(t: str) -> str:
    return rf"list_filter(list_transform(string_split({t}, chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"


def norm_title(t: str) -> str:
    return f"array_to_string({words(f'replace({t}, chr(95), chr(32))')}, ' ')"


def numbers(t: str) -> str:
    return (
        rf"list_distinct(list_transform(regexp_extract_all({t}, '(?:^|[^\p{{L}}\d])((?:\d{{1,3}}(?:[,\x{{00A0}} ]\d{{3}})+|\d+)(?:\.\d+)?)', 1), "
        r"lambda x: CASE WHEN ltrim(regexp_replace(regexp_replace(x, '\..*$', ''), '[,\x{00A0} ]', '', 'g'), '0') = '' THEN '0' "
        r"ELSE ltrim(regexp_replace(regexp_replace(x, '\..*$', ''), '[,\x{00A0} ]', '', 'g'), '0') END || "
        r"CASE WHEN rtrim(regexp_extract(x, '\.(\d+)$', 1), '0') = '' THEN '' ELSE '.' || rtrim(regexp_extract(x, '\.(\d+)$', 1), '0') END))"
    )


def heading(p: str) -> str:
    return rf"(len({p}) < 80 AND NOT regexp_matches({p}, '[.:?!,;]$') AND len(regexp_extract_all({p}, '\S+')) <= 10 AND regexp_matches({p}, '^\p{{Lu}}'))"


def citations(t: str) -> str:
    return (
        rf"flatten(list_transform(flatten(list_transform(regexp_extract_all({t}, '{CITATION}', 1), lambda g: string_split(g, ','))), "
        r"lambda p: range(CAST(regexp_extract(p, '^\s*(\d+)', 1) AS INTEGER), 1 + CAST(coalesce(nullif(regexp_extract(p, '[–-]\s*(\d+)', 1), ''), regexp_extract(p, '^\s*(\d+)', 1)) AS INTEGER))))"
    )


#: Articles and passages as ``operators.ingest`` makes them from documents.
ARTICLES = rf"""ar0 AS (SELECT doc_id, {paragraphs("coalesce(text, '')")} AS paras FROM documents),
ar AS (SELECT doc_id, regexp_replace(substr(coalesce(paras[1], ''), 1, 60), '\s*\([\s;,]*\)', '', 'g') AS title, paras,
  coalesce(list_sum(list_transform(paras, lambda p: len(regexp_extract_all(p, '\S+')))), 0) AS words FROM ar0)"""
PASSAGES = f"""{ARTICLES},
ps AS (SELECT doc_id * 1000000 + ord AS chunk_id, doc_id, ord, title, body FROM (SELECT doc_id, title, unnest(paras) AS body, generate_subscripts(paras, 1) - 1 AS ord FROM ar))"""
#: Tokens with weights and stems, and statistics.
INDEX = f"""{PASSAGES},
tk0 AS (SELECT chunk_id, {index_tokens("title")} AS a, {index_tokens("body")} AS b FROM ps),
tk AS (SELECT chunk_id, len(a) + len(b) AS n, 'title' AS col, 6.0 AS weight, unnest(a) AS word, generate_subscripts(a, 1) - 1 AS pos FROM tk0
  UNION ALL SELECT chunk_id, len(a) + len(b), 'text', 1.0, unnest(b), generate_subscripts(b, 1) - 1 FROM tk0),
sm AS (SELECT count(*) AS n_chunks, avg(len(a) + len(b)) AS avg_len FROM tk0),
qs AS (SELECT item_id AS qid, text AS question FROM benchmark),
qt0 AS (SELECT qid, {content("question")} AS w FROM qs),
qt1 AS (SELECT qid, {distinct_in_order("w")} AS w FROM qt0),
vocab AS (SELECT word FROM tk UNION SELECT unnest(w) FROM qt1 UNION SELECT unnest({content("title")}) FROM ps UNION SELECT unnest({content("body")}) FROM ps),
{stem_sql("vocab")},
qt AS (SELECT qid, pos, word, stem FROM (SELECT qid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM qt1) JOIN stems USING (word)),
pl AS (SELECT chunk_id, n, col, weight, pos, stem FROM tk JOIN stems USING (word) WHERE stem IN (SELECT stem FROM qt)),
fr AS (SELECT stem, chunk_id, n, sum(weight) AS freq FROM pl GROUP BY ALL),
df AS (SELECT stem, count(*) AS df FROM fr GROUP BY 1),
cb AS (SELECT stem, chunk_id, CASE WHEN ln((n_chunks - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_chunks - df + 0.5) / (df + 0.5)) END
  * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * n / avg_len)) AS score FROM fr JOIN df USING (stem), sm),
ra0 AS (SELECT qid, pos, word, stem, CASE WHEN coalesce(df, 0) >= 2 THEN df ELSE 0 END AS df, n_chunks FROM qt LEFT JOIN df USING (stem), sm),
ra1 AS (SELECT *, ln((n_chunks - df + 0.5) / (df + 0.5) + 1) AS idf, df < n_chunks * 0.03 AS low, max(CAST(df < n_chunks * 0.03 AS INT)) OVER (PARTITION BY qid) AS any_low FROM ra0),
ra AS (SELECT qid, pos, word, stem, df, idf, row_number() OVER (PARTITION BY qid ORDER BY pos) AS "use", row_number() OVER (PARTITION BY qid ORDER BY round(idf, 9) DESC, pos) AS rare
  FROM ra1 WHERE low OR any_low = 0)"""


def top(source: str, n: int) -> str:
    """The first ``n`` of ``source(qid, chunk_id, score)``, ranked from 0."""
    return f"SELECT qid, chunk_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM ({source})) WHERE rank < {n}"


OR_LIST = top('SELECT qid, chunk_id, sum(score) AS score FROM cb JOIN ra USING (stem) WHERE "use" <= 12 GROUP BY ALL', 80)
AND_BASE = """an0 AS (SELECT qid, chunk_id, count(*) AS n, sum(score) AS score, count(*) FILTER (rare <= 2) AS n2, sum(score) FILTER (rare <= 2) AS score2
  FROM cb JOIN (SELECT * FROM ra WHERE rare <= 4) USING (stem) GROUP BY ALL),
an1 AS (SELECT qid, count(*) AS need FROM ra WHERE rare <= 4 GROUP BY 1),
an2 AS (SELECT qid, count(*) FILTER (n = need) AS n_full FROM an0 JOIN an1 USING (qid) GROUP BY 1),
an AS (SELECT qid, chunk_id, CASE WHEN n_full < 5 AND need > 2 THEN score2 ELSE score END AS score FROM an0 JOIN an1 USING (qid) JOIN an2 USING (qid)
  WHERE need >= 2 AND CASE WHEN n_full < 5 AND need > 2 THEN n2 = 2 ELSE n = need END)"""
AND_LIST = top("SELECT * FROM an", 60)
FUSED = f"""{AND_BASE}, ls AS (SELECT qid, chunk_id, 1.0 / (61 + rank) AS part FROM ({AND_LIST}) UNION ALL SELECT qid, chunk_id, 0.8 / (61 + rank) FROM ({OR_LIST})),
fu0 AS (SELECT qid, chunk_id, sum(part) AS fused FROM ls GROUP BY ALL),
fu AS (SELECT *, fused / max(fused) OVER (PARTITION BY qid) AS rrf, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 12) DESC, chunk_id) AS place FROM fu0)"""


def stem_list(t: str) -> str:
    """Stems of a text's content words, by the map ``sx``."""
    return f"list_transform({content(t)}, lambda z: sx[z])"


RERANKED = f"""{FUSED}, mp AS (SELECT map(list(word), list(stem)) AS sx FROM stems),
q2 AS (SELECT qid, {stem_list("question")} AS q FROM qs, mp),
c2 AS (SELECT chunk_id, ps.doc_id AS doc_id, ord, {stem_list("ps.title || '. ' || body")} AS seq, list_distinct({stem_list("ps.title")}) AS ts, least(1.0, log10(greatest(10, words)) / 4.5) AS prior
  FROM ps JOIN ar ON ar.doc_id = ps.doc_id, mp WHERE chunk_id IN (SELECT chunk_id FROM fu WHERE place <= 40)),
q3 AS (SELECT qid, q, list_distinct(q) AS qs, list_distinct(list_filter(list_transform(range(1, greatest(len(q), 1)), lambda i: CASE WHEN q[i] <> q[i + 1] THEN q[i] || ' ' || q[i + 1] END), lambda z: z IS NOT NULL)) AS qp FROM q2),
c3 AS (SELECT *, list_distinct(flatten(list_transform(range(1, len(seq) + 1), lambda i: flatten(list_transform([1, 2], lambda d: CASE WHEN i + d <= len(seq) THEN [seq[i] || ' ' || seq[i + d], seq[i + d] || ' ' || seq[i]] ELSE [] END))))) AS sp FROM c2),
rr AS (SELECT qid, chunk_id, doc_id, ord, rrf,
  CASE WHEN len(qs) = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform(list_intersect(qs, seq), lambda z: CASE WHEN len(z) > 6 THEN 1.3 ELSE 1.0 END)), 0) / list_sum(list_transform(qs, lambda z: CASE WHEN len(z) > 6 THEN 1.3 ELSE 1.0 END)) END AS coverage,
  CASE WHEN len(qp) = 0 THEN 0.0 ELSE len(list_intersect(qp, sp)) / len(qp) END AS proximity,
  CASE WHEN len(ts) = 0 THEN 0.0 ELSE len(list_intersect(ts, qs)) / len(ts) END AS title_overlap, CASE WHEN ord = 0 THEN 1.0 ELSE 0.0 END AS lead, prior
  FROM fu JOIN c3 USING (chunk_id) JOIN q3 USING (qid) WHERE place <= 40),
sc AS (SELECT *, 0.30 * rrf + 0.30 * coverage + 0.14 * proximity + 0.10 * title_overlap + 0.04 * lead + 0.04 * prior AS score FROM rr)"""
DIVERSE = """dv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(score, 9) DESC, chunk_id) AS d FROM sc) WHERE d <= 2) WHERE rank <= 10)"""
