"""SQL for the text operators that SQL can express."""

from __future__ import annotations

from quiremill.llm.repetition import LIMITS, LINE_LIMIT

_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard(n: int, num: int, den: int) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= {n} THEN list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: md5(array_to_string(w[i:i + {n - 1}], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2, 3),
l AS (SELECT a, b FROM p WHERE {den} * c >= {num} * (n - c)),
sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS at FROM sym UNION SELECT r.doc_id, sym.b FROM r JOIN sym ON sym.a = r.at)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, coalesce(min(r.at), s.doc_id) AS component_id FROM s LEFT JOIN r ON r.doc_id = s.doc_id GROUP BY 1, 2"""


def repetition() -> str:
    lengths = [3, *LIMITS]
    grams = ", ".join(
        f"g{n} AS (SELECT doc_id, unnest(range(1, len(w) - {n - 2})) AS i, w FROM d), h{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {n - 1}], ' ')) AS c FROM g{n}), "
        f"p{n} AS (SELECT DISTINCT doc_id, i + unnest(range({n})) AS i FROM h{n} WHERE c > 1), c{n} AS (SELECT doc_id, count(*) AS words, sum(length(w[i])) AS chars FROM p{n} JOIN d USING (doc_id) GROUP BY 1)"
        for n in lengths
    )
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = d.doc_id" for n in lengths)
    shares = " AND ".join(f"coalesce(c{n}.chars, 0)::DOUBLE / greatest(wc, 1) <= {limit}" for n, limit in LIMITS.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents), {grams},
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM d),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM l WHERE regexp_matches(line, {_WORD})),
q AS (SELECT doc_id, count(*) FILTER (k > 1) AS dup, coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) FILTER (k > 1), 0) AS dup_chars FROM m GROUP BY 1),
a AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS wc, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM d),
r AS (SELECT d.doc_id, n_words, wc AS word_chars, n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(c3.words, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(c3.words, 0) > 50 * n_words AS base_failed,
  {shares} AND coalesce(dup_chars, 0)::DOUBLE / greatest(wc, 1) <= {LINE_LIMIT} AS good FROM d JOIN a ON a.doc_id = d.doc_id {joins} LEFT JOIN q ON q.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept FROM r"""


def substring(window: int = 50) -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - {window - 2})) AS i, w FROM d), h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS h FROM x),
f AS (SELECT h, min(doc_id) AS m FROM h GROUP BY 1), g AS (SELECT DISTINCT doc_id, i + unnest(range({window})) AS i FROM h JOIN f USING (h) WHERE m < doc_id),
o AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT o.doc_id, count(g.i) AS n_removed, sha256(coalesce(string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY o.i), '')) AS kept_sha256 FROM o LEFT JOIN g ON g.doc_id = o.doc_id AND g.i = o.i GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
