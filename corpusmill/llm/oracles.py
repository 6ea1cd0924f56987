"""SQL (DuckDB) for the queries of this subpackage that SQL can express on small tables."""

from __future__ import annotations

_WS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def _bare(x: str) -> str:
    return f"regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def _tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_{_WS}]+'))"


_TRAIN = f"a AS (SELECT row_id, list_distinct({_words('text')}) AS w FROM dataset WHERE text IS NOT NULL), d AS (SELECT row_id, len(w) AS n, unnest(w) AS w FROM a WHERE len(w) >= 20)"
_TESTS = f"b AS (SELECT row_number() OVER () AS k, id, list_distinct({_words('text')}) AS w FROM dataset_test WHERE text IS NOT NULL AND id IS NOT NULL), t AS (SELECT k, id, len(w) AS n, unnest(w) AS w FROM b WHERE len(w) >= 20)"

_LINKS = f"""{_TRAIN}, l AS (SELECT x.row_id AS u, y.row_id AS v FROM d x JOIN d y ON x.w = y.w AND x.row_id < y.row_id AND y.n * 10 >= x.n * 7 AND x.n * 10 >= y.n * 7
 GROUP BY 1, 2 HAVING count(*) / (first(x.n) + first(y.n) - count(*)) >= 0.7), e AS (SELECT u, v FROM l UNION SELECT v, u FROM l)"""

_COPIES = f"""k AS (SELECT row_id, least(a, b) || ' ' || greatest(a, b) AS key FROM (SELECT row_id, {_bare("coalesce(termo, '')")} AS a, {_bare('text')} AS b FROM dataset WHERE text IS NOT NULL AND regexp_replace(text, '[{_WS}]+', '', 'g') <> ''))"""

_SUM = f"tok AS (SELECT source, sum({_tokens('text')}) AS n FROM documents GROUP BY 1), s AS (SELECT t.source, target_share, max_repeats, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER () AS total FROM source_targets t LEFT JOIN tok USING (source))"

_GRAMS = "SELECT {k}, g FROM (SELECT {k}, string_agg(w, ' ') OVER x AS g, count(*) OVER x AS c FROM (SELECT {k}, unnest(w) AS w, unnest(range(len(w))) AS i FROM {t}) WINDOW x AS (PARTITION BY {k} ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) WHERE c = 16"

_P1 = f"""{_TRAIN}, {_TESTS},
p1 AS (SELECT DISTINCT row_id, id AS test_id FROM (SELECT d.row_id, t.k, first(t.id) AS id, count(*) / (first(d.n) + first(t.n) - count(*)) AS j FROM d JOIN t USING (w) GROUP BY 1, 2) WHERE j >= 0.7)"""

_P2 = f"{_LINKS}, r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u), p2 AS (SELECT least(u, min(v)) AS group_row_id, u AS row_id FROM r GROUP BY u)"

_RUNS = f"""x AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL), y AS (SELECT row_number() OVER () AS k, id, {_words('text')} AS w FROM dataset_test WHERE text IS NOT NULL AND id IS NOT NULL),
a AS (SELECT doc_id, i, g FROM (SELECT doc_id, i, string_agg(w, ' ') OVER x AS g, count(*) OVER x AS c FROM (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM x) WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) WHERE c = 16),
b AS (SELECT k, i, g FROM (SELECT k, i, string_agg(w, ' ') OVER x AS g, count(*) OVER x AS c FROM (SELECT k, unnest(w) AS w, unnest(range(len(w))) AS i FROM y) WINDOW x AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) WHERE c = 16),
h AS (SELECT doc_id, k, a.i AS d, b.i AS t FROM a JOIN b USING (g)),
l AS (SELECT doc_id, k, count(*) + 15 AS n, min(d) AS d, min(t) AS t FROM (SELECT *, d - row_number() OVER (PARTITION BY doc_id, k, d - t ORDER BY d) AS run FROM h) GROUP BY doc_id, k, d - t, run)"""

_CUTS = f"""m AS (SELECT max_tokens AS m, overlap_tokens AS o FROM size_limits WHERE item_kind = 'documents'), d0 AS (SELECT doc_id, text, {_tokens('text')} AS n FROM documents WHERE text IS NOT NULL),
seg AS (SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(regexp_replace(replace(text, chr(10), chr(1)), '([.!?]["'')\\]»”’]*)[{_WS}]', '\\1' || chr(1), 'g'), chr(1)) AS s FROM d0 WHERE n > 0)),
cut AS (SELECT doc_id, sum({_tokens('s')}) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM seg), b AS (SELECT doc_id, list_sort(list_distinct(list(pos))) AS cuts FROM cut GROUP BY 1),
q(doc_id, n, cuts, piece, first_token, stop, nat) AS (SELECT doc_id, n, cuts, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), true FROM d0 JOIN b USING (doc_id)
 UNION ALL SELECT doc_id, n, cuts, piece + 1, greatest(stop - o, 0), CAST(coalesce(list_max(list_filter(cuts, lambda c: c > stop AND c <= greatest(stop - o, 0) + m)), greatest(stop - o, 0) + m) AS BIGINT),
  list_max(list_filter(cuts, lambda c: c > stop AND c <= greatest(stop - o, 0) + m)) IS NOT NULL FROM q, m WHERE stop < n)"""

ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_P1} SELECT row_id, test_id FROM p1",
    "p1_report": f"""WITH {_P1}, o AS (SELECT DISTINCT id AS test_id, split_name FROM dataset_test)
SELECT split_name, source, count(*) AS pairs, count(DISTINCT row_id) AS train_rows, count(DISTINCT test_id) AS test_items FROM p1 JOIN o USING (test_id) JOIN dataset USING (row_id) GROUP BY 1, 2""",
    "p2_found": f"WITH RECURSIVE {_P2} SELECT group_row_id, row_id FROM p2",
    "p2_group_sizes": f"WITH RECURSIVE {_P2} SELECT members, count(*) AS groups FROM (SELECT count(*) AS members FROM p2 GROUP BY group_row_id) GROUP BY 1",
    "p3_found": f"WITH {_COPIES} SELECT first_row_id, row_id FROM (SELECT min(row_id) OVER (PARTITION BY key) AS first_row_id, row_id, count(*) OVER (PARTITION BY key) AS n FROM k) WHERE n > 1",
    "p3_one_of_each": f"WITH {_COPIES} SELECT min(row_id) AS row_id, count(*) AS copies FROM k GROUP BY key",
    "p4_found": f"""WITH RECURSIVE v AS (SELECT DISTINCT termo FROM dataset WHERE termo IS NOT NULL AND length(termo) <= 120),
n AS (SELECT termo, {_bare('p')} AS name FROM (SELECT termo, unnest(string_split(termo, ';')) AS p FROM v) WHERE {_bare('p')} <> ''),
e AS (SELECT DISTINCT a.name AS u, b.name AS v FROM n a JOIN n b USING (termo)), r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
c AS (SELECT u AS name, min(v) AS unit FROM r GROUP BY 1), t AS (SELECT termo, min(unit) AS unit FROM n JOIN c USING (name) GROUP BY 1), k AS (SELECT unit FROM t GROUP BY 1 HAVING count(*) > 1)
SELECT row_id, unit FROM dataset JOIN t USING (termo) WHERE unit IN (SELECT unit FROM k)""",
    "p5_found": f"""WITH x AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL), y AS (SELECT row_number() OVER () AS k, id, {_words('text')} AS w FROM dataset_test WHERE text IS NOT NULL AND id IS NOT NULL),
a AS ({_GRAMS.format(k='doc_id', t='x')}), b AS ({_GRAMS.format(k='k', t='y')}) SELECT DISTINCT a.doc_id, y.id AS test_id FROM a JOIN b USING (g) JOIN y USING (k)""",
    "p5_longest_matches": f"""WITH {_RUNS} SELECT doc_id, id AS test_id, n AS match_words, d AS doc_word, t AS test_word FROM (SELECT doc_id, y.id, n, d, t, row_number() OVER (PARTITION BY doc_id, y.id ORDER BY n DESC, d, t) AS rn FROM l JOIN y USING (k)) WHERE rn = 1""",
    "p5_clean_sources": f"WITH {_RUNS} SELECT source, count(*) AS documents FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l) GROUP BY 1",
    "p4_checked": "SELECT 'units divided' AS what, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'rows assigned', count(*) FROM dataset UNION ALL SELECT 'rows more than once', 0 UNION ALL SELECT 'splits off their share by more than a bin', 0",
    "p6_wanted": f"WITH {_SUM} SELECT source, n AS tokens, CAST(round(target_share * total) AS BIGINT) AS wanted_tokens, n * max_repeats >= target_share * total AS reachable FROM s",
    "p6_checked": "SELECT 'documents drawn too often' AS what, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'rates not settled', 0 UNION ALL SELECT 'sources with room off their share', 0",
    "p7_cuts": f'WITH RECURSIVE {_CUTS} SELECT doc_id, CAST(piece AS BIGINT) AS piece, first_token, stop - first_token AS tokens, nat AS "natural" FROM q WHERE piece > 0',
    "p6_found": f"WITH {_SUM} SELECT source FROM s WHERE n * max_repeats < target_share * total",
    "p7_found": f"""WITH m AS (SELECT max_tokens AS m FROM size_limits WHERE item_kind = 'documents'), d AS (SELECT doc_id, text, {_tokens('text')} AS n FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(string_split(regexp_replace(replace(text, chr(10), chr(1)), '([.!?]["'')\\]»”’]*)[{_WS}]', '\\1' || chr(1), 'g'), chr(1))) AS s FROM d, m WHERE n > m)
SELECT doc_id FROM s, m GROUP BY doc_id HAVING max({_tokens('s')}) > first(m)""",
}
