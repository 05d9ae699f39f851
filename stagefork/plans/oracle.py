"""SQL for the queries of this package, written from their formulas for another engine."""

from __future__ import annotations

import re

from ..functions.stem import AFTER_PLURAL, DOUBLE, PREFIXES, SHORT, STEP_2, STEP_3, STEP_4, WHOLE
from ..functions.text import CONTENT_STOPWORDS, INDEX_STOPWORDS


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


STOP, CONTENT = _list(INDEX_STOPWORDS), _list(CONTENT_STOPWORDS)
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"
WORD = r"'^\p{L}{3,}$'"


def _tokens(x: str) -> str:
    return TOKENS.format(x)


def _terms(x: str) -> str:
    return f"list_filter({_tokens(x)}, lambda t: NOT list_contains({STOP}, t))"


def _draw(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def _bigrams(x: str) -> str:
    return f"list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1])"


def _bm25(name: str, texts: str) -> dict[str, str]:
    """Scores and first 20 of the channels, for the texts in a step `texts`."""
    return {
        f"{name}_bm25": f"""SELECT q.text, p.doc_id, round(CAST(sum(p.contrib) AS DOUBLE), 9) AS bm25
            FROM (SELECT text, unnest({_terms('text')}) AS term FROM {texts}) q JOIN posts p USING (term) GROUP BY ALL""",
        f"{name}_qv": f"""SELECT text, CAST(h % 64 AS INT) AS bucket, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS q
            FROM (SELECT text, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) AS h
                  FROM (SELECT text, unnest(list_concat(toks, {_bigrams('toks')})) AS f FROM (SELECT text, {_tokens('text')} AS toks FROM {texts})))
            GROUP BY ALL HAVING q <> 0""",
        f"{name}_dense": f"""SELECT text, doc_id, round(dot / (norm * q_norm), 9) AS dense
            FROM (SELECT text, doc_id, CAST(sum(v * q) AS DOUBLE) AS dot, any_value(norm) AS norm, any_value(q_norm) AS q_norm
                  FROM vectors JOIN {name}_qv USING (bucket) JOIN (SELECT text, sqrt(sum(q * q)) AS q_norm FROM {name}_qv GROUP BY text) USING (text) GROUP BY ALL)""",
        **{f"{name}_{c}_top": f"""SELECT * FROM (SELECT text, doc_id, score, row_number() OVER (PARTITION BY text ORDER BY score DESC, doc_id) AS rk
            FROM (SELECT t.text, d.doc_id, coalesce(s.{c}, 0.0) AS score FROM {texts} t CROSS JOIN (SELECT doc_id FROM corpus) d LEFT JOIN {name}_{c} s ON s.text = t.text AND s.doc_id = d.doc_id))
            WHERE rk <= 20""" for c in ("bm25", "dense")},
    }


def _run(name: str, worlds: str) -> dict[str, str]:
    """Ranks of all worlds in the step `worlds` (world_id, bm25_text, dense_text, rerank_text, first_stage)."""
    return {
        f"{name}_texts": f"SELECT DISTINCT bm25_text AS text FROM {worlds} UNION SELECT dense_text FROM {worlds}",
        **_bm25(name, f"{name}_texts"),
        f"{name}_pool": f"""SELECT world_id, doc_id, CASE sum(c) WHEN 3 THEN 'both' WHEN 1 THEN 'bm25_only' ELSE 'dense_only' END AS provenance FROM (
            SELECT w.world_id, t.doc_id, 1 AS c FROM {worlds} w JOIN {name}_bm25_top t ON t.text = w.bm25_text WHERE first_stage <> 'dense'
            UNION ALL SELECT w.world_id, t.doc_id, 2 FROM {worlds} w JOIN {name}_dense_top t ON t.text = w.dense_text WHERE first_stage <> 'bm25') GROUP BY ALL""",
        f"{name}_pairs": f"SELECT DISTINCT w.rerank_text AS text, p.doc_id FROM {name}_pool p JOIN {worlds} w USING (world_id)",
        f"{name}_ce": f"""SELECT p.text, p.doc_id, round(coalesce(CAST(c.cover AS DOUBLE), 0.0)
                + 0.5 * len(list_intersect({_bigrams('p.toks')}, {_bigrams('d.tokens')})) - 0.1 * ln(1 + d.doc_len), 6) AS ce
            FROM (SELECT text, doc_id, {_tokens('text')} AS toks FROM {name}_pairs) p JOIN corpus d USING (doc_id)
            LEFT JOIN (SELECT x.text, x.doc_id, sum(CAST(posts.idf AS DECIMAL(38, 12))) AS cover
                       FROM (SELECT text, doc_id, unnest(list_distinct({_terms('text')})) AS term FROM {name}_pairs) x JOIN posts USING (term, doc_id) GROUP BY ALL) c
            ON c.text = p.text AND c.doc_id = p.doc_id""",
        f"{name}_ranked": f"""SELECT world_id, doc_id, provenance, ce, n, CAST(least(n, 21) AS INT) AS rank FROM (
            SELECT p.world_id, p.doc_id, p.provenance, c.ce, row_number() OVER (PARTITION BY p.world_id ORDER BY c.ce DESC, p.doc_id) AS n
            FROM {name}_pool p JOIN {worlds} w USING (world_id) JOIN {name}_ce c ON c.text = w.rerank_text AND c.doc_id = p.doc_id)""",
    }


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in table.items()) + "}"


def _stems(words: str) -> str:
    """term, stem for a step with a column `term`."""
    behind = "CASE WHEN regexp_matches({x}, '[aeiouy][^aeiouy]') THEN length(regexp_extract({x}, '^[^aeiouy]*[aeiouy]+[^aeiouy]')) ELSE length({x}) END"
    ending = lambda names: f"regexp_extract(w, '({'|'.join(sorted(names, key=len, reverse=True))})$', 1)"
    step = lambda source, w: f"SELECT term, {w} AS w, r1, r2, stop FROM {source}"
    cut, prefix = "left(w, length(w) - length(e))", f"'^({'|'.join(PREFIXES)})'"
    past = f"""CASE WHEN stop OR e = '' THEN w WHEN e LIKE 'eed%' THEN CASE WHEN length(c) >= r1 THEN c || 'ee' ELSE w END WHEN NOT regexp_matches(c, '[aeiouy]') THEN w
        WHEN regexp_matches(c, '(at|bl|iz)$') THEN c || 'e' WHEN regexp_matches(c, '{DOUBLE}') THEN left(c, length(c) - 1) WHEN regexp_matches(c, '{SHORT}') AND r1 >= length(c) THEN c || 'e' ELSE c END"""
    second = f"""CASE WHEN NOT stop AND e <> '' AND length(w) - length(e) >= r1 AND (e <> 'ogi' OR w LIKE '%logi') AND (e <> 'li' OR regexp_matches(w, '[cdeghkmnrt]li$')) THEN {cut} || {_map(STEP_2)}[e] ELSE w END"""
    third = f"CASE WHEN NOT stop AND e <> '' AND length(w) - length(e) >= r1 AND (e <> 'ative' OR length(w) - 5 >= r2) THEN {cut} || {_map(STEP_3)}[e] ELSE w END"
    fourth = f"CASE WHEN NOT stop AND e <> '' AND length(w) - length(e) >= r2 AND (e <> 'ion' OR regexp_matches(w, '[st]ion$')) THEN {cut} ELSE w END"
    return f"""WITH p0 AS (SELECT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM (SELECT DISTINCT term FROM {words})),
        p1 AS (SELECT *, CASE WHEN regexp_matches(w, {prefix}) THEN length(regexp_extract(w, {prefix})) ELSE {behind.format(x='w')} END AS r1 FROM p0),
        p2 AS (SELECT *, r1 + {behind.format(x='w[r1 + 1:]')} AS r2 FROM p1),
        p3 AS (SELECT term, r1, r2, CASE WHEN w LIKE '%sses' THEN left(w, length(w) - 2) WHEN regexp_matches(w, '(ied|ies)$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
               WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, length(w) - 1) ELSE w END AS w FROM p2),
        p4 AS (SELECT *, list_contains({_list(AFTER_PLURAL)}, w) AS stop, {ending(('eedly', 'ingly', 'edly', 'eed', 'ing', 'ed'))} AS e FROM p3),
        p5 AS (SELECT *, {cut} AS c FROM p4), p6 AS ({step('p5', past)}),
        p7 AS ({step('p6', "CASE WHEN NOT stop AND regexp_matches(w, '^.+[^aeiouy][yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END")}),
        p8 AS (SELECT *, {ending(STEP_2)} AS e FROM p7), p9 AS ({step('p8', second)}),
        p10 AS (SELECT *, {ending(STEP_3)} AS e FROM p9), p11 AS ({step('p10', third)}),
        p12 AS (SELECT *, {ending(STEP_4)} AS e FROM p11), p13 AS ({step('p12', fourth)}),
        p14 AS (SELECT term, CASE WHEN stop THEN w WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT regexp_matches(left(w, length(w) - 1), '{SHORT}')) OR w LIKE '%ll' AND length(w) - 1 >= r2
               THEN left(w, length(w) - 1) ELSE w END AS w FROM p13)
        SELECT term, CASE WHEN length(term) <= 2 THEN term ELSE coalesce({_map(WHOLE)}[term], translate(w, 'Y', 'y')) END AS stem FROM p14"""


def _flip(w: str) -> str:
    return f"""CASE WHEN {w} LIKE '%s' THEN CASE WHEN {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y' WHEN {w} LIKE '%ses' THEN left({w}, length({w}) - 2) ELSE left({w}, length({w}) - 1) END
        WHEN regexp_matches({w}, '(s|x|z|ch|sh)$') THEN {w} || 'es' WHEN regexp_matches({w}, '[^aeiou]y$') THEN left({w}, length({w}) - 1) || 'ies' ELSE {w} || 's' END"""


def _boot(name: str, clusters: str, seed: int, gap: str, sums: tuple[str, ...]) -> dict[str, str]:
    return {
        f"{name}_n": f"SELECT *, row_number() OVER (ORDER BY query_id) - 1 AS place, count(*) OVER () AS g FROM {clusters}",
        f"{name}_m": f"""SELECT rep, {gap} AS m FROM (SELECT rep, {', '.join(f'sum(b.{c}) AS {c}' for c in sums)}
            FROM (SELECT r.rep, {_draw(f"'{seed}'", "'boot'", 'r.rep', 'a.place')} % a.g AS place FROM (SELECT unnest(range(1000)) AS rep) r CROSS JOIN {name}_n a) d
            JOIN {name}_n b USING (place) GROUP BY rep)""",
    }


CONF = ("doc_len", "doc_emb_norm", "lex_overlap", "query_len")
PATHS = ("reranker", "lexical", "dense", "residual")
_WORLDS = {"baseline": "000", "full": "111", "freeze_candidates": "001", "freeze_rerank": "110", "freeze_dense": "101", "freeze_bm25": "011"}
_GAIN = "CAST((pow(2, {r}) - 1) / log2({n} + 1) AS DECIMAL(38, 12))"
_SHUFFLED = f"""CASE WHEN len(ws) < 2 THEN query_text ELSE CASE WHEN array_to_string(mixed, ' ') = array_to_string(ws, ' ') THEN array_to_string(list_reverse(ws), ' ') ELSE array_to_string(mixed, ' ') END END"""

#: Steps by name; a query takes those that it names, and theirs.
STEPS: dict[str, str] = {
    "corpus": f"""SELECT doc_id, split_part(t, chr(10), 1) AS title, t AS text, {_tokens('t')} AS tokens,
            list_filter({_tokens('t')}, lambda x: NOT list_contains({CONTENT}, x)) AS content_tokens, CAST(len({_terms('t')}) AS DOUBLE) AS doc_len
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "posts": f"""SELECT term, doc_id, tf, df, idf, CAST(idf * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * doc_len / avgdl)) AS DECIMAL(38, 12)) AS contrib
        FROM (SELECT *, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf
              FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (SELECT doc_id, doc_len, term, count(*) AS tf FROM (SELECT doc_id, doc_len, unnest({_terms('text')}) AS term FROM corpus) GROUP BY ALL))
              CROSS JOIN (SELECT count(*) AS n_docs, avg(doc_len) AS avgdl FROM corpus))""",
    "vectors": f"""SELECT doc_id, bucket, v, sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS norm
        FROM (SELECT doc_id, CAST(h % 64 AS INT) AS bucket, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS v
              FROM (SELECT doc_id, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) AS h FROM (SELECT doc_id, unnest(list_concat(tokens, {_bigrams('tokens')})) AS f FROM corpus)) GROUP BY ALL HAVING v <> 0)""",
    "judged": """SELECT query_id, doc_id, CAST(1 + coalesce(quality, 0) AS INT) AS rel
        FROM (SELECT DISTINCT b.item_id AS query_id, d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))
        LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)""",
    "asked": f"""SELECT query_id, string_agg(term, ' ' ORDER BY n) AS query_text FROM (
            SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY df DESC, term) AS n
            FROM (SELECT item_id AS query_id, unnest(list_distinct({_terms('text')})) AS term FROM benchmark)
            JOIN (SELECT DISTINCT term, df FROM posts) USING (term)
            WHERE df BETWEEN 0.05 * (SELECT count(*) FROM corpus) AND 0.40 * (SELECT count(*) FROM corpus))
        WHERE n <= 4 AND query_id IN (SELECT query_id FROM judged) GROUP BY query_id""",
    "base_worlds": "SELECT query_id AS world_id, query_text AS bm25_text, query_text AS dense_text, query_text AS rerank_text, 'union' AS first_stage FROM asked",
    **_run("b", "base_worlds"),
    "base": """SELECT r.world_id AS query_id, a.query_text, r.doc_id, r.provenance, coalesce(s.bm25, 0.0) AS bm25, coalesce(v.dense, 0.0) AS dense, r.ce, r.n, r.rank
        FROM b_ranked r JOIN asked a ON a.query_id = r.world_id
        LEFT JOIN b_bm25 s ON s.text = a.query_text AND s.doc_id = r.doc_id LEFT JOIN b_dense v ON v.text = a.query_text AND v.doc_id = r.doc_id""",
    "lex_worlds": "SELECT query_id AS world_id, query_text AS bm25_text, query_text AS dense_text, query_text AS rerank_text, 'bm25' AS first_stage FROM asked",
    **_run("l", "lex_worlds"),
    "tops": """SELECT a.query_id, t.doc_id, t.rk, 'bm25' AS channel FROM b_bm25_top t JOIN asked a ON a.query_text = t.text WHERE t.rk <= 10
        UNION ALL SELECT a.query_id, t.doc_id, t.rk, 'dense' FROM b_dense_top t JOIN asked a ON a.query_text = t.text WHERE t.rk <= 10""",
    "channels": "SELECT query_id, doc_id, rk AS rank, channel || '_only' AS channel FROM tops UNION ALL SELECT query_id, doc_id, n, 'full_pipeline' FROM base WHERE n <= 10",
    "gains": f"""SELECT q.query_id, q.channel, round(CASE WHEN i.ideal > 0 THEN coalesce(CAST(g.dcg AS DOUBLE) / CAST(i.ideal AS DOUBLE), 0.0) ELSE 0.0 END, 9) AS ndcg
        FROM (SELECT DISTINCT query_id, channel FROM channels) q
        LEFT JOIN (SELECT query_id, channel, sum({_GAIN.format(r='rel', n='rank')}) AS dcg FROM channels JOIN judged USING (query_id, doc_id) GROUP BY ALL) g USING (query_id, channel)
        LEFT JOIN (SELECT query_id, sum({_GAIN.format(r='rel', n='n')}) AS ideal FROM (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS n FROM judged) WHERE n <= 10 GROUP BY ALL) i USING (query_id)""",
    "words": f"""SELECT term, df, ln(n / (1 + df)) AS idf, df >= 5 AND df <= 0.20 * n AS in_pool
        FROM (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(content_tokens)) AS term FROM corpus) WHERE regexp_matches(term, {WORD}) GROUP BY term)
        CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM corpus)""",
    "word_tf": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(content_tokens) AS term FROM corpus) WHERE regexp_matches(term, {WORD}) GROUP BY ALL",
    "aims": f"""SELECT query_id, query_text, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_draw("'42'", "'target'", 'query_id', 'doc_id')}, doc_id) AS k
        FROM (SELECT b.query_id, b.query_text, b.doc_id FROM base b JOIN judged j USING (query_id, doc_id) WHERE j.rel >= 1)) WHERE k <= 3""",
    "cand": f"""SELECT query_id, doc_id, term, tf, round(w, 9) AS weight, round(w / CAST(sum(CAST(w AS DECIMAL(38, 12))) OVER own AS DOUBLE), 9) AS select_prob, count(*) OVER own AS n_candidate_terms
        FROM (SELECT query_id, doc_id, term, tf, CASE WHEN sum(w0) OVER (PARTITION BY query_id, doc_id) > 0 THEN w0 ELSE 1.0 END AS w
              FROM (SELECT a.query_id, a.doc_id, t.term, t.tf, greatest(0.0, t.tf * v.idf) AS w0 FROM aims a JOIN word_tf t USING (doc_id) JOIN words v USING (term)
                    WHERE NOT list_contains({_tokens('a.query_text')}, t.term)))
        WINDOW own AS (PARTITION BY query_id, doc_id)""",
    "treated": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id
            ORDER BY round(-ln(({_draw("'42'", "'treatment'", 'query_id', 'doc_id', 'term')} + 0.5) / 4294967296.0) / weight, 9), term) AS k FROM cand WHERE weight > 0) WHERE k <= 3""",
    "admit": f"""SELECT a.query_id, a.doc_id, w.term FROM aims a JOIN corpus d USING (doc_id) CROSS JOIN (SELECT term FROM words WHERE in_pool) w
        WHERE NOT list_contains(d.tokens, w.term) AND NOT list_contains({_tokens('a.query_text')}, w.term)""",
    "pool_n": "SELECT term, row_number() OVER (ORDER BY term) - 1 AS number FROM words WHERE in_pool",
    "drawn_c": f"""SELECT query_id, doc_id, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY place) AS k FROM (
            SELECT query_id, doc_id, number, min(j) AS place FROM (SELECT a.query_id, a.doc_id, t.j, {_draw("'42'", "'control'", 'a.query_id', 'a.doc_id', 't.j')} % (SELECT count(*) FROM pool_n) AS number
                FROM aims a CROSS JOIN (SELECT unnest(range(24)) AS j) t) GROUP BY ALL) JOIN pool_n USING (number) JOIN admit USING (query_id, doc_id, term)) WHERE k <= 3""",
    "controlled": f"""SELECT query_id, doc_id, term FROM drawn_c UNION ALL SELECT query_id, doc_id, term FROM (
            SELECT m.*, coalesce(h.has, 0) + row_number() OVER (PARTITION BY m.query_id, m.doc_id ORDER BY {_draw("'42'", "'control'", 'm.query_id', 'm.doc_id', 'm.term')}, m.term) AS k
            FROM (SELECT query_id, doc_id, term FROM admit EXCEPT SELECT query_id, doc_id, term FROM drawn_c) m
            LEFT JOIN (SELECT query_id, doc_id, count(*) AS has FROM drawn_c GROUP BY ALL) h ON h.query_id = m.query_id AND h.doc_id = m.doc_id) WHERE k <= 3""",
    "index_words": f"SELECT unnest({_terms('text')}) AS term FROM corpus",
    "stems": _stems("index_words"),
    "mates": """SELECT f.term AS word, CASE WHEN f.term = g.one THEN g.two ELSE g.one END AS other FROM (SELECT DISTINCT p.term, s.stem FROM posts p JOIN stems s USING (term)) f
        JOIN (SELECT stem, max(CASE WHEN n = 1 THEN term END) AS one, max(CASE WHEN n = 2 THEN term END) AS two FROM (
            SELECT term, stem, row_number() OVER (PARTITION BY stem ORDER BY df DESC, term) AS n FROM (SELECT DISTINCT p.term, p.df, s.stem FROM posts p JOIN stems s USING (term))) GROUP BY stem) g
        ON g.stem = f.stem WHERE g.two IS NOT NULL""",
    "ranged": "SELECT term, doc_id // 64 AS range, max(contrib) AS best, count(*) AS n FROM posts GROUP BY ALL",
    "kths": "SELECT term, min(contrib) AS kth FROM (SELECT term, contrib, row_number() OVER (PARTITION BY term ORDER BY contrib DESC, doc_id) AS n FROM posts) WHERE n <= 20 GROUP BY term HAVING count(*) = 20",
    "query_words": f"SELECT query_id, unnest({_terms('query_text')}) AS term FROM asked",
    "posts_s": f"""SELECT term, doc_id, tf, df, idf, CAST(idf * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * doc_len / avgdl)) AS DECIMAL(38, 12)) AS contrib
        FROM (SELECT *, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf
              FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (SELECT doc_id, doc_len, stem AS term, count(*) AS tf FROM (SELECT doc_id, doc_len, unnest({_terms('text')}) AS term FROM corpus) JOIN stems USING (term) GROUP BY ALL))
              CROSS JOIN (SELECT count(*) AS n_docs, avg(doc_len) AS avgdl FROM corpus))""",
    "scores_s": f"""SELECT query_id, doc_id, round(CAST(sum(contrib) AS DOUBLE), 9) AS bm25 FROM (SELECT query_id, stem AS term FROM (SELECT query_id, unnest({_terms('query_text')}) AS term FROM asked) JOIN stems USING (term))
        JOIN posts_s USING (term) GROUP BY ALL""",
    "barred_s": f"""SELECT DISTINCT t.query_id, t.doc_id, w.term FROM (SELECT a.query_id, a.doc_id, unnest(list_distinct(list_concat(d.tokens, {_tokens('a.query_text')}))) AS own FROM aims a JOIN corpus d USING (doc_id)) t
        LEFT JOIN stems s ON s.term = t.own JOIN (SELECT term, stem FROM pool_n JOIN stems USING (term)) w ON w.term = t.own OR w.stem = s.stem""",
    "inject": """SELECT i.*, a.query_text, a.query_text || ' ' || i.term AS injected_query FROM (
            SELECT query_id, doc_id, term, 'treatment' AS arm, 'target_document' AS term_source, select_prob, n_candidate_terms, weight AS term_tfidf_weight FROM treated
            UNION ALL SELECT query_id, doc_id, term, 'control', 'control_pool', 1.0 / p.n, p.n, 0.0 FROM controlled CROSS JOIN (SELECT count(*) AS n FROM words WHERE in_pool) p) i
        JOIN aims a USING (query_id, doc_id)""",
    "audit": f"""SELECT i.query_id, i.doc_id, i.term, i.arm, 'append_term' AS operator, i.term_source, coalesce(t.tf, 0) AS term_tf_in_doc, w.df AS term_df_corpus,
            round(100.0 * w.df / (SELECT count(*) FROM corpus), 6) AS term_doc_freq_pct, round(w.idf, 9) AS term_idf, list_contains({_tokens('d.title')}, i.term) AS term_in_title,
            CASE WHEN len({_terms('i.term')}) > 0 THEN array_to_string(list_sort({_terms('i.term')}), ' ') ELSE '<stopword/dropped>' END AS term_bm25_form,
            'end' AS injection_position, round(i.select_prob, 9) AS select_prob, i.n_candidate_terms, i.term_tfidf_weight
        FROM inject i JOIN words w USING (term) LEFT JOIN word_tf t ON t.doc_id = i.doc_id AND t.term = i.term JOIN corpus d ON d.doc_id = i.doc_id""",
    "inj_worlds": "SELECT DISTINCT injected_query AS world_id, injected_query AS bm25_text, injected_query AS dense_text, injected_query AS rerank_text, 'union' AS first_stage FROM inject",
    **_run("i", "inj_worlds"),
    "log": f"""SELECT u.query_id, u.doc_id, u.term, u.arm, u.operator, u.term_source, u.term_tf_in_doc, u.term_df_corpus, u.term_doc_freq_pct, u.term_idf, u.term_in_title, u.term_bm25_form,
            u.injection_position, u.select_prob, u.n_candidate_terms, u.term_tfidf_weight, i.query_text, i.injected_query, b.rank AS base_rank, coalesce(r.rank, 21) AS new_rank, b.rank = 21 AS base_censored,
            b.rank - coalesce(r.rank, 21) AS delta_rank, b.ce AS base_ce, r.ce AS new_ce, round(r.ce - b.ce, 6) AS delta_ce,
            b.bm25 AS base_bm25, coalesce(s.bm25, 0.0) AS new_bm25, round(coalesce(s.bm25, 0.0) - b.bm25, 9) AS delta_bm25,
            b.dense AS base_dense, coalesce(v.dense, 0.0) AS new_dense, round(coalesce(v.dense, 0.0) - b.dense, 9) AS delta_dense,
            r.ce IS NOT NULL AS in_candidates, b.provenance AS provenance_base, coalesce(r.provenance, 'none') AS provenance_new, d.doc_len, round(coalesce(n.norm, 0.0), 9) AS doc_emb_norm,
            round(CASE WHEN len(list_distinct(list_concat({_tokens('i.query_text')}, d.tokens))) > 0 THEN len(list_intersect({_tokens('i.query_text')}, d.tokens)) / len(list_distinct(list_concat({_tokens('i.query_text')}, d.tokens))) ELSE 0.0 END, 9) AS lex_overlap,
            len({_tokens('i.query_text')}) AS query_len
        FROM audit u JOIN inject i USING (query_id, doc_id, term) JOIN base b USING (query_id, doc_id) JOIN corpus d USING (doc_id)
        LEFT JOIN (SELECT doc_id, any_value(norm) AS norm FROM vectors GROUP BY doc_id) n USING (doc_id)
        LEFT JOIN i_ranked r ON r.world_id = i.injected_query AND r.doc_id = u.doc_id
        LEFT JOIN i_bm25 s ON s.text = i.injected_query AND s.doc_id = u.doc_id LEFT JOIN i_dense v ON v.text = i.injected_query AND v.doc_id = u.doc_id""",
    "clusters": "SELECT query_id, arm, CAST(sum(abs(delta_rank)) AS DOUBLE) AS s, count(*) AS n FROM log GROUP BY ALL",
    "treat_c": "SELECT query_id, s, n FROM clusters WHERE arm = 'treatment'",
    "control_c": "SELECT query_id, s, n FROM clusters WHERE arm = 'control'",
    **_boot("bt", "treat_c", 42, "s / n", ("s", "n")), **_boot("bc", "control_c", 42, "s / n", ("s", "n")),
    "both_c": "SELECT t.query_id, t.s AS s_t, t.n AS n_t, c.s AS s_c, c.n AS n_c FROM treat_c t JOIN control_c c USING (query_id)",
    **_boot("bd", "both_c", 43, "s_t / n_t - s_c / n_c", ("s_t", "n_t", "s_c", "n_c")),
    "diff": """SELECT (SELECT round(sum(s_t) / sum(n_t) - sum(s_c) / sum(n_c), 9) FROM both_c) AS point, round(quantile_cont(m, 0.025), 9) AS lo, round(quantile_cont(m, 0.975), 9) AS hi,
        (SELECT count(*) FROM both_c) AS n_clusters FROM bd_m""",
    "med_rows": f"""SELECT i.query_id, i.doc_id, i.term, c.cfg, w.world,
            CASE WHEN w.seen[1] = '1' THEN injected_query ELSE query_text END AS bm25_text, CASE WHEN w.seen[2] = '1' THEN injected_query ELSE query_text END AS dense_text, CASE WHEN w.seen[3] = '1' THEN injected_query ELSE query_text END AS rerank_text
        FROM inject i CROSS JOIN (VALUES ('union'), ('bm25')) c(cfg) CROSS JOIN (VALUES {', '.join(f"('{w}', '{s}')" for w, s in _WORLDS.items())}) w(world, seen) WHERE i.arm = 'treatment'""",
    "med_worlds": "SELECT DISTINCT concat_ws('#', cfg, bm25_text, dense_text, rerank_text) AS world_id, bm25_text, dense_text, rerank_text, cfg AS first_stage FROM med_rows",
    **_run("m", "med_worlds"),
    "paths": f"""SELECT *, total - reranker - lexical - dense AS residual FROM (
            SELECT *, r_baseline - r_full AS total, r_baseline - r_freeze_candidates AS reranker, r_freeze_candidates - r_freeze_dense AS lexical,
                CASE WHEN cfg = 'bm25' THEN 0 ELSE r_freeze_candidates - r_freeze_bm25 END AS dense, r_baseline - r_freeze_rerank AS first_stage_total
            FROM (SELECT query_id, doc_id, term, cfg, {', '.join(f"max(CASE WHEN world = '{w}' THEN coalesce(k.rank, 21) END) AS r_{w}" for w in _WORLDS)}
                  FROM med_rows r LEFT JOIN m_ranked k ON k.world_id = concat_ws('#', r.cfg, r.bm25_text, r.dense_text, r.rerank_text) AND k.doc_id = r.doc_id GROUP BY ALL))""".replace("query_id, doc_id, term, cfg, max", "r.query_id, r.doc_id, r.term, r.cfg, max"),
    "means": f"""SELECT cfg, count(*) AS n_pairs, avg(abs(total)) AS mean_abs_total, avg(total) AS mean_total, {', '.join(f'avg(abs({p})) AS {p}_mean_abs, avg({p}) AS {p}_mean' for p in PATHS)} FROM paths GROUP BY cfg""",
    "ratios": f"""SELECT cfg, n_pairs, round(mean_abs_total, 9) AS mean_abs_total, round(mean_total, 9) AS mean_total, {', '.join(f'round({p}_mean_abs, 9) AS {p}_mean_abs, round({p}_mean, 9) AS {p}_mean' for p in PATHS)},
            {', '.join(f'round(CASE WHEN whole > 0 THEN 100 * {p}_mean_abs / whole ELSE 0.0 END, 9) AS {p}_share_pct' for p in PATHS)},
            round(CASE WHEN mean_abs_total > 0 THEN 100 * residual_mean_abs / mean_abs_total ELSE 0.0 END, 9) AS nonadditivity_pct_of_total
        FROM (SELECT *, {' + '.join(f'{p}_mean_abs' for p in PATHS)} AS whole FROM means)""",
    "shifts": " UNION ALL ".join(f"SELECT '{p}' AS path, round(abs(max(CASE WHEN cfg = 'union' THEN {p}_share_pct END) - max(CASE WHEN cfg = 'bm25' THEN {p}_share_pct END)), 6) AS shift_pp FROM ratios" for p in PATHS),
    "destop": f"""SELECT query_id, query_text, CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') ELSE query_text END AS variant_text
        FROM (SELECT *, list_filter(list_filter(regexp_split_to_array(query_text, '\\s+'), lambda w: w <> ''), lambda w: NOT list_contains({CONTENT}, regexp_replace(lower(w), '^[.,?!;:]+|[.,?!;:]+$', '', 'g'))) AS kept FROM asked)""",
    "shuffle": f"""SELECT query_id, query_text, {_SHUFFLED} AS variant_text FROM (SELECT *, list_transform(list_sort(list_transform(range(1, len(ws) + 1), lambda i:
            {{'h': md5(concat_ws('|', '42', 'shuffle', query_id, i - 1)), 'w': ws[i]}})), lambda x: x.w) AS mixed FROM (SELECT *, list_filter(regexp_split_to_array(query_text, '\\s+'), lambda w: w <> '') AS ws FROM asked))""",
    "all_words": "SELECT DISTINCT unnest(tokens) AS term FROM corpus",
    "cores": r"""SELECT query_id, query_text, i - 1 AS i, regexp_extract(w, '^(.*?[\p{L}\p{N}])?([^\p{L}\p{N}]*)$', 1) AS core, regexp_extract(w, '^(.*?[\p{L}\p{N}])?([^\p{L}\p{N}]*)$', 2) AS tail
        FROM (SELECT *, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT *, list_filter(regexp_split_to_array(query_text, '\s+'), lambda w: w <> '') AS ws FROM asked))""",
    "flips": rf"""SELECT query_id, i, flip FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_draw("'42'", "'flip'", 'query_id', 'i')}, i) AS k
        FROM (SELECT *, {_flip('core')} AS flip FROM cores WHERE regexp_matches(core, '^\p{{Ll}}{{4,}}$') AND NOT list_contains({CONTENT}, core)) WHERE flip <> core AND flip IN (SELECT term FROM all_words)) WHERE k = 1""",
    "synonym": rf"""SELECT query_id, query_text, string_agg(out || tail, ' ' ORDER BY i) AS variant_text FROM (
        SELECT c.query_id, c.query_text, c.i, c.tail, coalesce(f.flip, CASE WHEN regexp_matches(core, '^\p{{Lu}}') THEN upper(s[1]) || s[2:] ELSE s END, core) AS out
        FROM (SELECT c.*, m.other AS s FROM cores c LEFT JOIN mates m ON m.word = lower(c.core)) c LEFT JOIN flips f ON f.query_id = c.query_id AND f.i = c.i) GROUP BY ALL""",
    "fifty": f"""SELECT query_id FROM asked ORDER BY {_draw("'42'", "'stability'", 'query_id')}, query_id LIMIT 50""",
    "rewrites": """SELECT *, 'destop' AS variant FROM destop WHERE query_id IN (SELECT query_id FROM fifty) UNION ALL SELECT *, 'shuffle' FROM shuffle WHERE query_id IN (SELECT query_id FROM fifty)
        UNION ALL SELECT *, 'synonym' FROM synonym WHERE query_id IN (SELECT query_id FROM fifty)""",
    "rw_worlds": """SELECT DISTINCT text AS world_id, text AS bm25_text, text AS dense_text, text AS rerank_text, 'union' AS first_stage FROM (SELECT query_text AS text FROM rewrites UNION SELECT variant_text FROM rewrites)""",
    **_run("s", "rw_worlds"),
    "lists": """SELECT text, 'bm25' AS config, list(doc_id ORDER BY rk) AS docs FROM s_bm25_top WHERE rk <= 10 GROUP BY text UNION ALL SELECT text, 'dense', list(doc_id ORDER BY rk) FROM s_dense_top WHERE rk <= 10 GROUP BY text
        UNION ALL SELECT world_id, 'full', list(doc_id ORDER BY n) FROM s_ranked WHERE n <= 10 GROUP BY world_id""",
    "paired": """SELECT r.query_id, r.variant, a.config, r.query_text, r.variant_text, a.docs AS a, b.docs AS b,
            list_transform(range(1, 11), lambda d: CAST(len(list_intersect(a.docs[1:d], b.docs[1:d])) AS DOUBLE)) AS x
        FROM rewrites r JOIN lists a ON a.text = r.query_text JOIN lists b ON b.text = r.variant_text AND b.config = a.config""",
    "raw": """SELECT query_id, variant, config, round(0.1 / 0.9 * list_sum(list_transform(range(1, 11), lambda d: x[d] / d * pow(0.9, d))) + x[10] / 10 * pow(0.9, 10), 9) AS rbo,
        a = b AS identical, query_text AS query_original, variant_text AS query_variant, query_text = variant_text AS unchanged_text FROM paired""",
    "noop": "SELECT variant, round(avg(CAST(unchanged_text AS INT)), 9) AS frac_noop, avg(CAST(unchanged_text AS INT)) >= 0.80 AS degenerate FROM raw GROUP BY variant",
    "concepts": f"""SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(content_tokens)) AS term FROM corpus) WHERE regexp_matches(term, {WORD}) GROUP BY term
        HAVING df BETWEEN 0.05 * (SELECT count(*) FROM corpus) AND 0.40 * (SELECT count(*) FROM corpus) ORDER BY df DESC, term LIMIT 3""",
    "panel": f"""SELECT b.query_id, b.doc_id, c.term AS concept, CAST(list_contains(d.content_tokens, c.term) AS INT) AS d, b.ce AS ce_score, d.doc_len, round(coalesce(n.norm, 0.0), 9) AS doc_emb_norm,
            round(CASE WHEN len(list_distinct(list_concat({_tokens('b.query_text')}, d.tokens))) > 0 THEN len(list_intersect({_tokens('b.query_text')}, d.tokens)) / len(list_distinct(list_concat({_tokens('b.query_text')}, d.tokens))) ELSE 0.0 END, 9) AS lex_overlap,
            CAST(len({_tokens('b.query_text')}) AS DOUBLE) AS query_len, b.bm25, b.dense, b.provenance
        FROM base b JOIN corpus d USING (doc_id) CROSS JOIN concepts c LEFT JOIN (SELECT doc_id, any_value(norm) AS norm FROM vectors GROUP BY doc_id) n USING (doc_id)""",
    "ols_w": """SELECT *, sy1 / n1 - (sy - sy1) / (n - n1) AS b, (sy - sy1) / (n - n1) AS a FROM (SELECT concept, CAST(count(*) AS DOUBLE) AS n, CAST(sum(d) AS DOUBLE) AS n1, CAST(sum(CAST(ce_score AS DECIMAL(38, 12))) AS DOUBLE) AS sy,
        CAST(sum(CAST(ce_score * d AS DECIMAL(38, 12))) AS DOUBLE) AS sy1, CAST(count(DISTINCT query_id) AS DOUBLE) AS g FROM panel GROUP BY concept) WHERE n1 > 0 AND n1 < n""",
    "ols": """SELECT w.*, sqrt((n1 * n1 * m00 - 2 * n1 * n * m01 + n * n * m11) / pow(n * n1 - n1 * n1, 2) * g / (g - 1) * (n - 1) / (n - 2)) AS se FROM ols_w w JOIN (
        SELECT concept, sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11 FROM (SELECT concept, query_id, sum(ce_score - a - b * d) AS s0, sum((ce_score - a - b * d) * d) AS s1 FROM panel JOIN ols_w USING (concept) GROUP BY ALL) GROUP BY concept) USING (concept)""",
    "naive": "SELECT concept, CAST(n AS BIGINT) AS n_units, CAST(n1 AS BIGINT) AS n_treated, round(b, 6) AS naive_coef, round(se, 6) AS naive_se, round(b - 1.96 * se, 6) AS naive_ci_lo, round(b + 1.96 * se, 6) AS naive_ci_hi FROM ols",
    "celled": f"""SELECT p.query_id, p.doc_id, p.concept, p.d, p.ce_score, concat_ws('-', {', '.join(f'len(list_filter(q_{c}, lambda q: q < p.{c}))' for c in CONF)}) AS cell, r.rep, {_draw("'42'", "'fold'", 'r.rep', 'p.query_id', 'p.doc_id')} % 5 AS fold
        FROM panel p CROSS JOIN (SELECT {', '.join(f'quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}' for c in CONF)} FROM panel) CROSS JOIN (VALUES (0), (1), (2)) r(rep)""",
    "fit": """SELECT c.concept, c.rep, c.ce_score, c.d,
            coalesce((SELECT avg(o.ce_score) FROM celled o WHERE o.concept = c.concept AND o.rep = c.rep AND o.cell = c.cell AND o.fold <> c.fold), (SELECT avg(o.ce_score) FROM celled o WHERE o.concept = c.concept AND o.rep = c.rep AND o.fold <> c.fold)) AS l,
            coalesce((SELECT avg(o.d) FROM celled o WHERE o.concept = c.concept AND o.rep = c.rep AND o.cell = c.cell AND o.fold <> c.fold), (SELECT avg(o.d) FROM celled o WHERE o.concept = c.concept AND o.rep = c.rep AND o.fold <> c.fold)) AS m FROM celled c""",
    "theta": "SELECT concept, rep, sum((d - m) * (ce_score - l)) / sum((d - m) * (d - m)) AS theta FROM fit GROUP BY ALL",
    "plr_r": "SELECT concept, rep, any_value(theta) AS theta, sqrt(sum(pow((d - m) * ((ce_score - l) - theta * (d - m)), 2))) / sum((d - m) * (d - m)) AS se FROM fit JOIN theta USING (concept, rep) GROUP BY ALL",
    "plr": "SELECT concept, round(b, 6) AS dml_coef, round(se, 6) AS dml_se, round(b - 1.96 * se, 6) AS dml_ci_lo, round(b + 1.96 * se, 6) AS dml_ci_hi FROM (SELECT concept, median(theta) AS b, median(se) AS se FROM plr_r GROUP BY concept)",
    "compare": "SELECT concept, n_treated, n_units, naive_coef, dml_coef, dml_ci_lo, dml_ci_hi, naive_coef < dml_ci_lo OR naive_coef > dml_ci_hi AS naive_outside_dml_ci, round(abs(naive_coef - dml_coef), 6) AS abs_shift FROM naive JOIN plr USING (concept)",
    "crit": f"""SELECT 'C1' AS criterion, CASE WHEN n_clusters = 0 OR lo IS NULL THEN 'INCONCLUSIVE' WHEN lo > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM diff
        UNION ALL SELECT 'C2', CASE WHEN (SELECT count(*) FROM ratios) < 2 THEN 'INCONCLUSIVE' WHEN (SELECT max(greatest({', '.join(f'{p}_share_pct' for p in PATHS)})) FROM ratios) <= 90 AND (SELECT max(shift_pp) FROM shifts) >= 10 THEN 'PASS' ELSE 'FAIL' END
        UNION ALL SELECT 'C3', CASE WHEN count(*) = 0 THEN 'INCONCLUSIVE' WHEN count(*) FILTER (WHERE naive_outside_dml_ci) > 0 THEN 'PASS' ELSE 'FAIL' END FROM compare""",
}

_MEAN = "round(CAST(avg(CAST({c} AS DECIMAL(38, 12))) AS DOUBLE), 9)"
_AVG = "round(avg({c}), 9)"
FINAL: dict[str, str] = {
    "corpus_scan": r"SELECT doc_id, title, length(text) AS n_chars, length(array_to_string(regexp_split_to_array(trim(text, ' '), '\s+')[1:460], ' ')) AS ce_chars, doc_len FROM corpus",
    "tokenize": "SELECT doc_id, len(tokens) AS n_tokens, len(list_distinct(tokens)) AS n_distinct FROM corpus",
    "content_tokens": "SELECT doc_id, len(content_tokens) AS n_content, len(list_distinct(content_tokens)) AS n_distinct FROM corpus",
    "bm25_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest({_terms('text')}) AS term FROM corpus) GROUP BY term",
    "vocab_df": "SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(content_tokens)) AS term FROM corpus) GROUP BY term",
    "doc_tf": "SELECT * FROM word_tf",
    "postings": "SELECT term, doc_id, tf, df, round(idf, 9) AS idf, round(CAST(contrib AS DOUBLE), 6) AS contrib FROM posts",
    "qrels": "SELECT * FROM judged",
    "query_texts": "SELECT * FROM asked",
    "bm25_scores": "SELECT a.query_id, s.doc_id, s.bm25 FROM b_bm25 s JOIN asked a ON a.query_text = s.text WHERE s.bm25 > 0",
    "bm25_topk": "SELECT a.query_id, t.doc_id, t.score AS bm25, t.rk FROM b_bm25_top t JOIN asked a ON a.query_text = t.text",
    "emb_norms": "SELECT doc_id, round(any_value(norm), 9) AS norm FROM vectors GROUP BY doc_id",
    "dense_scores": "SELECT a.query_id, s.doc_id, s.dense FROM b_dense s JOIN asked a ON a.query_text = s.text",
    "dense_topk": "SELECT a.query_id, t.doc_id, t.score AS dense, t.rk FROM b_dense_top t JOIN asked a ON a.query_text = t.text",
    "topk_single": "SELECT * FROM tops",
    "candidate_pool": "SELECT query_id, doc_id, provenance FROM base",
    "rerank": "SELECT query_id, doc_id, ce FROM base",
    "censored_rank": "SELECT query_id, doc_id, rank FROM base",
    "pipeline_run": "SELECT world_id AS query_id, doc_id, provenance, ce, rank FROM l_ranked",
    "full_top10": "SELECT query_id, doc_id, n AS rank FROM base WHERE n <= 10",
    "baseline": "SELECT query_id, query_text, doc_id, provenance, bm25, dense, ce, rank FROM base",
    "ndcg": "SELECT * FROM gains",
    "ndcg_summary": "SELECT *, full_pipeline > greatest(bm25_only, dense_only) AS reranker_helps FROM (SELECT " + ", ".join(f"round(CAST(avg(CAST(CASE WHEN channel = '{c}' THEN ndcg END AS DECIMAL(38, 12))) AS DOUBLE), 9) AS {c}" for c in ("bm25_only", "dense_only", "full_pipeline")) + ", count(DISTINCT query_id) AS n_queries FROM gains)",
    "targets": "SELECT query_id, doc_id FROM aims",
    "control_pool": "SELECT term, df, round(idf, 9) AS idf FROM words WHERE in_pool",
    "control_admissible": "SELECT query_id, doc_id, count(*) AS n_admissible FROM admit GROUP BY ALL",
    "treatment_candidates": "SELECT query_id, doc_id, term, tf, weight FROM cand",
    "select_prob": "SELECT query_id, doc_id, term, select_prob, n_candidate_terms FROM cand",
    "treatment_terms": "SELECT query_id, doc_id, term FROM treated",
    "control_terms": "SELECT query_id, doc_id, term FROM controlled",
    "injected_queries": "SELECT query_id, doc_id, term, arm, injected_query FROM inject",
    "term_provenance": "SELECT * FROM audit",
    "intervention_log": "SELECT * FROM log",
    "origin_documents": "SELECT doc_id, title, substr(text, 1, 400) AS text_snippet, length(text) AS text_chars, CAST(doc_len AS INT) AS doc_len_tokens, len(content_tokens) AS n_content_tokens FROM corpus WHERE doc_id IN (SELECT doc_id FROM log)",
    "design_checks": "SELECT max(CASE WHEN arm = 'control' THEN abs(delta_bm25) END) AS max_abs_delta_bm25_control, round(avg(CAST(base_censored AS INT)), 9) AS censored_share FROM log",
    "run_counts": "SELECT count(*) AS n_rows, count(DISTINCT query_id) AS n_queries, count(DISTINCT (query_id, doc_id)) AS n_pairs FROM log",
    "arm_means": "SELECT arm, count(*) AS n, " + ", ".join(f"{_AVG.format(c=c)} AS {n}" for c, n in (("delta_rank", "mean_delta_rank"), ("abs(delta_rank)", "mean_abs_delta_rank"), ("delta_ce", "mean_delta_ce"), ("delta_bm25", "mean_delta_bm25"), ("delta_dense", "mean_delta_dense"))) + " FROM log GROUP BY arm",
    "cluster_stats": "SELECT * FROM clusters",
    "bootstrap_ci": " UNION ALL ".join(f"SELECT '{arm}' AS arm, (SELECT round(sum(s) / sum(n), 9) FROM {t}) AS point, round(quantile_cont(m, 0.025), 9) AS lo, round(quantile_cont(m, 0.975), 9) AS hi FROM {b}_m" for arm, t, b in (("control", "control_c", "bc"), ("treatment", "treat_c", "bt"))),
    "bootstrap_diff_ci": "SELECT * FROM diff",
    "contrast_uncensored": "SELECT arm, round(avg(abs(delta_rank)), 9) AS mean_abs_delta_rank, count(*) AS n FROM log WHERE NOT base_censored AND (SELECT count(DISTINCT arm) FROM log WHERE NOT base_censored) = 2 GROUP BY arm",
    "delta_rank_hist": "SELECT arm, delta_rank, count(*) AS n FROM log GROUP BY ALL",
    "mediation_paths": "SELECT * FROM paths",
    "mediation_ratio": "SELECT * FROM ratios",
    "mediation_shift": "SELECT * FROM shifts",
    "jaccard": f"SELECT j.query_id, j.doc_id, round(len(list_intersect({_tokens('a.query_text')}, d.tokens)) / len(list_distinct(list_concat({_tokens('a.query_text')}, d.tokens))), 9) AS jaccard FROM judged j JOIN asked a USING (query_id) JOIN corpus d USING (doc_id)",
    "rbo": "SELECT query_id, variant, config, rbo FROM raw",
    "corpus_vocab": "SELECT * FROM all_words",
    "variant_destop": "SELECT query_id, variant_text FROM destop",
    "variant_shuffle": "SELECT query_id, variant_text FROM shuffle",
    "variant_synonym": "SELECT query_id, variant_text FROM synonym",
    "stability_raw": "SELECT * FROM raw",
    "stability_summary": """SELECT r.*, n.frac_noop, n.degenerate FROM (SELECT variant, config, round(avg(rbo), 9) AS mean_rbo, round(stddev_samp(rbo), 6) AS std_rbo, min(rbo) AS min_rbo, round(avg(CAST(identical AS INT)), 9) AS frac_identical, count(*) AS n,
        round(avg(rbo) FILTER (WHERE NOT unchanged_text), 9) AS mean_rbo_changed, nullif(count(*) FILTER (WHERE NOT unchanged_text), 0) AS n_changed, round(1 - round(avg(rbo), 9), 9) AS instability, round(1 - round(avg(rbo) FILTER (WHERE NOT unchanged_text), 9), 9) AS instability_changed
        FROM raw GROUP BY ALL) r JOIN noop n USING (variant)""",
    "stability_noop": "SELECT * FROM noop",
    "rbo_box_stats": "SELECT variant, config, " + ", ".join(f"round(quantile_cont(rbo, {p}), 9) AS {n}" for p, n in ((0.0, "lowest"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "highest"))) + " FROM raw GROUP BY ALL",
    "concept_terms": "SELECT * FROM concepts",
    "dml_panel": "SELECT * FROM panel",
    "naive_ols": "SELECT * FROM naive",
    "dml_plr": "SELECT * FROM plr",
    "dml_compare": "SELECT * FROM compare",
    "criteria": "SELECT * FROM crit",
    "verdict": "SELECT *, CASE WHEN n_pass = 3 THEN 'yes' WHEN n_pass <= 1 AND n_inconclusive = 0 THEN 'no' ELSE 'mixed' END AS verdict FROM (SELECT count(*) FILTER (WHERE status = 'PASS') AS n_pass, count(*) FILTER (WHERE status = 'INCONCLUSIVE') AS n_inconclusive FROM crit)",
    "shard_merge": "SELECT b.query_id, b.doc_id, b.rank, s.shard FROM base b JOIN (SELECT query_id, CAST((row_number() OVER (ORDER BY query_id) - 1) % 4 AS INT) AS shard FROM asked) s USING (query_id)",
    "shard_of": "SELECT query_id, CAST((row_number() OVER (ORDER BY query_id) - 1) % 4 AS INT) AS shard FROM asked",
    "term_stems": "SELECT * FROM stems",
    "bm25_terms_stemmed": "SELECT stem, count(*) AS n FROM index_words JOIN stems USING (term) GROUP BY stem",
    "postings_stemmed": "SELECT term, doc_id, tf, df, round(idf, 9) AS idf, round(CAST(contrib AS DOUBLE), 6) AS contrib FROM posts_s",
    "bm25_topk_stemmed": """SELECT query_id, doc_id, bm25, rk FROM (SELECT query_id, doc_id, coalesce(s.bm25, 0.0) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(s.bm25, 0.0) DESC, doc_id) AS rk
        FROM (SELECT query_id, doc_id FROM asked CROSS JOIN corpus) LEFT JOIN scores_s s USING (query_id, doc_id)) WHERE rk <= 20""",
    "control_admissible_stemmed": """SELECT a.query_id, a.doc_id, (SELECT count(*) FROM pool_n) - coalesce(b.n, 0) AS n_admissible FROM aims a
        LEFT JOIN (SELECT query_id, doc_id, count(*) AS n FROM barred_s GROUP BY ALL) b ON b.query_id = a.query_id AND b.doc_id = a.doc_id WHERE (SELECT count(*) FROM pool_n) > coalesce(b.n, 0)""",
    "qrels_fold": "SELECT conv_id AS query_id, role AS doc_id, CAST(arg_max(length(text), turn) AS INT) AS rel FROM conversations WHERE text IS NOT NULL GROUP BY ALL",
    "word_forms": "SELECT * FROM mates",
    "bm25_pruning": """SELECT query_id, count(*) AS ranges, count(*) FILTER (WHERE kept) AS ranges_read, CAST(sum(n) AS BIGINT) AS postings, CAST(coalesce(sum(n) FILTER (WHERE kept), 0) AS BIGINT) AS postings_read FROM (
            SELECT q.query_id, b.range, sum(b.n) AS n, sum(b.best) >= coalesce(CAST(any_value(t.least) AS DECIMAL(38, 12)) - 0.000000002, -1) AS kept FROM query_words q JOIN ranged b USING (term)
            LEFT JOIN (SELECT query_id, max(kth) AS least FROM query_words JOIN kths USING (term) GROUP BY query_id) t ON t.query_id = q.query_id GROUP BY ALL) GROUP BY query_id""",
    "extremes": """SELECT r.*, s.path, s.shift_pp FROM (SELECT query_id, variant, config, rbo FROM raw ORDER BY rbo, variant, config, query_id LIMIT 1) r
        CROSS JOIN (SELECT path, shift_pp FROM shifts ORDER BY shift_pp DESC, path DESC LIMIT 1) s""",
}

#: Steps of single queries that take the place of those that others share: `extremes` rewrites all queries.
OWN: dict[str, dict[str, str]] = {
    "extremes": {"rewrites": "SELECT *, 'destop' AS variant FROM destop UNION ALL SELECT *, 'shuffle' FROM shuffle UNION ALL SELECT *, 'synonym' FROM synonym"},
}


def _needed(text: str, found: dict[str, None], steps: dict[str, str]) -> None:
    for name in steps:
        if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
            _needed(steps[name], found, steps)
            found[name] = None


def sql() -> dict[str, str]:
    out = {}
    for name, text in FINAL.items():
        found: dict[str, None] = {}
        steps = STEPS | OWN.get(name, {})
        _needed(text, found, steps)
        head = ", ".join(f"{n} AS MATERIALIZED ({steps[n]})" for n in found)
        out[name] = f"WITH {head} {text}" if head else text
    return out
