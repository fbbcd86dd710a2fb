"""DuckDB SQL equivalents of the registered plans (tables are views named
after the parquet files). Each string returns the same column names as the
Spark plan; doubles are rounded to 6 places in both."""

from __future__ import annotations

from ..functions.stopwords import ENGLISH_STOP_WORDS
from ..functions.text import ABBREVIATION_BREAK

TERM_RE = r"[\p{L}\p{N}_]{2,}"


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


SIDES = """d AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'old' ELSE 'new' END AS side, text
              FROM documents)"""

COUNTS = f"""t AS (SELECT doc_id, side, unnest(regexp_extract_all(lower(text), '{TERM_RE}')) AS term FROM d),
c AS (SELECT doc_id, side, term, count(*) AS n FROM t GROUP BY doc_id, side, term)"""

TFIDF = """nold AS (SELECT count(*)::DOUBLE AS n FROM d WHERE side = 'old'),
idf AS (SELECT term, ln((nold.n + 1) / (count(*) + 1)) + 1 AS idf
        FROM c, nold WHERE side = 'old' GROUP BY term, nold.n),
w0 AS (SELECT c.doc_id, c.side, c.term, c.n * idf.idf AS w FROM c JOIN idf ON c.term = idf.term),
w AS (SELECT doc_id, side, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w0)"""


def topk_pairs(dist_sql: str, k: int) -> str:
    return f"""r AS (SELECT new_id, old_id, dist,
              row_number() OVER (PARTITION BY new_id ORDER BY round(dist, 12), old_id) AS rank
              FROM ({dist_sql}))
SELECT new_id, rank, old_id, round(dist, 6) + 0.0 AS dist FROM r WHERE rank <= {k}"""


def topk_tfidf_sql(k: int = 3, metric: str = "cosine") -> str:
    pairs = """SELECT n.doc_id AS new_id, o.doc_id AS old_id FROM d n, d o
               WHERE n.side = 'new' AND o.side = 'old'"""
    if metric == "cosine":
        body = """dots AS (SELECT a.doc_id AS new_id, b.doc_id AS old_id, sum(a.w * b.w) AS dot
                 FROM w a JOIN w b ON a.term = b.term WHERE a.side = 'new' AND b.side = 'old'
                 GROUP BY 1, 2),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY doc_id),"""
        dist = f"""SELECT p.new_id, p.old_id,
              CASE WHEN coalesce(nn.nrm, 0) = 0 OR coalesce(no.nrm, 0) = 0 THEN 'NaN'::DOUBLE
                   ELSE 1 - coalesce(dots.dot, 0) / (nn.nrm * no.nrm) END AS dist
            FROM ({pairs}) p LEFT JOIN dots USING (new_id, old_id)
            LEFT JOIN nrm nn ON nn.doc_id = p.new_id LEFT JOIN nrm no ON no.doc_id = p.old_id"""
    elif metric == "euclidean":
        # (a - b)^2 over the union of the terms: what a pair does not share is added term by term, never taken off a sum
        body = """sq AS (SELECT doc_id, sum(w * w) AS sq FROM w GROUP BY doc_id),
sh AS MATERIALIZED (SELECT a.doc_id AS new_id, b.doc_id AS old_id, sum((a.w - b.w) * (a.w - b.w)) AS shared, count(*) AS n
       FROM w a JOIN w b ON a.term = b.term WHERE a.side = 'new' AND b.side = 'old' GROUP BY 1, 2),
nt AS (SELECT doc_id, count(*) AS nt FROM w GROUP BY doc_id),
near AS MATERIALIZED (SELECT new_id, old_id, shared FROM sh JOIN nt x ON x.doc_id = new_id JOIN nt y ON y.doc_id = old_id
         WHERE sh.n >= 0.5 * greatest(x.nt, y.nt)),
oa AS (SELECT new_id, old_id, sum(w.w * w.w) AS own FROM near JOIN w ON w.doc_id = new_id
       WHERE NOT EXISTS (FROM w o WHERE o.doc_id = old_id AND o.term = w.term) GROUP BY ALL),
ob AS (SELECT new_id, old_id, sum(w.w * w.w) AS own FROM near JOIN w ON w.doc_id = old_id
       WHERE NOT EXISTS (FROM w o WHERE o.doc_id = new_id AND o.term = w.term) GROUP BY ALL),
ss AS (SELECT a.doc_id AS new_id, b.doc_id AS old_id, sum(a.w * a.w) AS a_sh, sum(b.w * b.w) AS b_sh
       FROM w a JOIN w b ON a.term = b.term WHERE a.side = 'new' AND b.side = 'old' GROUP BY 1, 2),"""
        dist = f"""SELECT p.new_id, p.old_id,
              sqrt(CASE WHEN near.shared IS NOT NULL THEN near.shared + coalesce(oa.own, 0) + coalesce(ob.own, 0)
                   ELSE greatest(coalesce(sn.sq, 0) + coalesce(so.sq, 0) - coalesce(ss.a_sh, 0) - coalesce(ss.b_sh, 0)
                        + coalesce(sh.shared, 0), 0) END) AS dist
            FROM ({pairs}) p LEFT JOIN sh USING (new_id, old_id) LEFT JOIN near USING (new_id, old_id)
            LEFT JOIN oa USING (new_id, old_id) LEFT JOIN ob USING (new_id, old_id) LEFT JOIN ss USING (new_id, old_id)
            LEFT JOIN sq sn ON sn.doc_id = p.new_id LEFT JOIN sq so ON so.doc_id = p.old_id"""
    else:
        raise ValueError(metric)
    return f"""WITH {SIDES},
{COUNTS},
{TFIDF},
{body}
{topk_pairs(dist, k)}"""


def topk_counts_jaccard_sql(k: int = 3) -> str:
    pairs = """SELECT n.doc_id AS new_id, o.doc_id AS old_id FROM d n, d o
               WHERE n.side = 'new' AND o.side = 'old'"""
    return f"""WITH {SIDES},
{COUNTS},
vocab AS (SELECT DISTINCT term FROM c WHERE side = 'old'),
w AS (SELECT c.* FROM c JOIN vocab USING (term)),
nz AS (SELECT doc_id, count(*) AS nnz FROM w GROUP BY doc_id),
sh AS (SELECT a.doc_id AS new_id, b.doc_id AS old_id, count(*) AS both_nz,
              count(*) FILTER (WHERE a.n = b.n) AS eq
       FROM w a JOIN w b ON a.term = b.term WHERE a.side = 'new' AND b.side = 'old' GROUP BY 1, 2),
{topk_pairs(f'''SELECT p.new_id, p.old_id,
         CASE WHEN coalesce(x.nnz, 0) + coalesce(y.nnz, 0) - coalesce(sh.both_nz, 0) = 0 THEN 0.0
              ELSE (coalesce(x.nnz, 0) + coalesce(y.nnz, 0) - coalesce(sh.both_nz, 0) - coalesce(sh.eq, 0))::DOUBLE
                   / (coalesce(x.nnz, 0) + coalesce(y.nnz, 0) - coalesce(sh.both_nz, 0)) END AS dist
       FROM ({pairs}) p LEFT JOIN sh USING (new_id, old_id)
       LEFT JOIN nz x ON x.doc_id = p.new_id LEFT JOIN nz y ON y.doc_id = p.old_id''', k)}"""


# ----------------------------------------------------------------------------- text
WS = r"[ \t\n\x0B\f\r]+"
STOPS = sql_list(ENGLISH_STOP_WORDS)


def _ws_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}'), lambda t: t <> '')"


def _clean_tokens(x: str = "text") -> str:
    s1 = f"regexp_replace({x}, '(?m)^https?://.*[\\r\\n]*', '', 'g')"
    s2 = f"array_to_string(list_filter({_ws_tokens(s1)}, lambda t: NOT starts_with(t, '@')), ' ')"
    s3 = f"translate({s2}, chr(10) || chr(9), '  ')"
    s4 = f"regexp_replace(regexp_replace({s3}, '[^a-zA-Z]', ' ', 'g'), ' +', ' ', 'g')"
    return f"list_filter({_ws_tokens(s4)}, lambda t: NOT list_contains({STOPS}, t))"


CLEANED_OLD_NEW = f"""SELECT doc_id, len(toks)::BIGINT AS n_tokens, array_to_string(toks, ' ') AS clean
FROM (SELECT doc_id, {_clean_tokens()} AS toks FROM documents)"""

FILTER_REPORT = f"""SELECT count(*) AS n_before, count(*) FILTER (WHERE n > 0) AS n_after,
       count(*) FILTER (WHERE n = 0) AS n_removed
FROM (SELECT len({_clean_tokens()}) AS n FROM documents)"""

_SENTS = f"""list_filter(string_split(regexp_replace(regexp_replace(trim(text), '([.!?]){WS}', '\\1' || chr(1), 'g'),
                             '{ABBREVIATION_BREAK}', '\\1\\2. ', 'g'), chr(1)),
                         lambda s: length(s) > 0)"""
_WORDS = f"""list_filter(list_transform({_SENTS},
               lambda s: {_ws_tokens("lower(regexp_replace(s, '[^a-zA-Z]', ' ', 'g'))")}), lambda w: len(w) > 0)"""
SENTENCE_STATS = f"""SELECT doc_id, len({_SENTS})::BIGINT AS n_sentences, len({_WORDS})::BIGINT AS n_word_lists,
       len(flatten({_WORDS}))::BIGINT AS n_words FROM documents"""

_PUNCT = "regexp_extract_all(text, '[\\w'']+|[.,!?;/-]')"
PUNCT_TOKEN_STATS = f"""SELECT doc_id, len({_PUNCT})::BIGINT AS n_tokens,
       len(list_filter({_PUNCT}, lambda x: regexp_full_match(x, '[.,!?;/-]')))::BIGINT AS n_punct FROM documents"""

ALPHA_TOKEN_STATS = f"""SELECT doc_id, len({_ws_tokens('lower(text)')})::BIGINT AS n_tokens,
       len(list_filter({_ws_tokens('lower(text)')}, lambda x: regexp_full_match(x, '\\p{{L}}+')))::BIGINT AS n_alpha
FROM documents"""

_HDR = "CASE WHEN instr(text, chr(10) || chr(10)) > 0 THEN substr(text, instr(text, chr(10) || chr(10)) + 2) ELSE '' END"
_FOOT_LINES = f"string_split(regexp_replace(h, '^\\s+|\\s+$', '', 'g'), chr(10))"
NEWSGROUP_STRIPPED = f"""WITH a AS (SELECT doc_id, {_HDR} AS h FROM documents),
b AS (SELECT doc_id, h, {_FOOT_LINES} AS lines FROM a),
c AS (SELECT doc_id, h, lines,
             list_max(list_transform(range(1, len(lines) + 1),
                      lambda i: CASE WHEN regexp_full_match(lines[i], '\\s*-*\\s*') THEN i ELSE 0 END)) AS idx
      FROM b),
d AS (SELECT doc_id, CASE WHEN idx > 1 THEN array_to_string(lines[1:idx - 1], chr(10)) ELSE h END AS f FROM c),
e AS (SELECT doc_id, array_to_string(list_filter(string_split(f, chr(10)),
             lambda ln: NOT regexp_matches(ln, '(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\\||^>)')),
             chr(10)) AS body FROM d)
SELECT doc_id, length(body)::BIGINT AS n_chars, md5(body) AS body_md5 FROM e"""

CONVERSATION_TOKENS = f"""SELECT conv_id, count(*) AS n_turns, sum(n) AS n_tokens FROM (
  SELECT conv_id, len(list_filter({_ws_tokens("lower(regexp_replace(text, '[^a-zA-Z]', ' ', 'g'))")},
                                  lambda t: NOT list_contains({STOPS}, t))) AS n
  FROM conversations) GROUP BY conv_id"""


# ----------------------------------------------------------------------------- weighting
_WORDS_DOC = _ws_tokens("lower(regexp_replace(text, '[^a-zA-Z]', ' ', 'g'))")
WORD_COUNTS = f"""wt AS (SELECT doc_id, side, unnest({_WORDS_DOC}) AS term FROM d),
wc AS (SELECT doc_id, side, term, count(*) AS n FROM wt GROUP BY ALL)"""

TF_MODES = f"""WITH {SIDES}, {WORD_COUNTS}
SELECT doc_id, term, n, round(1 + ln(n), 6) AS tf_sublinear,
       round(0.5 + 0.5 * n / max(n) OVER (PARTITION BY doc_id), 6) AS tf_augmented FROM wc"""

IDF_TABLE = f"""WITH {SIDES}, {WORD_COUNTS},
nold AS (SELECT count(*)::DOUBLE AS n FROM d WHERE side = 'old'),
x AS (SELECT term, count(*) AS df FROM wc WHERE side = 'old' GROUP BY term),
y AS (SELECT term, df, round(1 + ln(floor(nold.n / df)), 6) AS idf_floor, round(1 + ln(nold.n / df), 6) AS idf_real
      FROM x, nold)
SELECT *, min(idf_floor) OVER () AS min_idf_floor FROM y"""

TFIDF_MATRIX = f"""WITH {SIDES}, {COUNTS}, {TFIDF}
SELECT doc_id, side, term, round(w, 6) AS w FROM w"""


def tfidf_sublinear_top_sql(max_features: int = 5000) -> str:
    return f"""WITH {SIDES}, {COUNTS},
nold AS (SELECT count(*)::DOUBLE AS n FROM d WHERE side = 'old'),
st AS (SELECT term, count(*) AS df, sum(n) AS cf FROM c WHERE side = 'old' GROUP BY term),
top AS (SELECT term FROM st ORDER BY cf DESC, term LIMIT {max_features}),
idf AS (SELECT st.term, ln((nold.n + 1) / (df + 1)) + 1 AS idf FROM st, nold WHERE st.term IN (SELECT term FROM top)),
w0 AS (SELECT c.doc_id, c.side, c.term, (1 + ln(c.n)) * idf.idf AS w FROM c JOIN idf ON c.term = idf.term),
w AS (SELECT doc_id, side, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w0)
SELECT doc_id, side, term, round(w, 6) AS w FROM w"""


def count_matrix_sql(max_features: int = 1000) -> str:
    return f"""WITH {SIDES}, {COUNTS},
top AS (SELECT term FROM c WHERE side = 'old' GROUP BY term ORDER BY sum(n) DESC, term LIMIT {max_features})
SELECT doc_id, side, term, n FROM c WHERE term IN (SELECT term FROM top)"""


DOC_LENGTHS = f"""WITH {SIDES}
SELECT doc_id, side, len({_WORDS_DOC})::BIGINT AS n_tokens, len(list_distinct({_WORDS_DOC}))::BIGINT AS n_distinct
FROM d"""


# ----------------------------------------------------------------------------- embeddings
EMB = """e AS (SELECT vec_id AS doc_id, vec_id % 5 = 0 AS is_query, embedding::DOUBLE[] AS vec, label FROM embeddings)"""


def topk_embeddings_sql(k: int = 5, metric: str = "cosine") -> str:
    if metric == "cosine":
        dist = """1 - list_dot_product(q.vec, r.vec) / (sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(r.vec, r.vec)))"""
    else:
        dist = """sqrt(list_sum(list_transform(list_zip(q.vec, r.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"""
    pairs = f"""SELECT q.doc_id AS new_id, r.doc_id AS old_id, {dist} AS dist
                FROM e q, e r WHERE q.is_query AND NOT r.is_query"""
    return f"""WITH {EMB},
{topk_pairs(pairs, k)}"""


def most_similar_benchmark_sql(k: int = 10) -> str:
    return f"""WITH d AS (SELECT doc_id, FALSE AS q, text FROM documents UNION ALL
                SELECT item_id, TRUE, text FROM benchmark),
t AS (SELECT doc_id, q, unnest(regexp_extract_all(lower(text), '{TERM_RE}')) AS term FROM d),
c AS (SELECT doc_id, q, term, count(*) AS n FROM t GROUP BY ALL),
nd AS (SELECT count(*)::DOUBLE AS n FROM documents),
idf AS (SELECT term, ln((nd.n + 1) / (count(*) + 1)) + 1 AS idf FROM c, nd WHERE NOT q GROUP BY term, nd.n),
w AS (SELECT c.doc_id, c.q, c.term, c.n * idf.idf AS w FROM c JOIN idf USING (term)),
nrm AS (SELECT doc_id, q, sqrt(sum(w * w)) AS nrm FROM w GROUP BY doc_id, q),
dots AS (SELECT a.doc_id AS item_id, b.doc_id, sum(a.w * b.w) AS dot FROM w a JOIN w b USING (term)
         WHERE a.q AND NOT b.q GROUP BY 1, 2),
p AS (SELECT i.doc_id AS item_id, x.doc_id FROM d i, d x WHERE i.q AND NOT x.q),
s AS (SELECT p.item_id, p.doc_id,
             CASE WHEN coalesce(ni.nrm, 0) = 0 OR coalesce(nx.nrm, 0) = 0 THEN 'NaN'::DOUBLE
                  ELSE 1 - coalesce(dots.dot, 0) / (ni.nrm * nx.nrm) END AS dist
      FROM p LEFT JOIN dots USING (item_id, doc_id)
      LEFT JOIN nrm ni ON ni.doc_id = p.item_id AND ni.q LEFT JOIN nrm nx ON nx.doc_id = p.doc_id AND NOT nx.q),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(dist, 12), doc_id) AS rank FROM s)
SELECT item_id, rank, doc_id, round(1 - dist, 6) AS similarity FROM r WHERE rank <= {k}"""


def _hash_vec(dim: int = 8) -> str:
    comps = ", ".join(
        f"('0x' || substr(md5(term || '#{i // 8}'), {4 * (i % 8) + 1}, 4))::BIGINT / 65535.0 - 0.5"
        for i in range(dim))
    return f"[{comps}]"


def word_vectors_cte(dim: int = 8) -> str:
    return f"""{WORD_COUNTS},
vocab AS (SELECT term FROM wc GROUP BY term),
raw AS (SELECT term, {_hash_vec(dim)} AS v FROM vocab),
wv AS (SELECT term, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS vec FROM raw)"""


def _vec_of(rows: str, weight: str, keys: str = "doc_id, side") -> str:
    return f"""SELECT {keys}, list(round(s / cnt, 6) + 0.0 ORDER BY i) AS vec FROM (
  SELECT {keys}, i, sum({weight} * vec[i]) AS s, any_value(cnt) AS cnt FROM (
    SELECT *, sum(n) OVER (PARTITION BY doc_id) AS cnt FROM ({rows})) x,
    range(1, 9) AS g(i) GROUP BY {keys}, i) GROUP BY {keys}"""


WORD_VECTORS_TABLE = f"""WITH {SIDES}, {word_vectors_cte()}
SELECT term, list_transform(vec, lambda x: round(x, 6) + 0.0) AS vec FROM wv"""

DOC_VECTORS_MEAN = f"""WITH {SIDES}, {word_vectors_cte()}
{_vec_of("SELECT wc.doc_id, wc.side, wc.n, wv.vec FROM wc JOIN wv USING (term)", "n")}"""


def doc_vectors_tfidf_sql(tf_mode: str = "raw") -> str:
    tf = {"raw": "n", "sublinear": "1 + ln(n)",
          "augmented": "0.5 + 0.5 * n / max(n) OVER (PARTITION BY doc_id)"}[tf_mode]
    return f"""WITH {SIDES}, {word_vectors_cte()},
nold AS (SELECT count(*)::DOUBLE AS n FROM d WHERE side = 'old'),
idf AS (SELECT term, 1 + ln(floor(nold.n / count(*))) AS idf FROM wc, nold WHERE side = 'old' GROUP BY term, nold.n),
mn AS (SELECT min(idf) AS m FROM idf),
inv AS (SELECT wc.* FROM wc WHERE term IN (SELECT term FROM wv)),
tf AS (SELECT *, {tf} AS tf FROM inv),
rows AS (SELECT tf.doc_id, tf.side, tf.n, tf.n * tf.tf * coalesce(idf.idf, mn.m) AS wt, wv.vec
         FROM tf LEFT JOIN idf USING (term) CROSS JOIN mn JOIN wv USING (term))
{_vec_of("SELECT * FROM rows", "wt")}"""


_SEQ_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' + "' || chr(9) || chr(10) || '"
_SEQ_TOKENS = ("list_filter(string_split(translate(lower(text), '" + _SEQ_FILTERS.replace("'", "''").replace("'' || chr(9) || chr(10) || ''", "' || chr(9) || chr(10) || '")
               + "', repeat(' ', 33)), ' '), lambda x: x <> '')")
SEQ_TOKENS = f"""st AS (SELECT doc_id, unnest(tk) AS term, unnest(range(len(tk))) AS pos
       FROM (SELECT doc_id, {_SEQ_TOKENS} AS tk FROM documents)),
widx AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, min((doc_id, pos))) AS term_id, count(*) AS n
         FROM st GROUP BY term)"""

WORD_INDEX = f"""WITH {SEQ_TOKENS} SELECT term, term_id, n FROM widx"""


def padded_sequences_sql(length: int = 50) -> str:
    return f"""WITH {SEQ_TOKENS},
s AS (SELECT doc_id, list(term_id ORDER BY pos) AS seq FROM st JOIN widx USING (term) GROUP BY doc_id),
a AS (SELECT documents.doc_id, coalesce(seq, []::BIGINT[]) AS seq FROM documents LEFT JOIN s USING (doc_id))
SELECT doc_id, list_concat(list_transform(range(greatest({length} - len(seq), 0)), lambda x: 0::BIGINT),
                           seq[greatest(len(seq) - {length}, 0) + 1:]) AS seq FROM a"""


EMBEDDING_MATRIX = f"""WITH {SIDES}, {word_vectors_cte()}, {SEQ_TOKENS}
SELECT term_id, list_transform(coalesce(wv.vec, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]), lambda x: round(x, 6) + 0.0) AS vec
FROM widx LEFT JOIN wv USING (term)
UNION ALL SELECT 0, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]"""


def subsampled_counts_sql(threshold: float = 1e-3, seed: int = 7) -> str:
    return f"""WITH tk AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos
            FROM (SELECT doc_id, {_WORDS_DOC} AS w FROM documents)),
tot AS (SELECT count(*)::DOUBLE AS n FROM tk),
cf AS (SELECT term, count(*) / any_value(tot.n) AS f FROM tk, tot GROUP BY term),
x AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR || ':' || pos::VARCHAR || ':{seed}'), 1, 8))::BIGINT
                     / 4294967296.0 < (sqrt(f / {threshold}) + 1) * {threshold} / f AS keep
      FROM tk JOIN cf USING (term))
SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE keep) AS n_kept FROM x GROUP BY doc_id"""


ENCODE_SOURCES = """SELECT source, dense_rank() OVER (ORDER BY source) AS code FROM (SELECT DISTINCT source FROM documents)"""


# ----------------------------------------------------------------------------- clusters
LABEL_COUNTS = "SELECT label, count(*) AS n FROM embeddings GROUP BY label"

_ASSIGN = f"""{EMB},
cen AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS cluster_id, vec FROM (SELECT * FROM e ORDER BY doc_id LIMIT 10)),
dd AS (SELECT e.doc_id, cen.cluster_id, e.label, e.vec,
              sqrt(list_sum(list_transform(list_zip(e.vec, cen.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist
       FROM e, cen),
asg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(dist, 12), cluster_id) AS r FROM dd)
        WHERE r = 1),
cont AS (SELECT cluster_id, label, count(*) AS n FROM asg GROUP BY cluster_id, label)"""

CLUSTER_CONTINGENCY = f"WITH {_ASSIGN} SELECT cluster_id, label, n FROM cont"

CLUSTER_SCORES_FIXED = f"""WITH {_ASSIGN},
per AS (SELECT cluster_id, sum(n) AS nc, max(n) AS mx, sum(n * log2(n)) AS snl FROM cont GROUP BY cluster_id)
SELECT sum(nc) AS n, round(sum(mx) / sum(nc), 6) AS purity,
       round(sum(nc * (snl / nc - log2(nc))) / sum(nc), 6) AS entropy FROM per"""

CLUSTER_MAJORITY = f"""WITH {_ASSIGN}
SELECT cluster_id, label, n FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, label) AS r FROM cont) WHERE r = 1"""

KMEANS_STEP = f"""WITH {_ASSIGN}
SELECT cluster_id, any_value(n) AS n, list(round(m, 6) + 0.0 ORDER BY i) AS vec, round(any_value(cost), 4) AS cost FROM (
  SELECT cluster_id, i, avg(vec[i]) AS m, count(*) AS n, any_value(cost) AS cost FROM (
     SELECT *, sum(dist * dist) OVER (PARTITION BY cluster_id) AS cost FROM asg) a,
     range(1, 65) AS g(i) GROUP BY cluster_id, i) GROUP BY cluster_id"""

TOP_TERMS_PER_SOURCE = f"""WITH t AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '{TERM_RE}')) AS term FROM documents),
c AS (SELECT doc_id, source, term, count(*) AS n FROM t GROUP BY ALL),
nd AS (SELECT count(*)::DOUBLE AS n FROM documents),
idf AS (SELECT term, ln((nd.n + 1) / (count(*) + 1)) + 1 AS idf FROM c, nd GROUP BY term, nd.n),
w0 AS (SELECT c.doc_id, c.source, c.term, c.n * idf.idf AS w FROM c JOIN idf USING (term)),
w AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS wn FROM w0),
sz AS (SELECT source, count(*) AS nd FROM documents GROUP BY source),
cen AS (SELECT source, term, sum(wn) / any_value(nd) AS weight FROM w JOIN sz USING (source) GROUP BY source, term),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS rank FROM cen)
SELECT source, rank, term, round(weight, 6) AS weight FROM r WHERE rank <= 20"""


def _lloyd_sql(points: str, dim: int, k: int = 10, steps: int = 8, cosine: bool = False) -> str:
    """CTEs that end in a (doc_id, cluster_id, label): unrolled Lloyd steps from hash-chosen centres."""
    unit = "list_transform(vec, lambda v: v / sqrt(list_dot_product(vec, vec)))"
    vec = unit if cosine else "vec"
    where = "WHERE list_dot_product(vec, vec) > 0" if cosine else ""
    if cosine:
        dist = "1 - list_dot_product(x.vec, c.vec) / (sqrt(list_dot_product(x.vec, x.vec)) * sqrt(list_dot_product(c.vec, c.vec)))"
    else:
        dist = "sqrt(list_sum(list_transform(list_zip(x.vec, c.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
    parts = [f"""p AS MATERIALIZED ({points}),
x AS MATERIALIZED (SELECT doc_id, {vec} AS vec, label FROM p {where}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS cluster_id, vec
       FROM (SELECT * FROM x ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {k}))"""]
    for i in range(steps + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT doc_id, cluster_id, label, vec FROM (
  SELECT x.doc_id, c.cluster_id, x.label, x.vec,
         row_number() OVER (PARTITION BY x.doc_id ORDER BY round({dist}, 12), c.cluster_id) AS r FROM x, c{i} c) WHERE r = 1)""")
        if i < steps:
            parts.append(f"""m{i} AS MATERIALIZED (SELECT cluster_id, list(m ORDER BY i) AS vec FROM (
  SELECT cluster_id, i, avg(vec[i]) AS m FROM a{i}, range(1, {dim + 1}) AS g(i) GROUP BY ALL) GROUP BY cluster_id),
n{i} AS MATERIALIZED (SELECT cluster_id, {unit if cosine else 'vec'} AS vec FROM m{i}),
c{i + 1} AS MATERIALIZED (SELECT cluster_id, list_transform(vec, lambda v: round(v, 12)) AS vec FROM n{i}
       UNION ALL SELECT * FROM c{i} WHERE cluster_id NOT IN (SELECT cluster_id FROM n{i}))""")
    if cosine:
        parts.append(f"""a AS (SELECT doc_id, cluster_id, label FROM a{steps}
  UNION ALL SELECT doc_id, -1, label FROM p WHERE list_dot_product(vec, vec) = 0)""")
    else:
        parts.append(f"a AS (SELECT doc_id, cluster_id, label FROM a{steps})")
    return ",\n".join(parts)


def _scores_sql(method: str) -> str:
    return f"""cont AS (SELECT cluster_id, label, count(*) AS n FROM a GROUP BY ALL),
per AS (SELECT cluster_id, sum(n) AS nc, max(n) AS mx, sum(n * log2(n)) AS snl FROM cont GROUP BY cluster_id)
SELECT '{method}' AS method, sum(nc) AS n, round(sum(mx) / sum(nc), 6) AS purity,
       round(sum(nc * (snl / nc - log2(nc))) / sum(nc), 6) AS entropy FROM per"""


KMEANS_SCORES = f"""WITH {EMB},
{_lloyd_sql("SELECT doc_id, vec, label FROM e", 64)},
{_scores_sql("kmeans")}"""

SPHERICAL_KMEANS_SCORES = f"""WITH {EMB},
{_lloyd_sql("SELECT doc_id, vec, label FROM e", 64, cosine=True)},
{_scores_sql("spherical_kmeans")}"""

_DOC_POINTS = f"""dv AS MATERIALIZED ({_vec_of("SELECT wc.doc_id, wc.side, wc.n, wv.vec FROM wc JOIN wv USING (term)", "n")}),
{_lloyd_sql("SELECT dv.doc_id, dv.vec, documents.source AS label FROM dv JOIN documents USING (doc_id)", 8)}"""

KMEANS_DOCUMENTS_SCORES = f"""WITH {SIDES}, {word_vectors_cte()},
{_DOC_POINTS},
{_scores_sql("kmeans_documents")}"""

KMEANS_DOCUMENTS_TOP_TERMS = f"""WITH {SIDES}, {word_vectors_cte()},
{_DOC_POINTS},
{COUNTS},
nd AS (SELECT count(*)::DOUBLE AS n FROM documents),
idf AS (SELECT term, ln((nd.n + 1) / (count(*) + 1)) + 1 AS idf FROM c, nd GROUP BY term, nd.n),
w0 AS (SELECT c.doc_id, c.term, c.n * idf.idf AS w FROM c JOIN idf USING (term)),
w AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS wn FROM w0),
sz AS (SELECT cluster_id, count(*) AS nd FROM a GROUP BY cluster_id),
cen AS (SELECT cluster_id, term, round(sum(wn) / any_value(nd), 9) AS weight
        FROM w JOIN a USING (doc_id) JOIN sz USING (cluster_id) GROUP BY cluster_id, term),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, term) AS rank FROM cen)
SELECT cluster_id, rank, term, round(weight, 6) AS weight FROM r WHERE rank <= 20"""


# ----------------------------------------------------------------------------- document vectors and counts, old and new
def topk_doc_vectors_sql(vectors: str, k: int = 3) -> str:
    """``vectors``: a query that ends in SELECT doc_id, side, vec."""
    dist = ("1 - list_dot_product(q.vec, r.vec) / "
            "(sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(r.vec, r.vec)))")
    pairs = f"""SELECT q.doc_id AS new_id, r.doc_id AS old_id,
       CASE WHEN list_dot_product(q.vec, q.vec) = 0 OR list_dot_product(r.vec, r.vec) = 0 THEN 'NaN'::DOUBLE
            ELSE {dist} END AS dist
       FROM v q, v r WHERE q.side = 'new' AND r.side = 'old'"""
    return f"""WITH v AS MATERIALIZED ({vectors}),
{topk_pairs(pairs, k)}"""


def topk_counts_sql(metric: str, k: int = 3) -> str:
    pairs = "SELECT n.doc_id AS new_id, o.doc_id AS old_id FROM d n, d o WHERE n.side = 'new' AND o.side = 'old'"
    if metric == "cosine":
        dist = """CASE WHEN coalesce(x.sq, 0) = 0 OR coalesce(y.sq, 0) = 0 THEN 'NaN'::DOUBLE
                  ELSE 1 - coalesce(dot, 0) / (sqrt(x.sq) * sqrt(y.sq)) END"""
    else:
        dist = "sqrt((coalesce(x.sq, 0) + coalesce(y.sq, 0) - 2 * coalesce(dot, 0))::DOUBLE)"  # whole numbers: exact
    return f"""WITH {SIDES},
{COUNTS},
vocab AS (SELECT DISTINCT term FROM c WHERE side = 'old'),
w AS (SELECT c.* FROM c JOIN vocab USING (term)),
q AS (SELECT doc_id, sum(n * n)::BIGINT AS sq FROM w GROUP BY doc_id),
sh AS (SELECT a.doc_id AS new_id, b.doc_id AS old_id, sum(a.n * b.n)::BIGINT AS dot
       FROM w a JOIN w b ON a.term = b.term WHERE a.side = 'new' AND b.side = 'old' GROUP BY 1, 2),
{topk_pairs(f'''SELECT p.new_id, p.old_id, {dist} AS dist FROM ({pairs}) p LEFT JOIN sh USING (new_id, old_id)
       LEFT JOIN q x ON x.doc_id = p.new_id LEFT JOIN q y ON y.doc_id = p.old_id''', k)}"""


# ----------------------------------------------------------------------------- words, html
_W = r"[\p{L}\p{N}_]"
_MARKED = rf"regexp_replace(lower(text), '({_W})(n''t)', '\1' || chr(1) || '\2', 'g')"
_WORD_TOKENS = (rf"regexp_extract_all({_MARKED}, 'n''t|''{_W}+|{_W}+(?:-{_W}+)*|"
                r"[^\p{L}\p{N}_ \t\n\x0B\f\r\x01]')")
WORD_TOKEN_STATS = f"""SELECT doc_id, len({_WORD_TOKENS})::BIGINT AS n_tokens,
  len(list_filter({_WORD_TOKENS}, lambda x: starts_with(x, chr(39)) OR x = 'n' || chr(39) || 't'))::BIGINT AS n_clitics
FROM documents"""


def _html_text(x: str) -> str:
    from ..functions import html as H
    for pattern, to in H.STEPS:
        quoted = pattern.replace("'", "''")
        x = f"regexp_replace({x}, '{quoted}', {H.sql_literal(to)}, 'g')"
    for name, to in H.ENTITIES:
        x = f"replace({x}, '&{name};', {H.sql_literal(to)})"
    return x


HTML_TEXT = f"""WITH t AS (SELECT page_id, replace({_html_text("html")}, '&amp;', '&#38;') AS t FROM pages),
n AS (SELECT page_id, list_reduce(list_prepend(t, list_distinct(regexp_extract_all(t, '&#([0-9]{{1,6}});', 1))),
        lambda a, b: replace(a, '&#' || b || ';', chr(b::INTEGER))) AS t FROM t)
SELECT page_id, length(t)::BIGINT AS n_chars, len({_ws_tokens("t")})::BIGINT AS n_words FROM n"""


# ----------------------------------------------------------------------------- trained word vectors
_PAIRS = f"""ss AS (SELECT doc_id, {_WORDS} AS s FROM documents),
s1 AS (SELECT doc_id, unnest(s) AS w, unnest(range(len(s))) AS sid FROM ss),
tk AS (SELECT doc_id, sid, unnest(w) AS term, unnest(range(len(w))) AS wid FROM s1),
tot AS (SELECT count(*)::DOUBLE AS n FROM tk),
cf AS (SELECT term, count(*) / any_value(tot.n) AS f FROM tk, tot GROUP BY term),
kept AS (SELECT doc_id, sid, term, row_number() OVER (PARTITION BY doc_id, sid ORDER BY wid) AS rn FROM tk JOIN cf USING (term)
         WHERE ('0x' || substr(md5(doc_id::VARCHAR || ':' || sid::VARCHAR || '.' || wid::VARCHAR || ':7'), 1, 8))::BIGINT
               / 4294967296.0 < (sqrt(f / 1e-3) + 1) * 1e-3 / f),
pr AS (SELECT a.term, b.term AS ctx, count(*) AS n FROM kept a JOIN kept b
       ON a.doc_id = b.doc_id AND a.sid = b.sid AND a.rn <> b.rn AND abs(a.rn - b.rn) <= 10 GROUP BY ALL),
pt AS (SELECT term, sum(n)::DOUBLE AS total FROM pr GROUP BY term),
pn AS (SELECT sum(total) AS n FROM pt),
info AS (SELECT pr.term, pr.ctx, pr.n, greatest(ln(pr.n * pn.n / (x.total * y.total)), 0) AS ppmi
         FROM pr JOIN pt x ON pr.term = x.term JOIN pt y ON pr.ctx = y.term CROSS JOIN pn)"""

COOCCURRENCE_PPMI = f"""WITH {_PAIRS}
SELECT term, count(*) AS n_contexts, sum(n)::BIGINT AS n, round(sum(ppmi), 6) AS ppmi_sum, round(max(ppmi), 6) AS ppmi_max
FROM info GROUP BY term"""

_STEPS = " UNION ALL ".join(
    f"SELECT ctx, (('0x' || substr(md5(ctx || '#{j}'), 1, 8))::BIGINT % 300)::INTEGER AS d, "
    f"CASE WHEN substr(md5(ctx || '#{j}'), 9, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s "
    "FROM (SELECT DISTINCT ctx FROM info)" for j in range(4))
WORD2VEC_DOC_VECTORS = f"""WITH {SIDES}, {WORD_COUNTS}, {_PAIRS},
steps AS ({_STEPS}),
cell AS (SELECT term, d, sum(ppmi * s) AS x FROM info JOIN steps USING (ctx) WHERE ppmi > 0 GROUP BY term, d),
nrm AS (SELECT term, sqrt(sum(x * x)) AS nrm FROM cell GROUP BY term),
words AS (SELECT DISTINCT term FROM pr),
cnt AS (SELECT doc_id, side, sum(n) AS cnt FROM wc JOIN words USING (term) GROUP BY ALL),
dv AS (SELECT doc_id, side, d, sum(n * x / nrm) AS v FROM wc JOIN cell USING (term) JOIN nrm USING (term)
       WHERE nrm > 0 GROUP BY ALL)
SELECT cnt.doc_id, cnt.side, list(round(coalesce(v, 0) / cnt, 6) + 0.0 ORDER BY g.d) AS vec
FROM cnt CROSS JOIN range(300) g(d) LEFT JOIN dv ON dv.doc_id = cnt.doc_id AND dv.side = cnt.side AND dv.d = g.d
GROUP BY cnt.doc_id, cnt.side"""
