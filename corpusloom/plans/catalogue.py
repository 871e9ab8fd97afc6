"""Queries of the reference operators over the driver's tables, and their SQL twins.

Fitted phi and theta depend on random numbers, so the diagnostics run on closed-form stand-ins:
topics are language classes, phi is the smoothed class-term distribution, theta one expectation step.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import cut, read
from ..models.dirichlet import GSDMM, LDA
from ..operators import cooc, diagnostics, text, vectors, weights
from . import analysis

R = 6
KEYWORDS = [("model", "topic"), ("model", "topics"), ("model", "absent-word"), ("data", "documents"), ("data", "words"), ("data", "tokens")]


#: What one query has written already: the bag of words and the stand-ins, so that texts are tokenized once.
_memo: dict = {}


def _once(name: str, sf: str, make):
    if (name, sf) not in _memo:
        _memo[name, sf] = cut(make())
    return _memo[name, sf]


def _fresh(query):
    """The query with nothing kept from the one before."""

    def run(s: SparkSession, sf: str) -> DataFrame:
        _memo.clear()
        return query(s, sf)

    return run


def _docs(s: SparkSession, sf: str) -> DataFrame:
    return text.token_docs(read(s, sf, "documents"))


def _held(s, sf):
    """``_docs``, written once for queries that read them several times."""
    return _once("docs", sf, lambda: _docs(s, sf))


def _bow(s, sf):
    return text.bag_of_words(_docs(s, sf))


def _class(s, sf, column="source"):
    return read(s, sf, "documents").select("doc_id", _label(column))


def _label(column):
    return F.lower(F.trim(F.coalesce(F.col(column), F.lit("none")))).alias("class")


def _tallies(s, sf, column):
    """(class, term, df, tf) with the class from the document's own row, or None where an id stands in several rows."""
    d = read(s, sf, "documents")
    if ("repeated", sf) not in _memo:
        _memo["repeated", sf] = text.repeated(d)
    if _memo["repeated", sf]:
        return None
    return _once(f"tallies {column}", sf, lambda: text.counted(d.select(_label(column), text.tokenize(F.col("text")).alias("tokens"))).filter("term is not null"))


def _kept(s, sf, column="lang"):
    rows = _tallies(s, sf, column)
    if rows is None:
        return _once("kept", sf, lambda: text.prune(_once("bow", sf, lambda: text.bag_of_words(_held(s, sf))), min_doc_freq=2))
    return _once("kept", sf, lambda: rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).filter("df >= 2"))


def _counts(s, sf, column="source"):
    kept, rows = _kept(s, sf, column), _tallies(s, sf, column)
    if rows is not None:
        return _once(f"counts {column}", sf, lambda: rows.join(kept.select("term"), "term").select("class", "term", "tf"))
    return _once(f"counts {column}", sf, lambda: weights.class_counts(_once("bow", sf, lambda: text.bag_of_words(_held(s, sf))).join(kept.select("term"), "term"), _class(s, sf, column)))


def _phi(s, sf):
    return _once("phi", sf, lambda: _smoothed(s, sf))


def _smoothed(s, sf):
    """Smoothed class-term distribution over the kept vocabulary: (n + .01) / (N + .01 V)."""
    c = _counts(s, sf, "lang")
    v = _kept(s, sf).select("term")
    k = c.groupBy("class").agg(F.sum("tf").alias("total"))
    size = v.agg(F.count(F.lit(1)).alias("v"))
    # classes are a handful of languages; the grid is classes x vocabulary, which phi has by nature
    grid = v.crossJoin(F.broadcast(k)).crossJoin(F.broadcast(size))
    x = grid.join(c, ["class", "term"], "left")
    return x.select(F.col("class").alias("topic"), "term", ((F.coalesce("tf", F.lit(0)) + 0.01) / (F.col("total") + 0.01 * F.col("v"))).alias("prob"))


def _theta(s, sf):
    return _once("theta", sf, lambda: _shares(s, sf))


def _shares(s, sf):
    """Mean over a document's known tokens of phi_kw / sum_k phi_kw."""
    phi = _phi(s, sf)
    share = phi.join(phi.groupBy("term").agg(F.sum("prob").alias("all")), "term").select("topic", "term", (F.col("prob") / F.col("all")).alias("r"))
    x = _once("bow", sf, lambda: text.bag_of_words(_held(s, sf))).join(share, "term").groupBy("doc_id", "topic").agg(F.sum(F.col("cnt") * F.col("r")).alias("m"), F.sum("cnt").alias("n"))
    return x.select("doc_id", "topic", F.round(F.col("m") / F.col("n"), 9).alias("p"))


def _top(s, sf):
    return weights.top_terms(_phi(s, sf).withColumn("prob", F.round("prob", 12)), 10, "topic", "prob").select("topic", "place", "term")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, R) for c in columns})


def _emb(s, sf):
    return read(s, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _term_counts(s, sf, name):
    return _counts(s, sf, "lang").filter(F.col("class") == name).select("term", F.col("tf").alias("n"))


def _keywords(s):
    return s.createDataFrame(KEYWORDS, "set string, term string")


def queries() -> dict:
    q = {
        "tokenize_terms": lambda s, d: _bow(s, d).groupBy("term").agg(F.sum("cnt").alias("tf")),
        "vocab_df_tf": lambda s, d: text.vocabulary(_bow(s, d)),
        "prune_vocab": lambda s, d: text.prune(_bow(s, d), min_doc_freq=3, max_doc_fraction=0.2, min_cf=4),
        "kept_docs": lambda s, d: text.kept_documents(_bow(s, d), text.prune(_bow(s, d), min_doc_freq=3, max_doc_fraction=0.05)),
        "doc_lengths": lambda s, d: _docs(s, d).select("doc_id", F.size("tokens").alias("n")),
        "removal_curve": lambda s, d: text.removal_curve(_bow(s, d), [1, 2, 5, 20, 100]),
        "stopword_suggest": lambda s, d: text.suggest_stopwords(_bow(s, d), 0.2),
        "ngrams_bigram": lambda s, d: _docs(s, d).select(F.explode(text.ngrams(F.col("tokens"), 2)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")),
        "phrases_default": lambda s, d: _rounded(text.learn_phrases(_docs(s, d)), "score"),
        "phrases_npmi": lambda s, d: _rounded(text.learn_phrases(_docs(s, d), threshold=0.5, scoring="npmi"), "score"),
        "phrases_applied": lambda s, d: text.apply_phrases(_docs(s, d), text.learn_phrases(_docs(s, d))).select("doc_id", F.size("tokens").alias("n")),
        "chunk_tokens": lambda s, d: text.chunk_tokens(_docs(s, d), 40, 10).select("parent", "chunk", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("words")),
        "fighting_words": lambda s, d: _rounded(weights.fighting_words(_term_counts(s, d, "en"), _term_counts(s, d, "de")), "z"),
        "fighting_words_informative": lambda s, d: _rounded(weights.fighting_words(_term_counts(s, d, "en"), _term_counts(s, d, "de"), informative=True), "z"),
        "keyword_stats": lambda s, d: _rounded(weights.keyword_stats(text.vocabulary(_bow(s, d)), _keywords(s)), "share"),
        "keyword_refine": lambda s, d: weights.refine_keywords(text.vocabulary(_bow(s, d)), _keywords(s)),
        "token_weights_information": lambda s, d: _rounded(weights.token_weights(text.vocabulary(_bow(s, d))), "weight"),
        "token_weights_inverse": lambda s, d: _rounded(weights.token_weights(text.vocabulary(_bow(s, d)), "inverse"), "weight"),
        "cooc_doc": lambda s, d: cooc.cooccurrence(_docs(s, d), _top(s, d), 0)[1],
        "cooc_window10": lambda s, d: cooc.cooccurrence(_docs(s, d), _top(s, d), 10)[1],
        "coherence_umass": lambda s, d: _rounded(cooc.coherence(_docs(s, d), _top(s, d)), "coherence"),
        "coherence_uci": lambda s, d: _rounded(cooc.coherence(_docs(s, d), _top(s, d), "c_uci"), "coherence"),
        "coherence_npmi": lambda s, d: _rounded(cooc.coherence(_docs(s, d), _top(s, d), "c_npmi"), "coherence"),
        "topic_diversity": lambda s, d: _rounded(diagnostics.topic_diversity(_top(s, d)), "diversity"),
        "exclusivity": lambda s, d: _rounded(diagnostics.exclusivity(_phi(s, d).withColumn("prob", F.round("prob", 12))), "exclusivity"),
        "label_scores": lambda s, d: _rounded(diagnostics.label_scores(_phi(s, d)), "lift", "score"),
        "topic_divergence_js": lambda s, d: _rounded(diagnostics.topic_divergence(_phi(s, d)), "js"),
        "topic_cosine": lambda s, d: _rounded(diagnostics.topic_cosine(_phi(s, d)), "cosine"),
        "topic_sizes": lambda s, d: _rounded(diagnostics.topic_sizes(_theta(s, d)), "mass"),
        "top_topics": lambda s, d: _rounded(diagnostics.top_topics(_theta(s, d)), "p"),
        "top_documents": lambda s, d: _rounded(diagnostics.top_documents(_theta(s, d)), "p"),
        "topic_correlation": lambda s, d: _rounded(diagnostics.topic_correlation(_theta(s, d)), "corr"),
        "topics_over_time": lambda s, d: _rounded(diagnostics.topics_over_time(_theta(s, d), read(s, d, "documents").filter("loaded_at is not null").select("doc_id", F.date_format("loaded_at", "yyyy-MM").alias("stamp"))), "prevalence"),
        "by_strata": lambda s, d: _rounded(diagnostics.by_strata(_theta(s, d), _class(s, d).withColumnRenamed("class", "level")), "mean", "low", "high"),
        "effect_ols_single": lambda s, d: _rounded(diagnostics.effect_single(_theta(s, d), read(s, d, "documents").filter("text is not null").select("doc_id", (F.length("text") / 1000).alias("x"))), "slope", "intercept", "r2"),
        "centroids": lambda s, d: vectors.centroids(_emb(s, d)).select("label", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", R)),
        "cosine_topk": lambda s, d: vectors.nearest(_emb(s, d).filter("id % 50 = 0").select(F.col("id").alias("query"), F.col("vec").alias("q")), _emb(s, d), 5),
        "soft_assign": lambda s, d: _rounded(vectors.soft_assign(_emb(s, d).select("id", "vec"), vectors.centroids(_emb(s, d))), "p"),
        "kmeans_step": lambda s, d: vectors.kmeans_step(_emb(s, d).select("id", "vec"), vectors.centroids(_emb(s, d))).withColumn("cost", F.round("cost", 4)),
        "pca_gram": lambda s, d: vectors.gram(_emb(s, d), 64).withColumn("s", F.round("s", 4)),
    }
    # fits depend on random starts: rows only, checked by planted structure in the tests
    q["lda_cvb0_topics"] = lambda s, d: LDA(8, alpha_sum=1.0).fit(_docs(s, d), min_doc_freq=5, **FITS["cvb0"]).phi()
    q["lda_gibbs_topics"] = lambda s, d: LDA(8, alpha_sum=1.0, sampler="gibbs").fit(_docs(s, d), min_doc_freq=5, **FITS["gibbs"]).phi()
    q["lda_doc_topic"] = lambda s, d: LDA(8, alpha_sum=1.0).fit(_docs(s, d), min_doc_freq=5, **FITS["cvb0"]).doc_topic()
    q["gsdmm_clusters"] = lambda s, d: GSDMM(12).fit(_docs(s, d), min_doc_freq=5).doc_cluster
    for name, opts in CTFIDF.items():
        q[name] = lambda s, d, o=opts: _rounded(weights.ctfidf(_counts(s, d), **o), "weight")
    q["ctfidf_topk"] = lambda s, d: weights.top_terms(_rounded(weights.ctfidf(_counts(s, d)), "weight"))
    q |= analysis.queries(sys.modules[__name__])
    return {name: _fresh(f) for name, f in q.items()}


#: Sweeps until the convergence test of ``LDA.fit``, 1000 at most; Gibbs then averages 5 snapshots 25 sweeps apart.
FITS = {"cvb0": {"iters": 1000, "convergence_tol": 1e-3}, "gibbs": {"iters": 1000, "convergence_tol": 1e-4, "num_samples": 5, "sample_interval": 25}}
CTFIDF = {"ctfidf": {}, "ctfidf_bm25": {"bm25": True}, "ctfidf_sqrt": {"reduce_frequent": True}, "ctfidf_bm25_sqrt": {"bm25": True, "reduce_frequent": True}}

_BASE = r"""
docs AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '\p{L}[\p{L}\-''’.·]*\p{L}'), lambda w: lower(w)) AS tokens FROM documents),
tok AS (SELECT doc_id, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM docs),
bow AS (SELECT doc_id, term, count(*) AS cnt FROM tok GROUP BY ALL),
voc AS (SELECT term, count(*) AS df, CAST(sum(cnt) AS BIGINT) AS tf FROM bow GROUP BY term),
tot AS (SELECT count(DISTINCT doc_id) AS total FROM bow)
"""


def _classed(column: str) -> str:
    return f"""{_BASE},
kept AS (SELECT term FROM voc WHERE df >= 2),
cls AS (SELECT doc_id, lower(trim(coalesce({column}, 'none'))) AS class FROM documents),
cc AS (SELECT class, term, CAST(sum(cnt) AS BIGINT) AS tf FROM bow JOIN kept USING (term) JOIN cls USING (doc_id) GROUP BY ALL)
"""


_PHI = f"""{_classed('lang')},
grid AS (SELECT class, total AS n, term, v FROM (SELECT class, sum(tf) AS total FROM cc GROUP BY class), (SELECT term FROM kept), (SELECT count(*) AS v FROM kept)),
phi AS (SELECT class AS topic, term, (coalesce(tf, 0) + 0.01::DOUBLE) / (n + 0.01::DOUBLE * v) AS prob FROM grid LEFT JOIN cc USING (class, term)),
share AS (SELECT topic, term, prob / sum(prob) OVER (PARTITION BY term) AS r FROM phi),
theta AS (SELECT doc_id, topic, round(sum(cnt * r) / sum(cnt), 9) AS p FROM bow JOIN share USING (term) GROUP BY ALL),
top AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY round(prob, 12) DESC, term) AS place FROM phi QUALIFY place <= 10)
"""
_NEED = "need AS (SELECT DISTINCT x.term AS a, y.term AS b FROM top x JOIN top y ON x.topic = y.topic AND x.term < y.term)"


def _windows(w: int) -> str:
    last = "0" if w == 0 else f"greatest(len(tokens) - {w}, 0)"
    lo = "0" if w == 0 else f"greatest(pos - {w - 1}, 0)"
    return f"""
wl AS (SELECT doc_id, {last} AS last FROM docs WHERE len(tokens) > 0),
win AS (SELECT sum(last + 1) AS windows FROM wl),
seen AS (SELECT DISTINCT doc_id, term, unnest(range(least({lo}, least(pos, last)), least(pos, last) + 1)) AS s FROM tok JOIN wl USING (doc_id) WHERE term IN (SELECT term FROM top)),
occ AS (SELECT term, count(*) AS occ FROM seen GROUP BY term), {_NEED},
co AS (SELECT a, b, count(*) AS co FROM seen x JOIN seen y USING (doc_id, s) JOIN need ON x.term = a AND y.term = b GROUP BY ALL),
tp AS (SELECT x.topic, coalesce(co, 0) AS co, coalesce(p.occ, 0) AS oi, coalesce(q.occ, 0) AS oj FROM top x JOIN top y ON x.topic = y.topic AND x.place > y.place
  LEFT JOIN co ON a = least(x.term, y.term) AND b = greatest(x.term, y.term) LEFT JOIN occ p ON p.term = x.term LEFT JOIN occ q ON q.term = y.term)
"""


_EMB = """
e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
flat AS (SELECT id, label, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM e),
cen AS (SELECT label, i, avg(x) AS m FROM flat WHERE label >= 0 GROUP BY ALL),
cv AS (SELECT label, list(m ORDER BY i) AS c FROM cen GROUP BY label)
"""


def oracle_sql() -> dict[str, str]:
    return oracle_sql_core() | analysis.oracle_sql(sys.modules[__name__])


def oracle_sql_core() -> dict[str, str]:
    b, phi = _BASE, _PHI
    idf = {False: "ln(1 + a / f)", True: "ln(greatest(1.0, 1 + (a - f + 0.5) / (f + 0.5)))"}
    contrast = lambda prior: f"""WITH {_classed('lang')},
j AS (SELECT term, coalesce(x.tf, 0) AS n_a, coalesce(y.tf, 0) AS n_b FROM (SELECT * FROM cc WHERE class = 'en') x FULL JOIN (SELECT * FROM cc WHERE class = 'de') y USING (term)),
k AS (SELECT *, {prior} AS p FROM j), t AS (SELECT sum(n_a) AS t_a, sum(n_b) AS t_b, sum(p) AS t_p FROM k)
SELECT term, n_a, n_b, round((ln((n_a + p) / (t_a + t_p - n_a - p)) - ln((n_b + p) / (t_b + t_p - n_b - p))) / sqrt(1 / (n_a + p) + 1 / (n_b + p)), 6) AS z FROM k, t"""  # noqa: E731
    keys = "kw(set, term) AS (VALUES " + ", ".join(f"('{a}', '{w}')" for a, w in KEYWORDS) + ")"
    bigram = "bi AS (SELECT x.term AS a, y.term AS b FROM tok x JOIN tok y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1)"
    pair = f"{bigram}, n2 AS (SELECT a, b, count(*) AS n_ab FROM bi GROUP BY ALL HAVING count(*) >= 5), sc AS (SELECT CAST(count(*) AS DOUBLE) AS v, CAST(sum(tf) AS DOUBLE) AS total FROM voc)"
    npmi = "CASE WHEN co / windows >= 1 THEN 1.0 ELSE ln((CASE WHEN co <= 0 THEN 1e-12 ELSE co / windows END) / (greatest(oi / windows, 1e-12) * greatest(oj / windows, 1e-12))) / -ln(CASE WHEN co <= 0 THEN 1e-12 ELSE co / windows END) END"
    out = {
        "tokenize_terms": f"WITH {b} SELECT term, tf FROM voc",
        "vocab_df_tf": f"WITH {b} SELECT term, df, tf FROM voc",
        "prune_vocab": f"WITH {b} SELECT term, df, tf FROM voc, tot WHERE df >= 3 AND df <= ceil(total * 0.2::DOUBLE) AND tf >= 4",
        "kept_docs": f"WITH {b} SELECT doc_id, CAST(sum(cnt) AS BIGINT) AS n_tokens FROM bow JOIN voc USING (term), tot WHERE df >= 3 AND df <= ceil(total * 0.05::DOUBLE) GROUP BY doc_id",
        "doc_lengths": f"WITH {b} SELECT doc_id, CAST(len(tokens) AS INT) AS n FROM docs",
        "removal_curve": f"""WITH {b}, g(threshold) AS (VALUES (1), (2), (5), (20), (100)), m AS (SELECT doc_id, max(df) AS m FROM bow JOIN voc USING (term) GROUP BY doc_id)
SELECT threshold, (SELECT count(*) FROM voc WHERE df < threshold) AS words_removed, (SELECT count(*) FROM m WHERE m < threshold) AS docs_removed FROM g""",
        "stopword_suggest": rf"""WITH {b}, x AS (SELECT term, df, total, regexp_full_match(term, '[0-9]+') AS num, length(regexp_replace(term, '[^\p{{L}}]', '', 'g')) AS l FROM voc, tot)
SELECT 'common' AS reason, term, df FROM x WHERE df > ceil(total * 0.2::DOUBLE) UNION ALL SELECT 'short', term, df FROM x WHERE length(term) < 3 AND NOT num
UNION ALL SELECT 'numeric', term, df FROM x WHERE num UNION ALL SELECT 'nonalpha', term, df FROM x WHERE NOT num AND l * 2 < strlen(term) UNION ALL SELECT 'rare', term, df FROM x WHERE df <= 1""",
        "ngrams_bigram": f"WITH {b}, {bigram} SELECT a || '_' || b AS gram, count(*) AS n FROM bi GROUP BY 1",
        "phrases_default": f"WITH {b}, {pair} SELECT a, b, n_ab, round((n_ab - 5) * v / (CAST(x.tf AS DOUBLE) * y.tf), 6) AS score FROM n2 JOIN voc x ON x.term = a JOIN voc y ON y.term = b, sc WHERE (n_ab - 5) * v / (CAST(x.tf AS DOUBLE) * y.tf) >= 10",
        "phrases_npmi": f"""WITH {b}, {pair}, s AS (SELECT a, b, n_ab, ln((n_ab / total) / ((x.tf / total) * (y.tf / total))) / -ln(n_ab / total) AS score FROM n2 JOIN voc x ON x.term = a JOIN voc y ON y.term = b, sc)
SELECT a, b, n_ab, round(score, 6) AS score FROM s WHERE score >= 0.5""",
        "chunk_tokens": f"""WITH {b}, c AS (SELECT doc_id, tokens, len(tokens) AS n, greatest(CAST(ceil(len(tokens) / 40.0) AS INT), 1) AS k FROM docs),
c2 AS (SELECT *, CASE WHEN k > 1 AND n - (k - 1) * 40 < 10 THEN k - 1 ELSE k END AS m FROM c), c3 AS (SELECT *, unnest(range(m)) AS j FROM c2),
c4 AS (SELECT doc_id, j, tokens[j * 40 + 1 : CASE WHEN j = m - 1 THEN n ELSE j * 40 + 40 END] AS w FROM c3)
SELECT doc_id AS parent, CAST(j AS INT) AS chunk, CAST(len(w) AS INT) AS n, coalesce(array_to_string(w, ' '), '') AS words FROM c4""",
        "fighting_words": contrast("0.01::DOUBLE"),
        "fighting_words_informative": contrast("0.01::DOUBLE * (n_a + n_b)"),
        "keyword_stats": f"WITH {b}, {keys} SELECT set, term, coalesce(tf, 0) AS tf, coalesce(df, 0) AS df, round(coalesce(tf, 0) / (SELECT sum(tf) FROM voc), 6) AS share FROM kw LEFT JOIN voc USING (term)",
        "keyword_refine": f"WITH {b}, {keys} SELECT set, term, coalesce(tf, 0) >= 2 AND coalesce(df, 0) >= 1 AS kept FROM kw LEFT JOIN voc USING (term)",
        "token_weights_information": f"WITH {b} SELECT term, round(-log2(tf / (SELECT CAST(sum(tf) AS DOUBLE) FROM voc)), 6) AS weight FROM voc",
        "token_weights_inverse": f"WITH {b} SELECT term, round((SELECT CAST(sum(tf) AS DOUBLE) FROM voc) / tf, 6) AS weight FROM voc",
        "cooc_doc": f"WITH {phi}, {_windows(0)} SELECT a, b, co FROM co",
        "cooc_window10": f"WITH {phi}, {_windows(10)} SELECT a, b, co FROM co",
        "coherence_umass": f"WITH {phi}, {_windows(0)} SELECT topic, round(avg(CASE WHEN oj > 0 THEN ln((co + 1) / oj) END), 6) AS coherence FROM tp GROUP BY topic",
        "coherence_uci": f"WITH {phi}, {_windows(10)} SELECT topic, round(avg(ln((co / windows + 1e-12) / (greatest(oi / windows, 1e-12) * greatest(oj / windows, 1e-12)))), 6) AS coherence FROM tp, win GROUP BY topic",
        "coherence_npmi": f"WITH {phi}, {_windows(10)} SELECT topic, round(avg({npmi}), 6) AS coherence FROM tp, win GROUP BY topic",
        "topic_diversity": f"WITH {phi} SELECT round(count(DISTINCT term) / count(*), 6) AS diversity FROM top",
        "exclusivity": f"WITH {phi} SELECT topic, round(avg(r), 6) AS exclusivity FROM share JOIN top USING (topic, term) GROUP BY topic",
        "label_scores": f"WITH {phi} SELECT topic, term, round(prob / avg(prob) OVER t, 6) AS lift, round(prob * (ln(prob) - avg(ln(prob)) OVER t), 6) AS score FROM phi WINDOW t AS (PARTITION BY term)",
        "topic_divergence_js": f"""WITH {phi} SELECT x.topic AS topic_a, y.topic AS topic_b, round(sum(x.prob * log2(2 * x.prob / (x.prob + y.prob)) + y.prob * log2(2 * y.prob / (x.prob + y.prob))) / 2, 6) AS js
FROM phi x JOIN phi y ON x.term = y.term AND x.topic < y.topic GROUP BY ALL""",
        "topic_cosine": f"""WITH {phi}, nn AS (SELECT topic, sqrt(sum(prob * prob)) AS n FROM phi GROUP BY topic), dd AS (SELECT x.topic AS ta, y.topic AS tb, sum(x.prob * y.prob) AS d FROM phi x JOIN phi y ON x.term = y.term AND x.topic < y.topic GROUP BY ALL)
SELECT ta AS topic_a, tb AS topic_b, round(d / (p.n * q.n), 6) AS cosine FROM dd JOIN nn p ON p.topic = ta JOIN nn q ON q.topic = tb""",
        "topic_sizes": f"""WITH {phi}, first AS (SELECT doc_id, topic FROM theta QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, topic) = 1), n AS (SELECT topic, count(*) AS docs FROM first GROUP BY topic)
SELECT topic, coalesce(docs, 0) AS docs, round(mass, 6) AS mass FROM (SELECT topic, sum(p) AS mass FROM theta GROUP BY topic) LEFT JOIN n USING (topic)""",
        "top_topics": f"WITH {phi} SELECT doc_id, topic, round(p, 6) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, topic) AS place FROM theta QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY theta.p DESC, topic) <= 2",
        "top_documents": f"WITH {phi}, r AS (SELECT topic, doc_id, p, row_number() OVER (PARTITION BY topic ORDER BY p DESC, doc_id) AS place FROM theta) SELECT topic, doc_id, round(p, 6) AS p, place FROM r WHERE place <= 3",
        "topic_correlation": f"WITH {phi} SELECT x.topic AS topic_a, y.topic AS topic_b, round(coalesce(corr(x.p, y.p), 0), 6) AS corr FROM theta x JOIN theta y ON x.doc_id = y.doc_id AND x.topic < y.topic GROUP BY ALL",
        "topics_over_time": f"""WITH {phi}, m AS (SELECT strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m') AS stamp, topic, avg(p) AS v FROM theta JOIN documents USING (doc_id) WHERE loaded_at IS NOT NULL GROUP BY ALL)
SELECT stamp, topic, round(v / sum(v) OVER (PARTITION BY stamp), 6) AS prevalence FROM m""",
        "by_strata": f"""WITH {phi}, g AS (SELECT lower(trim(coalesce(source, 'none'))) AS level, topic, count(*) AS n, avg(p) AS mean, coalesce(stddev_samp(p), 0) / sqrt(count(*)) AS se FROM theta JOIN documents USING (doc_id) GROUP BY ALL)
SELECT level, topic, n, round(mean, 6) AS mean, round(greatest(0, mean - 1.959963984540054 * se), 6) AS low, round(least(1, mean + 1.959963984540054 * se), 6) AS high FROM g""",
        "effect_ols_single": f"""WITH {phi}, x AS (SELECT topic, p, length(text) / 1000 AS x FROM theta JOIN documents USING (doc_id) WHERE text IS NOT NULL)
SELECT topic, round(regr_slope(p, x), 6) AS slope, round(regr_intercept(p, x), 6) AS intercept, round(regr_r2(p, x), 6) AS r2, CAST(regr_count(p, x) AS BIGINT) AS n FROM x GROUP BY topic""",
        "centroids": f"WITH {_EMB} SELECT label, CAST(i AS INT) AS i, round(m, 6) AS x FROM cen",
        "cosine_topk": f"""WITH {_EMB}, c AS (SELECT q.id AS query, e.id AS id, round(list_cosine_similarity(q.vec, e.vec), 6) AS cosine FROM e, e q WHERE q.id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS place FROM c)
SELECT query, id, cosine, place FROM r WHERE place <= 5""",
        "soft_assign": f"""WITH {_EMB}, c AS (SELECT id, cv.label, greatest(0, list_cosine_similarity(vec, c)) AS c FROM e, cv)
SELECT id, label, round(CASE WHEN sum(c) OVER w > 0 THEN c / sum(c) OVER w ELSE 1 / count(*) OVER w END, 6) AS p FROM c WINDOW w AS (PARTITION BY id)""",
        "kmeans_step": f"""WITH {_EMB}, d AS (SELECT id, cv.label, round(list_sum(list_transform(list_zip(vec, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d FROM e, cv),
best AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, label) = 1) SELECT label, count(*) AS n, round(sum(d), 4) AS cost FROM best GROUP BY label""",
        "pca_gram": f"WITH {_EMB} SELECT CAST(x.i + 1 AS INT) AS i, CAST(y.i + 1 AS INT) AS j, round(sum(x.x * y.x), 4) AS s FROM flat x JOIN flat y ON x.id = y.id AND x.i <= y.i GROUP BY ALL",
    }
    for name, o in CTFIDF.items():
        tf = "sqrt(tf)" if o.get("reduce_frequent") else "tf"
        out[name] = f"""WITH {_classed('source')}, f AS (SELECT term, sum(tf) AS f FROM cc GROUP BY term), a AS (SELECT sum(tf) / count(DISTINCT class) AS a FROM cc)
SELECT class, term, round({tf} * {idf[bool(o.get('bm25'))]}, 6) AS weight FROM cc JOIN f USING (term), a"""
    out["ctfidf_topk"] = f"""WITH w AS ({out['ctfidf']}), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY weight DESC, term) AS place FROM w) SELECT class, term, weight, place FROM r WHERE place <= 10"""
    return out
