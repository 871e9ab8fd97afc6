"""Further queries of the reference operators and their SQL twins: effects, ranks, moments, checks, fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.session import cut, read
from ..models import gibbs
from ..models.dynamic import DTM, STS
from ..models.embedding import BERTopic, Top2Vec, cluster_points
from ..models.logistic import CTM, STM
from ..models.neural import ETM, ETMVAE, FASTopic
from ..models.supervised import PT, SupervisedLDA
from ..operators import cooc, design, diagnostics, selection, text, vectors, weights
from ..sources import corpus
from . import panels


def queries(c) -> dict:
    """``c`` is the catalogue, whose stand-ins for phi and theta these queries share."""
    r, docs, bow = c._rounded, c._docs, c._bow

    def covariates(s, d):
        """Length of the text in thousands and of its tokens in hundreds, and the source."""
        n = docs(s, d).select("doc_id", (F.size("tokens") / 100).alias("tokens_h"))
        raw = read(s, d, "documents").filter("text is not null").select("doc_id", (F.length("text") / 1000).alias("chars_k"), F.lower(F.trim(F.coalesce("source", F.lit("none")))).alias("source"))
        return raw.join(n, "doc_id")

    def slopes(s, d, features, **options):
        e = design.effect_frame(c._theta(s, d), covariates(s, d), features, **options)
        return r(e.filter("feature <> 'intercept'").select("topic", "feature", "coef", "se"), "coef", "se")

    def labels(s, d):
        """Languages numbered in their order; documents without one are noise."""
        return c._class(s, d, "lang").select("doc_id", F.when(F.col("class") == "none", "-1").otherwise(F.col("class")).alias("topic"))

    def outliers(s, d):
        phi, of = c._phi(s, d), labels(s, d)
        at = cut(phi.select("topic").distinct().filter("topic <> 'none'").withColumn("k", F.dense_rank().over(__import__("pyspark").sql.Window.orderBy("topic")) - 1))
        numbered = of.join(F.broadcast(at), "topic", "left").select("doc_id", F.coalesce("k", F.lit(-1)).alias("label"))
        return vectors.assign_outliers(bow(s, d), numbered, phi.join(F.broadcast(at), "topic").select(F.col("k").alias("topic"), "term", "prob"))

    def marginal(s, d):
        v = text.vocabulary(bow(s, d)).join(c._kept(s, d).select("term"), "term")
        return v.crossJoin(F.broadcast(v.agg(F.sum("tf").alias("all")))).select("term", (F.col("tf") / F.col("all")).alias("p"))

    def held(s, d):
        odd = docs(s, d).select("doc_id", F.explode(F.filter("tokens", lambda x, i: i % 2 == 1)).alias("term"))
        return odd.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))

    def residuals(s, d):
        x = selection.check_residuals(bow(s, d).join(c._kept(s, d).select("term"), "term"), c._theta(s, d), c._phi(s, d))
        return s.createDataFrame([(x["dispersion"], x["df"])], "dispersion double, df double").select(F.round("dispersion", 4).alias("dispersion"), "df")

    customer = lambda s, d: read(s, d, "customer")

    def splines(s, d):
        at = design.knots(customer(s, d), "c_acctbal", 4)
        return r(customer(s, d).withColumns(design.spline("c_acctbal", at)).select("c_custkey", "s1", "s2", "s3", "s4"), "s1", "s2", "s3", "s4")

    def formula(s, d):
        x, spec = design.design_matrix("~ c_mktsegment * c_acctbal", customer(s, d), "c_custkey")
        long = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("x")) for n in spec.names])).alias("f")
        return r(x.select("c_custkey", long).groupBy("f.feature").agg(F.sum("f.x").alias("total"), F.sum((F.col("f.x") != 0).cast("bigint")).alias("n")), "total")

    def aligned(s, d):
        kept = text.prune(bow(s, d), min_doc_freq=3, max_doc_fraction=0.2)
        return text.align_corpus(docs(s, d), kept).select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("words"))

    def nearest_documents(s, d):
        theta = c._theta(s, d)
        return r(selection.similar_documents(theta, theta.agg(F.min("doc_id")).first()[0], 10), "js")

    q = {
        "frex": lambda s, d: r(diagnostics.frex(c._phi(s, d).withColumn("prob", F.round("prob", 12))), "frex"),
        "relevance": lambda s, d: r(diagnostics.relevance(c._phi(s, d), marginal(s, d)), "relevance"),
        "topic_health": lambda s, d: r(diagnostics.topic_health(c._phi(s, d), diagnostics.topic_sizes(c._theta(s, d))), "share", "nearest"),
        "topic_table": lambda s, d: r(selection.topic_table(c._phi(s, d).withColumn("prob", F.round("prob", 12)), c._theta(s, d)), "prevalence"),
        "topic_correlation_clr": lambda s, d: r(panels.topic_correlation_clr(c._theta(s, d)), "corr"),
        "similar_documents": nearest_documents,
        "completion_loglik": lambda s, d: r(diagnostics.completion_loglik(held(s, d), c._theta(s, d), c._phi(s, d)), "loglik"),
        "check_residuals": residuals,
        "outliers_assigned": outliers,
        "effect_ols_multi": lambda s, d: slopes(s, d, ["chars_k", "tokens_h"]),
        "effect_cluster": lambda s, d: slopes(s, d, ["chars_k"], cluster="source"),
        "effect_logit": lambda s, d: slopes(s, d, ["chars_k", "tokens_h"], link="logit"),
        "coherence_cv": lambda s, d: r(cooc.coherence(docs(s, d), c._top(s, d), "c_v"), "coherence"),
        "spectral_moments": lambda s, d: cooc.pair_moments(bow(s, d).join(text.prune(bow(s, d), min_doc_freq=20, max_doc_fraction=0.3).select("term"), "term")).withColumn("q", F.round("q", 10)),
        "idf_plain": lambda s, d: r(text.idf(text.vocabulary(bow(s, d)), bow(s, d).select("doc_id").distinct().count()), "idf"),
        "idf_weights": lambda s, d: r(weights.idf_weights(c._counts(s, d)), "idf"),
        "top_fighting_words": lambda s, d: weights.top_fighting_words(r(weights.fighting_words(c._term_counts(s, d, "en"), c._term_counts(s, d, "de")), "z"), 20),
        "phrases_exported": lambda s, d: text.export_phrases(r(text.learn_phrases(docs(s, d)), "score")),
        "ngrams_trigram": lambda s, d: docs(s, d).select(F.explode(text.ngrams(F.col("tokens"), 3)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")),
        "corpus_stats": lambda s, d: corpus.corpus_stats(docs(s, d)),
        "align_corpus": aligned,
        "one_hot_design": lambda s, d: (lambda x: x.groupBy().agg(*[F.sum(n).alias(n.lower()) for n in x.columns if n.startswith("is_")]))(design.one_hot(customer(s, d), "c_mktsegment", prefix="is_")),
        "spline_basis": splines,
        "design_formula": formula,
        "term_barchart_lift": lambda s, d: r(panels.term_barchart(c._phi(s, d).withColumn("prob", F.round("prob", 12)), "lift", 5).withColumn("value", F.round("value", 6)), "value"),
    }

    # fits: rows only, checked by planted structure in the tests
    emb = lambda s, d: c._emb(s, d).select("id", "vec")
    def word_vectors(s, d):
        fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size("vec") == 64)
        return read(s, d, "word_vectors").filter("vec is not null").filter(fine).select(F.lower(F.trim("term")).alias("term"), "vec")

    by_lang = lambda s, d: c._class(s, d, "lang")
    keys = {"models": ["model", "topic", "topics"], "data": ["documents", "words", "tokens"]}
    share = lambda m: m.doc_topic()
    q |= {
        "dmr_effects": lambda s, d: gibbs.DMR(6).fit(docs(s, d), covariates(s, d).select("doc_id", "chars_k"), ["chars_k"], min_doc_freq=5).effects_frame(),
        "labeled_topics": lambda s, d: gibbs.LabeledLDA().fit(docs(s, d), by_lang(s, d).select("doc_id", F.array("class").alias("labels")), min_doc_freq=5).phi(),
        "seeded_doc_topic": lambda s, d: share(gibbs.SeededLDA(keys, residual=4).fit(docs(s, d), min_doc_freq=5)),
        "keyatm_topics": lambda s, d: gibbs.KeyATM(keys, num_topics=6).fit(docs(s, d), min_doc_freq=5).phi(),
        "pachinko_doc_topic": lambda s, d: share(gibbs.PA(3, 6).fit(docs(s, d), min_doc_freq=5)),
        "sage_topics": lambda s, d: gibbs.SAGE(4).fit(docs(s, d), by_lang(s, d).withColumnRenamed("class", "group"), min_doc_freq=10, iters=50).phi(),
        "hdp_topics": lambda s, d: gibbs.HDP(max_topics=30).fit(docs(s, d), min_doc_freq=5).phi(),
        "pt_doc_topic": lambda s, d: share(PT(6, num_pseudo=50).fit(docs(s, d), min_doc_freq=5)),
        "slda_predictions": lambda s, d: SupervisedLDA(6).fit(docs(s, d), covariates(s, d).select("doc_id", F.col("chars_k").alias("y")), min_doc_freq=5).predict(docs(s, d)),
        "stm_doc_topic": lambda s, d: share(STM(6).fit(docs(s, d), covariates(s, d).select("doc_id", "chars_k"), ["chars_k"], min_doc_freq=5)),
        "ctm_correlation": lambda s, d: CTM(6).fit(docs(s, d), min_doc_freq=5).topic_correlation(),
        "stm_content_topics": lambda s, d: STM(4).fit(docs(s, d), content=by_lang(s, d).withColumnRenamed("class", "group"), min_doc_freq=20, iters=20).phi(),
        "dtm_evolution": lambda s, d: DTM(4, chain_variance=0.05).fit(docs(s, d), read(s, d, "documents").select("doc_id", F.date_format("created_at", "yyyy").alias("time")), min_doc_freq=10).word_evolution(),
        "sts_sentiment": lambda s, d: STS(3).fit(docs(s, d), by_lang(s, d).select("doc_id", (F.col("class") == "en").cast("double").alias("s")), min_doc_freq=20, iters=10).sentiment(),
        "etm_topics": lambda s, d: ETM(6).fit(docs(s, d), word_vectors(s, d), min_doc_freq=5).phi(),
        "etm_vae_topics": lambda s, d: ETMVAE(6, hidden_size=64).fit(docs(s, d), word_vectors(s, d), min_doc_freq=5).phi(),
        "fastopic_doc_topic": lambda s, d: share(FASTopic(6).fit(docs(s, d), emb(s, d).withColumnRenamed("id", "doc_id"), min_doc_freq=5)),
        "hdbscan_labels": lambda s, d: cluster_points(emb(s, d), "hdbscan", min_cluster_size=15),
        "kmeans_labels": lambda s, d: cluster_points(emb(s, d), "kmeans", 10),
        "top2vec_words": lambda s, d: Top2Vec(10).fit(docs(s, d), emb(s, d), 64).top_words(10),
        "bertopic_doc_topic": lambda s, d: share(BERTopic(clusterer="kmeans", num_clusters=10, nr_topics=8).fit(docs(s, d), emb(s, d), 64)),
    }
    return q


def oracle_sql(c) -> dict[str, str]:
    b, phi, windows = c._BASE, c._PHI, c._windows
    cov = f"""{phi}, cv AS (SELECT doc_id, length(text) / 1000 AS chars_k, len(tokens) / 100 AS tokens_h, lower(trim(coalesce(source, 'none'))) AS source FROM documents JOIN docs USING (doc_id) WHERE text IS NOT NULL),
d AS (SELECT topic, p AS y, chars_k AS x1, tokens_h AS x2, source FROM theta JOIN cv USING (doc_id))"""
    npmi = "CASE WHEN co / windows >= 1 THEN 1.0 ELSE ln((CASE WHEN co <= 0 THEN 1e-12 ELSE co / windows END) / (greatest(oi / windows, 1e-12) * greatest(oj / windows, 1e-12))) / -ln(CASE WHEN co <= 0 THEN 1e-12 ELSE co / windows END) END"
    low = lambda v: f"row_number() OVER (PARTITION BY topic ORDER BY {v}, term) / count(*) OVER (PARTITION BY topic)"
    frex = f"""fe AS (SELECT topic, term, round(prob, 12) AS prob, round(round(prob, 12) / sum(round(prob, 12)) OVER (PARTITION BY term), 12) AS e FROM phi),
fx AS (SELECT topic, term, prob, 1 / (0.5 / ({low('prob')}) + 0.5 / ({low('e')})) AS frex FROM fe)"""
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    cube = lambda t: f"pow(greatest(x - k[{t}], 0), 3)"
    piece = lambda t: f"round(({cube(t)} - {cube(4)} * ((k[5] - k[{t}]) / (k[5] - k[4])) + {cube(5)} * ((k[4] - k[{t}]) / (k[5] - k[4]))) / pow(k[5] - k[1], 2), 6)"
    return {
        "frex": f"WITH {phi}, {frex} SELECT topic, term, round(frex, 6) AS frex FROM fx",
        "relevance": f"""WITH {phi}, m AS (SELECT term, tf / sum(tf) OVER () AS p FROM voc JOIN kept USING (term))
SELECT topic, term, round(0.6 * ln(prob) + 0.4 * ln(prob / p), 6) AS relevance FROM phi JOIN m USING (term)""",
        "topic_health": f"""WITH {phi}, nn AS (SELECT topic, sqrt(sum(prob * prob)) AS n FROM phi GROUP BY topic),
dd AS (SELECT x.topic AS ta, y.topic AS tb, sum(x.prob * y.prob) AS d FROM phi x JOIN phi y ON x.term = y.term AND x.topic <> y.topic GROUP BY ALL),
near AS (SELECT ta AS topic, max(d / (p.n * q.n)) AS nearest FROM dd JOIN nn p ON p.topic = ta JOIN nn q ON q.topic = tb GROUP BY ta),
sh AS (SELECT topic, sum(p) / (SELECT sum(p) FROM theta) AS share FROM theta GROUP BY topic)
SELECT topic, round(share, 6) AS share, round(nearest, 6) AS nearest, CASE WHEN share < 0.01 THEN 'dead' WHEN nearest >= 0.9 THEN 'duplicate' ELSE 'ok' END AS flag FROM sh LEFT JOIN near USING (topic)""",
        "topic_table": f"""WITH {phi}, {frex}, pw AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY round(prob, 12) DESC, term) AS pl FROM phi QUALIFY pl <= 7),
fw AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY frex DESC, term) AS pl FROM fx QUALIFY pl <= 7)
SELECT topic, round(avg(p), 6) AS prevalence, (SELECT string_agg(term, ', ' ORDER BY pl) FROM pw WHERE pw.topic = theta.topic) AS prob, (SELECT string_agg(term, ', ' ORDER BY pl) FROM fw WHERE fw.topic = theta.topic) AS frex FROM theta GROUP BY topic""",
        "topic_correlation_clr": f"""WITH {phi}, l AS (SELECT doc_id, topic, ln(greatest(p, 1e-12)) - avg(ln(greatest(p, 1e-12))) OVER (PARTITION BY doc_id) AS p FROM theta)
SELECT x.topic AS topic_a, y.topic AS topic_b, round(coalesce(corr(x.p, y.p), 0), 6) AS corr FROM l x JOIN l y ON x.doc_id = y.doc_id AND x.topic < y.topic GROUP BY ALL""",
        "similar_documents": f"""WITH {phi}, one AS (SELECT topic, p AS q FROM theta WHERE doc_id = (SELECT min(doc_id) FROM theta))
SELECT doc_id, round(js, 6) AS js FROM (SELECT doc_id, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2 AS js
FROM theta JOIN one USING (topic) WHERE doc_id <> (SELECT min(doc_id) FROM theta) GROUP BY doc_id) ORDER BY js, doc_id LIMIT 10""",
        "completion_loglik": f"""WITH {phi}, h AS (SELECT doc_id, term, count(*) AS n FROM tok WHERE pos % 2 = 1 GROUP BY ALL), m AS (SELECT doc_id, term, max(n) AS n, sum(p * prob) AS q FROM h JOIN phi USING (term) JOIN theta USING (doc_id, topic) GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, round(sum(n * ln(greatest(q, 1e-12))), 6) AS loglik FROM m GROUP BY doc_id""",
        "check_residuals": f"""WITH {phi}, kb AS (SELECT doc_id, term, cnt FROM bow JOIN kept USING (term)), sz AS (SELECT doc_id, sum(cnt) AS m FROM kb GROUP BY doc_id),
g AS (SELECT doc_id, term, least(greatest(sum(p * prob), 1e-12), 1 - 1e-12) AS q FROM theta JOIN phi USING (topic) GROUP BY ALL),
r AS (SELECT q, m, coalesce(cnt, 0) AS x FROM g JOIN sz USING (doc_id) LEFT JOIN kb USING (doc_id, term)),
t AS (SELECT sum((x * x - 2 * x * q * m) / (m * q * (1 - q)) + m * q / (1 - q)) AS d, sum(CASE WHEN q * m > 0.01 THEN 1 ELSE 0 END) AS nhat FROM r),
c AS (SELECT (SELECT count(DISTINCT topic) FROM phi) AS k, (SELECT count(*) FROM kept) AS v, (SELECT count(DISTINCT doc_id) FROM theta) AS n)
SELECT round(d / (nhat - v - (n * (k - 1) + k * (v - 1))), 4) AS dispersion, CAST(nhat - v - (n * (k - 1) + k * (v - 1)) AS DOUBLE) AS df FROM t, c""",
        "outliers_assigned": f"""WITH {phi}, tt AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS k FROM (SELECT DISTINCT topic FROM phi WHERE topic <> 'none')),
s AS (SELECT doc_id, k, sum(cnt * ln(prob + 1e-12)) AS s FROM bow JOIN phi USING (term) JOIN tt USING (topic) JOIN cls USING (doc_id) WHERE class = 'none' GROUP BY ALL),
best AS (SELECT doc_id, k FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, k) = 1)
SELECT doc_id, CAST(CASE WHEN class = 'none' THEN coalesce(best.k, -1) ELSE coalesce(tt.k, best.k, -1) END AS INT) AS label FROM cls LEFT JOIN tt ON tt.topic = cls.class LEFT JOIN best USING (doc_id)""",
        "effect_ols_multi": f"""WITH {cov}, m AS (SELECT topic, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, count(*) AS n FROM d GROUP BY topic),
s AS (SELECT topic, n, sum((x1 - m1) * (x1 - m1)) AS s11, sum((x2 - m2) * (x2 - m2)) AS s22, sum((x1 - m1) * (x2 - m2)) AS s12, sum((x1 - m1) * (y - my)) AS t1, sum((x2 - m2) * (y - my)) AS t2, sum((y - my) * (y - my)) AS yy FROM d JOIN m USING (topic) GROUP BY topic, n),
f AS (SELECT *, s11 * s22 - s12 * s12 AS det, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) AS b1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
v AS (SELECT *, (yy - b1 * t1 - b2 * t2) / (n - 3) AS s2 FROM f)
SELECT topic, 'chars_k' AS feature, round(b1, 6) AS coef, round(sqrt(s2 * s22 / det), 6) AS se FROM v UNION ALL SELECT topic, 'tokens_h', round(b2, 6), round(sqrt(s2 * s11 / det), 6) FROM v""",
        "effect_cluster": f"""WITH {cov}, m AS (SELECT topic, avg(y) AS my, avg(x1) AS mx, count(*) AS n FROM d GROUP BY topic), s AS (SELECT topic, n, my, mx, sum((x1 - mx) * (y - my)) / sum((x1 - mx) * (x1 - mx)) AS b, sum((x1 - mx) * (x1 - mx)) AS sxx FROM d JOIN m USING (topic) GROUP BY ALL),
u AS (SELECT topic, source, sum((x1 - mx) * (y - my - b * (x1 - mx))) AS u FROM d JOIN s USING (topic) GROUP BY ALL), g AS (SELECT topic, sum(u * u) AS meat, count(*) AS g FROM u GROUP BY topic)
SELECT topic, 'chars_k' AS feature, round(b, 6) AS coef, round(sqrt(meat * g / (g - 1) * (n - 1) / (n - 2)) / sxx, 6) AS se FROM s JOIN g USING (topic)""",
        "coherence_cv": f"""WITH {phi}, {windows(110)}, pr AS (SELECT x.topic, x.term AS wi, y.term AS wj, coalesce(co, 0) AS co, coalesce(p.occ, 0) AS oi, coalesce(q.occ, 0) AS oj FROM top x JOIN top y ON x.topic = y.topic AND x.term <> y.term
  LEFT JOIN co ON a = least(x.term, y.term) AND b = greatest(x.term, y.term) LEFT JOIN occ p ON p.term = x.term LEFT JOIN occ q ON q.term = y.term),
mt AS (SELECT topic, wi, wj, {npmi} AS v FROM pr, win UNION ALL SELECT topic, term, term, 1.0 FROM top), st AS (SELECT topic, wj, sum(v) AS s FROM mt GROUP BY ALL), ln AS (SELECT topic, sqrt(sum(s * s)) AS size FROM st GROUP BY topic),
rw AS (SELECT topic, wi, sum(v * s) AS d, sqrt(sum(v * v)) AS r FROM mt JOIN st USING (topic, wj) GROUP BY ALL) SELECT topic, round(avg(d / (r * size)), 6) AS coherence FROM rw JOIN ln USING (topic) GROUP BY topic""",
        "spectral_moments": f"""WITH {b}, kb AS (SELECT doc_id, term, cnt FROM bow JOIN (SELECT term FROM voc, tot WHERE df >= 20 AND df <= ceil(total * 0.3::DOUBLE)) USING (term)), sz AS (SELECT doc_id, sum(cnt) AS n FROM kb GROUP BY doc_id HAVING sum(cnt) > 1)
SELECT x.term AS a, y.term AS b, round(sum((x.cnt * y.cnt - CASE WHEN x.term = y.term THEN x.cnt ELSE 0 END) / CAST(n * (n - 1) AS DOUBLE)) / (SELECT count(*) FROM sz), 10) AS q FROM kb x JOIN kb y USING (doc_id) JOIN sz USING (doc_id) GROUP BY ALL""",
        "idf_plain": f"WITH {b} SELECT term, round(ln(total / df), 6) AS idf FROM voc, tot",
        "idf_weights": f"WITH {c._classed('source')} SELECT term, round(ln(1 + (SELECT sum(tf) / count(DISTINCT class) FROM cc) / sum(tf)), 6) AS idf FROM cc GROUP BY term",
        "top_fighting_words": f"""WITH w AS ({c.oracle_sql_core()['fighting_words']}), r AS (SELECT 'a' AS side, term, z, row_number() OVER (ORDER BY z DESC, term) AS place FROM w UNION ALL SELECT 'b', term, z, row_number() OVER (ORDER BY z, term) FROM w)
SELECT side, place, term, z FROM r WHERE place <= 20""",
        "phrases_exported": f"SELECT a || '_' || b AS phrase, score FROM ({c.oracle_sql_core()['phrases_default']})",
        "ngrams_trigram": f"WITH {b} SELECT x.term || '_' || y.term || '_' || z.term AS gram, count(*) AS n FROM tok x JOIN tok y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 JOIN tok z ON x.doc_id = z.doc_id AND z.pos = x.pos + 2 GROUP BY 1",
        "corpus_stats": f"WITH {b} SELECT (SELECT count(*) FROM docs) AS num_docs, (SELECT count(*) FROM voc) AS num_words, (SELECT CAST(sum(tf) AS BIGINT) FROM voc) AS total_tokens, false AS has_labels",
        "align_corpus": f"""WITH {b}, kv AS (SELECT term FROM voc, tot WHERE df >= 3 AND df <= ceil(total * 0.2::DOUBLE)), a AS (SELECT doc_id, count(*) AS n, string_agg(term, ' ' ORDER BY pos) AS words FROM tok JOIN kv USING (term) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n, coalesce(words, '') AS words FROM docs LEFT JOIN a USING (doc_id)""",
        "one_hot_design": "SELECT " + ", ".join(f"CAST(sum(CASE WHEN c_mktsegment = '{x}' THEN 1 ELSE 0 END) AS DOUBLE) AS is_{x.lower()}" for x in segments[1:]) + " FROM customer",
        "spline_basis": f"""WITH k AS (SELECT quantile_cont(c_acctbal, [0, 0.25, 0.5, 0.75, 1]) AS k FROM customer), x AS (SELECT c_custkey, c_acctbal AS x, k FROM customer, k)
SELECT c_custkey, round(x, 6) AS s1, {piece(1)} AS s2, {piece(2)} AS s3, {piece(3)} AS s4 FROM x""",
        "design_formula": " UNION ALL ".join(
            [*(f"SELECT 'c_mktsegment[{x}]' AS feature, CAST(count(*) AS DOUBLE) AS total, count(*) AS n FROM customer WHERE c_mktsegment = '{x}'" for x in segments[1:]),
             "SELECT 'c_acctbal', round(sum(c_acctbal), 6), count(*) FILTER (WHERE c_acctbal <> 0) FROM customer",
             *(f"SELECT 'c_mktsegment[{x}]:c_acctbal', round(sum(c_acctbal), 6), count(*) FILTER (WHERE c_acctbal <> 0) FROM customer WHERE c_mktsegment = '{x}'" for x in segments[1:])]
        ),
        "term_barchart_lift": f"""WITH {phi}, l AS (SELECT topic, term, round(round(prob, 12) / avg(round(prob, 12)) OVER (PARTITION BY term), 9) AS value FROM phi)
SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY value DESC, term) AS place, term, round(value, 6) AS value FROM l QUALIFY place <= 5""",
    }
