"""Command line: preprocess, train, show, analyze.

    python -m corpusloom preprocess texts.txt corpus --min-doc-freq 2
    python -m corpusloom train corpus model --num-topics 20
    python -m corpusloom show --topic-word model/topic_word --words 10
    python -m corpusloom analyze corpus --max-doc-fraction 0.5
"""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description="Topic-model analytics on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("preprocess", help="text lines or TSV to a corpus folder")
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("--format", choices=["plain", "tsv"], default="plain")
    a.add_argument("--id-field", action="store_true")
    a.add_argument("--id-column", type=int, default=0)
    a.add_argument("--label-column", type=int, default=1)
    a.add_argument("--text-column", type=int, default=2)
    a.add_argument("--stoplist")
    a.add_argument("--min-doc-freq", type=int, default=1)
    a.add_argument("--max-doc-fraction", type=float, default=1.0)
    a = sub.add_parser("train", help="corpus folder to topic tables")
    a.add_argument("corpus")
    a.add_argument("output")
    a.add_argument("--num-topics", type=int, default=10)
    a.add_argument("--iters", type=int, default=1000)
    a.add_argument("--num-samples", type=int, default=5)
    a.add_argument("--sample-interval", type=int, default=25)
    a.add_argument("--alpha-sum", type=float)
    a.add_argument("--beta", type=float, default=0.01)
    a.add_argument("--sampler", default="gibbs")
    a.add_argument("--optimize-interval", type=int, default=50)
    a.add_argument("--seed", type=int, default=42)
    a = sub.add_parser("show", help="top words of topics, top topics of documents")
    a.add_argument("--topic-word")
    a.add_argument("--doc-topic")
    a.add_argument("--words", type=int, default=10)
    a.add_argument("--doc-topics", type=int, default=3)
    a.add_argument("--threshold", type=float, default=0.0)
    a = sub.add_parser("analyze", help="suggest stop words")
    a.add_argument("corpus")
    a.add_argument("--max-doc-fraction", type=float, default=0.5)
    a.add_argument("--max-word-length", type=int, default=3)
    a.add_argument("--rare", type=int, default=1)
    a.add_argument("--num-candidates", type=int, default=50)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F
    from pyspark.sql import Window as W

    from .models.dirichlet import LDA
    from .operators import text
    from .sources import corpus

    o = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    if o.command == "preprocess":
        raw = corpus.read_lines(spark, o.input, o.id_field) if o.format == "plain" else corpus.read_tsv(spark, o.input, o.id_column, o.label_column, o.text_column)
        stop = text.load_stoplist(spark, o.stoplist) if o.stoplist else None
        docs, vocab = corpus.build_corpus(raw, "doc_name", "text", stopwords=stop, min_doc_freq=o.min_doc_freq, max_doc_fraction=o.max_doc_fraction)
        corpus.save_corpus(docs, vocab, o.output)
    elif o.command == "train":
        docs, _ = corpus.load_corpus(spark, o.corpus)
        m = LDA(o.num_topics, alpha_sum=o.alpha_sum, beta=o.beta, sampler=o.sampler, seed=o.seed, optimize_interval=o.optimize_interval)
        m.fit(docs.select(F.col("doc_name").alias("doc_id"), "tokens"), iters=o.iters, num_samples=o.num_samples, sample_interval=o.sample_interval)
        corpus.write_topic_word(m.phi(), f"{o.output}/topic_word")
        labels = docs.select(F.col("doc_name").alias("doc_id"), "label") if "label" in docs.columns else None
        corpus.write_doc_topic(m.doc_topic(), f"{o.output}/doc_topic", list(range(o.num_topics)), labels)
    elif o.command == "show":
        if o.topic_word:
            t = spark.read.csv(o.topic_word, sep="\t", header=True, schema="topic int, word string, probability double")
            w = W.partitionBy("topic").orderBy(F.col("probability").desc(), "word")
            top = t.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= o.words)
            for r in top.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w")).orderBy("topic").toLocalIterator():
                print(f"{r['topic']}\t{' '.join(x['word'] for x in r['w'])}")
        if o.doc_topic:
            d = spark.read.csv(o.doc_topic, sep="\t", header=True)
            topics = [c for c in d.columns if c.startswith("topic_")]
            pairs = F.array_sort(F.array(*[F.struct((-F.col(c).cast("double")).alias("p"), F.lit(int(c[6:])).alias("k")) for c in topics]))
            best = F.slice(F.filter(pairs, lambda x: -x["p"] >= o.threshold), 1, o.doc_topics)
            for r in d.select("doc", best.alias("t")).toLocalIterator():
                print(f"{r['doc']}\t{' '.join(f'{x.k}:{-x.p:.4f}' for x in r['t'])}")
    else:
        docs, _ = corpus.load_corpus(spark, o.corpus)
        bow = text.bag_of_words(docs.select(F.col("doc_name").alias("doc_id"), "tokens"))
        found = text.suggest_stopwords(bow, o.max_doc_fraction, o.max_word_length, o.rare)
        w = W.partitionBy("reason").orderBy(F.col("df").desc(), "term")
        # a report of the most frequent candidates of each rule
        for r in found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= o.num_candidates).orderBy("reason", "place").toLocalIterator():
            print(f"{r['reason']}\t{r['term']}\t{r['df']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
