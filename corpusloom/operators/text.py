"""Tokens, vocabulary, pruning, n-grams, phrases and chunks of text documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import small

# fixed value: the default token pattern
TOKEN = r"\p{L}[\p{L}\-'’.·]*\p{L}"


# fixed values: function words that carry no topic
ENGLISH_STOPWORDS = frozenset(
    "a about above after again against all also although an and any are as at be because been before being between both but by can could did do does doing down during each even few "
    "for from further get had has have having he her here him his how however if in into is it its itself just many more most much must no not now of on once only or other our out over "
    "own same she should since so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who will "
    "with would you your".split()
)


def load_stoplist(spark: SparkSession, path: str) -> list[str]:
    """Words of a file, one a line, without outer blanks; blank lines are left out."""
    return sorted(r[0] for r in spark.read.text(path).select(F.trim("value").alias("w")).filter("w <> ''").distinct().collect())


def tokenize(text: Column, lowercase: bool = True, pattern: str = TOKEN, min_length: int = 1, stopwords: list[str] | None = None) -> Column:
    """Array of the pattern's matches; lower case first, then short words and stop words go."""
    t = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    if lowercase:
        t = F.transform(t, F.lower)
    if min_length > 1:
        t = F.filter(t, lambda w: F.length(w) >= min_length)
    if stopwords:
        stop = F.array(*[F.lit(w) for w in stopwords])
        t = F.filter(t, lambda w: ~F.array_contains(stop, w))
    return t


def token_docs(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, tokens)."""
    return df.select(F.col(key).alias("doc_id"), tokenize(F.col(text), **options).alias("tokens"))


def custom_tokens(df: DataFrame, tokenizer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens) by a Python function from text to words, run on Arrow batches; null texts give no token."""

    @F.pandas_udf("array<string>")
    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda t: list(tokenizer(t)) if isinstance(t, str) else [])

    return df.select(F.col(key).alias("doc_id"), run(F.col(text)).alias("tokens"))


def bag_of_words(docs: DataFrame) -> DataFrame:
    """(doc_id, term, cnt)."""
    return docs.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("cnt"))


def vocabulary(bow: DataFrame) -> DataFrame:
    """(term, df, tf) of a bag of words; one row per document and term makes df a count."""
    return bow.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("cnt").alias("tf"))


def repeated(docs: DataFrame) -> bool:
    """Whether a ``doc_id`` stands in several rows, or is null; the rows of one id are one document."""
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col("doc_id").isNull()).isEmpty()


def _counted(batches):
    """Counts of a batch's rows (class, tokens): (class, term, df, tf), a term null for the rows with a token."""
    for b in batches:
        lists, given = b.column("tokens"), b.column("class").dictionary_encode()
        per = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        group = given.indices.fill_null(len(given.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        names = pa.concat_arrays([given.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
        words = lists.flatten().dictionary_encode()
        v, code = len(words.dictionary), words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(per)), per)[code >= 0]
        cell, n = np.unique(doc * v + code[code >= 0], return_counts=True)
        at = group[cell // max(v, 1)] * v + cell % max(v, 1)
        df, tf = np.bincount(at, minlength=len(names) * v), np.bincount(at, n, len(names) * v).astype(np.int64)
        used, full = np.nonzero(df)[0], np.bincount(group[per > 0], minlength=len(names))
        of = np.r_[used // max(v, 1), np.arange(len(names))]
        terms = pa.concat_arrays([words.dictionary.take(pa.array(used % max(v, 1))).cast(pa.string()), pa.nulls(len(names), pa.string())])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), terms, pa.array(np.r_[df[used], full]), pa.array(np.r_[tf[used], np.zeros(len(names), np.int64)])], names=["class", "term", "df", "tf"])


def counted(docs: DataFrame) -> DataFrame:
    """(class, term, df, tf) of (class, tokens), one row a document, and a row of term null whose df is the documents with a token.

    Counts are added batch by batch where the texts are, so only they are shuffled and no bag of words is.
    """
    return docs.select(F.col("class").cast("string").alias("class"), "tokens").mapInArrow(_counted, "class string, term string, df bigint, tf bigint").groupBy("class", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def prune(bow: DataFrame, min_doc_freq: int = 1, max_doc_fraction: float = 1.0, min_cf: int = 0, rm_top: int = 0) -> DataFrame:
    """Terms to keep: (term, df, tf), df at most ceil(D x fraction), D the documents with a token.

    The ``rm_top`` most frequent terms (ties by term) go first.
    """
    v = vocabulary(bow)
    if rm_top:
        # a top-k report: the removed terms are the feature
        v = v.join(small(v.orderBy(F.col("tf").desc(), "term").limit(rm_top).select("term"))[0], "term", "left_anti")
    total = bow.agg(F.count_distinct("doc_id").alias("total"))
    kept = v.crossJoin(F.broadcast(total)).filter((F.col("df") >= min_doc_freq) & (F.col("df") <= F.ceil(F.col("total") * F.lit(max_doc_fraction))) & (F.col("tf") >= min_cf))
    return kept.select("term", "df", "tf")


def kept_documents(bow: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): documents with a token left, and how many."""
    return bow.join(kept.select("term"), "term").groupBy("doc_id").agg(F.sum("cnt").alias("n_tokens"))


def removal_curve(bow: DataFrame, thresholds: list[int]) -> DataFrame:
    """(threshold, words_removed, docs_removed) if terms of a lower df went.

    A document dies when its greatest df is below the threshold, so one aggregation serves all.
    """
    v = vocabulary(bow)
    spark = bow.sparkSession
    grid = F.broadcast(spark.createDataFrame([(int(t),) for t in thresholds], "threshold int"))
    dead = bow.join(v.select("term", "df"), "term").groupBy("doc_id").agg(F.max("df").alias("m"))
    words = v.select("df").crossJoin(grid).groupBy("threshold").agg(F.sum((F.col("df") < F.col("threshold")).cast("bigint")).alias("words_removed"))
    docs = dead.crossJoin(grid).groupBy("threshold").agg(F.sum((F.col("m") < F.col("threshold")).cast("bigint")).alias("docs_removed"))
    return words.join(docs, "threshold")


def ngrams(tokens: Column, n: int, sep: str = "_") -> Column:
    """Contiguous n-grams of a token array."""
    last = F.size(tokens) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), sep))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))


def add_ngrams(docs: DataFrame, lo: int = 1, hi: int = 2, min_df: int = 1, sep: str = "_") -> DataFrame:
    """Tokens replaced by all their n-grams, shorter ones first; documents may become empty."""
    parts = [F.col("tokens") if n == 1 else ngrams(F.col("tokens"), n, sep) for n in range(lo, hi + 1)]
    out = docs.withColumn("tokens", F.concat(*parts))
    if min_df > 1:
        keep = vocabulary(bag_of_words(out)).filter(F.col("df") >= min_df).select("term")
        pos = out.select("doc_id", F.posexplode("tokens").alias("pos", "term")).join(keep, "term")
        new = pos.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("tokens"))
        out = out.drop("tokens").join(new, "doc_id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    return out


def learn_phrases(docs: DataFrame, min_count: int = 5, threshold: float = 10.0, scoring: str = "default") -> DataFrame:
    """(a, b, n_ab, score): adjacent word pairs that stand together more often than chance.

    default: (n_ab - min_count) V / (n_a n_b); npmi: ln(P(ab) / P(a)P(b)) / -ln P(ab) with
    P(x) = n_x / tokens, 1 where P(ab) = 1.
    """
    uni = docs.select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    pairs = docs.filter(F.size("tokens") > 1).select(F.explode(F.arrays_zip(F.slice("tokens", 1, F.size("tokens") - 1).alias("a"), F.slice("tokens", 2, F.size("tokens") - 1).alias("b"))).alias("p"))
    both = pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n_ab")).filter(F.col("n_ab") >= min_count)
    scale = F.broadcast(uni.agg(F.count(F.lit(1)).cast("double").alias("v"), F.sum("n").cast("double").alias("total")))
    x = both.join(uni.select(F.col("w").alias("a"), F.col("n").alias("n_a")), "a").join(uni.select(F.col("w").alias("b"), F.col("n").alias("n_b")), "b").crossJoin(scale)
    if scoring == "npmi":
        p = F.col("n_ab") / F.col("total")
        score = F.when(p >= 1, F.lit(1.0)).otherwise(F.log(p / ((F.col("n_a") / F.col("total")) * (F.col("n_b") / F.col("total")))) / -F.log(p))
    elif scoring == "default":
        score = (F.col("n_ab") - min_count) * F.col("v") / (F.col("n_a").cast("double") * F.col("n_b"))
    else:
        raise ValueError(f"unknown scoring {scoring!r}")
    return x.withColumn("score", score).filter(F.col("score") >= threshold).select("a", "b", "n_ab", "score")


def apply_phrases(docs: DataFrame, phrases: DataFrame, delimiter: str = "_") -> DataFrame:
    """Tokens with known pairs joined, from left to right, without overlap.

    The pairs a document needs are joined to it, so the phrase table may be of any size.
    """
    key = lambda a, b: F.concat(a, F.lit("\u0001"), b)
    adj = docs.filter(F.size("tokens") > 1).select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: key(F.element_at("tokens", i), F.element_at("tokens", i + 1)))).alias("k")).distinct()
    known = adj.join(phrases.select(key(F.col("a"), F.col("b")).alias("k")), "k").groupBy("doc_id").agg(F.collect_set("k").alias("known"))
    joined = docs.join(known, "doc_id", "left")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"))

    def step(s, w):
        hit = s["held"].isNotNull() & F.array_contains(F.col("known"), key(s["held"], w))
        flushed = F.when(s["held"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["held"]))
        return F.when(F.coalesce(hit, F.lit(False)), F.struct(F.array_append(s["out"], F.concat(s["held"], F.lit(delimiter), w)).alias("out"), F.lit(None).cast("string").alias("held"))).otherwise(F.struct(flushed.alias("out"), w.alias("held")))

    done = F.aggregate("tokens", start, step, lambda s: F.when(s["held"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["held"])))
    return joined.withColumn("tokens", F.when(F.col("known").isNull(), F.col("tokens")).otherwise(done)).drop("known")


def chunk_tokens(docs: DataFrame, max_words: int = 200, min_words: int = 50) -> DataFrame:
    """(parent, chunk, tokens): fixed strides; a last chunk under ``min_words`` joins the one before.

    An empty document gives one empty chunk.
    """
    n = F.size("tokens")
    full = F.greatest(F.ceil(n / F.lit(max_words)).cast("int"), F.lit(1))
    tail = n - (full - 1) * max_words
    chunks = F.when((full > 1) & (tail < min_words), full - 1).otherwise(full)
    d = docs.withColumn("_c", chunks).withColumn("_n", n)
    d = d.select(F.col("doc_id").alias("parent"), "tokens", "_c", "_n", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)).alias("chunk"))
    size = F.when(F.col("chunk") == F.col("_c") - 1, F.col("_n") - F.col("chunk") * max_words).otherwise(F.lit(max_words))
    return d.select("parent", "chunk", F.slice("tokens", F.col("chunk") * max_words + 1, size).alias("tokens"))


# fixed value: a sentence ends at a run of . ! or ?; what is left at the end of the text is one too
SENTENCE = r"[^.!?]+[.!?]+|\S.*$"


def sentences(text: Column) -> Column:
    """Array of the sentences of a text, without outer blanks; blank ones are left out."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def _pack(sents: list[str], most: int, least: int) -> list[str]:
    """Whole sentences packed greedily into chunks of at most ``most`` words; a longer sentence is cut into chunks of its own."""
    chunks: list[list[str]] = []
    room = 0
    for words in (s.split() for s in sents):
        if len(words) > most:
            chunks += [words[i : i + most] for i in range(0, len(words), most)]
            room = 0
        elif chunks and len(words) <= room:
            chunks[-1] = chunks[-1] + words
            room -= len(words)
        else:
            chunks.append(words)
            room = most - len(words)
    if len(chunks) > 1 and len(chunks[-1]) < least:
        tail = chunks.pop()
        chunks[-1] = chunks[-1] + tail
    return [" ".join(c) for c in chunks] or [""]


def split_documents(df: DataFrame, key: str = "doc_id", text: str = "text", max_words: int = 200, min_words: int = 50, sentence_aware: bool = True) -> DataFrame:
    """The rows of ``df`` once for each chunk of their text: other columns are copied, ``parent`` and ``chunk`` are added.

    Sentences stay whole where they fit (else words are counted); a last chunk of fewer than
    ``min_words`` words joins the one before.  An empty or null text gives one empty chunk.
    """
    if sentence_aware:

        @F.pandas_udf("array<string>")
        def run(part: pd.Series) -> pd.Series:
            return part.map(lambda s: _pack(list(s), max_words, min_words))

        pieces = run(sentences(F.col(text)))
    else:

        @F.pandas_udf("array<string>")
        def run(part: pd.Series) -> pd.Series:
            def cut(t):
                w = t.split()
                out = [w[i : i + max_words] for i in range(0, len(w), max_words)] or [[]]
                if len(out) > 1 and len(out[-1]) < min_words:
                    out[-2:] = [out[-2] + out[-1]]
                return [" ".join(c) for c in out]

            return part.map(cut)

        pieces = run(F.coalesce(F.col(text), F.lit("")))
    rest = [c for c in df.columns if c not in (text, "parent", "chunk")]
    return df.withColumn("_pieces", pieces).select(*rest, F.col(key).alias("parent"), F.posexplode("_pieces").alias("chunk", text))


def align_corpus(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``docs`` without the tokens that ``vocab`` (term) lacks; documents may become empty and stay."""
    side, _ = small(vocab.select("term").distinct())
    pos = docs.select("doc_id", F.posexplode("tokens").alias("pos", "term")).join(side, "term")
    new = pos.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("tokens"))
    return docs.drop("tokens").join(new, "doc_id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def export_phrases(phrases: DataFrame, delimiter: str = "_") -> DataFrame:
    """(phrase, score) in descending order of score, ties by phrase."""
    return phrases.select(F.concat_ws(delimiter, "a", "b").alias("phrase"), "score").orderBy(F.col("score").desc(), "phrase")


def idf(vocab: DataFrame, total: int) -> DataFrame:
    """(term, idf): ln(D / df)."""
    return vocab.select("term", F.log(F.lit(float(total)) / F.col("df")).alias("idf"))


def suggest_stopwords(bow: DataFrame, max_fraction: float = 0.5, max_length: int = 3, rare: int = 1) -> DataFrame:
    """(reason, term, df): too common, short, numeric, hardly alphabetic, rare."""
    v = vocabulary(bow).crossJoin(F.broadcast(bow.agg(F.count_distinct("doc_id").alias("total"))))
    numeric = F.col("term").rlike(r"^[0-9]+$")
    letters = F.length(F.regexp_replace("term", r"[^\p{L}]", ""))
    rules = {
        "common": F.col("df") > F.ceil(F.col("total") * F.lit(max_fraction)),
        "short": (F.length("term") < max_length) & ~numeric,
        "numeric": numeric,
        "nonalpha": ~numeric & (letters * 2 < F.octet_length("term")),
        "rare": F.col("df") <= rare,
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    return v.select(F.explode(reasons).alias("reason"), "term", "df")
