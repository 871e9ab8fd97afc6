"""What the estimators share: encoded documents, top words, frames of phi and theta."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import cut
from ..operators.text import counted, repeated
from .engine import bags, packed_bags, sums_over

#: Greatest number of cells topics x words that may be sent to every task.
MOST_CELLS = 50_000_000


class Encoded:
    """Documents as term counts: ``docs`` (doc_id, bag BINARY, see ``engine.packed_bags``) and the vocabulary in order."""

    def __init__(self, docs: DataFrame, min_doc_freq: int = 1, max_doc_fraction: float = 1.0, parts: int | None = None):
        self.spark: SparkSession = docs.sparkSession
        self._ids = docs.select("doc_id")
        if repeated(docs):
            # rows of one id are one document
            docs = docs.filter("tokens is not null").groupBy("doc_id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
        tally = cut(counted(docs.select(F.col("doc_id").isNull().alias("class"), "tokens")))
        total = tally.filter("term is null and class = 'false'").agg(F.sum("df")).first()[0] or 0
        # the vocabulary of a topic model is K x V on every task anyway; its size is checked in fit
        sums = tally.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
        kept = cut(sums.filter((F.col("df") >= min_doc_freq) & (F.col("df") <= math.ceil(total * max_doc_fraction))).select("term"))
        if kept.count() > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} words; prune the vocabulary")
        self.terms = [r.term for r in kept.orderBy("term").collect()]
        held, v = self.spark.sparkContext.broadcast(self.terms), max(1, len(self.terms))

        def encode(batches):
            known = pa.array(held.value, pa.string())
            for b in batches:
                lists = b.column("tokens")
                per = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                code = pc.index_in(lists.flatten(), known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                cell, n = np.unique((np.repeat(np.arange(len(per)), per) * v + code)[code >= 0], return_counts=True)
                cells = np.bincount(cell // v, minlength=len(per))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(pa.array(cells > 0)), packed_bags(cell % v, n, cells[cells > 0])], names=["doc_id", "bag"])

        bag = docs.select("doc_id", "tokens").mapInArrow(encode, f"doc_id {dict(docs.dtypes)['doc_id']}, bag binary")
        parts = parts or self.spark.sparkContext.defaultParallelism
        # a fixed number of partitions by key, so that the same seed gives the same fit
        self.docs = cut(bag.repartition(parts, "doc_id").sortWithinPartitions("doc_id"))
        self.parts = parts

    def frequencies(self) -> np.ndarray:
        """Tokens of every word."""
        v = len(self.terms)

        def part(b):
            _, w, n = bags(b)
            return np.bincount(w, n, v)

        return sums_over(self.docs, ["bag"], part, v)

    def wordless(self) -> DataFrame:
        """(doc_id): documents without a kept word, null and empty ones included."""
        return self._ids.distinct().join(self.docs.select(F.col("doc_id").alias("kept")), F.col("doc_id").eqNullSafe(F.col("kept")), "left_anti")

    def all_docs(self) -> DataFrame:
        """``docs`` with an empty bag for every document without a kept word."""
        empty = self.wordless().withColumn("bag", F.lit(bytearray()))
        return cut(self.docs.unionByName(empty).repartition(self.parts, "doc_id").sortWithinPartitions("doc_id"))

    def check(self, topics: int) -> None:
        if topics * len(self.terms) > MOST_CELLS:
            raise ValueError(f"{topics} topics x {len(self.terms)} words exceed {MOST_CELLS} cells; prune the vocabulary")


def phi_frame(spark: SparkSession, phi: np.ndarray, terms: list[str]) -> DataFrame:
    """(topic, term, prob)."""
    k, v = phi.shape
    # columns go over as Arrow, cell by cell of K x V, which Encoded.check bounds
    words = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(v, dtype=np.int32), k)), pa.array(list(terms)[:v], pa.string())).dictionary_decode() if v else pa.array([], pa.string())
    return spark.createDataFrame(pa.table({"topic": pa.array(np.repeat(np.arange(k, dtype=np.int32), v)), "term": words, "prob": pa.array(np.ascontiguousarray(phi, float).ravel())}))


def top_words(phi: np.ndarray, terms: list[str], n: int = 10) -> list[list[tuple[str, float]]]:
    """The n most probable words of every topic; of equal ones the earlier word."""
    return [[(terms[w], float(row[w])) for w in np.lexsort((np.arange(len(row)), -row))[:n]] for row in phi]


class TopicModel:
    """What every fitted model offers: topics, top words, names, shares of other documents, saving."""

    family = "none"
    topic_names: list[str] | None = None
    converged: bool | None = None

    def _encoded(self, enc: Encoded) -> None:
        self.vocabulary, self.spark = enc.terms, enc.spark

    def phi(self) -> DataFrame:
        """(topic, term, prob)."""
        return phi_frame(self.spark, self.topic_word, self.vocabulary)

    def top_words(self, n: int = 10, topic: int | None = None):
        t = top_words(self.topic_word, self.vocabulary, n)
        return t if topic is None else t[topic]

    def set_topic_names(self, names: list[str]) -> None:
        if len(names) != len(self.topic_word):
            raise ValueError("one name a topic")
        self.topic_names = list(names)

    def transform(self, docs: DataFrame, iters: int = 30) -> DataFrame:
        """(doc_id, topic, p) of other documents with the fitted topics."""
        from .dirichlet import fixed_topics

        k = len(self.topic_word)
        a = getattr(self, "alpha", None)
        return fixed_topics(docs, self.topic_word, self.vocabulary, a if a is not None and np.shape(a) == (k,) else np.full(k, 0.1), iters)

    def save(self, path: str) -> None:
        """Arrays and settings as Parquet rows (name, kind, value), beside the class in ``metadata``; documents' state is left out."""
        import json
        import pickle

        keep = {k: v for k, v in vars(self).items() if k not in ("spark",) and not isinstance(v, DataFrame)}
        rows = [(k, bytearray(pickle.dumps(v))) for k, v in sorted(keep.items())]
        self.spark.createDataFrame(rows, "name string, value binary").write.mode("overwrite").parquet(f"{path}/state")
        self.spark.createDataFrame([(json.dumps({"class": type(self).__name__, "version": 1}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
        if hasattr(self, "_state"):
            self.doc_topic().write.mode("overwrite").parquet(f"{path}/doc_topic")

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        import json
        import pickle

        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        if meta["class"] != cls.__name__:
            raise ValueError(f"{path} holds a {meta['class']}, not a {cls.__name__}")
        m = cls.__new__(cls)
        for r in spark.read.parquet(f"{path}/state").collect():
            setattr(m, r["name"], pickle.loads(bytes(r["value"])))
        m.spark = spark
        try:
            theta = spark.read.parquet(f"{path}/doc_topic")
            m.doc_topic = lambda: theta
        except Exception:  # noqa: BLE001  a model without documents' shares
            pass
        return m
