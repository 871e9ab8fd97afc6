"""Sources, token states and the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.__main__ import main
from corpusloom.models.dirichlet import LDA
from corpusloom.operators import text
from corpusloom.sources import corpus
from test_models import blocks


def test_line_numbers_are_physical_over_blocks(spark, tmp_path):
    lines = [("" if i % 7 == 3 else f"  line number {i} \t") for i in range(300)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    got = {r.doc_name: r.text for r in corpus.read_lines(spark, str(tmp_path / "a.txt")).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"doc_{i}": f"line number {i}" for i in range(300) if i % 7 != 3}


def test_ids_and_trimmed_columns(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one two  three\nalone\n\n")
    assert {(r.doc_name, r.text) for r in corpus.read_lines(spark, str(tmp_path / "a.txt"), True).collect()} == {("one", "two  three"), ("doc_1", "alone")}
    (tmp_path / "b.tsv").write_text("a\tl\ttext\nb\tm\t\t\nc\td\n")
    assert {r.doc_name for r in corpus.read_tsv(spark, str(tmp_path / "b.tsv")).collect()} == {"a"} and corpus.skipped_rows(spark, str(tmp_path / "b.tsv"), 3) == 2


def test_preparing_and_statistics(spark):
    d = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["a", "c"]), (3, ["a"]), (4, [])], "doc_id int, tokens array<string>")
    new, vocab, meta = corpus.prep_documents(d, d.select("doc_id"), upper_thresh=2)
    assert {r.term for r in vocab.collect()} == {"b", "c"} and {r.doc_id for r in meta.collect()} == {1, 2}
    assert tuple(corpus.corpus_stats(d).first()) == (4, 3, 6, False)
    assert {r.doc_id: r.tokens for r in text.align_corpus(d, vocab).collect()} == {1: ["b", "b"], 2: ["c"], 3: [], 4: []}


def test_sentences_stay_whole(spark):
    t = "One two three. Four five! Six? " + "long " * 12 + "end. tail words"
    d = spark.createDataFrame([(1, t, "m"), (2, None, "n")], "doc_id int, text string, meta string")
    got = [(r.parent, r.chunk, r.text, r.meta) for r in text.split_documents(d, max_words=6, min_words=3).orderBy("parent", "chunk").collect()]
    assert got[0] == (1, 0, "One two three. Four five! Six?", "m") and got[-1] == (2, 0, "", "n")
    assert [len(g[2].split()) for g in got if g[0] == 1] == [6, 6, 6, 3] and " ".join(g[2] for g in got if g[0] == 1) == " ".join(t.split())
    flat = [len(r.text.split()) for r in text.split_documents(d, max_words=8, min_words=6, sentence_aware=False).filter("parent = 1").orderBy("chunk").collect()]
    assert flat == [8, 13]
    custom = text.custom_tokens(d, lambda s: s.lower().split()).collect()
    assert len(custom[0].tokens) == 21 and custom[1].tokens == []


def test_states_round_trip(spark, tmp_path):
    d = blocks(spark, per=15)
    m = LDA(3, alpha_sum=0.3, sampler="sparse", seed=1).fit(d, iters=12, parts=2)
    m.save_state(str(tmp_path / "s"))
    n = LDA.load_state(spark, str(tmp_path / "s"))
    assert np.allclose(n.counts, m.counts) and np.allclose(n.alpha, m.alpha) and n.vocabulary == m.vocabulary
    a, b = ({(str(r.doc_id), r.topic): r.p for r in x.doc_topic().collect()} for x in (m, n))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in b)
    assert m.joint_log_likelihood() < m.log_likelihood()


def test_left_to_right_and_diagnostics(spark):
    d = blocks(spark, per=20)
    m = LDA(3, alpha_sum=0.3, seed=1, init="spectral").fit(d, iters=12, parts=2)
    e = m.evaluate(blocks(spark, per=4, seed=5).unionByName(spark.createDataFrame([(900, ["zz", "b0w1"]), (901, None)], "doc_id bigint, tokens array<string>")))
    assert e["num_oov"] == 1 and e["num_tokens"] == 145 and 7 < e["perplexity"] < 12
    rows = m.diagnostics(d, 5).collect()
    assert len(rows) == 3 and sum(r.rank1_docs for r in rows) == 60 and all(r.exclusivity > 0.9 and r.document_entropy > 2 for r in rows)
    assert m.similar_documents(0, 3).count() == 3
    s = LDA(3, alpha_sum=0.9, seed=1, optimize_interval=14, use_symmetric_alpha=True, optimize_beta=True, init="spectral").fit(d, iters=16, parts=2)
    assert np.allclose(s.alpha, s.alpha[0]) and s.alpha[0] < 0.3 and s.beta != 0.01


def test_command_line(spark, tmp_path, capsys):
    rng = np.random.default_rng(0)
    (tmp_path / "t.txt").write_text("\n".join(" ".join(f"{'ab'[i % 2]}{'xyzw'[j]}word" for j in rng.integers(0, 4, 8)) + " the" for i in range(40)))
    (tmp_path / "stop").write_text("the\n\n")
    c, m = str(tmp_path / "c"), str(tmp_path / "m")
    assert main(["preprocess", str(tmp_path / "t.txt"), c, "--stoplist", str(tmp_path / "stop")], spark) == 0
    assert main(["train", c, m, "--num-topics", "2", "--iters", "20", "--num-samples", "1", "--sample-interval", "2", "--alpha-sum", "0.2"], spark) == 0
    capsys.readouterr()
    main(["show", "--topic-word", f"{m}/topic_word", "--words", "3", "--doc-topic", f"{m}/doc_topic", "--doc-topics", "1"], spark)
    out = capsys.readouterr().out.strip().split("\n")
    assert len(out) == 42 and {len({w[0] for w in line.split("\t")[1].split()}) for line in out[:2]} == {1}
    main(["analyze", c, "--max-doc-fraction", "0.3"], spark)
    assert "common" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["nothing"], spark)


def test_small_text_helpers(spark):
    p = spark.createDataFrame([("a", "b", 2.0), ("c", "d", 9.0)], "a string, b string, score double")
    assert [tuple(r) for r in text.export_phrases(p).collect()] == [("c_d", 9.0), ("a_b", 2.0)]
    v = spark.createDataFrame([("a", 2)], "term string, df int")
    assert abs(text.idf(v, 8).first()["idf"] - np.log(4)) < 1e-12 and "the" in text.ENGLISH_STOPWORDS
    assert spark.createDataFrame([("A b. C",)], "t string").select(F.size(text.sentences(F.col("t")))).first()[0] == 2
