"""The training-data operators against brute force and on awkward rows."""

import itertools
from collections import Counter
from datetime import datetime
from fractions import Fraction

import numpy as np
import pytest

from corpusloom.llm import leaks, neardup, pairs, residue
from corpusloom.llm.clusters import hashed_features, similarity_clusters, typical_members
from corpusloom.llm.components import components
from corpusloom.llm.frequency import marked_words, word_frequencies
from corpusloom.llm.mixture import mix_plan, mix_sources, pfair
from corpusloom.llm.similar import similar_vectors
from corpusloom.llm.topn import top_items
from corpusloom.llm.trie import self_join

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
CORPUS = "doc_id bigint, tokens array<int>, loaded_at timestamp, word string"


def corpus(spark, rows):
    """With an extra column whose name clashes with inner names."""
    return spark.createDataFrame([(d, t, s, "x") for d, t, s in rows], CORPUS)


def vocab(spark, terms):
    return spark.createDataFrame([(i, t, "x") for i, t in terms], "term_id int, term string, df string")


def brute_pairs(docs, least=10):
    docs = {d: Counter(w) for d, w in docs.items() if len(w) >= least}
    out = set()
    for a, b in itertools.combinations(sorted(docs), 2):
        low, high = docs[a] & docs[b], docs[a] | docs[b]
        if sum(low.values()) * 10 >= 8 * sum(high.values()):
            out.add((a, b))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    docs, rows = {}, []
    for i in range(60):
        base = list(rng.integers(0, 90, rng.integers(8, 60)))
        for j in range(rng.integers(1, 5)):
            w = base.copy()
            for _ in range(rng.integers(0, max(1, len(w) // 6) + 1)):
                w[rng.integers(len(w))] = int(rng.integers(0, 90))
            rng.shuffle(w)
            docs[10 * i + j] = [int(x) for x in w]
    for d, w in docs.items():
        rows += [(d, [1, 2], T0), (d, [*w, None, 999], T1)]
    rows += [(9001, None, T0), (9002, [], T0), (None, [1] * 20, T0), (9003, [5] * 4, None)]
    args = corpus(spark, rows), vocab(spark, [(i, f"w{i}") for i in range(90)])
    for hot in (16384, 4):  # the second splits nearly every element
        links, members = neardup.near_duplicates(*args, hot_rows=hot)
        got = [tuple(r) for r in neardup.duplicate_pairs(links, members).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_pairs(docs)
    groups = neardup.duplicate_groups(links, members).collect()
    assert {r.doc_id for r in groups} == {x for p in brute_pairs(docs) for x in p}


def test_near_duplicates_of_nothing(spark):
    links, members = neardup.near_duplicates(corpus(spark, []), vocab(spark, []))
    assert neardup.duplicate_pairs(links, members).count() == 0
    assert neardup.duplicate_groups(links, members).count() == 0


def test_trie_join_finds_all_within_budget():
    rng = np.random.default_rng(2)
    sk = rng.integers(0, 256, (300, 4)).astype(np.uint8)
    sk[150:] = sk[:150] ^ np.packbits(rng.random((150, 32)) < 0.05, axis=1)
    head = rng.integers(0, 2, 300)
    head[150:] = head[:150]
    budget = lambda a, b: (a + b) / 2
    got = set()
    for i, j in self_join(head, sk, budget, np.full(300, 4), most=1000):
        got |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a, b in itertools.combinations(range(300), 2) if head[a] == head[b] and np.unpackbits(sk[a] ^ sk[b]).sum() <= 4}
    assert got == want


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (None, 3)], "a bigint, b bigint")
    assert {tuple(r) for r in components(links).collect()} == {(i, 1) for i in range(1, 6)} | {(8, 8), (9, 8)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a bigint, b bigint")
    assert {r.root for r in components(chain).collect()} == {0}


def test_word_frequencies_and_marks(spark):
    rows = [(1, [1, 2, 2, None, 77], T0), (1, [1, 1, 3], T1), (2, [2, 4], T0), (3, None, T0), (4, [77], T0), (5, [], T0), (2, [2, 4], T0)]
    v = vocab(spark, [(1, "Ab"), (2, "cd"), (3, " ab "), (4, "é"), (5, "never"), (6, None)])
    got = {r.word: (r.total_freq, r.doc_freq) for r in word_frequencies(corpus(spark, rows), v).collect()}
    assert got == {"ab": (3, 1), "cd": (1, 1), "é": (1, 1)}
    o = spark.createDataFrame([("a", 2, 1.0), ("b", 0, 0.0), ("n", None, None), ("nan", None, float("nan"))], "option_set string, min_doc_freq int, max_doc_fraction double")
    marks = {(r.option_set, r.word, r.mark) for r in marked_words(corpus(spark, rows), v, o).collect()}
    assert marks == {("a", w, "rare") for w in got} | {("b", w, "common") for w in got}
    assert marked_words(corpus(spark, []), v, o).count() == 0


@pytest.mark.parametrize("hot", [100_000, 5])
def test_top_items(spark, hot):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(i), float(rng.integers(0, 5)), T0, "x") for g in (0, 1, 2) for i in range(40 if g == 0 else 6)]
    rows += [(0, 3, 9.0, T1, "y"), (0, 4, None, T1, "y"), (0, 5, float("nan"), T1, "y"), (None, 1, 3.0, T0, "y"), (2, None, 3.0, T0, "y"), (0, 3, 9.0, T1, "y"), (3, 1, -0.0, T0, "z"), (3, 0, 0.0, T0, "z")]
    df = spark.createDataFrame(rows, "topic int, item int, weight double, at timestamp, place string")
    last = {}
    for g, i, w, t, _ in rows:
        if g is not None and i is not None and ((g, i) not in last or last[g, i][0] <= t):
            last[g, i] = (t, w)
    want = set()
    for g in range(4):
        rank = sorted((-w, i) for (h, i), (_, w) in last.items() if h == g and w is not None and w == w)[:10]
        want |= {(g, i, p + 1) for p, (_, i) in enumerate(rank)}
    got = [(r.topic, r.item, r.place) for r in top_items(df, ["topic"], "item", "weight", "at", 10, hot, 1000 if hot > 5 else 10**9).collect()]
    assert sorted(got) == sorted(want)
    assert top_items(df.limit(0), ["topic"], "item", "weight").count() == 0


def planted(n_groups=30, size=12, noise=150, seed=4):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(n_groups, 64))
    x = np.concatenate([np.repeat(c, size, 0) + 0.35 * rng.normal(size=(n_groups * size, 64)), rng.normal(size=(noise, 64))]).astype(np.float32)
    x = x[rng.permutation(len(x))] * rng.uniform(0.5, 3, (len(x), 1)).astype(np.float32)
    x[7] = x[3]
    return x


def table(spark, x):
    rows = [(i, [float(a) for a in v], "x") for i, v in enumerate(x)]
    rows += [rows[0], (900001, None, ""), (900002, [0.0] * 64, ""), (900003, [1.0] * 63, ""), (900004, [float("nan")] * 64, ""), (None, [1.0] * 64, ""), (900005, [None] * 64, "")]
    return spark.createDataFrame(rows, "doc_id bigint, vec array<float>, key string")


@pytest.mark.parametrize("shard", [100_000, 120])
def test_similar_vectors_recall(spark, shard):
    x = planted()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:5] if s[i, j] >= 0.8}
    rows = similar_vectors({"doc": (table(spark, x), "doc_id")}, min_similarity=0.8, shard_rows=shard, margin=0.2).collect()
    got = {(r.key, r.other) for r in rows}
    assert len(rows) == len(got) and len(got & want) / len(want) > 0.95 and (3, 7) in got and (7, 3) in got
    assert all(abs(r.similarity - s[r.key, r.other]) <= 1.01e-6 for r in rows)
    assert similar_vectors({"doc": (table(spark, x[:8]).limit(0), "doc_id")}).count() == 0


def test_similar_vectors_of_copies(spark):
    v = [float(i + 1) for i in range(64)]
    df = spark.createDataFrame([(i, v) for i in range(9)], "doc_id bigint, vec array<float>")
    got = {(r.key, r.other) for r in similar_vectors({"d": (df, "doc_id")}).collect()}
    assert got == {(i, j) for i in range(9) for j in [k for k in range(9) if k != i][:5]}


@pytest.mark.parametrize("cell,block", [(2048, 6144), (64, 40)])
def test_clusters_equal_brute_force(spark, cell, block):
    x = planted()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.78
    root = np.arange(len(x))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    size = Counter(root.tolist())
    want = {(int(r), i) for i, r in enumerate(root) if size[int(r)] >= 5}
    c = similarity_clusters(table(spark, x), cell_rows=cell, block_rows=block, margin=0.3)
    rows = c.collect()
    assert {(r.cluster_key, r.member) for r in rows} == want and len(rows) == len(want)
    assert all(r.size == size[r.cluster_key] for r in rows)
    best = typical_members(c, 2).collect()
    assert len(best) == 2 * len({r.cluster_key for r in rows})
    assert similarity_clusters(table(spark, x[:8]).limit(0)).count() == 0


def test_hashed_features(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, None), (4, ["c", None])], "k bigint, t array<string>")
    got = {r.key: r.vec for r in hashed_features(d, "k", "t", 8).collect()}
    assert set(got) == {1, 2, 4} and got[1] == got[2] and len(got[4]) == 8


def test_item_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    baskets = [set(rng.integers(0, 30, rng.integers(1, 9)).tolist()) | ({40, 41} if rng.random() < 0.2 else set()) | {50} for _ in range(200)]
    rows = [(i, int(w)) for i, b in enumerate(baskets) for w in b] + [(0, 50), (None, 1), (1, None)]
    df = spark.createDataFrame(rows, "basket bigint, item int")
    n = Counter(w for b in baskets for w in b)
    n2 = Counter(p for b in baskets for p in itertools.combinations(sorted(b), 2))
    for least, limit in ((8, 0.6), (3, None), (2, 0.2)):
        want = set()
        for (a, b), k in n2.items():
            v = 1.0 if k == 200 else np.log(k * 200 / (n[a] * n[b])) / -np.log(k / 200)
            if k >= least and (limit is None or v >= limit):
                want.add((a, b, k))
        rows_ = pairs.item_pairs(df, least, limit).collect()
        got = {(min(r.item_a, r.item_b), max(r.item_a, r.item_b), r.n_ab) for r in rows_}
        assert got == want and len(rows_) == len(want)
    top = max(rows_, key=lambda r: -r.ln_p)
    assert {top.item_a, top.item_b} == {40, 41} and top.q < 1e-6
    assert pairs.item_pairs(df.limit(0)).count() == 0


def test_null_honours_degrees_and_tail_is_near_exact():
    k, nk, f, nf = np.array([2.0, 5, 9]), np.array([30.0, 50, 20]), np.array([3.0, 20, 45]), np.array([20.0, 11, 6])
    f *= (k * nk).sum() / (f * nf).sum()
    p = pairs.fit_null(k, nk, f, nf)
    assert np.allclose(p @ nf, k, rtol=1e-5) and np.allclose(nk @ p, f, rtol=1e-5)
    q = (p[:, 1] * p[:, 2])[None]
    exact = np.array([1.0])
    for a, c in zip(q[0], nk.astype(int)):
        for _ in range(c):
            exact = np.convolve(exact, [1 - a, a])
    for n in (8, 12, 20):
        mean, ln = pairs.tail(q, nk, np.array([float(n)]))
        if n > mean[0]:
            assert abs(ln[0] - np.log(exact[n:].sum())) < 0.15


def test_leaks_exact_and_edited(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 7))
    items = [[word() for _ in range(40)] for _ in range(20)]
    docs, whole, edited = [], set(), set()
    for i, it in enumerate(items):
        s = int(rng.integers(0, 20))
        filler = [word() for _ in range(30)]
        docs.append((i, ", ".join(filler[:15]) + " " + " ".join(w.upper() for w in it[s : s + 12]) + ".\n" + " ".join(filler[15:])))
        whole.add((i, i))
        part = it[s : s + 20]
        part[10] = word()
        docs.append((100 + i, " ".join(filler[:9] + part)))
        edited.add((100 + i, i))
        docs.append((200 + i, " ".join(filler + it[:11])))
    docs += [(900, None), (901, ""), (902, "​" + "x " * 5000), (None, docs[0][1])]
    d = spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id bigint, text string, item string")
    e = spark.createDataFrame([(i, " ".join(w), "z") for i, w in enumerate(items)] + [(50, None, ""), (51, "too short", "")], "item_id bigint, text string, doc string")
    got = leaks.find_leaks(d, e).collect()
    assert {(r.doc, r.item) for r in got if r.edits == 0} == whole
    hit = {(r.doc, r.item) for r in got if r.edits == 1}
    assert len(hit & edited) >= 0.9 * len(edited)
    small_blocks = leaks.find_leaks(d, e, block_words=300).collect()
    assert {tuple(r) for r in small_blocks} == {tuple(r) for r in got}
    assert leaks.find_leaks(d.limit(0), e).count() == 0 and leaks.find_leaks(d, e.limit(0)).count() == 0


def test_edit_distance():
    a = np.array([[1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [1, 2, 3, 4, 5]])
    b = np.array([[1, 2, 3, 4, 5], [1, 9, 3, 4, 5], [9, 1, 2, 3, 4]])
    assert leaks.edits(a, b, 2).tolist() == [0, 1, 2] and leaks.edits(a, b, 1).tolist() == [0, 1, 2]


def test_pfair_keeps_every_prefix_within_one_block():
    w = {"a": Fraction(1, 2), "b": Fraction(1, 3), "c": Fraction(1, 6)}
    out = pfair(w, {"a": 300, "b": 200, "c": 100})
    assert Counter(out) == {"a": 300, "b": 200, "c": 100}
    seen = Counter()
    for t, s in enumerate(out, 1):
        seen[s] += 1
        assert all(abs(seen[x] - w[x] * t) < 1 for x in w)


def test_mixture(spark):
    text = "one two three four five "
    rows = [(i, text * 4, " Big" if i % 2 else "big ") for i in range(80)] + [(100 + i, text * 4, "small") for i in range(10)] + [(200, None, "big"), (201, text, None), (202, text, "other"), (203, "", "small")]
    d = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, source string, tokens string")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    plan = {r.source: r for r in mix_plan(d, t).collect()}
    assert not plan["big"].short and plan["small"].short and plan["none"].short
    assert plan["small"].drawn == 2 * plan["small"].tokens and plan["none"].tokens == 0
    assert abs(sum(r.share for r in plan.values()) - 1) < 1e-9
    mix = mix_sources(d, t).collect()
    assert Counter((r.source, r.use) for r in mix if r.source == "small") == {("small", 1): 10, ("small", 2): 10}
    drawn = sum(r.tokens for r in mix if r.source == "big")
    assert plan["big"].wanted <= drawn < plan["big"].wanted + max(r.tokens for r in mix)
    assert max(r.use for r in mix) <= 2 and mix_sources(d, t.limit(0)).count() == 0 and mix_plan(d.limit(0), t).filter("short").count() == 0


RESIDUE = [
    "Dear {{ first_name }}, your order is ready.", "Hello ${name}", "<%= title %> and more", "Last updated: %DATE%", "[INSERT COMPANY]", "Text [NAME HERE]", "[TBD: city]", "@@user@@", "__TITLE__",
    "Dear *|FNAME|*", "XXXX_CITY_XXXX", "<<name>>", "<your name here>", "{% block city %}", "#{email}", "Welcome back, [object Object]!", "Hola {nombre}:", "[[order_number]]", "&lt;date&gt; was it",
    "Lorem ipsum dolor sit amet", "vitae cursus purus libero augue massa porta", "Text goes here.", "Blindtext zum Füllen", "asdf asdf qwer", "blah blah blah", "Aquí va el texto.",
    "404 Not Found", "HTTP/1.1 502 Bad Gateway", "Error 503: Service Unavailable", "Oops! The page you are looking for does not exist.", "Zugriff verweigert.", "Votre session a expiré.",
    "<noscript>This app needs scripts to run.</noscript>", "Please enable Java­Script to view this page.", "Active JavaScript para ver esta página.", "x\r\nPLEASE ENABLE JAVASCRIPT TO VIEW THIS PAGE.",
]
REAL = [
    "In the template we write \"{{topic}}\" and fill it at the end.", "Placeholder tokens such as `${label}` distort the counts.", "The pair {noise, vineyard} is counted once.", "Unknown words are mapped to <unk>.",
    "```\n{{ name }}\n{% block x %}\n```\nThis tutorial shows Jinja.", "A topic with the words lorem and ipsum shows drafts.", "About 30 pages answered with code 404 and were skipped.", "The panel is drawn without JavaScript.",
    "Users asked whether \"please enable JavaScript\" pages should be dropped.", "Access to the 3 boxes was denied by the archive.", "The loader logged 'fetch shard 3: 503, retried' and went on.", "iter 404 ll -3.5",
    "Scripts under bin/ are required to rebuild table 3.", "Removing 50% of words and 30% more", "see note [12] and [sic]", "", "   ",
]


def test_residue(spark):
    for t in RESIDUE:
        assert residue.find_residue(t), t
    for t in REAL:
        assert not residue.find_residue(t), t
    rows = [(i, t, "a") for i, t in enumerate(RESIDUE)] + [(1000 + i, t, "b") for i, t in enumerate(REAL)] + [(5000, None, "c"), (None, RESIDUE[0], "c"), (5001, "word " * 200_000 + RESIDUE[0], "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kinds string")
    got = residue.template_residue(df).collect()
    assert {r.doc_id for r in got} == {*range(len(RESIDUE)), 5001} and all(0 < r.share <= 1 for r in got)
    assert residue.template_residue(df.limit(0)).count() == 0


def test_residue_far_from_code_is_kept():
    code = "```\n${A}\n\n${B}\n${C} ${D}\n```"
    assert [h[0] for h in residue.find_residue(f"Dear {{{{ first_name }}}}, hello.\n\nLater in the thread:\n{code}\nDone.")] == ["placeholder"]
    assert not residue.find_residue(f"First paragraph.\n\nPut {{{{ first_name }}}} there:\n{code}\nDone.")


def test_residue_in_mixed_case():
    for t in ["Dear [Your Name], hello.", "On [Insert date] we met.", "Sign: <Your Name>", "Dear %first_name%, hello", "Text [Name Here]", "City: [Tbd]"]:
        assert "placeholder" in [h[0] for h in residue.find_residue(t)], t
    for t in ["Read [click here](https://a.example) now.", "as shown [see here]", "In the template we write [Your Name].", "Removing 50% of words and 30% more", "Use `%first_name%` once."]:
        assert not residue.find_residue(t), t


def test_leaks_with_a_word_inserted_or_left_out(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 7))
    items = [[word() for _ in range(18)] for _ in range(40)]
    docs = []
    for i, it in enumerate(items):
        # the unbroken runs stay under 11 words; the passage also ends the document
        docs.append((i, " ".join([word() for _ in range(9)] + it[:9] + [word()] + it[9:])))
        docs.append((100 + i, " ".join([word() for _ in range(9)] + it[:9] + it[10:])))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    got = leaks.find_leaks(d, e).collect()
    assert all(r.doc % 100 == r.item and r.edits == 1 for r in got)
    for base in (0, 100):
        assert sum(base <= r.doc < base + 100 for r in got) >= 36


def test_end_free_edit_distance():
    a = np.array([[1, 2, 3, 4]] * 5)
    b = np.array([[1, 2, 3, 4, 9], [1, 9, 2, 3, 4], [1, 2, 4, 9, 9], [1, 2, 9, 4, 9], [9, 8, 3, 4, 9]])
    assert leaks.edits_free(a, b, 1).tolist() == [0, 1, 1, 1, 2]


def test_lookup_tables_that_are_joined_give_the_same(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [int(x) for x in rng.integers(0, 60, 25)] + [None, 777], T0) for i in range(40)]
    rows += [(100 + i, rows[i][1][::-1], T0) for i in range(10)] + [(200, None, T0), (201, [], T0)]
    args = corpus(spark, rows), vocab(spark, [(i, f"w{i % 50}") for i in range(60)])
    for f in (lambda n: word_frequencies(*args, limit=n), lambda n: neardup.duplicate_pairs(*neardup.near_duplicates(*args, limit=n)), lambda n: pairs.word_pairs(*args, 5, None, limit=n).select("term_a", "term_b", "n_ab", "n_a", "n_b")):
        sent, joined = ({tuple(r) for r in f(n).collect()} for n in (10**6, 0))
        assert sent == joined and sent


def test_copies_of_a_large_class_meet_in_blocks(spark):
    members = spark.createDataFrame([(i, 0) for i in range(40)] + [(50, 50), (60, 60)], "doc_id bigint, class_id bigint")
    links = spark.createDataFrame([(0, 50, 0.9)], "a bigint, b bigint, similarity double")
    got = [tuple(r) for r in neardup.duplicate_pairs(links, members, block_rows=7).collect()]
    assert len(got) == len(set(got)) and set(got) == set(itertools.combinations(range(40), 2)) | {(i, 50) for i in range(40)}


def test_surprise_selects_pairs_of_common_items(spark):
    rng = np.random.default_rng(12)
    # items 0 and 1 each in about a third of the baskets, mostly together: no NPMI bound would name them
    rows = []
    for i in range(600):
        b = set(rng.integers(5, 40, 6).tolist()) | ({0, 1} if rng.random() < 0.2 else set()) | ({0} if rng.random() < 0.2 else set()) | ({1} if rng.random() < 0.2 else set())
        rows += [(i, int(w)) for w in b]
    df = spark.createDataFrame(rows, "basket bigint, item int")
    top = {frozenset((r.item_a, r.item_b)) for r in pairs.item_pairs(df, 8, None, 0.01).collect()}
    assert frozenset((0, 1)) in top and len(top) <= 3
    assert frozenset((0, 1)) not in {frozenset((r.item_a, r.item_b)) for r in pairs.item_pairs(df, 8, 0.6).collect()}


def test_record_clusters_name_what_is_nearest_the_centroid(spark):
    from corpusloom.llm.clusters import record_clusters

    x = planted(3, 20, 0, seed=2)
    rows = record_clusters(table(spark, x), "doc_id", count=3).collect()
    assert sum({r.cluster: r.size for r in rows}.values()) == len(x) and len(rows) == 9
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for c in range(3):
        best = [r.member for r in sorted(rows, key=lambda r: r.place) if r.cluster == c]
        assert (u[best[0]] @ u[best[1:]].T >= 0.7).all()
    assert record_clusters(table(spark, x[:8]).limit(0), "doc_id").count() == 0


def test_mix_report_equals_the_plan(spark):
    from corpusloom.llm.mixture import mix_report

    d = spark.createDataFrame([(i, "one two three four " * 5, "big") for i in range(60)] + [(100 + i, "one two three four " * 5, "small") for i in range(5)], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    plan, report = ({r.source: r for r in f(d, t).collect()} for f in (mix_plan, mix_report))
    assert {s: r.short for s, r in plan.items()} == {s: r.short for s, r in report.items()}
    assert report["small"].reached == plan["small"].available and report["none"].reached == 0


OTHER_RESIDUE = ["[First Name]", "[Company Name]", "Hi {{ user['name'] }},", "<?php echo $title; ?>", "Dear %(name)s,", "Page not found", "Page non trouvée", "Die Seite konnte nicht gefunden werden.", "Internal Server Error", "Sie müssen JavaScript aktivieren", "Vous devez activer JavaScript", "Maecenas sed diam eget risus varius"]


def test_residue_of_other_spellings():
    for t in OTHER_RESIDUE:
        assert residue.find_residue(t), t
    for t in ["Set ${HOME} before you run the job.", "We saw 404 not found errors in 3% of the crawl.", "He wrote “" + "a long passage " * 30 + "{{ name }} and more” there."]:
        assert not residue.find_residue(t), t


def test_search_looks_again_only_at_new_nodes():
    """p4_found: a hop read and wrote its scratch for every neighbour, nodes met before included."""
    from corpusloom.llm.graph import Graph, search

    class Counted(np.ndarray):
        reads = 0

        def __getitem__(self, at):
            got = super().__getitem__(at)
            Counted.reads += np.size(got)
            return got

    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g, q = Graph(x, 12, 20), x[:50]
    mark = np.zeros((50, 900), np.int16).view(Counted)
    ids, sims = search(x, g.links, q, g._entries(q), 20, mark)
    met = int((mark.view(np.ndarray) > 0).sum())
    # NumPy counts the clearing of the scratch as one read of it
    assert Counted.reads <= mark.size + 2 * met
    exact = np.argsort(-(q @ x.T), 1)[:, :5]
    assert np.mean([len(set(a) & set(b[:5])) for a, b in zip(exact, ids)]) > 4.5
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in ids) and np.allclose(sims, (x[ids] * q[:, None]).sum(2), atol=1e-5)
