"""Hand-computed cases and brute force on small frames."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.operators import agreement as G
from corpuscope.operators import annotate as A
from corpuscope.operators import classify as M
from corpuscope.operators import compare as S
from corpuscope.operators import corpus as C
from corpuscope.operators import embedding as E
from corpuscope.operators import lasso as X
from corpuscope.operators import pca as P
from corpuscope.operators import similarity, spectral
from corpuscope.operators import tables as V
from corpuscope.operators import tokens as K
from corpuscope.operators import vocab as B
from corpuscope.operators.scale import hash_rank, join_by_frequency, running_total


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_entropy(spark):
    dtm = spark.createDataFrame(
        [("a", "t", 1), ("b", "t", 1), ("c", "u", 7), ("d", "v", 1)], "d string, w string, n long"
    )
    scores = {r.w: r for r in B.entropy_scores(dtm, "d", "w").collect()}
    t = scores["t"]
    assert (t.H, t.dH) == (pytest.approx(1), pytest.approx(1))
    assert t.ndH == pytest.approx(math.log10(2))
    assert scores["u"].H == 0.0
    assert [r.w for r in B.vocabulary(B.entropy_scores(dtm, "d", "w"), "w").collect()] == ["t"]


def test_top_and_bottom_keeps_ties(spark):
    df = spark.createDataFrame([(3,), (3,), (2,), (1,)], "v int")
    both = V.top_and_bottom(df, "v", 1)
    assert rows(both, "side", "v") == [("bottom", 1), ("top", 3), ("top", 3)]
    assert V.top_and_bottom(df, "v", 4).count() == 8


@pytest.mark.parametrize("lowest", [False, True])
def test_long_top_list_keeps_ties(spark, lowest):
    df = spark.range(4000).select((F.col("id") / 3).cast("int").alias("v"))
    got = sorted(r.v for r in V.top_n(df, "v", 1500, lowest=lowest).collect())
    values = sorted((i // 3 for i in range(4000)), reverse=not lowest)
    edge = values[1499]
    assert got == sorted(v for v in values if (v <= edge if lowest else v >= edge))


def test_alpha_of_one_value_is_null(spark):
    df = spark.createDataFrame([("1", "y"), ("1", "y")], "comment_id string, support string")
    assert G.krippendorff_alpha(df).first().alpha is None


def test_alpha(spark):
    codes = ["yyyy", "nnnn", "yynn"]
    long = [(str(i), c) for i, unit in enumerate(codes) for c in unit]
    long += [("single", "y"), ("0", None)]
    df = spark.createDataFrame(long, "comment_id string, support string")
    assert G.krippendorff_alpha(df).first().alpha == pytest.approx(1 - 11 * (8 / 3) / 72)


def test_modes_and_manual_coding(spark):
    sheets = [
        (coder, cid, "u" + cid, code, None)
        for cid, given in {"1": "yynn", "2": "yyyy", "3": "nNny"}.items()
        for coder, code in zip("abcd", given)
    ]
    df = spark.createDataFrame(
        sheets, "coder string, comment_id string, url string, support string, notes string"
    )
    coding = G.coding_table(df, list("abcd"))
    found = {r.comment_id: (list(r.mode), r.identical) for r in coding.collect()}
    assert found == {"1": (["y", "n"], False), "2": (["y"], True), "3": (["n"], False)}
    manual = {r.comment_id: r.support for r in G.load_manual_coding(coding).collect()}
    assert manual == {"1": None, "2": "support", "3": "oppose"}
    assert G.load_manual_coding(coding, filter_na=True).count() == 2
    assert G.repeated_comments(coding).count() == 0
    long = V.modes(df, "comment_id", "support", "coder")
    assert {r.comment_id: list(r.mode) for r in long.collect()}["1"] == ["y", "n"]


def test_modes_count_nulls(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("a", "x", 3)], "k string, v string, o int")
    assert list(V.modes(df, "k", "v", "o").first()["mode"]) == [None]
    assert list(V.modes(df, "k", "v", "o", na_rm=True).first()["mode"]) == ["x"]


def test_noun_share_completion(spark):
    coded = spark.createDataFrame(
        [("m", "oppose", "1", "x_science", "science"), ("m", "oppose", "2", "x_health", "health")],
        "coding string, support string, comment_id string, bigram string, noun string",
    )
    assert rows(S.noun_share(coded), "comment_id", "noun", "share") == [
        ("1", "health", 0.0), ("1", "science", 1.0), ("2", "health", 1.0), ("2", "science", 0.0)
    ]


@pytest.mark.parametrize("hot", [False, True])
def test_quantiles_match_numpy(spark, hot):
    rng = random.Random(3)
    data = [("a" if hot or rng.random() < 0.5 else "b", rng.choice([1.5, 2.0, rng.random() * 50])) for _ in range(700)]
    df = spark.createDataFrame(data, "g string, v double")
    probs = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for r in V.exact_quantiles(df, "v", probs, ["g"], moments=True).collect():
        values = [v for g, v in data if g == r.g]
        assert [r[k] for k in probs] == pytest.approx(list(np.quantile(values, list(probs.values()))))
        assert (r["size"], r["mean"]) == (len(values), pytest.approx(np.mean(values)))


def test_running_total_of_one_hot_group(spark):
    df = spark.range(1000).select(F.lit("all").alias("g"), F.col("id").alias("v"), F.lit(2).alias("w"))
    got = running_total(df, "v", "w", ["g"], total="t")
    assert got.filter((F.col("cumulative") != (F.col("v") + 1) * 2) | (F.col("t") != 2000)).count() == 0


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), F.lit(None).cast("string").alias("s"))
    ranks = [r[0] for r in hash_rank(df, "k", 1, ["s"]).select("hash_rank").collect()]
    assert sorted(ranks) == list(range(1, 501))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_by_frequency_equals_join(spark, how):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(50)] + [("none", 1)], "k string, x int")
    right = spark.createDataFrame([("hot", 300, "H")] + [(f"k{i}", 1, "c") for i in range(50)], "k string, n int, v string")
    for max_hot in (1, 3, 1000):
        got = join_by_frequency(left, right, "k", "n", how, max_hot)
        assert rows(got, "k", "x", F.coalesce("v", F.lit(""))) == rows(left.join(right, "k", how), "k", "x", F.coalesce("v", F.lit("")))


def test_upsample_keeps_every_row(spark):
    df = spark.range(47).select(F.col("id").alias("k"), F.when(F.col("id") < 7, "s").otherwise("o").alias("y"))
    up = V.upsample(df, "k", "y", 1)
    assert rows(up.groupBy("y").count(), "y", "count") == [("o", 40), ("s", 40)]
    assert up.select("k").distinct().count() == 47


def test_split_is_disjoint_and_stratified(spark):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 4 == 0).alias("y"))
    split = V.stratified_split(df, "k", "y", 0.75, 9)
    assert rows(split.groupBy("y", "split").count(), "y", "split", "count") == [
        (False, "test", 75), (False, "train", 225), (True, "test", 25), (True, "train", 75)
    ]
    train = split.filter("split = 'train'").select("k")
    assert train.intersect(split.filter("split = 'test'").select("k")).count() == 0


def test_sample_fixed_large_path_equals_small(spark):
    df = spark.range(200).select("id")
    by_rank = hash_rank(df, "id", 4, out="r").filter("r <= 30").select("id")
    assert rows(by_rank, "id") == rows(V.sample_fixed(df, "id", 30, 4), "id")


# --- text ------------------------------------------------------------------------


def corpus_of(spark, *texts):
    data = [(str(i), f"{i}-0", t, 0, len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "comment_id string, doc_id string, text string, docOrder int, len int")


def test_annotation(spark):
    text = "The <b>helpful</b> new studies help. See www.epa.gov, 3.5 times!"
    got = A.annotate(corpus_of(spark, text)).orderBy("sentence_id", "token_id").collect()
    assert [(r.sentence_id, r.token, r.pos) for r in got] == [
        (1, "The", "DET"), (1, "helpful", "ADJ"), (1, "new", "NOUN"), (1, "studies", "NOUN"),
        (1, "help", "NOUN"), (1, ".", "PUNCT"), (2, "See", "NOUN"), (2, "www.epa.gov,", "X"),
        (2, "3.5", "NUM"), (2, "times", "NOUN"), (2, "!", "PUNCT"),
    ]
    assert {r.token: r.lemma for r in got}["studies"] == "study"
    heads = {(r.sentence_id, r.token_id): r.head_token_id for r in got}
    assert heads[1, 1] == 3 and heads[1, 2] == 3 and heads[2, 3] == 4 and heads[1, 6] == 6


def test_heads_agree_with_window(spark):
    docs = corpus_of(spark, *["Useful and possible. The many active old things of 5 nations are visible"] * 3)
    full = A.annotate(docs)
    again = A.assign_heads(A.tagged_tokens(docs))
    cols = ["doc_id", "sentence_id", "token_id", "lemma", "pos", "head_token_id", "dep_rel"]
    assert rows(full, *cols) == rows(again, *cols)


def test_empty_text_is_refused(spark):
    with pytest.raises(Exception, match="empty text of document"):
        A.annotate_pending(corpus_of(spark, "fine", "")).collect()


def test_pending_documents_only(spark):
    docs = corpus_of(spark, "one thing", "two things")
    done = A.annotate(docs.filter("doc_id = '0-0'"))
    assert {r.doc_id for r in A.annotate_pending(docs, done).collect()} == {"1-0"}
    assert C.annotation_coverage(docs, done).first().n_missing == 1
    assert C.unannotated(docs, done).count() == 1


def test_kwic_case_and_lines(spark):
    docs = corpus_of(spark, "abc my own health and My OWN HEALTH\nnext", "OWN HEALTH only")
    got = [r.extracts for r in C.kwic(docs, "own health", window=3).collect()]
    assert got == ["my own health an", "My OWN HEALTH"]


def test_corpus_bounds(spark):
    comments = spark.createDataFrame([("a", "x" * 100), ("b", "x" * 101), ("c", None)], "comment_id string, text string")
    assert [r.doc_id for r in C.build_corpus(comments).collect()] == ["b-0"]


def test_bigrams_are_case_sensitive(spark):
    ann = A.annotate(corpus_of(spark, "Terrible science. Terrible Science. Useful health"))
    got = rows(B.adj_noun_bigrams(ann, ["science", "health"]), "bigram", "n")
    assert got == [("terrible_science", 1), ("useful_health", 1)]


@pytest.mark.parametrize("chunk", [2, 3, 256])
def test_cooccurrence_by_brute_force(spark, chunk):
    rng = random.Random(1)
    contexts = {f"c{i}": [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))] for i in range(60)}
    expected = {}
    for ts in contexts.values():
        for pair in itertools.product(set(ts), repeat=2):
            expected[pair] = expected.get(pair, 0) + 1
    expected = {p: n for p, n in expected.items() if n > 20}
    df = spark.createDataFrame([(t, c) for c, ts in contexts.items() for t in ts], "token string, context_id string")
    got = {(r.item1, r.item2): r.n for r in E.cooccurrence(df, 20, chunk).collect()}
    assert got == expected and expected


# --- linear algebra ------------------------------------------------------------------


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(0.6, size=(12, 40))
    x[:, 3] = 1  # a column without variance
    data = [(f"b{i:02d}", f"c{j}", int(x[i, j])) for i in range(12) for j in range(40) if x[i, j]]
    return x, spark.createDataFrame(data, "bigram string, comment_id string, n long")


def standardised(x):
    keep = x.std(axis=0) > 0
    z = x[:, keep] - x[:, keep].mean(axis=0)
    return z / x[:, keep].std(axis=0, ddof=1), np.flatnonzero(keep)


def test_pca_matches_dense(spark, matrix):
    x, dtm = matrix
    z, kept = standardised(x)
    pc = P.pca(dtm, 5)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    assert pc.values == pytest.approx(s[:5] ** 2)
    assert pc.vectors.residual.max() < P.TOLERANCE
    scores = {(r.bigram, r.PC): r.value for r in P.pc_scores(spark, pc).collect()}
    for j in range(5):
        sign = np.sign(u[np.abs(u[:, j]).argmax(), j])
        assert [scores[f"b{i:02d}", j + 1] for i in range(12)] == pytest.approx(sign * u[:, j] * s[j])
    loadings = {(r.comment_id, r.PC): r.value for r in P.pc_loadings(pc).collect()}
    assert len(loadings) == 5 * len(kept)
    first = np.array([loadings[f"c{c}", 1] for c in kept])
    assert abs(first @ vt[0]) == pytest.approx(1.0)
    ev = P.explained_variance(spark, pc).orderBy("PC").collect()
    assert ev[0].std_dev == pytest.approx(s[0] / math.sqrt(11))
    assert ev[4].cumulative == pytest.approx((s[:5] ** 2).sum() / (s**2).sum())
    assert P.misses(dtm, pc).agg(F.max("off")).first()[0] < 1e-8
    gram = z @ z.T
    for r in P.cooccurrence_cells(dtm).collect():
        assert r.g == pytest.approx(gram[int(r.bigram1[1:]), int(r.bigram2[1:])])


@pytest.mark.parametrize("block", [1024, 3])
def test_gram_cells_of_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    x = np.zeros((11, 9), int)
    for j in range(8):  # most bigrams share no comment, the last one varies in none
        x[rng.choice(10, 2, replace=False), j] = rng.integers(1, 4, 2)
    x[:, 8] = 2
    data = [(f"b{i:02d}", f"c{j}", int(x[i, j])) for i, j in zip(*np.nonzero(x))]
    dtm = spark.createDataFrame(data, "bigram string, comment_id string, n long")
    z, _ = standardised(x)
    assert (z @ z.T).shape == (11, 11) and (x[:, :8] @ x[:, :8].T == 0).sum() > 60
    got = {(r.bigram1, r.bigram2): r.g for r in P.cooccurrence_cells(dtm, block=block).collect()}
    want = {(f"b{i:02d}", f"b{k:02d}"): (z @ z.T)[i, k] for i in range(11) for k in range(i, 11)}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)


def test_gram_cells_of_little(spark):
    schema = "bigram string, comment_id string, n long"
    cells = lambda data: {tuple(r) for r in P.cooccurrence_cells(spark.createDataFrame(data, schema)).collect()}
    assert cells([]) == set()
    assert cells([("a", "c", 1), ("b", "c", 1)]) == {("a", "a", 0.0), ("a", "b", 0.0), ("b", "b", 0.0)}


def test_pca_of_little(spark):
    schema = "bigram string, comment_id string, n long"
    for data in ([], [("a", "c", 1)], [("a", "c", 1), ("b", "c", 1)]):
        dtm = spark.createDataFrame(data, schema)
        pc = P.pca(dtm, 5)
        assert len(pc.values) == P.pc_scores(spark, pc).count() == P.pc_loadings(pc).count() == 0
        assert P.explained_variance(spark, pc).count() == 0
    pc = P.pca(spark.createDataFrame([("a", "c", 1), ("b", "d", 2)], schema), 5)
    assert len(pc.values) == 1 and P.explained_variance(spark, pc).first().cumulative == pytest.approx(1)


@pytest.mark.parametrize(("m", "n", "k", "centre", "edge"), [(40, 60, 5, False, 16), (31, 50, 4, True, 16), (32, 50, 4, True, 16), (8, 5, 6, False, 2048)])
def test_leading_vectors_match_dense(spark, m, n, k, centre, edge, monkeypatch):
    monkeypatch.setattr(spectral, "BLOCK", edge)
    monkeypatch.setattr(spectral, "SUMS", 1)
    monkeypatch.setattr(spectral, "ENTRIES", 7)
    rng = np.random.default_rng(m)
    a = np.where(rng.random((m, n)) < 0.2, rng.normal(size=(m, n)), 0)
    cells = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    dense = a
    if centre:
        cells += [(m, j, float(-a[:, j].mean())) for j in range(n)]
        dense = a - a.mean(0)
    blocks = spectral.Blocks.of(spark.createDataFrame(cells, "i long, j long, v double"), m + centre, n)
    found = spectral.leading_vectors(spectral.Centred(blocks) if centre else blocks, k, 4, 12, 1e-9)
    u, s, _ = np.linalg.svd(dense, full_matrices=False)
    count = len(found.values)
    assert count == min(k, (s > 1e-5 * s[0]).sum())
    assert found.values == pytest.approx(s[:count], abs=1e-6)
    got = np.zeros((m, count))
    for r in spectral.as_rows(found.left, count, m).collect():
        got[r.i] = r.vec
    assert got.T @ got == pytest.approx(np.eye(count), abs=1e-6)
    assert np.abs((got * u[:, :count]).sum(0)) == pytest.approx(np.ones(count), abs=1e-6)
    assert found.sums == pytest.approx(got.sum(0), abs=1e-8)


def test_search_finds_the_best_through_few_lists(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 6)) * 8
    points = [(f"t{i}", "A" if i % 5 else "B", [float(x) for x in middle[i % 12] + rng.normal(size=6)]) for i in range(600)]
    points += [(f"same{i}", "A", points[1][2]) for i in range(200)] + [("zero", "A", [0.0] * 6)]
    vectors = spark.createDataFrame(points, "token string, pos string, vec array<double>")
    index = similarity.Index(vectors, tile=50)
    queries = vectors.filter("token in ('t1', 't7', 't10', 'zero', 'same3')")
    got = collections.defaultdict(set)
    for r in index.search(queries, 4).collect():
        got[r.match].add(r.token)
    by = {t: (p, np.array(v)) for t, p, v in points}
    for match in ("t1", "t7", "t10", "zero", "same3"):
        like = {t: float(np.einsum("d,d->", v, by[match][1])) for t, (p, v) in by.items() if p == by[match][0]}
        floor = sorted(like.values())[-4]
        assert got[match] == {t for t, s in like.items() if s >= floor}
    # Most lists can't reach what the first ones hold.
    first = index._routed(queries, False).count()
    floors = queries.withColumn("floor", F.lit(70.0))
    assert first + index._routed(floors, True).count() < 0.7 * 5 * index.lists.filter("pos = 'A'").count()


def test_search_of_nothing(spark):
    vectors = spark.createDataFrame([], "token string, pos string, vec array<double>")
    index = similarity.Index(vectors)
    assert index.search(vectors, 3).count() == 0


def test_word_vectors_match_dense(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(9, 9))
    a = a + a.T
    names = [f"w{i}_NOUN" for i in range(9)]
    data = [(names[i], names[j], float(a[i, j])) for i in range(9) for j in range(9)]
    vectors = E.word_vectors(spark.createDataFrame(data, "item1 string, item2 string, pmi double"), 3)
    got = {r.token: np.array(r.vec) for r in vectors.collect()}
    u = np.array([got[n] for n in names])
    assert u.T @ u == pytest.approx(np.eye(3), abs=1e-6)
    dense, s, _ = np.linalg.svd(a)
    assert np.abs(np.sum(u * dense[:, :3], axis=0)) == pytest.approx(np.ones(3), abs=1e-5)


def test_variants_by_brute_force(spark):
    rng = np.random.default_rng(5)
    names = [f"{w}{i}_{p}" for i, (w, p) in enumerate(itertools.product(["scien", "heal", "law"], ["NOUN", "ADJ"] * 6))]
    vec = {n: rng.normal(size=4) for n in names}
    df = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in vec.items()], "token string, vec array<double>")
    for block in (5, 1024):
        got = {}
        for r in E.get_variants(df, "scien", 3, block=block).collect():
            got.setdefault(r.match, set()).add(r.token)
        for m in [n for n in names if "scien" in n]:
            same = [n for n in names if n.split("_")[-1] == m.split("_")[-1]]
            best = sorted(same, key=lambda n: -float(vec[n] @ vec[m]))[:3]
            assert got[m] == set(best)
    sims = [r.similarity for r in E.similar(df, names[0], normalize=True).collect()]
    assert max(sims) == pytest.approx(1.0)


# --- classification --------------------------------------------------------------------


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(8)
    words = {"oppose": ["harm", "wrong", "stop"], "support": ["good", "helpful", "agree"]}
    docs, labels = [], []
    for i in range(160):
        side = "support" if i % 8 == 0 else "oppose"
        picked = [rng.choice(words[side]) for _ in range(4)] + [f"filler{rng.randint(0, 30)}" for _ in range(6)]
        docs.append((str(i), " ".join(picked)))
        labels.append((str(i), side))
    text = spark.createDataFrame(docs, "comment_id string, text string")
    coded = spark.createDataFrame(labels, "comment_id string, support string")
    features = M.hashed_features(M.word_counts(text))
    folded = V.stratified_folds(M.with_class_weights(coded), "comment_id", "support", 3, 1)
    return text, coded, features, M.feature_vectors(folded, features).cache()


def lasso_rows(spark, trained):
    _, coded, features, _ = trained
    folded = V.stratified_folds(M.with_class_weights(coded), "comment_id", "support", 3, 1)
    return X.sparse_rows(folded.withColumn("fold", F.col("fold").cast("int")), features, M.POSITIVE).cache()


def test_lasso_path_learns_and_scores(spark, trained):
    _, coded, features, _ = trained
    rows = lasso_rows(spark, trained)
    path = X.lasso_path(rows, [1e-9, 1e-3, 1e-2, 1e-1, 1.0], M.NUM_TERMS, [0, 1, 2]).cache()
    off = X.conditions(rows, path, M.NUM_TERMS)
    assert off.filter(f"worst is null or worst > {2 * X.TOLERANCE}").count() == 0
    tuning = M.tune_lasso(rows, path)
    assert tuning.count() == 15 and M.collect_metrics(tuning).count() == 5
    table = M.best_coefficients(path, tuning)
    assert table.filter("bucket = -1").count() == 1 and table.count() <= M.NUM_TERMS + 1
    quality = M.metrics(M.augment(coded, features, table)).first()
    assert quality.bal_accuracy > 0.9 and 0 <= quality.specificity <= 1
    # Penalties beyond the end of the path share its last fit; none is left at the largest.
    ends = {r.penalty: r.fitted for r in path.filter("fold = -1").select("penalty", "fitted").distinct().collect()}
    assert ends[1e-9] > 1e-9 and ends[1e-1] == 1e-1
    assert path.filter("penalty = 1.0 AND bucket >= 0").count() == 0


def test_lasso_held_out_metrics_are_those_of_scored_rows(spark, trained):
    rows = lasso_rows(spark, trained)
    path = X.lasso_path(rows, [1e-2], M.NUM_TERMS, [0, 1, 2]).cache()
    tuning = {r.fold: r for r in M.tune_lasso(rows, path).collect()}
    for fold in (0, 1, 2):
        held = rows.filter(F.col("fold") == fold)
        cells = held.select("comment_id", F.explode(F.arrays_zip("at", "x")).alias("c")).select("comment_id", F.col("c.at").alias("bucket"), F.col("c.x").alias("sign"))
        scored = M.augment(held.select("comment_id", "support"), cells, path.filter(F.col("fold") == fold).select("bucket", "beta"))
        want = M.metrics(scored).first()
        assert [tuning[fold][m] for m in M.METRICS] == pytest.approx([want[m] for m in M.METRICS])


def test_lasso_equals_plain_proximal_gradient(spark):
    rng = np.random.default_rng(5)
    n, terms = 60, 12
    x = rng.choice([-1.0, 0.0, 1.0], (n, terms), p=[0.2, 0.5, 0.3])
    y = (x[:, 0] + 0.7 * x[:, 3] + rng.normal(0, 0.8, n) > 0).astype(float)
    w = rng.choice([1.0, 2.5], n)
    data = [(str(i), float(y[i]), float(w[i]), i % 2, [int(j) for j in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] != 0]]) for i in range(n)]
    rows = spark.createDataFrame(data, "comment_id string, y double, weight double, fold int, at array<int>, x array<double>")
    found = X.lasso_path(rows, [0.15, 0.03, 0.008], terms, [0]).collect()
    for fold in (0, X.EVERY):
        use = np.arange(n) % 2 != fold if fold == 0 else np.ones(n, bool)
        xs, ys, ws = x[use], y[use], w[use] / w[use].sum()
        sd = np.sqrt(ws @ xs**2 - (ws @ xs) ** 2)
        for penalty in (0.15, 0.03, 0.008):
            b, b0, step = np.zeros(terms), 0.0, 0.2
            for _ in range(20_000):
                r = ws * (1 / (1 + np.exp(-(xs @ b + b0))) - ys)
                b0 -= step * r.sum()
                moved = b - step * (xs.T @ r)
                b = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty * sd, 0)
            got = np.zeros(terms + 1)
            for r in found:
                if r.fold == fold and r.penalty == penalty:
                    got[r.bucket + 1] = r.beta
            assert got == pytest.approx(np.concatenate([[b0], b]), abs=0.02)


def test_lasso_of_little(spark):
    schema = "comment_id string, y double, weight double, fold int, at array<int>, x array<double>"
    assert X.lasso_path(spark.createDataFrame([], schema), [0.1], 4, [0]).count() == 0
    one_class = spark.createDataFrame([("a", 1.0, 1.0, 0, [1], [1.0]), ("b", 1.0, 1.0, 1, [], [])], schema)
    assert X.lasso_path(one_class, [0.1], 4, [0, 1]).count() == 0
    both = one_class.union(spark.createDataFrame([("c", 0.0, 1.0, 1, [2], [-1.0])], schema))
    assert {r.fold for r in X.lasso_path(both, [0.1], 4, [0, 1]).collect()} == {0, X.EVERY}


def test_forest_is_fitted(spark, trained):
    _, _, _, train = trained
    got = M.augment_with_model(M.fit_forest(train, trees=5, max_depth=4), train)
    assert got.filter("pred_oppose < 0 or pred_oppose > 1").count() == 0


def test_class_weights_balance(spark, trained):
    _, coded, _, _ = trained
    sums = M.with_class_weights(coded).groupBy("support").agg(F.sum("weight").alias("w")).collect()
    assert len({round(r.w, 6) for r in sums}) == 1


def test_training_set_forces_form_letters(spark):
    text = corpus_of(spark, "a form letter", "support text", "unknown text", "other")
    coding = spark.createDataFrame([("0", "support"), ("1", "support"), ("2", None)], "comment_id string, support string")
    forms = spark.createDataFrame([("0",), ("0",)], "comment_id string")
    got = rows(M.training_set(text, coding, forms), "comment_id", "support")
    assert got == [("0", "oppose"), ("1", "support")]


def test_zero_variance_bucket_goes(spark):
    f = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("a", 2, 1), ("b", 3, 1), ("a", 4, 1), ("b", 4, -1)], "comment_id string, bucket int, sign int")
    n = spark.createDataFrame([(2,)], "n long")
    assert {r.bucket for r in M.drop_zero_variance(f, n).collect()} == {2, 3, 4}
    assert M.penalty_grid()[0] == pytest.approx(1e-10) and len(M.penalty_grid()) == 30


def test_ranks_move_rows_once(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("s"))
    plan = hash_rank(df, "k", 1, ["s"], size="n")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" in plan
    sums = df.groupBy("s", "k").agg(F.count("*").alias("n"))
    plan = running_total(sums, "k", "n", ["s"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_equal_values_stay_in_their_tasks(spark):
    df = spark.range(0, 200_000, 1, 16).select(F.lit(7).alias("v"), (F.col("id") % 2).alias("g"))
    for by in ((), ("g",)):
        out = V.top_n(df, "v", 5, by)
        tasks = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in tasks) == 200_000 and len(tasks) == 16


def test_variants_join_blocks_by_number(spark):
    rows = [(f"w{i}_{'AB'[i % 2]}", [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [("null_A", None)]
    vectors = spark.createDataFrame(rows, "token string, vec array<double>")
    for pos in (True, False):
        found = E.get_variants(vectors, "^(w1|w2)_", 3, filter_pos=pos, block=8)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        got = collections.defaultdict(set)
        for r in found.collect():
            got[r.match].add((r.token, r.similarity))
        for token, vec in rows[1:3]:
            like = {t: sum(a * b for a, b in zip(v, vec)) for t, v in rows[:60] if not pos or t[-1] == token[-1]}
            third = sorted(like.values(), reverse=True)[2]
            assert got[token] == {(t, s) for t, s in like.items() if s >= third}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_found_and_tagged_once(spark):
    """Neither a filter nor a count by lemma repeats the pattern or the rules."""
    docs = corpus_of(spark, "The useful things are many.")
    for df in (K.doc_term_matrix(A.tagged_tokens(docs)), A.tagged_tokens(docs).filter("pos = 'NOUN'"), A.annotate(docs).filter("pos = 'ADJ'")):
        plan = plan_of(df)
        assert plan.count("regexp_extract_all(") == 1 and plan.count("EndsWith(low") <= 22 + 12
        assert "EndsWith(lower(" not in plan


def test_heads_are_not_looked_for_before_a_join(spark):
    a = A.annotate(corpus_of(spark, "The useful things are many."))
    heads = a.filter("pos = 'NOUN'").select("doc_id", F.col("token_id").alias("head_token_id"))
    assert "Filter isnotnull((" not in plan_of(a.filter("pos = 'ADJ'").join(heads, ["doc_id", "head_token_id"]))
    assert not a.schema["head_token_id"].nullable


def test_bigrams_read_annotations_once_and_count_repeats(spark):
    schema = "comment_id string, doc_id string, sentence_id int, token_id int, token string, lemma string, pos string, head_token_id int"
    adj = [("c", "d", 1, 1, "good", "good", "ADJ", 3), ("c", "d", 1, 2, "bad", "bad", "ADJ", 3), ("c", "d", 1, 4, "sad", "-", "ADJ", 3)]
    data = [*adj, ("c", "d", 1, 3, "law", "law", "NOUN", 3)] * 2
    data += [(None, "d", 1, 1, "good", "good", "ADJ", 3), (None, "d", 1, 3, "law", "law", "NOUN", 3)]
    data += [("c", "d", 2, 1, "good", "good", "ADJ", None), ("c", "d", 2, 1, "law", "law", "NOUN", 1), ("c", "d", 3, 3, "Law", "law", "NOUN", 3)]
    found = B.adj_noun_bigrams(spark.createDataFrame(data, schema), ["law"])
    assert rows(found, "comment_id", "bigram", "n") == [("c", "bad_law", 4), ("c", "good_law", 4)]
    assert plan_of(found).count("LogicalRDD") == 1


def test_running_totals_read_rows_once(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 3), (2.5, 1)], "v double, w int")
    summed = running_total(df.groupBy("v").agg(F.sum("w").alias("w")), "v", "w", total="all")
    assert rows(summed, "v", "cumulative", "all") == [(1.0, 1, 5), (2.0, 4, 5), (2.5, 5, 5)]
    assert "LogicalRDD" not in plan_of(summed)


def test_lasso_of_few_rows_is_one_job_a_path(spark, monkeypatch):
    """Folds fitted alone and step by step give the same path; alone, no step is a job."""
    rng = np.random.default_rng(4)
    data = []
    for i in range(90):
        at = sorted(rng.choice(12, 5, replace=False).tolist())
        data.append((at, [float(v) for v in rng.choice([-1.0, 1.0], 5)], float((0 in at) != (rng.random() < 0.2)), 1.0, i % 3))
    frame = spark.createDataFrame(data, "at array<int>, x array<double>, y double, weight double, fold int")
    penalties, steps, step = [0.3, 0.1, 0.03, 0.01], [], X._step
    monkeypatch.setattr(X, "_step", lambda *a: steps.append(1) or step(*a))

    def path():
        return {(r.fold, r.penalty, r.bucket): (r.fitted, r.beta) for r in X.lasso_path(frame, penalties, 12, [0, 1, 2]).collect()}

    alone = path()
    assert not steps
    monkeypatch.setattr(X, "ALONE_ROWS", 0)
    together = path()
    assert steps and alone.keys() == together.keys()
    for k, (fitted, beta) in together.items():
        assert alone[k] == pytest.approx((fitted, beta), abs=1e-7)

