"""The training-data operators against brute force, libraries and round trips."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import (
    bpe, exact_dedup, fingerprints, mixing, near_dedup, packed, pii, quality, queries, substring_dedup, token_counts, urls,
)

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Nulls, empty and long texts, ties, repeated rows and white space of all kinds.
ODD = [
    (1, "a b c", "s"), (1, "a b c", "s"), (2, None, None), (3, "", "t"), (4, " \t\n", "t"), (5, "abc", "s"),
    (6, "a  b\x0bc", "t"), (None, "a b c", "t"), (7, "x" * 9000 + " y" * 50, "u"), (8, "é 東京 \u00a0 z", "\U0001f600"),
    (9, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "u"),
    (10, "ONE one two three four five six seven eight nine ten eleven twelve thirteen fourteen fin", "u"),
    (11, "a", None), (12, "one two three four five six seven eight nine ten eleven twelve thirteen", "u"),
]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, id long, row string, h int, ids int, key string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, s, "en", None if t is None else len(t), 0, "row", 0, 0, "key") for i, t, s in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return WORDS.findall(text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# 1. byte-level BPE


@pytest.fixture(scope="module")
def library():
    import tiktoken

    v = queries.vocabulary()
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


TEXTS = [
    "", " ", "  ", "   a", "a   ", "a \n b", "a \n \n b", " \n\t x", "don't we'll 'S", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "東京は 日本の首都", "🙂🙂 ok", "a\u00a0 b", "\x00\x01", "x" * 3000, "<|endoftext|>", "12 345  67½", "\u2003 \u2003x", "ab" * 700,
]


def test_bpe_equals_the_library(library):
    v = queries.vocabulary()
    for t in TEXTS:
        assert v.encode(t).tolist() == library.encode_ordinary(t)
        assert v.decode(v.encode(t)) == t.encode()
    rng = random.Random(5)
    alphabet = "abcdefgh  \n\té東.,'s0123\u00a0🙂"
    for _ in range(1500):
        t = "".join(rng.choices(alphabet, k=rng.randint(1, 40)))
        assert v.encode(t).tolist() == library.encode_ordinary(t)


def test_pattern_agrees_on_every_character(library):
    v = queries.vocabulary()
    for first in range(0, 0x110000, 0x400):
        chars = [chr(c) for c in range(first, first + 0x400) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}! {c}  {c}b" for c in chars)
        assert v.encode(text).tolist() == library.encode_ordinary(text)
        if first > 0x20000 and first != 0xE0000:
            continue


def test_prefix_table_appends_and_edits():
    v, rng = queries.vocabulary(), random.Random(3)
    data = "".join(rng.choices("theandofinger .,", k=400)).encode()
    table = bpe.PrefixTable(v, data[:250])
    before = list(table.last)
    table.append(data[250:])
    assert table.last[:251] == before
    assert table.ids() == bpe.PrefixTable(v, data).ids()
    for _ in range(60):
        a = rng.randint(0, len(data))
        b = min(len(data), a + rng.randint(0, 4))
        new = "".join(rng.choices("theandofinger .,", k=rng.randint(0, 5))).encode()
        data = data[:a] + new + data[b:]
        computed = table.replace(a, b, new)
        fresh = bpe.PrefixTable(v, data)
        assert (table.data, table.last) == (fresh.data, fresh.last)
        assert computed <= len(data) + 1 - a
    assert computed < 200 or a < 250


def test_bpe_small_memory_gives_the_same(monkeypatch):
    v = queries.vocabulary()
    small = bpe.Memory(v.encode_piece, 1000)
    for piece in ["the", " of", "xyzzy", "the", " ing", "abba", "the", "zz zz"]:
        assert small[piece] == v.encode_piece(piece)
    assert len(small) <= 4


def test_bpe_splits_by_the_given_pattern():
    import tiktoken

    pattern = r"\p{L}+ ?|[^\p{L}]"
    v = bpe.Vocabulary(queries.vocabulary().ranks, pattern)
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=v.ranks, special_tokens={})
    for t in TEXTS:
        assert v.encode(t).tolist() == other.encode_ordinary(t)


def test_bpe_odd_rows(odd, empty, library):
    got = bpe.token_digests(odd, queries.vocabulary()).collect()
    assert len(got) == len(ODD)
    want = collections.Counter()
    for i, t, _ in ODD:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), sha(",".join(map(str, ids))), sha(t or "")] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    assert bpe.token_digests(empty, queries.vocabulary()).count() == 0
    coded = bpe.encode(odd, queries.vocabulary())
    assert coded.columns == [*[c for c in odd.columns if c != "ids"], "ids"]


# 2. mixing


def check_mix(rows, sources):
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
    for s, group in sources.items():
        taken = sum(r.taken for r in group)
        assert taken == math.floor(group[0].target) if any(r.size for r in group) else taken == 0
        assert group[0].target <= 3 * group[0].source_size


@pytest.mark.parametrize("block", [7])
def test_mix_odd_rows(odd, block):
    rows = mixing.mix(odd.withColumn("extra", F.col("source")), block=block).collect()
    assert len(rows) == len(ODD)
    assert sorted(r.size for r in rows) == sorted(len(words(t)) for _, t, _ in ODD)
    by = collections.defaultdict(list)
    for r in rows:
        by[(r.source_size, r.target)].append(r)
    check_mix(rows, by)
    assert sum(g[0].target for g in by.values()) == pytest.approx(sum(r.size for r in rows))
    again = mixing.mix(odd, block=block).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mix_of_nothing(empty, spark):
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mixed_documents(blank).count() == 0


def test_schedule_spreads_sources_evenly(docs):
    slots = mixing.schedule(mixing.source_targets(mixing.document_sizes(docs)), 16).collect()
    by = collections.defaultdict(list)
    for s in slots:
        by[s.sid].append(s.t)
    n = len(slots)
    for places in ([t for t in p if t < n] for p in by.values()):
        places.sort()
        share = len(places) / n
        assert max(abs((k + 1) - share * (t + 1)) for k, t in enumerate(places)) < 12
    assert all(sorted(s.k for s in slots if s.sid == sid) == list(range(len(by[sid]))) for sid in by)


def test_mixed_documents_keep_columns(odd):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert max(collections.Counter((r.doc_id, r.text) for r in out.collect()).values()) <= 6


# 3. exact dedup


def brute_exact(rows):
    bare = lambda t: "".join(words(t))
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[bare(t)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t, *_ in rows:
        g = groups[bare(t)]
        out.append((i, min(g)[3], len(g), sha(bare(t))))
    return sorted(map(str, out))


@pytest.mark.parametrize("block", [3])
def test_exact_odd_rows(odd, empty, block, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", block)
    rows = exact_dedup.exact_duplicates(odd).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in rows) == brute_exact(ODD)
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({r.text_sha256 for r in rows})
    assert all(r.doc_id == r.keep_id for r in kept)
    stays = exact_dedup.drop_duplicates(odd)
    assert stays.columns == odd.columns
    assert collections.Counter((r.doc_id, r.text) for r in stays.collect()).keys() == {
        (i, t) for i, t, _ in ODD if any(k.doc_id == i and k.text_sha256 == sha("".join(words(t))) and k.n_chars == len(t or "") for k in kept)
    }
    assert stays.count() == len(kept)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_block_names_survive_clashing_digests(odd, monkeypatch):
    """With a digest that clashes for the first seed another seed is taken."""
    real = exact_dedup.F.xxhash64

    def weak(*columns):
        out = real(*columns)
        first = any(str(c) in ("Column<'0'>", "Column<'1'>") for c in columns)
        return F.pmod(out, F.lit(2)) if first else out

    monkeypatch.setattr(exact_dedup.F, "xxhash64", weak)
    monkeypatch.setattr(exact_dedup, "BLOCK", 8)
    names, seed = exact_dedup._block_names(odd, "text", 4)
    assert seed > 0 and names.count() > 4


# 4. personal data


def test_feistel_permutes(spark):
    n = spark.range(0, 12 * 35)
    s = pii.feistel((F.col("id") / 35).cast("int"), F.col("id") % 35, F.lit(12), F.lit(35), "k", "x")
    seen = {(r.s.a, r.s.b) for r in n.select(s.alias("s")).collect()}
    assert seen == {(a, b) for a in range(12) for b in range(35)}
    digits = spark.range(0, 1000).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "x").alias("d"))
    assert sorted(r.d for r in digits.collect()) == [f"{i:03d}" for i in range(1000)]


def luhn(number):
    d = [int(c) for c in number if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


CASES = {
    "card": (["4111111111111111", "4111-1111-1111-1111", "378282246310005"], ["4111111111111112", "1234567890123"]),
    "phone": (["+1 (183) 555-1276", "(202) 555-0147", "+49 30 1234 5678"], ["555-1276", "+1"]),
    "ssn": (["123-45-6789", "899-99-9999"], ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567"]),
    "iban": (["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"], ["DE88370400440532013000"]),
    "ipv4": (["3.76.85.226", "255.255.255.0"], ["300.1.1.1", "1.2.3", "1.2.3.4.5"]),
    "date": (["2024-02-29", "31.12.1999", "12/31/1999"], ["2023-02-29", "31.13.1999", "13/31/1999", "1650-01-01"]),
    "email": (["a.b-7@mail.example.com", "élan.55@x.org"], ["a@b", "@example.com"]),
}


@pytest.mark.parametrize("kind", CASES)
def test_pii_kinds(spark, kind):
    good, bad = CASES[kind]
    rows = [(n, f"see {x}, or {x}." if ok else f"see {x} here") for ok, xs in ((True, good), (False, bad)) for n, x in enumerate(xs)]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    for r, x in zip(got[: len(good)], good):
        assert [(p.kind, p.found) for p in r.pii] == [(kind, x)] * 2
        new = r.pii[0].instead
        assert r.text == f"see {new}, or {new}." and new != x
        shape = lambda s: re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", s))
        if kind != "ipv4":
            assert shape(new) == shape(x)
        if kind == "card":
            assert luhn(new)
    for r, x in zip(got[len(good) :], bad):
        assert (r.text, r.pii) == (f"see {x} here", [])
    # Pseudonyms are valid themselves, so they are found again.
    again = pii.pseudonymise(spark.createDataFrame([(1, r.text) for r in got[: len(good)]], "doc_id long, text string"), "k")
    assert all({p.kind for p in r.pii} == {kind} for r in again.collect())


NEIGHBOURS = {
    "4111111111111111 12/27": ["4111111111111111"], "4111111111111111 123": ["4111111111111111"],
    "no 12 4111111111111111": ["4111111111111111"], "4111 1111 1111 1111 12 27 123": ["4111 1111 1111 1111"],
    "12 27 4111 1111 1111 1111 4": ["4111 1111 1111 1111"], "BE68539007547034 EUR": ["BE68539007547034"],
    "AB13 BE68 5390 0754 7034 EUR 5": ["BE68 5390 0754 7034"], "AB12 4111 1111 1111 1111": ["4111 1111 1111 1111"],
    "BE68539007547034 4111 1111 1111 1111": ["BE68539007547034", "4111 1111 1111 1111"],
    "378282246310005 2024-02-29": ["378282246310005", "2024-02-29"], "4111111111111111 31.12.1999": ["4111111111111111", "31.12.1999"],
    "4111111111111111 3.76.85.226": ["4111111111111111", "3.76.85.226"], "4111111111111111 JOHN.DOE@x.org": ["4111111111111111", "JOHN.DOE@x.org"],
    "000-12-3456 123-45-6789": ["123-45-6789"], "202-555-0147": ["202-555-0147"], "202.555.0147": ["202.555.0147"], "202 555 0147": ["202 555 0147"],
    "+12025550147": ["+12025550147"], "+33 1 23 45 67 89": ["+33 1 23 45 67 89"], "+12025550147 2024-02-29": ["+12025550147", "2024-02-29"],
    "+33 1 23 45 67 89 4111 1111 1111 1111": ["+33 1 23 45 67 89", "4111 1111 1111 1111"],
    "4111111111111112 123": [], "DE88370400440532013000 EUR": [], "1234567 12-34 56": [], " ".join(["7"] * 2000): [],
    "x " + "12 " * 1000 + "4111111111111111": ["4111111111111111"],
}


def test_pii_next_to_numbers(spark):
    rows = list(enumerate(NEIGHBOURS))
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    for r in got:
        text = rows[r.doc_id][1]
        found = [p.found for p in r.pii]
        if len(text) > 3000:
            # Sevens and twelves in a row can pass as cards themselves.
            assert text.startswith("7") or "4111111111111111" not in r.text
            continue
        assert found == NEIGHBOURS[text], text
        for p in r.pii:
            text = text.replace(p.found, p.instead)
            assert p.found not in r.text
        assert r.text == text


def test_pii_of_a_long_run_takes_seconds(spark):
    import time

    rows = [("1 " + "a" * 1_000_000,), ("1 " + "a" * 500_000 + " me@example.org " + "b." * 200_000,)]
    frame = spark.createDataFrame([(i, t) for i, (t,) in enumerate(rows)], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: [x.kind for x in r.pii] for r in pii.pseudonymise(frame, "k").collect()}
    assert got == {0: [], 1: ["email"]} and time.time() - start < 60


def test_pii_odd_rows(odd, empty, docs):
    got = pii.pseudonymise(odd, "k").collect()
    assert [(r.doc_id, r.text, r.pii) for r in got] == [(i, t, []) for i, t, _ in ODD]
    assert pii.pseudonymise(empty, "k").count() == 0
    real = pii.pseudonymise(docs, "k").withColumnRenamed("text", "masked").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert any(r.pii for r in real)
    for r in real:
        left = r.text
        for p in r.pii:
            assert p.found in left
        if not r.pii:
            assert r.masked == left
        assert not any(p.found in r.masked for p in r.pii if len(p.found) > 9)


# 5. token counts


@pytest.mark.parametrize("hot", [50])
def test_token_counts(odd, empty, docs, spark, hot):
    import sentencepiece

    model = public_tokenizers.path(queries.PIECE_FILE)
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    more = [(100 + n, t) for n, t in enumerate(TEXTS + ["\n", "a\n\nb \n", "▁x ▁", " <s> </s>", "ﬁ ①\r\n"])]
    both = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    both = both.unionByName(docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    rows = both.collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in rows)
    got = token_counts.count_tokens(both, model, hot=hot).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert token_counts.count_tokens(empty, model).count() == 0


# 6. quality


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen, unseen = labels.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 = 0")
    model = quality.fit(docs, seen)
    rows = quality.score(docs, model).join(unseen, "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) for r in rows) / len(rows)
    good = [r for r in rows if r.quality == 1]
    assert right > 0.97 and sum(r.kept for r in good) / len(good) > 0.98
    assert quality.fit(docs, seen).final.bias == pytest.approx(model.final.bias, rel=1e-6)


def exchange_data(spark, n=3000, known=300, seed=1):
    """Documents whose length and source both tell their class; few labels."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < 0.6
    text = [" ".join(["word"] * max(1, int(rng.normal(30 if g else 12, 6)))) for g in good]
    source = [f"s{int(rng.integers(0, 40)) * 2 + (g if rng.random() < 0.93 else 1 - g)}" for g in good.astype(int)]
    docs = spark.createDataFrame([(i, t, s, "en", len(t)) for i, (t, s) in enumerate(zip(text, source))], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, int(good[i])) for i in range(known)], "doc_id long, quality int")
    return docs, labels, good


def test_views_teach_each_other(spark):
    docs, labels, good = exchange_data(spark)
    alone, taught = quality.fit(docs, labels, rounds=0), quality.fit(docs, labels)
    assert alone.exchanged == () and len(taught.exchanged) == 2 * quality.ROUNDS
    for view in ("by_text", "by_meta"):  # both views, both classes
        lessons = [x for x in taught.exchanged if x.view == view]
        assert all(0 < x.weight <= 300 for x in lessons) and max(x.good for x in lessons) > 200 and max(x.bad for x in lessons) > 100, lessons
    right = {}
    for name, model in (("alone", alone), ("taught", taught)):
        rows = quality.score(docs.filter("doc_id >= 300"), model).select("doc_id", "kept", "meta_score", "text_score").collect()
        right[name] = [np.mean([x == good[r.doc_id] for r, x in ((r, f(r)) for r in rows)]) for f in (lambda r: r.kept, lambda r: r.meta_score >= 0.5)]
    # The metadata view knows few sources by labels alone, and most of them after what the text view tells.
    assert right["taught"][1] > right["alone"][1] + 0.004 and right["taught"][0] >= right["alone"][0] - 0.005
    assert taught.pairs.count() == docs.select("source", "lang").distinct().count()


def test_sums_fit_like_rows(spark):
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(400, 2)), rng.random(400) + 0.1
    y = (x[:, 0] - x[:, 1] + rng.normal(size=400) > 0).astype(float)
    rows = spark.createDataFrame([(float(a), float(b), float(c), float(d)) for (a, b), c, d in zip(x, y, w)], "a double, b double, y double, w double")
    got = quality.fit_by_sums(rows, [F.col("a"), F.col("b")], F.col("y"), F.col("w"))
    z = np.column_stack([np.clip((x - got.mean) / got.sd, -6, 6), np.ones(400)])
    p = 1 / (1 + np.exp(-(z @ np.append(got.weight, got.bias))))
    assert np.abs(z.T @ (w * (y - p)) - np.append(got.weight, 0) * 1.0).max() < 1e-3
    assert got.mean == pytest.approx(np.average(x, 0, w))


def test_score_equals_numpy(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.meta_features(quality.text_features(docs)).select("doc_id", "__x", "__stated", "__source", "__lang").collect()
    odds = {(r["__source"], r["__lang"]): (r.source_odds, r.lang_odds) for r in model.pairs.collect()}
    x = np.array([r["__x"] for r in rows])
    m = np.array([[r["__stated"], *odds[r["__source"], r["__lang"]]] for r in rows])
    z = model.final.logit(np.column_stack([model.text.logit(x), model.meta.logit(m)]))
    for most in (quality.PAIRS, 3):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(quality, "PAIRS", most)
            got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
        assert [got[r.doc_id] for r in rows] == pytest.approx(list(quality._sigmoid(z)))


def test_sources_without_labels_count_as_the_mean(spark):
    docs, labels, _ = exchange_data(spark, 400)
    model = quality.fit(docs, labels, rounds=0)
    other = docs.limit(1).withColumn("source", F.lit("unseen"))
    assert 0 < quality.score(other, model).first().meta_score < 1
    shares = {r["__source"]: r.source_odds for r in model.pairs.collect()}
    assert len(set(shares.values())) > 10 and len(shares) == docs.select("source").distinct().count()


def test_quality_odd_rows(odd, empty, docs, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    none = labels.limit(0)
    for l in (labels, none):
        kept = quality.keep_good(odd, l)
        assert kept.columns == odd.columns
    assert quality.keep_good(odd, none).count() == len(ODD)
    assert quality.keep_good(empty, labels).count() == 0
    strange = spark.createDataFrame([(1, None, None), (1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, labels.unionByName(strange, allowMissingColumns=True)).count() > 0
    scored = quality.score(odd, quality.fit(docs, labels))
    assert scored.filter("quality_score is null").count() == 0
    clash = docs.withColumns({"y": F.lit(1), "x": F.lit("x"), "weight": F.lit(2), "row": F.lit(0), "kept": F.lit("?"), "n_chars": F.lit("many")})
    kept = quality.keep_good(clash, labels)
    assert kept.columns == clash.columns and 0 < kept.count() <= docs.count()


# 7. near dedup


def brute_near(rows, least=near_dedup.SIMILAR):
    """id -> class for (id, text) rows by all pairs."""
    def shingles(ws):
        return collections.Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else collections.Counter()

    members = collections.defaultdict(list)
    for i, t in rows:
        members[tuple(words(t))].append(i)
    df = collections.Counter()
    for ws, m in members.items():
        df.update(set(shingles(ws)))

    def idf(x):
        return math.log(1 + len(members) / df[x])

    texts = list(members)
    weighted = [{x: c * idf(x) for x, c in shingles(ws).items()} for ws in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            u, v = weighted[a], weighted[b]
            common = sum(min(u[x], v[x]) for x in u.keys() & v.keys())
            if common and common / (sum(u.values()) + sum(v.values()) - common) >= least:
                parent[root(a)] = root(b)
    classes = collections.defaultdict(list)
    for k, ws in enumerate(texts):
        classes[root(k)] += members[ws]
    return {i: min(c, key=lambda x: (x is None, x)) for c in classes.values() for i in c}


def edited(ws, rng, n):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"new{rng.random()}"
    return " ".join(ws)


def test_near_classes_equal_all_pairs(spark, docs):
    rng = random.Random(2)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    longer = [words(t) for _, t in rows if len(words(t)) > 150]
    for k in range(12):
        rows += [(1000 + 100 * k + j, edited(longer[k], rng, j % 3 + 1)) for j in range(3 + 2 * (k == 0) * 15)]
    rows += [(5000 + k, " ".join(longer[k][:40] + longer[k + 1][:400])) for k in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(frame).collect()
    want = brute_near(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = collections.Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_odd_rows(odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    want = brute_near([(i, t) for i, t, _ in ODD])
    assert sorted(str((r.doc_id, r.class_id)) for r in got) == sorted(str((i, want[i])) for i, _, _ in ODD)
    stays = near_dedup.drop_near_duplicates(odd)
    assert stays.columns == odd.columns
    assert sorted(str(r.doc_id) for r in stays.collect()) == sorted(map(str, {*want.values()}))
    assert near_dedup.near_duplicates(empty).count() == 0


def test_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(near_dedup, "stored", lambda df, name, f=near_dedup.stored: rounds.append(name) or f(df, name))
    links = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = near_dedup.components(links)
    assert got.count() == 401 and {r.comp for r in got.select("comp").distinct().collect()} == {0}
    assert rounds.count("nearest") < 16


def test_weights_are_those_of_all_texts(spark, docs, monkeypatch):
    """Every shingle's weight, however rare, with texts in many blocks and ranges dealt twice."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2000)
    monkeypatch.setattr(packed, "range_bits", lambda n: 9)
    monkeypatch.setattr(packed, "DEALT", 1 << 10)
    near_dedup.small_batches(spark)
    rows, texts = near_dedup.texts_of(docs, "doc_id", "text")
    blocks = near_dedup.stored(near_dedup._blocks(texts.repartition(12)), "blocks")
    counts = near_dedup.shared_counts(blocks, 1e4)
    n, df, seen = rows.select("key").distinct().count(), collections.Counter(), []
    for r in blocks.join(counts, "block", "left").collect():
        texts_, h, tf = near_dedup.unpack_block(bytes(r.data))
        w = near_dedup.weights(h, tf, [bytes(c) for c in r.counts or []], n)
        df.update(h.tolist())
        seen += zip(h.tolist(), tf.tolist(), w.tolist())
        assert texts_["shingles"].sum() == len(h)
    assert blocks.count() > 10 and max(df.values()) > 3
    for h, tf, w in seen:
        assert w == pytest.approx(tf * math.log(1 + n / df[h]))


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.comp for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    comp = {}
    for a, b in links:
        comp.setdefault(a, a), comp.setdefault(b, b)
    for _ in range(400):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert {n: c for n, c in got.items()} == {n: c for n, c in comp.items() if n in got}
    assert all(n in got for a, b in links if a != b for n in (a, b))


def test_samples_agree_as_often_as_sets_are_alike():
    import numpy as np

    rng, s = np.random.default_rng(0), near_dedup.Sampler(3000)
    h = np.sort(rng.integers(0, 1 << 44, 300, dtype=np.uint64))
    w1 = rng.random(300) * 3 + 0.1
    w2 = w1 * np.where(rng.random(300) < 0.4, rng.random(300) * 3, 1)
    a, b = s.samples(h, w1, np.array([300])), s.samples(h, w2, np.array([300]))
    true = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((a == b).mean() - true) < 0.04
    assert near_dedup.similarity(h, w1, h, w2) == pytest.approx(true)


# 8. fingerprints


#: Runs of up to 16 characters, and every character of longer ones.
PIECES = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,16}(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]")


def brute_prints(text, hashes, k=fingerprints.K, w=fingerprints.WINDOW):
    pieces = PIECES.findall(text)
    grams = [tuple(pieces[i : i + k]) for i in range(max(1, len(pieces) - k + 1))] if pieces else []
    h = [hashes(g) for g in grams]
    chosen = []
    for i in range(max(1, len(h) - w + 1)) if h else ():
        window = h[i : i + w]
        least = min(window)
        at = max(j for j, x in enumerate(window) if x == least)
        if (i + at) not in chosen:
            chosen.append(i + at)
    return [(p, h[p]) for p in chosen]


def test_fingerprints_of_text_without_spaces(spark):
    rng = random.Random(3)
    text = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3000))
    rows = [(0, text), (1, "x" + text), (2, "前" + text[:1500] + text[1501:]), (3, "y " + text[7:2000])]
    prints = fingerprints.winnow(spark.createDataFrame(rows, "i long, t string"), "t", "p")
    found = {r.i: set(r.h) for r in prints.select("i", fingerprints.hashes(F.col("p")).alias("h")).collect()}
    for i in (1, 2):
        assert len(found[0] & found[i]) / len(found[0] | found[i]) > 0.98
    assert len(found[3] & found[0]) > 0.95 * len(found[3])


def test_fingerprints_split_frequent_ids(spark):
    """Half of the rows have no id or one id; no task gets them all, and equal texts still follow each other."""
    rows = [(None, f"text {i} of many words in a row") for i in range(300)] + [(5, f"other {i} text of words") for i in range(300)]
    rows += [(5, "the same text again")] * 200 + [(i, f"row {i} with its words") for i in range(10, 400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    buckets = fingerprints._bucketed(frame, "doc_id", "text", 400)
    sizes = [r["count"] for r in buckets.groupBy("bucket").count().collect()]
    assert max(sizes) < 120 and sum(r.copies for r in buckets.collect()) == len(rows)
    got = fingerprints.edited_likeness(frame, size=400).collect()
    hashes = dict(spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string").select("t", F.xxhash64("t").alias("h")).collect())
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = collections.Counter()
    for n, (i, t) in enumerate(order):
        third = len(t) // 3
        want[i, t[: len(t) - third] + order[(n + 1) % len(order)][1][:third]] += 1
    assert collections.Counter((r.doc_id, r.edited) for r in got) == want


@pytest.mark.parametrize("size", [3000])
def test_fingerprints_equal_brute_force(spark, odd, docs, size):
    rows = [(i, t) for i, t, _ in ODD] + [(1000 + r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(80).collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.edited_likeness(frame, size=size)
    got = got.withColumn("at", fingerprints.places(F.col("prints"))).withColumn("hash", F.transform("prints", lambda x: F.shiftright(x, 32)))
    got = got.withColumn("ehash", fingerprints.hashes(F.col("edited_prints"))).collect()
    assert len(got) == len(rows)
    # The hash of every gram, from the engine.
    grams = {g for _, t in rows for g in _grams(t or "")} | {g for r in got for g in _grams(r.edited)}
    table = spark.createDataFrame([(list(g),) for g in grams], "g array<string>")
    hashed = table.select("g", F.transform("g", lambda x: F.xxhash64(x)).alias("w"))
    known = {tuple(r.g): r.h for r in hashed.select("g", F.shiftrightunsigned(F.xxhash64(*[F.get("w", F.lit(j)) for j in range(5)]), 33).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]), reverse=True)
    hashes = spark.createDataFrame([(t or "",) for _, t in order], "t string").select(F.xxhash64("t").alias("h")).collect()
    order = [r for r, _ in sorted(zip(order, hashes), key=lambda x: (x[0][0] is None, -(x[0][0] or 0), x[1].h))]
    left = collections.Counter((r.doc_id, r.n_chars, r.edited, tuple(r.at), tuple(r.hash), r.near_edited, r.near_next) for r in got)
    for n, (i, t) in enumerate(order):
        t, following = t or "", order[(n + 1) % len(order)][1] or ""
        third = len(t) // 3
        e = t[: len(t) - third] + following[:third]
        prints, eprints, nprints = (brute_prints(x, known.__getitem__) for x in (t, e, following))
        like = lambda a, b: (len({h for _, h in a} & {h for _, h in b}) / len({h for _, h in a} | {h for _, h in b})) if a or b else 1.0
        key = (i, len(t), e, tuple(p for p, _ in prints), tuple(h for _, h in prints), like(prints, eprints), like(prints, nprints))
        assert left[key] > 0, key
        left[key] -= 1


def _grams(text, k=fingerprints.K):
    pieces = PIECES.findall(text)
    return [tuple(pieces[i : i + k]) for i in range(max(1, len(pieces) - k + 1))] if pieces else []


def test_fingerprints_of_nothing(empty):
    assert fingerprints.edited_likeness(empty).count() == 0


# 9. urls


def test_url_parts_and_rules(spark):
    urls_ = {
        "https://A.Example.ORG/en/12?x#y": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "x://b.com/de/1": ("b.com", "/de/1", "com/de/", "block"),
        "http://b.com?q=/de/": ("b.com", "", None, None),
        "http://h/p://z/de/": ("h", "/p://z/de/", None, None),
        "a\nb://com/fr/": ("com", "/fr/", "com/fr/", "allow"),
        "no scheme": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None),
        "http://É.com/de/": ("É.com", "/de/", "com/de/", "block"),
    }
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    outcomes = spark.createDataFrame([(0, True), (None, False), (99, True), (5, None)], "page_id long, bad boolean")
    got = {r.page_id: r for r in urls.filter_urls(pages.unionByName(pages.limit(1)), outcomes).collect()}
    for n, (host, path, rule, verdict) in enumerate(urls_.values()):
        assert (got[n].host, got[n].path, got[n].rule) == (host, path, rule)
        assert got[n].verdict == (verdict or got[n].verdict)
    assert urls.filter_urls(pages.limit(0), outcomes).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages.filter("page_id > 4 and page_id < 6"), outcomes.limit(0)).collect()} == {"allow"}


def test_registered_domains(spark):
    want = {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "uk": ("uk", "uk"),
        "www.example.com": ("example.com", "com"), "example.com:8080": ("example.com", "com"), "me@x.example.com": ("example.com", "com"),
        "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "[::1]:443": ("[::1]", "[::1]"), "": ("", ""),
        "a.github.io": ("a.github.io", "github.io"), "localhost": ("localhost", "localhost"), "example.com.": ("example.com", "com"),
    }
    rows = spark.createDataFrame([(h,) for h in want], "host string")
    got = {r.host: (r.d, r.s) for r in rows.select("host", urls.domain_of(F.col("host")).alias("d"), urls.suffix_of(F.col("host")).alias("s")).collect()}
    assert got == want


def test_one_bad_host_leaves_others_under_its_suffix(spark):
    pages = [(i, f"http://bad.co.uk/{i}") for i in range(60)] + [(100 + i, f"http://site{i}.co.uk/") for i in range(40)] + [(200, "http://new.co.uk/")]
    outcomes = spark.createDataFrame([(i, i < 60) for i in range(140)], "page_id long, bad boolean")
    verdict = {r.host: r.verdict for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), outcomes, ()).collect()}
    assert verdict["bad.co.uk"] == "block" and {verdict[h] for h in verdict if h != "bad.co.uk"} == {"allow"}


def test_reputation_shrinks(spark):
    pages = [(n, f"http://{h}/") for n, h in enumerate(["bad.x.net"] * 60 + ["good.x.net"] * 60 + ["new.x.net"] + ["few.y.net"] * 2 + ["z.q.net"] * 200)]
    outcomes = [(n, n < 60 or n in (121, 122)) for n in range(len(pages)) if n != 120]
    found = {r.host: r for r in urls.reputations(
        spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad boolean")
    ).collect()}
    assert found["bad.x.net"].mean > 0.8 and found["good.x.net"].mean < 0.2
    assert found["good.x.net"].mean < found["new.x.net"].mean < found["bad.x.net"].mean
    assert found["few.y.net"].mean < 1 and found["few.y.net"].sd > found["bad.x.net"].sd


# 10. substring dedup


def brute_repeats(rows, width=13):
    first = {}
    for i, t in rows:
        ws = words(t)
        for k in range(len(ws) - width + 1):
            w = tuple(ws[k : k + width])
            first[w] = min(first.get(w, math.inf), math.inf if i is None else i)
    out = []
    for i, t in rows:
        ws = words(t)
        gone = set()
        for k in range(len(ws) - width + 1):
            if first[tuple(ws[k : k + width])] < (math.inf if i is None else i):
                gone.update(range(k, k + width))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return collections.Counter(out)


@pytest.mark.parametrize(("width", "block"), [(13, 500), (3, 40)])
def test_substrings_equal_brute_force(spark, odd, empty, docs, width, block, monkeypatch):
    monkeypatch.setattr(substring_dedup.repeated_places, "__defaults__", (width, block))
    rows = [(i, t) for i, t, _ in ODD] + [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    extra = odd.select("doc_id", "text", "id", "row").unionByName(docs.select("doc_id", "text").withColumns({"id": F.lit(0), "row": F.lit("")}))
    got = substring_dedup.remove_repeats(extra, width=width).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(rows, width)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substrings_of_texts_with_one_hash(spark):
    """Rows without an id, two by two with the same 32-bit hash: only one of two holds a repeat."""
    passage = " ".join(f"w{i}" for i in range(13))
    n = spark.range(0, 200_000, 1, 8)
    long = n.select(F.concat(F.lit(passage + " "), F.col("id").cast("string")).alias("a")).withColumn("h", F.hash("a"))
    short = n.select(F.concat(F.lit("clean "), F.col("id").cast("string")).alias("b")).withColumn("h", F.hash("b"))
    pairs = long.join(short, "h").limit(3).collect()
    assert pairs
    rows = [(1, passage)] + [(None, t) for p in pairs for t in (p.a, p.b, f"{p.b} " + " ".join(f"u{i}" for i in range(20)))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(rows)


def block_of(rng, n, first_id, width=13):
    """Documents of some hundred words each, n words in all."""
    sizes = rng.integers(100, 700, n // 400)
    documents = np.zeros(len(sizes), substring_dedup.DOCUMENT)
    documents["id"] = first_id + np.arange(len(sizes))
    documents["start"] = np.cumsum(sizes) - sizes
    flat = rng.integers(0, 1 << 63, int(sizes.sum()), dtype=np.uint64)
    return documents, sizes, flat


def test_segments_hold_what_was_dealt():
    rng = np.random.default_rng(2)
    documents, sizes, flat = block_of(rng, 4000, 7)
    later = int(documents["start"][5])
    flat[later : later + 60] = flat[20:80]
    rows = list(substring_dedup.settle(3, documents, sizes, flat, 13))
    assert [k for _, k, _, _ in rows[:2]] == [substring_dedup.DOCUMENTS, substring_dedup.PLACES]
    found = []
    for where, kind, block, data in rows[2:]:
        (number, owners, h, more, at), = packed.segments(data)
        assert number == block == 3 and (h >> np.uint64(64 - packed.FIRST) == where).all()
        assert (np.diff(h.astype(float)) >= 0).all()
        doc = np.searchsorted(documents["start"], at, "right") - 1
        own = np.searchsorted(owners["start"], at, "right") - 1
        assert (documents["id"][doc] == owners["id"][own]).all()
        for again, part in packed.deal_again([data], packed.FIRST, 5):
            (_, o2, h2, m2, at2), = packed.segments(part)
            assert ((h2 << np.uint64(packed.FIRST)) >> np.uint64(59) == again).all()
            assert (o2["id"][np.searchsorted(o2["start"], at2, "right") - 1] == documents["id"][np.searchsorted(documents["start"], at2, "right") - 1]).all()
            found += at2.tolist()
    places = np.frombuffer(rows[1][3], np.uint32).tolist()
    assert sorted(found + places) == packed.inside(sizes, 13).tolist()


def test_bytes_of_a_word_do_not_grow_with_the_input():
    """What travels for a word is about the same whether hashes have 64, 2,048 or 65,536 ranges."""
    rng = np.random.default_rng(5)
    first = collections.defaultdict(list)
    n = 0
    for block in range(4):
        documents, sizes, flat = block_of(rng, 1 << 18, block << 20)
        n += len(flat)
        for where, kind, _, data in substring_dedup.settle(block, documents, sizes, flat, 13):
            if kind == substring_dedup.SEGMENTS:
                first[where].append(data)
    row = 40  # what a row costs beside its data
    at_first = sum(len(d) + row for ds in first.values() for d in ds) / n
    for bits in (11, 16):
        again = [d for ds in first.values() for _, d in packed.deal_again(ds, packed.FIRST, bits - packed.FIRST)]
        assert sum(len(d) + row for d in again) / n < 2.5 * at_first
    assert at_first < 18


@pytest.mark.parametrize("bits", [8, 12])
def test_substrings_dealt_twice(spark, docs, bits, monkeypatch):
    monkeypatch.setattr(substring_dedup.repeated_places, "__defaults__", (13, 3000))
    monkeypatch.setattr(packed, "range_bits", lambda n: bits)
    monkeypatch.setattr(packed, "DEALT", 1 << 10)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = substring_dedup.remove_repeats(docs.select("doc_id", "text")).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(rows)


def test_windows_that_share_64_bits_stay_apart():
    h, more = np.array([5, 5, 5, 9], np.uint64), np.array([2, 1, 2, 1], np.uint16)
    ids = np.array([3, 1, 8, 4])
    order = substring_dedup.sort_hashes(h, more)
    hit = substring_dedup._covered(h[order], more[order], ids[order])
    assert set(order[hit].tolist()) == {2}


@pytest.mark.parametrize(("bits", "direct"), [(packed.FIRST, packed.FIRST), (9, packed.FIRST), (9, 12)])
def test_repeats_of_other_blocks_are_found_in_any_number_of_ranges(spark, bits, direct, monkeypatch):
    """Blocks of many tasks repeat each other's passages, dealt once or twice; each is run once, under one number."""
    monkeypatch.setattr(packed, "DIRECT", direct, raising=False)
    monkeypatch.setattr(substring_dedup.repeated_places, "__defaults__", (5, 60))
    monkeypatch.setattr(packed, "range_bits", lambda n: bits)
    rng = random.Random(8)
    passages = [" ".join(f"w{rng.randrange(500)}" for _ in range(12)) for _ in range(6)]
    rows = [(i, " ".join([*(f"u{i}_{k}" for k in range(10)), rng.choice(passages), f"v{i}", rng.choice(passages)])) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7, "doc_id")
    got = substring_dedup.remove_repeats(frame, width=5).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(rows, 5)
