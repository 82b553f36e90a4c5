"""Spelling variants, the Merkle manifest and BPE by a queue of merges."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import manifest, merges, queries, variants
from corpuscope.llm.common import Memory

from .test_operators import ODD, docs, empty, odd, sha  # noqa: F401

LOWER = {i: i + 32 for i in range(65, 91)}


# 11. spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(n):
    out = {}
    for w in n:
        near = [x for x in n if x != w and abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = [best if best and n[best] >= 10 * n[w] else None, w, n[w], len(near)]
    for row in out.values():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {(w, f, r, k, near, n[f] if f else None) for w, (f, r, k, near) in out.items()}


def as_rows(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_word_counts(docs, spark):  # noqa: F811
    rows = [(3, "CAFÉTERIA café÷terias"), (None, "Straßenbahn xStraßenbahn"), (4, None), (4, "")]
    rows += [(i, "Cafétéria nineteen") for i in range(200)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    want = collections.Counter()
    for r in both.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            k = h % len(run)
            want[run[:k] + run[k + 1 :] if h % 31 == 0 else run] += 1
    got = {r.word: r.n for r in variants.word_counts(both).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2 and len(w) >= 7}


@pytest.mark.parametrize("block, tile", [(256, 4096), (2, 4096), (256, 3)])
def test_variant_groups_equal_brute_force(spark, block, tile, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", block)
    monkeypatch.setattr(variants, "TILE", tile)
    monkeypatch.setattr(variants, "CELLS", 64)
    rng, n = random.Random(4), {}
    for _ in range(60):
        word = "".join(rng.choices("abcdeéÿz", k=rng.randint(7, 12)))
        n[word] = rng.choice([3, 40, 500, 6000])
        for _ in range(6):
            k, c = rng.randrange(len(word)), rng.choice("abcdeéÿz")
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :], word[::-1]])
            n[word] = rng.choice([2, 4, 40, 400])
    n |= {"a" * 900: 5, "a" * 901: 50, "a" * 300 + "b" + "a" * 600: 500}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert as_rows(variants.variant_groups(words)) == brute_groups(n)


def test_every_pair_of_blocks_meets_once(spark):
    rng = random.Random(8)
    words = {"".join(rng.choices("abcdefgh", k=rng.randint(7, 9))) for _ in range(300)}
    k = 5
    placed = variants.blocks(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), k)
    met = variants.meetings(placed, k).collect()
    groups = collections.defaultdict(list)
    for r in met:
        groups[r.own, r.tile, r.turn].append(r)
    seen = collections.Counter()
    for (_, _, turn), rows in groups.items():
        own = [r.word for r in rows if not r.guest]
        for a in own:
            for b in [r.word for r in rows if r.guest] + ([x for x in own if x > a] if turn == 0 else []):
                seen[frozenset((a, b))] += 1
    assert set(seen.values()) == {1}
    assert all(frozenset((a, b)) in seen for a in words for b in words if a < b and one_edit(a, b))


def test_the_smaller_block_travels(spark):
    rng = random.Random(3)
    anagrams = {"".join(rng.sample("abcdefg", 7)) for _ in range(40)}
    placed = variants.blocks(spark.createDataFrame([(w, 1) for w in [*anagrams, "abcdefgh"]], "word string, n long"), 5)
    assert [r.word for r in variants.meetings(placed, 5).collect() if r.guest] == ["abcdefgh"]


def test_words_of_thousands_of_letters(spark):
    n = {"a" * 5000: 5, "a" * 5001: 50, "a" * 2500 + "b" + "a" * 2500: 500}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert as_rows(variants.variant_groups(words)) == brute_groups(n)


def test_forms_follow_to_the_last(spark):
    n = {"abcdefgh": 10**6, "abcdefg": 10**4, "abcdefx": 10**2, "abcdexx": 2, "abcdxxx": 2}
    got = {r.word: r.root for r in variants.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == {**{w: "abcdefgh" for w in n}, "abcdxxx": "abcdxxx"}


def test_variants_odd_rows(odd, empty):  # noqa: F811
    assert variants.spelling_variants(empty).count() == 0
    assert as_rows(variants.spelling_variants(odd)) == brute_groups({r.word: r.n for r in variants.word_counts(odd).collect()})


# 12. Merkle manifest


def brute_manifest(rows):
    """leaf, subroot, root, proof and what the tampered leaf gives, by position."""

    def lines(leaves):
        out = [leaves]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def way(levels, i):
        for level in levels[:-1]:
            run = level[i // 2 * 2 : i // 2 * 2 + 2]
            yield "".join(run[: i % 2]), "".join(run[i % 2 + 1 :])
            i //= 2

    def leaf(r, more=0):
        values = [r.doc_id, r.source, r.lang, r.n_chars + more if r.n_chars is not None else None, r.text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    trees = collections.defaultdict(list)
    for r in rows:
        trees[r.lang].append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for t in trees.values():
        t.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    levels = {t: lines([leaf(r) for r in trees[t]]) for t in order}
    crown = lines([levels[t][-1][0] for t in order])
    found = collections.Counter()
    for at, t in enumerate(order):
        for i, r in enumerate(trees[t]):
            path = [*way(levels[t], i), *way(crown, at)]
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            h = leaf(r, int(tampered))
            for left, right in path:
                h = sha(left + h + right)
            proof = sha("".join(a + b for a, b in path))
            found[r.doc_id, leaf(r), levels[t][-1][0], crown[-1][0], proof, h, h == crown[-1][0]] += 1
    return found


@pytest.mark.parametrize("digits", [1, 3, 8])
def test_manifest_equals_brute_force(docs, odd, spark, digits, monkeypatch):  # noqa: F811
    monkeypatch.setattr(manifest, "DIGITS", digits)
    columns = ["doc_id", "source", "lang", "n_chars", "text", "tree", "rank", "node", "digest"]
    clash = lambda df: df.select(*columns[:5], *[F.lit(0).alias(c) for c in columns[5:]])
    more = odd.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, "\U0001f600").otherwise("￮"))
    both = clash(docs.filter("doc_id < 90")).union(clash(more))
    rows = both.collect()
    got = collections.Counter(tuple(r) for r in manifest.verified_manifest(both).collect())
    want = brute_manifest(rows)
    assert got == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_little(empty, docs):  # noqa: F811
    assert manifest.verified_manifest(empty).count() == 0
    one = manifest.verified_manifest(docs.filter("doc_id = 5")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_values_cannot_run_together(spark):
    rows = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "-"), ("-", None), ("", None)], "a string, b string")
    assert rows.select(manifest.leaf([F.col("a"), F.col("b")]).alias("h")).distinct().count() == 5


# 13. BPE by a queue of merges


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(queries.MERGES_FILE))


def library_ids(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_merges_equal_the_library(tokenizer):
    v, rng = queries.merge_vocabulary(), random.Random(6)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "<|endoftext|>", "<|endof", "'s", "'S", "é", "東", " ", "\x1c", "\x85", "1", "½", "🙂", "x" * 90]
    for _ in range(2000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        ids = v.encode(t).tolist()
        assert ids == library_ids(tokenizer, t)
        assert v.decode(ids) == t
        some = [rng.randrange(50257) for _ in range(12)]
        assert v.decode(some) == tokenizer.decode(some, skip_special_tokens=False)


def test_merges_split_every_character_alike(tokenizer):
    v = queries.merge_vocabulary()
    for first in range(0, 0x110000, 0x1000):
        text = "".join(f"a{chr(c)}1{chr(c)}! {chr(c)}  {chr(c)}b" for c in range(first, first + 0x1000) if not 0xD800 <= c < 0xE000)
        assert v.encode(text).tolist() == library_ids(tokenizer, text)


def test_merges_take_the_lowest_rank_first():
    v = queries.merge_vocabulary()
    rng = random.Random(2)
    for _ in range(200):
        ids = [v.first[b] for b in "".join(rng.choices("theandingoer", k=rng.randint(1, 40))).encode()]
        want = list(ids)
        while True:
            options = [(v.rank[a << 32 | b], i) for i, (a, b) in enumerate(zip(want, want[1:])) if a << 32 | b in v.rank]
            if not options:
                break
            i = min(options)[1]
            want[i : i + 2] = [v.made[v.rank[want[i] << 32 | want[i + 1]]]]
        assert v.merge(ids) == want


def test_merges_odd_rows(odd, empty, tokenizer):  # noqa: F811
    v = queries.merge_vocabulary()
    want = collections.Counter()
    for i, t, _ in ODD:
        ids = library_ids(tokenizer, t or "")
        want[i, len(ids), sha(",".join(map(str, ids))), sha(t or "")] += 1
    assert collections.Counter(tuple(r) for r in merges.token_digests(odd, v).collect()) == want
    assert merges.token_digests(empty, v).count() == 0
    coded = merges.encode(odd, v)
    assert coded.columns == [*[c for c in odd.columns if c != "ids"], "ids"]
    back = merges.decode(coded, v, out="text")
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, _ in ODD)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        merges.Merges(public_tokenizers.path("word_bpe_49k.json"))


def test_memory_is_bounded_in_bytes():
    made = []
    kept = Memory(lambda k: made.append(k) or k.encode() * 10, 4000)
    for i in range(500):
        word = f"w{i % 200}"
        assert kept[word] == word.encode() * 10
        assert sum(map(len, kept.values())) + sum(map(len, kept.older.values())) < 4000
    assert kept["x" * 100] and "x" * 100 not in kept
    assert len(made) > 200


def test_op13_on_the_whole_table(spark, tokenizer, docs):  # noqa: F811
    want = set()
    for r in docs.collect():
        ids = library_ids(tokenizer, r.text or "")
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text or "")))
    assert {tuple(r) for r in queries.op13_bpe(spark, "/root/testdata/sf0.001").collect()} == want


def test_variants_broadcast_nothing(spark, monkeypatch):
    """Tables that grow with the words are sorted and joined, however small Spark takes them for."""
    plans = []
    keep = variants.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(variants, "stored", seen)
    rows = [("abcdefgh", 100), ("abcdefgi", 5), ("abcdefg", 2), ("zyxwvuts", 3)]
    found = variants.variant_groups(spark.createDataFrame(rows, "word string, n long"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not [p for p in plans if "Broadcast" in p]
    assert {r.word: r.root for r in found.collect()} == {
        "abcdefgh": "abcdefgh", "abcdefgi": "abcdefgh", "abcdefg": "abcdefgh", "zyxwvuts": "zyxwvuts"
    }
