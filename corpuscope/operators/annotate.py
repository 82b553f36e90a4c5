"""Token annotation: sentences, tokens, lemmas, parts of speech and heads.

The default annotator is one narrow stage: a document is split into sentences,
each sentence into tokens, and heads are found inside the sentence's own array,
so no shuffle or window is needed however many documents there are. Words are
tagged once per token, before anything filters or groups by the tag.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tagging import TagRules, lemma_of, pos_tag, sentences, tokens
from ..functions.text import strip_html
from .scale import join_by_frequency

DEP_LABELS = {"ADJ": "amod", "DET": "det", "NUM": "nummod"}


def _sentences(corpus: DataFrame) -> DataFrame:
    split = corpus.select(
        "comment_id", "doc_id", F.posexplode(sentences(strip_html("text"))).alias("s", "sentence")
    )
    return split.select("comment_id", "doc_id", (F.col("s") + 1).alias("sentence_id"), "sentence")


def tokenize(corpus: DataFrame) -> DataFrame:
    """One row per sentence with its tokens as an array."""
    return _sentences(corpus).select(
        "comment_id", "doc_id", "sentence_id", tokens(F.col("sentence")).alias("tokens")
    )


def _tagged(exploded: DataFrame, rules: TagRules) -> DataFrame:
    """Rows (i, token, ...) with low and pos.

    The tag is the one entry of an exploded array: a filter or a later expression then reads
    a column, where Spark would otherwise repeat the rules, and ``lower`` for every ending.
    """
    low = exploded.withColumns({"low": F.lower("token"), "first": F.substring("token", 1, 1)})
    pos = pos_tag(F.col("token"), F.col("low"), F.col("i") == 0, rules, F.col("first"))
    return low.select("*", F.explode(F.array(pos)).alias("pos"))


def tagged_tokens(corpus: DataFrame, rules: TagRules | None = None) -> DataFrame:
    """Annotations without heads: what counting and searching need."""
    rules = rules or TagRules()
    # The array is exploded where it is made; of a column Spark would make it twice, to drop empty ones.
    exploded = _sentences(corpus).select(
        "comment_id", "doc_id", "sentence_id", F.posexplode(tokens(F.col("sentence"))).alias("i", "token")
    )
    return _tagged(exploded, rules).select(
        "comment_id",
        "doc_id",
        "sentence_id",
        (F.col("i") + 1).alias("token_id"),
        "token",
        lemma_of(F.col("low"), F.col("pos"), rules).alias("lemma"),
        "pos",
    )


def dep_label(head_found, pos):
    label = F.lit(None).cast("string")
    for tag, name in DEP_LABELS.items():
        label = F.when(pos == tag, F.lit(name)).otherwise(label)
    return F.when(head_found, label).otherwise(F.lit("dep"))


def annotate(corpus: DataFrame, rules: TagRules | None = None) -> DataFrame:
    """Full annotations, one row per token.

    The head of an adjective, determiner or number is the nearest noun among the
    next ``head_window`` tokens of its sentence; any other token, and a modifier
    without such a noun, is its own head.
    """
    rules = rules or TagRules()

    # The whole slice, as an expression: see ``tagged_tokens``.
    every = F.slice("tokens", 1, F.lit(2**31 - 1))
    exploded = tokenize(corpus).select(
        "comment_id", "doc_id", "sentence_id", "tokens", F.posexplode(every).alias("i", "token")
    )
    tagged = _tagged(exploded, rules).withColumn("token_id", F.col("i") + 1)
    # Few words go on with the row, and only those after a modifier.
    next_ones = F.slice("tokens", F.col("i") + 2, F.lit(rules.head_window))
    tagged = tagged.withColumn("ahead", F.when(F.col("pos").isin(*rules.modifiers), next_ones)).drop("tokens")
    tags_ahead = F.zip_with(
        "ahead", F.transform("ahead", F.lower), lambda t, l: pos_tag(t, l, F.lit(False), rules)
    )
    # Never null, or a join by the head would look for all heads to drop those that are.
    noun_at = F.coalesce(F.array_position(tags_ahead, F.lit("NOUN")).cast("int"), F.lit(0))
    offset = F.when(F.col("pos").isin(*rules.modifiers), noun_at).otherwise(F.lit(0))
    headed = tagged.withColumn("offset", offset)
    return headed.select(
        "comment_id",
        "doc_id",
        "sentence_id",
        "token_id",
        "token",
        lemma_of(F.col("low"), F.col("pos"), rules).alias("lemma"),
        "pos",
        (F.col("token_id") + F.col("offset")).alias("head_token_id"),
        dep_label(F.col("offset") > 0, F.col("pos")).alias("dep_rel"),
    )


def assign_heads(tokens_df: DataFrame, rules: TagRules | None = None) -> DataFrame:
    """Heads for an existing token table, by a window inside each sentence."""
    rules = rules or TagRules()
    ahead = (
        W.partitionBy("doc_id", "sentence_id")
        .orderBy("token_id")
        .rowsBetween(1, rules.head_window)
    )
    noun_id = F.first(F.when(F.col("pos") == "NOUN", F.col("token_id")), ignorenulls=True)
    found = F.when(F.col("pos").isin(*rules.modifiers), noun_id.over(ahead))
    return (
        tokens_df.withColumn("__noun", found)
        .withColumn("head_token_id", F.coalesce("__noun", "token_id"))
        .withColumn("dep_rel", dep_label(F.col("__noun").isNotNull(), F.col("pos")))
        .drop("__noun")
    )


def annotate_with_lexicon(
    corpus: DataFrame, lexicon: DataFrame, rules: TagRules | None = None
) -> DataFrame:
    """Annotations where a lexicon (word, lemma, pos) overrides the rules.

    Only the corpus's own words are looked up: the vocabulary is counted, joined
    with the lexicon, and joined back with its counts at hand, so the words that
    make up most of a text are served by a bounded broadcast.
    """
    rules = rules or TagRules()
    base = tagged_tokens(corpus, rules).withColumn("word", F.lower("token"))
    entries = lexicon.select(
        "word", F.col("lemma").alias("__lemma"), F.col("pos").alias("__pos")
    ).dropDuplicates(["word"])
    vocabulary = base.groupBy("word").agg(F.count("*").alias("__n")).join(entries, "word", "left")
    looked_up = join_by_frequency(base, vocabulary, "word", "__n")
    tagged = looked_up.select(
        "comment_id",
        "doc_id",
        "sentence_id",
        "token_id",
        "token",
        F.coalesce("__lemma", "lemma").alias("lemma"),
        F.coalesce("__pos", "pos").alias("pos"),
    )
    return assign_heads(tagged, rules)


def annotate_pending(
    corpus: DataFrame,
    done: DataFrame | None = None,
    annotator: Callable[[DataFrame], DataFrame] = annotate,
    force: bool = False,
) -> DataFrame:
    """Annotate only documents without stored annotations.

    Refuses, through a failing row check, a text of length zero. ``annotator``
    may be any function with the output columns of ``annotate``, for instance
    one built on ``mapInPandas`` with a trained parser.
    """
    todo = corpus
    if done is not None and not force:
        todo = corpus.join(done.select("doc_id").distinct(), "doc_id", "left_anti")
    bad = F.concat(F.lit("nothing to annotate: empty text of document "), F.col("doc_id"))
    checked = F.when(F.length("text") == 0, F.raise_error(bad)).otherwise(F.col("text"))
    return annotator(todo.withColumn("text", checked))


def head_quality(annotations: DataFrame) -> DataFrame:
    """Adjectives, and how many of their heads are not whole numbers."""
    adjectives = annotations.filter(F.col("pos") == "ADJ")
    head = F.col("head_token_id").cast("string").try_cast("double")
    whole = head.isNotNull() & (head == F.floor(head))
    return adjectives.agg(
        F.count("*").alias("n_adjectives"),
        F.sum(F.when(F.coalesce(whole, F.lit(False)), 0).otherwise(1)).alias("n_bad_heads"),
    )
