"""Rule-based tokens, parts of speech and lemmas as column expressions.

A statistical parser is outside Spark's reach; these rules give the same
columns with fixed, documented meaning. ``TagRules`` holds all word lists, so a
project can pass its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentences end at whitespace that follows a terminator.
SENTENCE_GAP = r"(?<=[.!?])\s+"

# A URL, a number, a word with inner apostrophes, or any other visible character.
TOKEN = (
    r"(?:https?://|www\.)[^\s<>]+"
    r"|[0-9]+(?:[.,][0-9]+)*"
    r"|\p{L}[\p{L}\p{M}]*(?:['’]\p{L}+)*"
    r"|\S"
)

URL_STARTS = ("http://", "https://", "www.")

# English closed-class words by part of speech.
CLOSED_CLASS = {
    "DET": "a an the this that these those each every some any no all both".split(),
    "PRON": (
        "i you he she it we they me him her us them my your his its our their "
        "who whom whose which what myself yourself itself themselves"
    ).split(),
    "ADP": (
        "of in on at by for with from into onto over under about against between "
        "through during before after above below up down out off as"
    ).split(),
    "CCONJ": "and or but nor".split(),
    "SCONJ": "if because although while since unless whereas".split(),
    "PART": "to not".split(),
    "AUX": (
        "is are was were be been being am do does did have has had can could "
        "will would shall should may might must"
    ).split(),
    "ADV": "very too also so just only then there here now never always often".split(),
}

# Word endings by part of speech, longest families first.
SUFFIXES = {
    "ADV": ["ly"],
    "ADJ": ["ble", "ful", "ous", "ive", "less", "ical", "ific", "ish"],
    "NOUN": ["tion", "sion", "ment", "ness", "ity", "ism", "ence", "ance", "ship"],
    "VERB": ["ing", "ed", "ize", "ify"],
}

# Plural noun endings and what replaces them.
PLURALS = [("sses", "ss"), ("ies", "y"), ("ss", "ss"), ("us", "us"), ("is", "is"), ("s", "")]


@dataclass(frozen=True)
class TagRules:
    closed_class: dict = field(default_factory=lambda: CLOSED_CLASS)
    suffixes: dict = field(default_factory=lambda: SUFFIXES)
    plurals: list = field(default_factory=lambda: PLURALS)
    modifiers: tuple = ("ADJ", "DET", "NUM")
    head_window: int = 4


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_GAP)


def tokens(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(TOKEN), F.lit(0))


def pos_tag(
    token: Column, low: Column, first_in_sentence: Column, rules: TagRules, first: Column | None = None
) -> Column:
    """Part of speech of a token; ``low`` is its lower case and ``first`` its first character.

    Cheap tests come first: the first character decides between words and the
    rest, one set lookup settles whether a word is of a closed class at all, and
    endings are compared as strings. Regular expressions see one character.
    """
    first = F.substring(token, 1, 1) if first is None else first
    closed = None
    for pos, words in rules.closed_class.items():
        hit = low.isin(words)
        closed = F.when(hit, pos) if closed is None else closed.when(hit, pos)
    known = [w for words in rules.closed_class.values() for w in words]
    word = F.when(is_url(token), F.lit("X")).when(low.isin(known), closed)
    for pos, endings in rules.suffixes.items():
        word = word.when(reduce(or_, [low.endswith(e) for e in endings]), pos)
    capital = (first != F.lower(first)) & ~first_in_sentence
    word = word.when(capital, "PROPN").otherwise("NOUN")
    other = (
        F.when(first.between("0", "9"), "NUM").when(first.rlike(r"\p{P}"), "PUNCT").otherwise("SYM")
    )
    letter = first.between("a", "z") | first.between("A", "Z") | first.rlike(r"\p{L}")
    return F.when(letter, word).otherwise(other)


def is_url(token: Column) -> Column:
    return reduce(or_, [token.startswith(s) for s in URL_STARTS])


def lemma_of(low: Column, pos: Column, rules: TagRules) -> Column:
    """Lower case; nouns of more than three letters also lose a plural ending."""
    plural = (pos == "NOUN") & (F.length(low) > 3)
    plural = plural & reduce(or_, [low.endswith(e) for e, _ in rules.plurals])
    lemma = None
    for ending, replacement in rules.plurals:
        stem = F.substring(low, F.lit(1), F.length(low) - len(ending))
        new = F.concat(stem, F.lit(replacement))
        hit = low.endswith(ending)
        lemma = F.when(hit, new) if lemma is None else lemma.when(hit, new)
    return F.when(plural, lemma).otherwise(low)
