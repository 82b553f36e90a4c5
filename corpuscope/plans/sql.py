"""Common table expressions for the checking SQL (DuckDB dialect).

They state the inputs independently of the Spark code: sentences by a consuming
pattern instead of a split, heads by a window instead of arrays, co-occurrence by
a self-join. Only the word lists are shared, being fixed values.
"""

from __future__ import annotations

from ..functions.tagging import CLOSED_CLASS, PLURALS, SUFFIXES, TOKEN, TagRules
from .inputs import CODERS, NOUNS


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def text_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SENTENCE = r"(?s)(?:.*?[.!?]+(?:\s+|\z)|.+)"

_POS = "\n".join(
    [
        "CASE WHEN regexp_matches(token, '^(?:https?://|www\\.)') THEN 'X'",
        "WHEN regexp_matches(token, '^[0-9]') THEN 'NUM'",
        "WHEN regexp_matches(token, '^\\p{P}') THEN 'PUNCT'",
        "WHEN NOT regexp_matches(token, '^\\p{L}') THEN 'SYM'",
        *[f"WHEN lower(token) IN ({quoted(w)}) THEN '{p}'" for p, w in CLOSED_CLASS.items()],
        *[
            "WHEN " + " OR ".join(f"ends_with(lower(token), '{x}')" for x in e) + f" THEN '{p}'"
            for p, e in SUFFIXES.items()
        ],
        "WHEN regexp_matches(token, '^\\p{Lu}') AND token_id > 1 THEN 'PROPN'",
        "ELSE 'NOUN' END",
    ]
)

_LEMMA = "\n".join(
    [
        "CASE WHEN pos <> 'NOUN' OR length(token) <= 3 THEN lower(token)",
        *[
            f"WHEN ends_with(lower(token), '{e}') THEN "
            f"left(lower(token), length(token) - {len(e)}) || '{r}'"
            for e, r in PLURALS
        ],
        "ELSE lower(token) END",
    ]
)

_WINDOW = TagRules().head_window

_SHEETS = " UNION ALL ".join(
    f"""SELECT '{c}' AS coder, CAST(doc_id AS VARCHAR) AS comment_id,
      'https://www.regulations.gov/comment/' || doc_id AS url,
      {'upper' if k == 1 else ''}(CASE WHEN (doc_id + {k}) % 31 = 0 THEN 'NA'
        WHEN (doc_id + {7 * k}) % 21 = 0 THEN (CASE WHEN quality = 1 THEN 'y' ELSE 'n' END)
        ELSE (CASE WHEN quality = 1 THEN 'n' ELSE 'y' END) END) AS support,
      CASE WHEN toxic = 1 THEN 'note {k}' END AS notes FROM labels"""
    for k, c in enumerate(CODERS)
)

# name -> (names it builds on, query)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": (
        (),
        """SELECT CAST(doc_id AS VARCHAR) AS comment_id, CAST(0 AS INTEGER) AS docOrder, text FROM documents
        UNION ALL SELECT CAST(conv_id AS VARCHAR), CAST(turn + 1 AS INTEGER), text FROM conversations""",
    ),
    "corpus": (
        ("docs",),
        """SELECT comment_id, comment_id || '-' || docOrder AS doc_id, text, docOrder,
          CAST(length(text) AS INTEGER) AS len FROM docs
        WHERE length(text) > 100 AND length(text) < 1000000""",
    ),
    "sents": (
        ("corpus",),
        f"""SELECT comment_id, doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS sentence_id
        FROM (SELECT comment_id, doc_id, regexp_extract_all(
          regexp_replace(text, '(?s)<.*?>', ' ', 'g'), {text_literal(_SENTENCE)}) AS l FROM corpus)""",
    ),
    "toks": (
        ("sents",),
        f"""SELECT comment_id, doc_id, sentence_id, unnest(l) AS token, generate_subscripts(l, 1) AS token_id
        FROM (SELECT comment_id, doc_id, sentence_id, regexp_extract_all(s, {text_literal(TOKEN)}) AS l FROM sents)""",
    ),
    "tagged": (("toks",), f"SELECT *, {_POS} AS pos FROM toks"),
    "tokens": (("tagged",), f"SELECT *, {_LEMMA} AS lemma FROM tagged"),
    "annotations": (
        ("tokens",),
        f"""SELECT *, CASE WHEN pos IN ('ADJ', 'DET', 'NUM') AND noun_id IS NOT NULL THEN noun_id ELSE token_id END AS head_token_id
        FROM (SELECT *, first_value(CASE WHEN pos = 'NOUN' THEN token_id END IGNORE NULLS) OVER (
          PARTITION BY doc_id, sentence_id ORDER BY token_id
          ROWS BETWEEN 1 FOLLOWING AND {_WINDOW} FOLLOWING) AS noun_id FROM tokens)""",
    ),
    "bigrams": (
        ("annotations",),
        f"""SELECT a.comment_id, a.lemma || '_' || h.lemma AS bigram, count(*) AS n
        FROM annotations a JOIN annotations h ON a.doc_id = h.doc_id AND a.sentence_id = h.sentence_id
          AND a.head_token_id = h.token_id
        WHERE a.pos = 'ADJ' AND a.lemma <> '-' AND h.pos = 'NOUN' AND h.token IN ({quoted(NOUNS)})
        GROUP BY 1, 2""",
    ),
    "scores": (
        ("bigrams",),
        """SELECT bigram, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_docs, sum(-p * log2(p)) AS H,
          log2((SELECT count(DISTINCT comment_id) FROM bigrams)) - sum(-p * log2(p)) AS dH
        FROM (SELECT *, n / sum(n) OVER (PARTITION BY bigram) AS p FROM bigrams) GROUP BY bigram""",
    ),
    "vocab_bigrams": (
        ("bigrams", "scores"),
        "SELECT * FROM bigrams WHERE bigram IN (SELECT bigram FROM scores WHERE H > 1e-9)",
    ),
    "dtm": (
        ("tokens",),
        """SELECT comment_id, lemma, count(*) AS n FROM tokens
        WHERE pos NOT IN ('PUNCT', 'SPACE', 'SYM', 'X', 'NUM') GROUP BY 1, 2""",
    ),
    "sheets": ((), _SHEETS),
    "codes": (
        ("sheets",),
        "SELECT coder, comment_id, url, notes, CASE WHEN support = 'NA' THEN 'NA' ELSE lower(support) END AS support FROM sheets",
    ),
    "votes": (
        ("codes",),
        """SELECT comment_id, support, c, first_coder, max(c) OVER (PARTITION BY comment_id) AS top
        FROM (SELECT comment_id, support, count(*) AS c, min(coder) AS first_coder FROM codes GROUP BY 1, 2)""",
    ),
    "modes": (
        ("votes",),
        """SELECT comment_id, string_agg(support, '' ORDER BY first_coder) AS mode
        FROM votes WHERE c = top GROUP BY 1""",
    ),
    "imputed": (
        (),
        """SELECT comment_id, text, pred_oppose, CASE WHEN pred_oppose > 0.5 THEN 'oppose' ELSE 'support' END AS pred_class
        FROM (SELECT CAST(doc_id AS VARCHAR) AS comment_id, text, ((doc_id * 7919) % 1000) / 1000.0::DOUBLE AS pred_oppose FROM documents)""",
    ),
    "codings": (
        ("modes", "imputed"),
        """SELECT 'manual' AS coding, comment_id, CASE mode WHEN 'y' THEN 'support' WHEN 'n' THEN 'oppose' END AS support FROM modes
        UNION ALL SELECT 'filtered', comment_id, pred_class FROM imputed WHERE pred_oppose < 1 - 0.8::DOUBLE OR pred_oppose > 0.8::DOUBLE
        UNION ALL SELECT 'imputed', comment_id, pred_class FROM imputed""",
    ),
    "coded": (
        ("vocab_bigrams", "codings"),
        """SELECT c.coding, c.support, b.comment_id, b.bigram, b.n, regexp_extract(b.bigram, '[^_]*$') AS noun
        FROM vocab_bigrams b JOIN codings c ON b.comment_id = c.comment_id
        WHERE c.support IN ('support', 'oppose')""",
    ),
    "side_docs": (
        ("coded",),
        "SELECT coding, support, count(DISTINCT comment_id) AS n_docs FROM coded GROUP BY 1, 2",
    ),
    "p_bigram": (
        ("coded", "side_docs"),
        """SELECT coding, support, bigram, count(DISTINCT comment_id) AS df, any_value(n_docs) AS n_docs,
          count(DISTINCT comment_id) / any_value(n_docs)::DOUBLE AS p
        FROM coded JOIN side_docs USING (coding, support) GROUP BY 1, 2, 3""",
    ),
    "llr": (
        ("p_bigram",),
        """SELECT coding, bigram, oppose, support, log10(oppose + 1e-5) - log10(support + 1e-5) AS llr
        FROM (SELECT coding, bigram, coalesce(max(p) FILTER (support = 'oppose'), 0) AS oppose,
          coalesce(max(p) FILTER (support = 'support'), 0) AS support FROM p_bigram GROUP BY 1, 2)""",
    ),
    "lemma_llr": (
        ("tokens", "codings"),
        """SELECT coding, lemma, oppose, support, ln(1 + oppose) - ln(1 + support) AS llr FROM (
          SELECT coding, lemma, coalesce(max(share) FILTER (support = 'oppose'), 0) AS oppose,
            coalesce(max(share) FILTER (support = 'support'), 0) AS support
          FROM (SELECT c.coding, c.support, t.lemma, count(DISTINCT t.comment_id) / any_value(s.total)::DOUBLE AS share
            FROM (SELECT DISTINCT comment_id, lemma FROM tokens) t JOIN codings c USING (comment_id)
            JOIN (SELECT coding, support, count(*) AS total FROM codings WHERE support IS NOT NULL GROUP BY 1, 2) s
              ON s.coding = c.coding AND s.support = c.support
            GROUP BY 1, 2, 3) GROUP BY 1, 2)""",
    ),
    "content": (
        ("tokens",),
        """SELECT lemma || '_' || pos AS token, doc_id || '-' || sentence_id AS context_id
        FROM tokens WHERE pos IN ('ADJ', 'NOUN', 'VERB', 'ADV')""",
    ),
    "unigrams": (
        ("content",),
        "SELECT token, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM content GROUP BY 1",
    ),
}


def sql(body: str, *names: str) -> str:
    """The query with every table expression it needs, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    # Expressions read more than once are kept, so their work is done once.
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered]
    return "WITH " + ",\n".join(parts) + "\n" + body
