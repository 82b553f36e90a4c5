"""5. Token counts without token ids.

No piece of the vocabulary goes on behind a space or a line end, so a text falls
into pre-tokens that are encoded independently: runs of spaces with the word after
them, and runs of line ends. Each distinct pre-token of the corpus is counted once
by the library; a document's count is the sum over its pre-tokens.

Pre-tokens that make up more than 1/HOT of all occurrences, fewer than HOT by
arithmetic and far fewer in real texts, are looked up from a broadcast; only the rest
is shuffled to its count, with one row per document and pre-token.

Cases: null and empty texts have 0 bytes and 0 tokens; a text of any length is
counted whole; every row gives a row, rows that repeat a doc_id too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches, stored, text_of

HOT = 1_500_000
UNIT = 64
#: What ends a pre-token: a space or line end behind anything else, or the reverse of a line end.
BORDER = r"(?<=[^ ])(?= )|(?<=[^\n])(?=\n)|(?<=\n)(?=[^\n])"
#: The same pre-tokens as matches.
PIECES = r" *[^ \n]+| +|\n+"


def check_vocabulary(model: str) -> None:
    """The sum over pre-tokens is exact only for such a vocabulary."""
    import re

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any("\n" in p or re.search("[^▁]▁", p) for p in pieces):
        raise ValueError("a piece of this vocabulary goes on behind a space or a line end")
    odd = "  ﬁ①  Å\u00a0e\u0301\r "
    if sp.decode(sp.encode(odd)) != odd:
        raise ValueError("this vocabulary changes texts before it encodes them")


def pre_tokens(text: Column) -> Column:
    """The model puts one space before a text that isn't empty."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(F.concat(F.lit(" "), text), BORDER)
    )


def piece_counts(distinct: DataFrame, model: str) -> DataFrame:
    """Add ``n``, the number of tokens of the pre-token in column ``piece``."""
    small_batches(distinct.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        # The library puts a space before every text; a line end keeps it apart.
        extra = len(sp.encode("\n"))
        for batch in batches:
            texts = ["\n" + x for x in batch.column("piece").to_pylist()]
            n = pa.array([len(x) - extra for x in sp.encode(texts, num_threads=1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], [*batch.schema.names, "n"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema]
    return distinct.mapInArrow(run, ", ".join([*fields, "n long"]))


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """key, n_bytes and n_tokens of every row."""
    check_vocabulary(model)
    body = text_of(text)
    small_batches(docs.sparkSession)
    counted = (
        docs.select(F.explode(pre_tokens(body)).alias("piece")).groupBy("piece").agg(F.count("*").alias("freq"))
    )
    vocabulary = stored(piece_counts(counted, model), "pre-tokens")
    total = vocabulary.agg(F.sum("freq")).first()[0] or 0
    # A piece of more bytes has to be more frequent, so all of them hold at most hot * UNIT bytes.
    is_hot = F.col("freq") * hot > F.lit(total) * F.ceil(F.octet_length("piece") / F.lit(UNIT))
    frequent = docs.sparkSession.sparkContext.broadcast(
        {r.piece: r.n for r in vocabulary.filter(is_hot).select("piece", "n").collect()}
    )
    rare = vocabulary.filter(~is_hot).select("piece", "n")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with the tokens of its frequent pre-tokens, one for each rare pre-token."""
        import re
        from collections import Counter

        find, known = re.compile(PIECES).findall, frequent.value.get
        for b in batches:
            rows, keys, sizes, pieces, ms = [], [], [], [], []
            for row, k, t in zip(b.column("row").to_pylist(), b.column("key").to_pylist(), b.column("t").to_pylist()):
                tokens = 0
                for piece, tf in Counter(find(" " + t) if t else ()).items():
                    n = known(piece)
                    if n is None:
                        rows.append(row)
                        keys.append(None)
                        sizes.append(None)
                        pieces.append(piece)
                        ms.append(tf)
                    else:
                        tokens += tf * n
                rows.append(row)
                keys.append(k)
                sizes.append(len(t.encode()))
                pieces.append(f"\n{row}")  # no pre-token, and spread over the tasks
                ms.append(tokens)
                if len(rows) > 100_000:
                    yield batch_of(rows, keys, sizes, pieces, ms)
                    rows, keys, sizes, pieces, ms = [], [], [], [], []
            yield batch_of(rows, keys, sizes, pieces, ms)

    def batch_of(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["row", "key", "n_bytes", "piece", "m"])

    # The number of a row goes only with what this one pass makes of it.
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), body.alias("t"))
    types = (pa.int64(), to_arrow_type(own.schema["key"].dataType), pa.int64(), pa.string(), pa.int64())
    rows = own.mapInArrow(
        frequencies, f"row long, key {own.schema['key'].dataType.simpleString()}, n_bytes long, piece string, m long"
    )
    sums = rows.join(rare, "piece", "left").groupBy("row").agg(
        F.max("key").alias(key), F.max("n_bytes").alias("n_bytes"),
        F.sum(F.col("m") * F.coalesce("n", F.lit(1))).alias("n_tokens"),
    )
    return sums.select(key, "n_bytes", "n_tokens")


def token_limits(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    return count_tokens(docs, model).withColumn("over_limit", F.col("n_tokens") > limit)
