"""Time the headline steps at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

stored; the later steps read the stored tables.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.operators import compare as S
from corpuscope.operators import embedding as E
from corpuscope.operators import pca as P
from corpuscope.operators import tokens as K
from corpuscope.operators import vocab as B
from corpuscope.operators.annotate import annotate
from corpuscope.operators.corpus import form_letters, kwic
from corpuscope.plans import inputs as I
from corpuscope.plans.ingest import attachment_text
from corpuscope.plans.text import PHRASES
from corpuscope.session import fresh_path, local_session

KEYWORDS = {"first": "(?!(?-i)The of)(the of)", "second": "ertion|ontion", "third": "ness|ment"}


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, f):
        start = time.time()
        out = f()
        times[name] = round(time.time() - start, 3)
        return out

    def store(name: str, df: DataFrame) -> DataFrame:
        path = fresh_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    run(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())  # start the engine

    timed("attachment_text", lambda: run(attachment_text(spark, sf_dir)))
    corpus = timed("build_corpus", lambda: store("corpus", I.corpus(spark, sf_dir)))
    ann = timed("annotate", lambda: store("annotations", annotate(corpus)))
    codings = timed("codings", lambda: store("codings", I.codings(spark, sf_dir)))

    def entropy(pos: str):
        dtm = ann.filter(F.col("pos") == pos).groupBy("comment_id", "lemma").agg(F.count("*").alias("n"))
        run(B.entropy_scores(dtm, "comment_id", "lemma").orderBy(F.desc("ndH")))

    timed("verb_entropy", lambda: entropy("VERB"))
    timed("noun_entropy", lambda: entropy("NOUN"))

    def bigram_entropy():
        bigrams = store("bigrams", B.adj_noun_bigrams(ann, I.NOUNS))
        scores = store("scores", B.entropy_scores(bigrams, "comment_id", "bigram"))
        return store("vocab", B.select_vocab(bigrams, scores))

    vocab = timed("bigram_entropy", bigram_entropy)

    def components():
        pc = P.pca(vocab, 5)
        run(P.pc_loadings(pc))

    timed("pca", components)
    timed("pos_distribution", lambda: run(K.pos_distribution(ann)))
    dtm = timed("doc_term_matrix", lambda: store("dtm", K.doc_term_matrix(ann)))
    timed("length_quantiles", lambda: run(K.length_quantiles(dtm)))
    timed("mean_idf", lambda: run(K.mean_idf(dtm)))
    timed("form_letters", lambda: run(form_letters(corpus, PHRASES)))
    timed("kwic", lambda: run(kwic(corpus, "tion of")))
    timed("keyword_occurrence", lambda: run(S.keyword_occurrence(corpus, codings, KEYWORDS)))

    def llr():
        coded = store("coded", S.coded_bigrams(vocab, codings))
        run(S.llr_extremes(S.bigram_llr(S.bigram_occurrence(coded)), 10))

    timed("bigram_llr", llr)
    timed("token_llr", lambda: run(S.llr_extremes(S.token_llr(ann, codings), 15, "lemma")))

    def pmi():
        content = store("content", E.content_tokens(ann))
        run(E.pmi(content))

    timed("pmi", pmi)

    print(
        json.dumps(
            {
                "metric": "total wall-clock of the analysis steps",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
