"""Relational verbs over the business and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import is_in, not_in
from ..functions.text import detect
from ..operators import tables as V
from ..operators.annotate import assign_heads
from ..operators import corpus as corpus_ops
from . import inputs as I
from .catalog import query
from .sql import sql


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return I.table(spark, sf_dir, name)


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Round for comparison: all double columns, or the named ones."""
    chosen = names or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, 6) for c in chosen})


# --- projections and filters ---------------------------------------------------


@query("SELECT c_name AS name, c_custkey AS id, c_mktsegment AS segment FROM customer")
def project_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")
    )


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def select_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.columns_like(t(spark, sf_dir, "lineitem"), starts="l_", ends="key")


@query("SELECT n_nationkey AS nationkey, n_name AS name, n_regionkey AS regionkey FROM nation")
def rename_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.rename_with(t(spark, sf_dir, "nation"), lambda c: c.removeprefix("n_"), "n_").select(
        "nationkey", "name", "regionkey"
    )


@query(
    """SELECT doc_id, CAST(sign(quality) AS INTEGER) AS quality, CAST(sign(toxic) AS INTEGER) AS toxic FROM labels"""
)
def across_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.across(
        t(spark, sf_dir, "labels"), ["quality", "toxic"], lambda c: F.signum(c).cast("int")
    )


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars < 1000000 AND n_chars > 100")
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return t(spark, sf_dir, "documents").filter((n < 1_000_000) & (n > 100)).select("doc_id", "n_chars")


_MAYBE = """(SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query(f"SELECT doc_id, toxic FROM {_MAYBE} WHERE toxic IS NULL OR toxic NOT IN (1, 2)")
def null_safe_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null is not in the set, so anti-membership keeps it."""
    joined = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", "toxic").filter(not_in("toxic", [1, 2]))


@query(f"SELECT doc_id FROM {_MAYBE} WHERE toxic IN (1, 2)")
def null_safe_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.filter(is_in("toxic", [1, 2])).select("doc_id")


@query("SELECT event_id, value FROM events WHERE value < 1 OR value > 90")
def disjunctive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return t(spark, sf_dir, "events").filter((v < 1) | (v > 90)).select("event_id", "value")


@query(f"SELECT toxic IS NULL AS missing, count(*) AS n FROM {_MAYBE} GROUP BY 1")
def null_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy(F.col("toxic").isNull().alias("missing")).agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, regexp_matches(text, 'tion') AS cased, regexp_matches(text, '(?i)tion') AS uncased,
  contains(lower(text), 'the of') AS phrase FROM documents"""
)
def regex_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select(
        "doc_id",
        detect("text", "tion").alias("cased"),
        detect("text", "tion", ignore_case=True).alias("uncased"),
        F.lower("text").contains("the of").alias("phrase"),
    )


@query(
    """SELECT doc_id, CASE WHEN quality = 0 THEN 'support' WHEN toxic = 0 THEN 'oppose' END AS side FROM labels"""
)
def conditional_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("quality") == 0, "support").when(F.col("toxic") == 0, "oppose")
    return t(spark, sf_dir, "labels").select("doc_id", side.alias("side"))


@query(
    """SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\\s<>]+')) AS url FROM documents"""
)
def unnest_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty list gives no row."""
    urls = F.regexp_extract_all("text", F.lit(r"https?://[^\s<>]+"), F.lit(0))
    return t(spark, sf_dir, "documents").select("doc_id", F.explode(urls).alias("url"))


# --- joins ------------------------------------------------------------------------


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def inner_join_renamed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name")


@query(
    sql(
        """SELECT a.comment_id, a.doc_id, CAST(a.sentence_id AS INTEGER) AS sentence_id, CAST(a.token_id AS INTEGER) AS token_id,
  a.lemma AS lemma_x, h.lemma AS lemma_y
FROM (SELECT comment_id, doc_id, sentence_id, token_id, head_token_id, lemma FROM annotations WHERE pos = 'ADJ') a
JOIN (SELECT doc_id, sentence_id, token_id, lemma FROM annotations WHERE pos = 'NOUN') h
  ON a.doc_id = h.doc_id AND a.sentence_id = h.sentence_id AND a.head_token_id = h.token_id""",
        "annotations",
    )
)
def dependency_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four keys, one of them renamed: adjectives with the nouns they belong to."""
    a = I.annotations(spark, sf_dir)
    keys = ["comment_id", "doc_id", "sentence_id", "head_token_id"]
    nouns = a.filter("pos = 'NOUN'").select(
        "comment_id", "doc_id", "sentence_id", F.col("token_id").alias("head_token_id"), F.col("lemma").alias("lemma_y")
    )
    adjectives = a.filter("pos = 'ADJ'").select(*keys, "token_id", F.col("lemma").alias("lemma_x"))
    return adjectives.join(nouns, keys).drop("head_token_id")


@query(
    """SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", "quality"
    )


@query(
    """SELECT DISTINCT doc_id, lang, n FROM documents NATURAL JOIN
  (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)"""
)
def natural_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join on all common columns, named explicitly."""
    docs = t(spark, sf_dir, "documents")
    counts = docs.groupBy("lang", "source").agg(F.count("*").alias("n"))
    common = [c for c in docs.columns if c in counts.columns]
    return docs.join(counts, common, "left").select("doc_id", "lang", "n")


@query(
    """SELECT a.l_orderkey, a.l_partkey, a.l_suppkey, p.p_name AS name1, s.s_name AS name2 FROM lineitem a
  LEFT JOIN part p ON a.l_partkey = p.p_partkey LEFT JOIN supplier s ON a.l_suppkey = s.s_suppkey"""
)
def double_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name1"))
    suppliers = t(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name2")
    )
    items = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return items.join(parts, "l_partkey", "left").join(suppliers, "l_suppkey", "left").select(
        "l_orderkey", "l_partkey", "l_suppkey", "name1", "name2"
    )


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = t(spark, sf_dir, "labels").filter("quality = 1")
    return t(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select("doc_id", "n_chars")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = t(spark, sf_dir, "labels").select("doc_id").distinct()
    return t(spark, sf_dir, "documents").join(labelled, "doc_id", "left_anti").select("doc_id", "n_chars")


@query(
    """SELECT u.user_id, e.event_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM events) u
  CROSS JOIN (SELECT DISTINCT event_type FROM events) e
  LEFT JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) c
    ON c.user_id = u.user_id AND c.event_type = e.event_type"""
)
def complete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user with every event type, absent pairs as 0, without a cross join."""
    counts = t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return V.complete(counts, ["user_id"], "event_type", "n")


@query(
    """SELECT d.doc_id, d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS flagged FROM documents d"""
)
def mark_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = t(spark, sf_dir, "labels").filter("toxic = 1")
    return V.mark(t(spark, sf_dir, "documents").select("doc_id"), toxic, "doc_id", "flagged")


# --- aggregation ---------------------------------------------------------------------


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def count_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query(
    """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS top, bool_or(value > 99) AS any_high
FROM events GROUP BY 1"""
)
def summarize_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.round(F.sum("value"), 4).alias("total"),
        F.max("value").alias("top"),
        F.bool_or(F.col("value") > 99).alias("any_high"),
    )


@query(
    """SELECT lang, CAST(sum(CASE WHEN a THEN 1 ELSE 0 END) AS BIGINT) AS a_sum, round(avg(CASE WHEN a THEN 1.0 ELSE 0.0 END), 6) AS a_mean,
  CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) AS BIGINT) AS b_sum, round(avg(CASE WHEN b THEN 1.0 ELSE 0.0 END), 6) AS b_mean
FROM (SELECT lang, contains(text, 'tion') AS a, contains(text, 'http') AS b FROM documents) GROUP BY 1"""
)
def boolean_sum_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = t(spark, sf_dir, "documents").select(
        "lang", F.col("text").contains("tion").alias("a"), F.col("text").contains("http").alias("b")
    )
    return r6(flags.groupBy("lang").agg(*V.sum_and_mean(["a", "b"])))


@query(
    """SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 2) AS mean,
  round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 6) AS median FROM lineitem GROUP BY 1, 2"""
)
def mean_median_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = t(spark, sf_dir, "lineitem")
    by = ["l_returnflag", "l_linestatus"]
    both = V.exact_quantiles(items, "l_extendedprice", {"median": 0.5}, by, moments=True)
    return both.select(*by, F.round("mean", 2).alias("mean"), F.round("median", 6).alias("median"))


_PROBS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p100": 1.0}


@query(
    "SELECT "
    + ", ".join(f"round(quantile_cont(value, {p}), 6) AS {k}" for k, p in _PROBS.items())
    + " FROM events"
)
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(V.exact_quantiles(t(spark, sf_dir, "events"), "value", _PROBS))


@query(
    """SELECT min(n)::DOUBLE AS min, round(quantile_cont(n, 0.25), 6) AS q1, round(quantile_cont(n, 0.5), 6) AS median,
  round(avg(n), 6) AS mean, round(quantile_cont(n, 0.75), 6) AS q3, max(n)::DOUBLE AS max
FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)"""
)
def six_number_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return r6(V.six_numbers(per, "n"))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_suppkey").alias("suppliers")
    )


@query(
    """SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS discount FROM lineitem GROUP BY 1"""
)
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = t(spark, sf_dir, "lineitem")
    x, w = F.col("l_discount").cast("double"), F.col("l_quantity").cast("double")
    return r6(items.groupBy("l_returnflag").agg(V.weighted_mean(x, w).alias("discount")))


@query("SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY 1")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(V.count_share(t(spark, sf_dir, "documents"), "lang"))


@query(
    sql(
        "SELECT comment_id, string_agg(text, chr(10) ORDER BY docOrder) AS text FROM corpus GROUP BY 1",
        "corpus",
    )
)
def concat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_ops.concat_texts(I.corpus(spark, sf_dir))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query(
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1"""
)
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return V.keep_first(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    """SELECT user_id, coalesce(max(n) FILTER (event_type = 'click'), 0) AS click, coalesce(max(n) FILTER (event_type = 'view'), 0) AS view,
  coalesce(max(n) FILTER (event_type = 'error'), 0) AS error
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1"""
)
def pivot_one_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return V.pivot_fill(counts, ["user_id"], "event_type", "n", ["click", "view", "error"])


@query(
    """SELECT source, max(n) FILTER (lang = 'en') AS n_en, max(n) FILTER (lang = 'fr') AS n_fr,
  max(longest) FILTER (lang = 'en') AS longest_en, max(longest) FILTER (lang = 'fr') AS longest_fr
FROM (SELECT source, lang, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY 1, 2) GROUP BY 1"""
)
def pivot_two_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = t(spark, sf_dir, "documents").groupBy("source", "lang").agg(
        F.count("*").alias("n"), F.max("n_chars").alias("longest")
    )
    return V.pivot_many(stats, ["source"], "lang", ["n", "longest"], ["en", "fr"])


@query(
    sql(
        """SELECT comment_id, count(*) FILTER (support = 'n') AS total_n, count(DISTINCT support) = 1 AS identical FROM codes GROUP BY 1""",
        "codes",
    )
)
def row_wise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and equality across the coders' columns of a wide table."""
    coding = I.coding(spark, sf_dir)
    total = sum((F.when(F.col(f"support_{c}") == "n", 1).otherwise(0) for c in I.CODERS), F.lit(0))
    return coding.select("comment_id", total.cast("long").alias("total_n"), "identical")


@query(
    """SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS mode FROM (
  SELECT *, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS r FROM (
    SELECT user_id, event_type, count(*) AS n, min(event_id) AS o FROM events GROUP BY 1, 2)) WHERE r = 1 GROUP BY 1"""
)
def statistical_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.modes(t(spark, sf_dir, "events"), "user_id", "event_type", "event_id")
    return found.select("user_id", F.array_join("mode", ",").alias("mode"))


@query(
    """SELECT l_orderkey, count(DISTINCT l_returnflag) + max(CASE WHEN l_returnflag IS NULL THEN 1 ELSE 0 END) = 1 AS identical FROM lineitem GROUP BY 1"""
)
def unanimity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(V.unanimous("l_returnflag"))


@query(
    """SELECT CAST(least(floor((v - lo) / (hi - lo) * 80) + 1, 80) AS INTEGER) AS bin, count(*) AS n
FROM (SELECT log10(n_chars) AS v, min(log10(n_chars)) OVER () AS lo, max(log10(n_chars)) OVER () AS hi FROM documents) GROUP BY 1"""
)
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.histogram(t(spark, sf_dir, "documents"), F.log10("n_chars"), 80)


@query(
    """SELECT value, count(*) AS n, round(sum(count(*)) OVER (ORDER BY value) / (SELECT count(*) FROM events), 6) AS ecdf
FROM events GROUP BY 1"""
)
def empirical_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(V.ecdf(t(spark, sf_dir, "events"), "value"), "ecdf")


# --- windows, order, sampling ---------------------------------------------------------


@query(
    """SELECT lang, source, n, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM (
  SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)"""
)
def grouped_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = t(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return r6(V.share_within(counts, ["lang"], "n"))


@query(
    """SELECT e.event_id, e.event_type, n_users FROM events e JOIN (
  SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1) u USING (event_type)"""
)
def distinct_count_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return V.with_distinct_count(events, ["event_type"], "user_id", "n_users").drop("user_id")


@query(
    sql(
        "SELECT doc_id, row_number() OVER (ORDER BY md5('row:' || doc_id), doc_id) AS row_id FROM corpus",
        "corpus",
    )
)
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_ops.with_row_id(I.corpus(spark, sf_dir)).select("doc_id", "row_id")


@query(
    """SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS r FROM customer) WHERE r <= 5"""
)
def top_n_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = V.top_n(t(spark, sf_dir, "customer"), "c_acctbal", 5, ["c_mktsegment"])
    return top.select("c_mktsegment", "c_custkey", "c_acctbal")


@query(
    sql(
        """SELECT doc_id, CAST(sentence_id AS INTEGER) AS sentence_id, CAST(token_id AS INTEGER) AS token_id, pos, CAST(head_token_id AS INTEGER) AS head_token_id
FROM annotations WHERE head_token_id <> token_id""",
        "annotations",
    )
)
def heads_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest noun ahead, by a window over an existing token table."""
    heads = assign_heads(I.tokens(spark, sf_dir))
    return heads.filter("head_token_id <> token_id").select(
        "doc_id", "sentence_id", "token_id", "pos", "head_token_id"
    )


@query("SELECT doc_id, n_chars, lang FROM documents ORDER BY lang, n_chars DESC, doc_id")
def order_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").orderBy(
        "lang", F.desc("n_chars"), "doc_id"
    )


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 10")
def ordered_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return V.ordered_slice(docs, 11, 20, F.desc("n_chars"), F.col("doc_id"))


@query(
    """SELECT doc_id, n_chars, 'top' AS side FROM (SELECT *, rank() OVER (ORDER BY n_chars DESC) AS r FROM documents) WHERE r <= 20
UNION ALL SELECT doc_id, n_chars, 'bottom' FROM (SELECT *, rank() OVER (ORDER BY n_chars) AS r FROM documents) WHERE r <= 20"""
)
def top_and_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_and_bottom(t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 20)


@query("SELECT doc_id, quality FROM labels ORDER BY md5('3:' || doc_id), doc_id LIMIT 100")
def fixed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sample_fixed(t(spark, sf_dir, "labels"), "doc_id", 100, 3).select("doc_id", "quality")


_RANKED = """(SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('{seed}:' || doc_id), doc_id) AS r,
  count(*) OVER (PARTITION BY quality) AS size FROM labels)"""


@query(
    f"""SELECT doc_id, quality, CASE WHEN r <= floor(size * 0.75) THEN 'train' ELSE 'test' END AS split FROM {_RANKED.format(seed=11)}"""
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = V.stratified_split(t(spark, sf_dir, "labels"), "doc_id", "quality", 0.75, 11)
    return split.select("doc_id", "quality", "split")


@query(f"SELECT doc_id, quality, CAST(r % 5 AS INTEGER) AS fold FROM {_RANKED.format(seed=12)}")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = V.stratified_folds(t(spark, sf_dir, "labels"), "doc_id", "quality", 5, 12)
    return folds.select("doc_id", "quality", "fold")


@query(
    f"""SELECT doc_id, quality, CAST(unnest(range(1, CAST(most // size + CASE WHEN r <= most % size THEN 1 ELSE 0 END AS BIGINT) + 1)) AS INTEGER) AS copy
FROM (SELECT *, max(size) OVER () AS most FROM {_RANKED.format(seed=13)})"""
)
def upsample_minority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.upsample(t(spark, sf_dir, "labels"), "doc_id", "quality", 13)
    return rows.select("doc_id", "quality", "copy")


@query(
    """SELECT lang, source, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n, source) AS INTEGER) AS ord
FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)"""
)
def value_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = t(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return V.value_order(counts, ["lang"], "n")


# --- set operations ----------------------------------------------------------------------


@query(
    """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier"""
)
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    s = t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    return c.unionByName(s, allowMissingColumns=True)


@query(
    """SELECT 'documents' AS origin, lang AS grp, count(*) AS n FROM documents GROUP BY 2
UNION ALL SELECT 'turns', role, count(*) FROM conversations GROUP BY 2"""
)
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {
        "documents": t(spark, sf_dir, "documents").select(F.col("lang").alias("grp")),
        "turns": t(spark, sf_dir, "conversations").select(F.col("role").alias("grp")),
    }
    counted = {k: df.groupBy("grp").agg(F.count("*").alias("n")) for k, df in frames.items()}
    return V.tagged_union(counted, "origin")


@query(
    """SELECT coding, lang, count(*) AS n FROM (SELECT 'quality' AS coding, doc_id FROM labels WHERE quality = 1
  UNION ALL SELECT 'toxic', doc_id FROM labels WHERE toxic = 1) JOIN documents USING (doc_id) GROUP BY 1, 2"""
)
def mapped_over_codings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysis mapped over several label sets and bound with their name."""
    docs = t(spark, sf_dir, "documents")
    labels = t(spark, sf_dir, "labels")
    frames = {c: labels.filter(F.col(c) == 1) for c in ("quality", "toxic")}
    return V.mapped(
        frames, lambda df: df.join(docs, "doc_id").groupBy("lang").agg(F.count("*").alias("n"))
    )


@query(
    """SELECT item, count(*) AS n FROM (SELECT l_partkey AS item FROM lineitem UNION ALL SELECT ps FROM (SELECT p_partkey AS ps FROM part)) GROUP BY 1"""
)
def concatenated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"))
    b = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"))
    return a.union(b).groupBy("item").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents INTERSECT SELECT conv_id FROM conversations")
def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id")
    return docs.intersect(t(spark, sf_dir, "conversations").select("conv_id"))


@query("SELECT count(*) AS n_rows FROM (SELECT DISTINCT text, lang, source FROM documents)")
def drop_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("text", "lang", "source")
    return docs.dropDuplicates().agg(F.count("*").alias("n_rows"))
