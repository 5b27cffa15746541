"""Fusion, recipes and runs (X1-X9), and the pluggable surfaces (UD1-UD4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import CUSTOMER_NEG, LINEITEM_NULLS, customer_neg, lineitem_nulls, query, table
from queries.cleaning import C14_COLS, C14_SQL, IDS, mode_sql
from queries.text_ops import VOCAB
from tabloom.operators import clean, fusion, text
from tabloom.plans import store
from tabloom.plans.recipe import Recipe
from tabloom.sources.files import scratch_path


def text_features(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("double").alias("chars"), F.size(F.split("text", " ")).cast("double").alias("blanks"))


def struct_features(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") % 97).cast("double").alias("score"))


@query("x1_build_combined", """SELECT doc_id, doc_id AS struct__doc_id, lang AS struct__lang, (n_chars % 97)::DOUBLE AS struct__score, length(text)::DOUBLE AS text__chars, len(string_split(text, ' '))::DOUBLE AS text__blanks FROM documents""")
def combined(spark, d):
    s = fusion.FusionSession(spark, scratch_path(spark, "fusion"), "doc_id")
    v = s.combine(struct_features(spark, d), table(spark, d, "documents"), text_pipeline=lambda _: text_features(spark, d))
    return s.store.read(v)


@query("x1_match_report", "SELECT 'matched' AS part, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS rows FROM documents UNION ALL SELECT 'unmatched', count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) FROM documents")
def match(spark, d):
    return fusion.match_report(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "doc_id")


@query("x2_default_features", """SELECT 'l_discount' AS feature, count(l_discount) AS rows FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax) FROM lineitem UNION ALL SELECT 'l_quantity', count(l_quantity) FROM lineitem""")
def default_features(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.lit(1).alias("constant"), F.col("l_orderkey").alias("struct__l_orderkey"))
    names = fusion.default_features(li, ["l_extendedprice"], "l_orderkey")
    return li.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "rows")


@query("x3_recipe_parameters", f"""WITH {C14_SQL} SELECT 'fill' AS kind, 'l_quantity' AS "column", (SELECT median(l_quantity) FROM lineitem_nulls)::INT::VARCHAR AS text, NULL::DOUBLE AS a, NULL::DOUBLE AS b
UNION ALL SELECT 'fill', 'l_returnflag', {mode_sql('l_returnflag')}, NULL, NULL UNION ALL SELECT 'drop', 'l_tax', NULL, NULL, NULL """ + "".join(
    f"UNION ALL SELECT 'scale', '{c}', NULL, round(avg({c}), 9), round(stddev_pop({c}), 9) FROM f " for c in C14_COLS))
def recipe_parameters(spark, d):
    out = clean.auto_preprocess(lineitem_nulls(spark, d), "linear_regression", exclude=IDS)
    return out.recipe.to_df(spark).drop("step").withColumns({"a": F.round("a", 9), "b": F.round("b", 9)})


CHAIN = "c AS (SELECT o_orderkey AS version, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS source_version, o_custkey FROM orders)"


@query("x4_recipe_chain", f"""WITH {CHAIN}, t AS (SELECT max(version) AS v, arg_max(o_custkey, version) AS k FROM c) SELECT (row_number() OVER (ORDER BY version))::INT - 1 AS place, version FROM c, t WHERE o_custkey = k""")
def chain(spark, d):
    from queries.io_ops import lineage

    versions = lineage(spark, d)
    last = versions.agg(F.max("version")).first()[0]
    return spark.createDataFrame(list(enumerate(store.chain(versions, last))), "place int, version bigint")


@query("x5_replay", f"WITH {C14_SQL} SELECT * FROM c14")
def replay(spark, d):
    """Fitted parameters go through a table and come back before they are replayed."""
    df = lineitem_nulls(spark, d)
    params = clean.auto_preprocess(df, "linear_regression", exclude=IDS).recipe.to_df(spark)
    path = scratch_path(spark, "recipe")
    params.write.parquet(path)
    out = Recipe.from_df(spark.read.parquet(path)).transform(df)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", *[F.round(c, 6).alias(c) for c in C14_COLS])


@query("x5_replay_cap", f"""WITH {CUSTOMER_NEG}, f AS (SELECT c_custkey, greatest(account_amount, 0) AS account_amount FROM customer_neg)
SELECT s_suppkey AS c_custkey, round((greatest(s_acctbal, 0) - (SELECT avg(account_amount) FROM f)) / (SELECT stddev_pop(account_amount) FROM f), 6) AS account_amount FROM supplier""")
def replay_cap(spark, d):
    fitted = clean.auto_preprocess(customer_neg(spark, d), "knn", exclude=["c_custkey", "c_nationkey"]).recipe
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("account_amount"))
    return fitted.transform(new).withColumn("account_amount", F.round("account_amount", 6))


@query("x6_rebuild_text_features", f"""WITH {VOCAB.replace('LIMIT 10000', 'LIMIT 500')}, nt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM benchmark) GROUP BY 1, 2)
SELECT item_id, term, coalesce(tf, 0)::DOUBLE AS weight FROM (SELECT item_id, term FROM benchmark, voc) LEFT JOIN nt USING (item_id, term)""")
def rebuild_text(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    fitted = text.fit_vectorizer(docs, "count", max_features=500)
    wide = fusion.wide_terms(fitted.transform(items, "item_id"), fitted.vocabulary, items, "item_id", "text__")
    terms = [c for c in wide.columns if c != "item_id"]
    return wide.unpivot(["item_id"], terms, "term", "weight").withColumn("term", F.substring("term", 7, 1000))


def session(spark, d):
    s = fusion.FusionSession(spark, scratch_path(spark, "fusion"), "doc_id")
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    struct = docs.select("doc_id", "quality", F.when(F.col("n_chars") % 5 != 0, F.col("n_chars") % 97).cast("double").alias("score"))
    first = s.combine(struct, text_features(spark, d))
    second, _ = s.preprocess(first, "logistic_regression", "struct__quality")
    return s, second


@query("x7_run_training")
def run_training(spark, d):
    s, v = session(spark, d)
    return s.train(v, "struct__quality", "classification")["report"]


@query("x8_run_log", "SELECT 1::INT AS run, 2::INT AS version, 'regression' AS task_type, 'text__blanks' AS target, CASE WHEN count(*) > 0 THEN 'r2' END AS metric_name FROM documents UNION ALL SELECT 2, 2, 'clustering', NULL, 'silhouette' FROM (SELECT count(*) FROM documents)")
def run_log(spark, d):
    s, v = session(spark, d)
    s.train(v, "text__blanks", "regression", ["text__chars", "struct__score"])
    s.train(v, None, "clustering", ["text__chars", "struct__score"])
    return s.runs().select("run", "version", "task_type", "target", "metric_name")


@query("x8_leaderboard")
def leaderboard(spark, d):
    s, v = session(spark, d)
    s.train(v, "text__blanks", "regression", ["struct__score"])
    s.train(v, "text__blanks", "regression", ["text__chars", "struct__score"])
    return fusion.leaderboard(s.runs())


@query("x9_predict_with_run")
def predict(spark, d):
    s, v = session(spark, d)
    run = s.train(v, "struct__quality", "classification", ["text__chars", "text__blanks", "struct__score"])["run"]
    new = struct_features(spark, d).drop("lang")
    return s.predict(run, new, text_features(spark, d))[1]


@query("ud1_text_pipeline", "SELECT doc_id, lower(substr(text, 1, 5)) AS text__head FROM documents")
def text_pipeline(spark, d):
    s = fusion.FusionSession(spark, scratch_path(spark, "fusion"), "doc_id")
    docs = table(spark, d, "documents").select("doc_id", "text")
    v = s.combine(docs.select("doc_id"), docs, text_pipeline=lambda t: t.select("doc_id", F.lower(F.substring("text", 1, 5)).alias("head")))
    return s.store.read(v).select("doc_id", "text__head")


@query("ud2_image_pipeline", "SELECT vec_id, label::BIGINT AS struct__label, round(list_avg(list_transform(embedding, lambda e: greatest(0, least(255, floor((e::DOUBLE + 0.6) * 220))))), 2) AS img__mean FROM embeddings")
def image_pipeline(spark, d):
    from queries.image_ops import pixels

    s = fusion.FusionSession(spark, scratch_path(spark, "fusion"), "vec_id")
    struct = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"))
    v = s.combine(struct, image=pixels(spark, d), image_pipeline=lambda p: p.groupBy(F.col("image_id").alias("vec_id")).agg(F.round(F.avg("r"), 2).alias("mean")))
    return s.store.read(v).select("vec_id", "struct__label", "img__mean")


@query("ud3_edited_decisions", f"WITH {LINEITEM_NULLS} SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_quantity, {mode_sql('l_quantity')}) AS l_quantity, l_tax FROM lineitem_nulls")
def edited_decisions(spark, d):
    df = lineitem_nulls(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    decisions = [dict(x, strategy="mode") for x in clean.decide_missing(df) if x["column"] == "l_quantity"]
    return clean.apply_missing(df, decisions).df


@query("ud4_supplied_scorer", "SELECT doc_id, CASE WHEN length(text) >= 1000 THEN 'long' ELSE 'short' END AS raw_label FROM documents")
def supplied_scorer(spark, d):
    from tabloom.operators import topics

    def make():
        import numpy as np

        return lambda texts: np.asarray([[float(len(t) >= 1000), float(len(t) < 1000)] for t in texts], dtype=np.float32)

    return topics.score_documents(table(spark, d, "documents"), make, ["long", "short"]).select("doc_id", "raw_label")
