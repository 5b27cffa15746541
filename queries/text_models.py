"""Text models (N22-N28, N30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import corpus, query, table
from tabloom.operators import reduce, text, topics
from tabloom.session import cut_lineage


def make_letter_model():
    """A stand-in model: shares of six letters and the text length; any loaded model has this shape."""
    import numpy as np

    def predict(texts):
        rows = [[t.lower().count(c) / max(1, len(t)) for c in "etaoin"] + [float(len(t))] for t in texts]
        return np.asarray(rows, dtype=np.float32)

    return predict


@query("n22_embed_with_model", "SELECT doc_id, (length(text) - length(replace(lower(text), 'e', '')))::BIGINT AS e, length(text)::DOUBLE AS chars FROM documents")
def embed(spark, d):
    out = topics.embed_with(corpus(spark, d), make_letter_model)
    share, chars = F.col("vector")[0].cast("double"), F.col("vector")[6].cast("double")
    return out.select("doc_id", F.round(share * chars).cast("bigint").alias("e"), chars.alias("chars"))


@query("n22_embed_word2vec")
def word2vec(spark, d):
    turns = table(spark, d, "conversations").withColumn("doc_id", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return topics.embed_word2vec(turns, 16).select("doc_id", F.posexplode("vector").alias("position", "value")).withColumn("value", F.round("value", 6))


@query("n23_projection_rows")
def projection(spark, d):
    c = corpus(spark, d)
    vectors = topics.embed_with(c, make_letter_model)
    return reduce.projection_rows(vectors, c, 7, 3)


@query("n23_projection_tfidf")
def projection_tfidf(spark, d):
    c = corpus(spark, d)
    fitted = text.fit_vectorizer(c, "tfidf")
    return reduce.sparse_projection_rows(fitted.transform(c), c, fitted.size, 3)


@query("n24_text_classification")
def classify(spark, d):
    docs = table(spark, d, "documents")
    return topics.classify_text(docs, "lang", text.fit_vectorizer(docs, "tfidf"))["report"]


@query("n24_text_classification_nb")
def classify_nb(spark, d):
    docs = table(spark, d, "documents")
    return topics.classify_text(docs, "lang", text.fit_vectorizer(docs, "count"), "naive_bayes")["report"]


def lda_fit(spark, d):
    c = corpus(spark, d)
    fitted = text.fit_vectorizer(c, "count")
    return topics.fit_lda(cut_lineage(fitted.vectors(c)), fitted.vocabulary, 4)


def nmf_fit(spark, d):
    c = corpus(spark, d)
    fitted = text.fit_vectorizer(c, "tfidf")
    return topics.fit_nmf(fitted.transform(c), fitted.size, 4)


@query("n25_lda_keywords")
def lda(spark, d):
    return topics.topic_keywords(lda_fit(spark, d), 10)


@query("n26_nmf_keywords")
def nmf(spark, d):
    return topics.topic_keywords(nmf_fit(spark, d), 10)


SCORES = """SELECT doc_id, unnest(range(3))::INT AS topic, unnest([(n_chars % 7) / 7.0, (n_chars % 5) / 5.0, (n_chars % 3) / 3.0])::DOUBLE AS weight FROM documents"""


def weight_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.array(*[(F.col("n_chars") % m) / float(m) for m in (7, 5, 3)])).alias("topic", "weight"))
    return topics.TopicFit(docs.select(F.col("topic"), F.col("doc_id").cast("string").alias("term"), "weight"), docs)


@query("n27_topic_keywords", f"SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, doc_id::VARCHAR)::INT AS rank, doc_id::VARCHAR AS term, round(weight, 4) AS weight FROM ({SCORES}) QUALIFY rank <= 10")
def keywords(spark, d):
    return topics.topic_keywords(weight_rows(spark, d), 10)


@query("n27_dominant_topic", f"SELECT doc_id, topic, round(weight, 4) AS weight FROM ({SCORES}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, topic) = 1")
def dominant(spark, d):
    return topics.dominant_topic(weight_rows(spark, d))


@query("n27_topic_sizes", f"SELECT topic, count(*) AS documents FROM (SELECT doc_id, topic FROM ({SCORES}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, topic) = 1) GROUP BY 1")
def sizes(spark, d):
    return topics.topic_sizes(topics.dominant_topic(weight_rows(spark, d)))


@query("n28_text_clusters")
def clusters(spark, d):
    c = corpus(spark, d)
    vectors = cut_lineage(text.fit_vectorizer(c, "tfidf").vectors(c))
    found, _ = topics.cluster_documents(vectors, 4)
    return topics.representatives(found, c)


@query("n30_score_documents", """WITH l AS (SELECT doc_id, (length(text) - length(replace(lower(text), 'e', '')))::DOUBLE / length(text) AS e, (length(text) - length(replace(lower(text), 't', '')))::DOUBLE / length(text) AS t FROM documents)
SELECT doc_id, CASE WHEN e >= t THEN 'vowel' ELSE 'consonant' END AS raw_label, round(1 / (1 + exp(-abs(e - t) * 10)), 3) AS confidence FROM l""")
def score(spark, d):
    def make():
        import numpy as np

        return lambda texts: np.asarray([[10.0 * t.lower().count("e") / max(1, len(t)), 10.0 * t.lower().count("t") / max(1, len(t))] for t in texts], dtype=np.float32)

    return topics.score_documents(corpus(spark, d), make, ["vowel", "consonant"]).select("doc_id", "raw_label", F.round("confidence", 3).alias("confidence"))
