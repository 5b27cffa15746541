"""Text models: embeddings, classification, topics, clusters and batch scoring."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import textcols as tx
from tabloom.functions.columns import col
from tabloom.functions.scalars import preview
from tabloom.operators import metrics
from tabloom.operators.clean import label_encode
from tabloom.operators.relational import best_per_group, top_k_per_group
from tabloom.operators.split import train_test_split
from tabloom.operators.text import Vectorizer, fit_vectorizer
from tabloom.session import cut_lineage

NMF_TERMS = 50_000  # the term side of the factorisation is broadcast: vocabulary x topics numbers


# ---- embeddings -------------------------------------------------------------------------------------------

def embed_with(corpus: DataFrame, make_predict_fn: Callable, batch_size: int = 32, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, vector) from any model: ``make_predict_fn()`` gives ``fn(texts) -> 2-d array``."""
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return corpus.select(key, udf(col(text)).alias("vector"))


def embed_word2vec(corpus: DataFrame, size: int = 64, min_count: int = 5, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, vector): mean of word vectors trained on the corpus itself."""
    tokens = corpus.select(key, tx.word_tokens(col(text)).alias("tokens"))
    model = Word2Vec(vectorSize=size, minCount=min_count, seed=seed, inputCol="tokens", outputCol="_v").fit(tokens)
    return model.transform(tokens).select(key, vector_to_array("_v").alias("vector"))


# ---- classification -----------------------------------------------------------------------------------------

def classify_text(corpus: DataFrame, label: str, vectorizer: Vectorizer, choice: str = "logistic", test_size: float = 0.2, seed: int = 42, key: str = "doc_id",
                  logistic_iterations: int = 1000, svc_iterations: int = 2000, trees: int = 100, forest_depth: int = 30) -> dict:
    """Sparse vectors all the way; missing labels become ``unknown``. Spark's trees stop at depth 30."""
    labelled = corpus.withColumn("_class", F.coalesce(col(label).cast("string"), F.lit("unknown")))
    coded, mapping = label_encode(labelled.select(key, "_class"), "_class", "label")
    data = vectorizer.vectors(corpus, key).join(coded.select(F.col(key).alias("doc_id"), F.col("label").cast("double").alias("label")), "doc_id")
    parts = cut_lineage(train_test_split(data, "doc_id", test_size, seed, "label"))
    train, test = parts.where("split = 'train'"), parts.where("split = 'test'")
    n, classes = train.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    est = {
        "logistic": lambda: LogisticRegression(maxIter=logistic_iterations, tol=1e-4, regParam=1.0 / n, standardization=False),
        "naive_bayes": lambda: NaiveBayes(modelType="multinomial"),
        "random_forest": lambda: RandomForestClassifier(numTrees=trees, maxDepth=forest_depth, seed=seed),
        "linear_svc": lambda: LinearSVC(maxIter=svc_iterations, tol=1e-4, regParam=1.0 / n) if classes <= 2 else OneVsRest(classifier=LinearSVC(maxIter=svc_iterations, tol=1e-4, regParam=1.0 / n)),
    }[choice]()
    model = est.fit(train)
    scored = model.transform(test).select("doc_id", "label", "prediction")
    return {"model": model, "mapping": mapping, "scored": scored, "report": metrics.classification_report(scored), "metrics": metrics.accuracy(scored)}


# ---- topics ---------------------------------------------------------------------------------------------------

@dataclass
class TopicFit:
    """(topic, term, weight) and (doc_id, topic, weight) in long form."""

    terms: DataFrame
    documents: DataFrame


def fit_lda(vectors: DataFrame, vocabulary: DataFrame, k: int = 5, max_iter: int = 20, seed: int = 42) -> TopicFit:
    model = LDA(k=k, maxIter=max_iter, seed=seed, featuresCol="features").fit(vectors)
    described = model.describeTopics(vocabulary.count())
    terms = described.select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("z")).select("topic", F.col("z.termIndices").alias("index"), F.col("z.termWeights").alias("weight"))
    docs = model.transform(vectors).select("doc_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "weight"))
    return TopicFit(terms.join(vocabulary.select("index", "term"), "index").select("topic", "term", "weight"), docs)


def fit_nmf(long: DataFrame, n_terms: int, k: int = 5, max_iter: int = 500, tol: float = 1e-4, seed: int = 42) -> TopicFit:
    """Lee-Seung multiplicative updates for ``X ~ W H`` on (doc_id, index, term, weight) rows.

    W lives with its documents: a document's row is one record (indices, values, w). H (terms x k)
    is the bounded side, carried by the closures; per round only partial sums of W'X and W'W, of the
    same bounded size, leave the tasks and are added up by an aggregate.
    """
    if n_terms * k > NMF_TERMS * 100:
        raise ValueError("vocabulary x topics too large: lower max_features")
    if long.where("weight < 0").limit(1).count():
        raise ValueError("non-negative factorisation needs non-negative weights")
    docs = cut_lineage(long.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("index", "weight"))).alias("cells")).select(
        "doc_id", F.transform("cells", lambda c: c["index"]).alias("i"), F.transform("cells", lambda c: c["weight"]).alias("v")))
    rng = np.random.default_rng(seed)
    mean = long.agg(F.sum("weight")).first()[0] / max(1, docs.count()) / n_terms
    scale = float(np.sqrt(max(mean, 1e-12) / k))
    h = scale * np.abs(rng.standard_normal((k, n_terms)))
    eps, w_steps = 1e-10, 20

    def solve_w(cols, vals, h, hht):
        """W of all documents of a batch: flat cells, one matrix product per inner step. Also the documents' sizes and H'x."""
        sizes = np.array([len(c) for c in cols])
        flat, data = np.concatenate(cols).astype(np.int64), np.concatenate(vals)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        hx = np.add.reduceat(h[:, flat].T * data[:, None], starts, axis=0)
        w = np.full((len(sizes), len(hht)), scale)
        for _ in range(w_steps):
            w = w * hx / (w @ hht + eps)
        return w, hx, sizes, flat, data

    previous = None
    for _ in range(max_iter):
        now, hht = h, h @ h.T

        def partial(batches, h=now, hht=hht):
            wtx, wtw, err = np.zeros((k, n_terms)), np.zeros((k, k)), 0.0
            for b in batches:
                if not len(b):
                    continue
                w, hx, sizes, flat, data = solve_w(b["i"], b["v"], h, hht)
                for a in range(k):
                    wtx[a] += np.bincount(flat, np.repeat(w[:, a], sizes) * data, n_terms)
                wtw += w.T @ w
                err += float(data @ data) - 2 * float((w * hx).sum()) + float(((w @ hht) * w).sum())
            hit = np.nonzero(wtx.sum(axis=0))[0]
            rows = [("x", int(j), wtx[:, j].tolist()) for j in hit] + [("w", a, wtw[a].tolist()) for a in range(k)] + [("e", 0, [err] * k)]
            yield pd.DataFrame(rows, columns=["part", "j", "s"])

        sums = docs.mapInPandas(partial, "part string, j int, s array<double>").groupBy("part", "j").agg(
            F.array(*[F.sum(F.col("s")[a]) for a in range(k)]).alias("s")).collect()  # vocabulary + k rows
        wtx, wtw, err = np.zeros((k, n_terms)), np.zeros((k, k)), 0.0
        for r in sums:
            if r["part"] == "x":
                wtx[:, r["j"]] = r["s"]
            elif r["part"] == "w":
                wtw[r["j"]] = r["s"]
            else:
                err = max(r["s"][0], 0.0)
        h = h * wtx / (wtw @ h + eps)
        if previous is not None and previous - err <= tol * max(previous, eps):
            break
        previous = err
    final, hht = h, h @ h.T

    @F.pandas_udf("array<double>")
    def weights(i: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(list(solve_w(i, v, final, hht)[0]) if len(i) else [])

    spark = long.sparkSession
    names = {r["index"]: r["term"] for r in long.select("index", "term").distinct().collect()}  # the vocabulary
    terms = spark.createDataFrame([(a, names[j], float(h[a, j])) for a in range(k) for j in names], "topic int, term string, weight double")
    return TopicFit(terms, docs.select("doc_id", F.posexplode(weights("i", "v")).alias("topic", "weight")))


def topic_keywords(fit: TopicFit, top: int = 10) -> DataFrame:
    """(topic, rank, term, weight)."""
    return top_k_per_group(fit.terms, "topic", "weight", "term", top).select("topic", "rank", "term", F.round("weight", 4).alias("weight"))


def dominant_topic(fit: TopicFit) -> DataFrame:
    """(doc_id, topic, weight): the heaviest topic per document, smallest topic on ties."""
    return best_per_group(fit.documents, "doc_id", "weight", ["topic"], "topic").withColumn("weight", F.round("weight", 4))


def topic_sizes(dominant: DataFrame) -> DataFrame:
    return dominant.groupBy("topic").agg(F.count(F.lit(1)).alias("documents"))


# ---- clusters -------------------------------------------------------------------------------------------------

def cluster_documents(vectors: DataFrame, k: int = 5, seed: int = 42, n_init: int = 10) -> tuple[DataFrame, list]:
    """(doc_id, cluster, distance to the centre) and the centres, of the best of ``n_init`` starts."""
    fits = [KMeans(k=k, seed=seed + i, maxIter=100).fit(vectors) for i in range(n_init)]
    model = min(fits, key=lambda f: f.summary.trainingCost)
    centres = [c.tolist() for c in model.clusterCenters()]
    out = model.transform(vectors)
    squared = _distance_udf(centres)("features", "prediction")
    return out.select("doc_id", F.col("prediction").alias("cluster"), F.sqrt(squared).alias("distance")), centres


def _distance_udf(centres: list):
    """Distance of a sparse vector to its centre: |x|^2 - 2 x.c + |c|^2 on the non-zero cells."""
    matrix = np.asarray(centres)
    norms = (matrix * matrix).sum(axis=1)

    @F.udf("double")
    def squared(v, p):
        idx, val = (v.indices, v.values) if hasattr(v, "indices") else (np.arange(len(v)), v.toArray())
        return float(max(0.0, val @ val - 2 * (matrix[p, idx] @ val) + norms[p]))

    return squared


def representatives(clusters: DataFrame, corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """The document nearest to each centre with a 300-character preview."""
    best = best_per_group(clusters, "cluster", "distance", [key], key, largest=False)
    return best.join(corpus.select(key, preview("text", 300).alias("preview")), key)


# ---- scoring --------------------------------------------------------------------------------------------------

def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def label_scores(df: DataFrame, logits: str, labels: list[str]) -> DataFrame:
    """Adds ``raw_label`` and ``confidence`` from an array of logits; the first best label wins."""
    p = softmax(col(logits).cast("array<double>"))
    work = df.withColumn("_p", p)
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    names = F.array(*[F.lit(x) for x in labels])
    return work.withColumns({"raw_label": F.element_at(names, best), "confidence": F.array_max("_p")}).drop("_p")


def score_documents(corpus: DataFrame, make_predict_fn: Callable, labels: list[str], batch_size: int = 32, text: str = "text") -> DataFrame:
    """Batch scoring of a supplied classifier: logits by ``predict_batch_udf``, the rest as expressions."""
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return label_scores(corpus.withColumn("_logits", udf(col(text))), "_logits", labels).drop("_logits")


def vectorize_and_fit(corpus: DataFrame, weighting: str = "tfidf", max_features: int = 10_000) -> tuple[Vectorizer, DataFrame]:
    fitted = fit_vectorizer(corpus, weighting, max_features=max_features)
    return fitted, fitted.vectors(corpus)
