"""Corpus, cleaning, lengths, n-grams, keyword in context, and count / TF-IDF vectors in long form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import textcols as tx
from tabloom.functions.columns import col
from tabloom.functions.scalars import char_count, word_count, words
from tabloom.operators import profile
from tabloom.operators.quantiles import column_quantiles
from tabloom.operators.ranking import global_row_number

# Sentiment order and the label spellings that map to it.
SENTIMENT_ORDER = ["Very Negative", "Negative", "Neutral", "Positive", "Very Positive"]
STAR_RULES = {
    "1": ("Very Negative", "negative"), "2": ("Negative", "negative"), "3": ("Neutral", "neutral"),
    "4": ("Positive", "positive"), "5": ("Very Positive", "positive"),
}
WORD_RULES = {
    "Negative": ("negative", "label_0", "0", "neg"),
    "Neutral": ("neutral", "1", "neu"),
    "Positive": ("positive", "label_2", "2", "label_1", "pos"),
}


# ---- corpus --------------------------------------------------------------------------------------

def append_to_corpus(corpus: DataFrame | None, new: DataFrame, source: str, text: str = "text", order_by: str | None = None, label: str | None = None) -> DataFrame:
    """Union with the source recorded. Old rows keep their ``doc_id``; new ones follow the largest, in the order of the key.

    With ``label`` the column is carried along as text; rows added without one have no label.
    """
    key = col(order_by) if order_by else col(text)
    start = 0
    if corpus is not None:
        last = corpus.agg(F.max("doc_id")).first()[0]
        start = 0 if last is None else last + 1
    added = new.select(F.lit(source).alias("source"), key.cast("string").alias("_key"), col(text).cast("string").alias("text"),
                       (col(label).cast("string") if label else F.lit(None).cast("string")).alias("label"))
    order = [F.col("_key").try_cast("bigint").asc_nulls_last(), F.col("_key"), F.col("text")]
    out = global_row_number(added, order, "doc_id", start=start).select("doc_id", "text", "source", "label")
    if corpus is not None:
        old = corpus.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source", (F.col("label") if "label" in corpus.columns else F.lit(None).cast("string")).alias("label"))
        out = old.unionByName(out)
    carried = label is not None or (corpus is not None and "label" in corpus.columns)
    return out if carried else out.drop("label")


def read_text_column(df: DataFrame, text: str, label: str | None = None) -> DataFrame:
    cols = [col(text).cast("string").alias("text")] + ([col(label).alias("label")] if label else [])
    return df.where(col(text).isNotNull()).select(*cols)


def clean(corpus: DataFrame, steps: list, text: str = "text", out: str = "cleaned_text") -> DataFrame:
    """Ordered steps as one projection. A step is a name, (name, kwargs), or a column function."""
    c = col(text)
    for step in steps:
        name, kw = (step, {}) if not isinstance(step, tuple) else step
        c = name(c, **kw) if callable(name) else tx.STEPS[name](c, **kw)
    return corpus.withColumn(out, c)


class CleaningSession:
    """Step list with undo and reset; the cleaned corpus is always recomputed from the raw one."""

    def __init__(self, corpus: DataFrame):
        self.corpus, self.steps = corpus, []

    def add(self, step) -> "CleaningSession":
        self.steps.append(step)
        return self

    def undo(self) -> "CleaningSession":
        self.steps = self.steps[:-1]
        return self

    def reset(self) -> "CleaningSession":
        self.steps = []
        return self

    def result(self) -> DataFrame:
        return clean(self.corpus, self.steps)


def length_change(corpus: DataFrame, before: str = "text", after: str = "cleaned_text") -> DataFrame:
    a, b = F.avg(F.length(before)), F.avg(F.length(after))
    return corpus.agg(a.alias("mean_before"), b.alias("mean_after")).withColumn(
        "change_pct", (F.col("mean_after") - F.col("mean_before")) * 100.0 / F.col("mean_before")
    )


# ---- lengths -------------------------------------------------------------------------------------

def length_stats(corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return corpus.select(key, word_count(col(text)).cast("bigint").alias("word_count"), char_count(col(text)).cast("bigint").alias("char_count"))


def length_histogram(corpus: DataFrame, measure: str = "word_count", bins: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    return profile.histogram(length_stats(corpus, key, text), measure, bins)


def length_summary(corpus: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    stats = length_stats(corpus, key, text)
    q = column_quantiles(stats, ["word_count", "char_count"], [0.5])
    vocabulary = corpus.select(F.explode(words(F.lower(col(text)))).alias("w")).agg(F.count_distinct("w").alias("vocabulary"))
    longest = stats.agg(F.max("word_count").alias("max_words"))
    return longest.join(vocabulary, F.lit(True)).select(  # two one-row tables
        F.lit(q["word_count"][0.5]).alias("median_words"), "max_words", F.lit(q["char_count"][0.5]).alias("median_chars"), "vocabulary"
    )


# ---- n-grams ---------------------------------------------------------------------------------------

def ngram_counts(corpus: DataFrame, n: int, text: str = "text", strip_punct: bool = False) -> DataFrame:
    base = F.lower(col(text))
    if strip_punct:
        base = F.lower(tx.remove_punctuation(col(text)))
    return (
        corpus.where(col(text).isNotNull()).select(F.explode(tx.ngrams(words(base), n)).alias("ngram"))
        .groupBy("ngram").agg(F.count(F.lit(1)).alias("count"))
    )


def ngram_freq(corpus: DataFrame, n: int, top_k: int = 20, text: str = "text", strip_punct: bool = False) -> DataFrame:
    return ngram_counts(corpus, n, text, strip_punct).orderBy(F.desc("count"), "ngram").limit(top_k)


def word_weights(corpus: DataFrame, max_words: int = 150, stopwords: list[str] = (), text: str = "text") -> DataFrame:
    """(word, count, weight = count / largest count) of the most frequent words."""
    counts = (
        corpus.select(F.explode(tx.word_tokens(col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    )
    if stopwords:
        counts = counts.where(~F.col("word").isin(sorted(set(stopwords))))
    top = counts.orderBy(F.desc("count"), "word").limit(max_words)
    return top.withColumn("weight", F.col("count") / F.max("count").over(Window.partitionBy(F.lit(1))))  # max_words rows


# ---- keyword in context -----------------------------------------------------------------------------

def kwic(
    corpus: DataFrame, query: str, window: int = 7, case_sensitive: bool = False, max_results: int | None = 500,
    whole_word: bool = False, first_per_doc: bool = False, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, position, left, hit, right). The cap is tested after each document, in key order."""
    term = query.strip()
    schema_key = corpus.schema[key].dataType.simpleString()
    if not term:
        return corpus.sparkSession.createDataFrame([], f"`{key}` {schema_key}, position int, left string, hit string, right string")
    if whole_word:
        edge = rf"(?<!{tx.WORD})", rf"(?!{tx.WORD})"
        pattern = ("" if case_sensitive else "(?iu)") + edge[0] + r"\Q" + term + r"\E" + edge[1]
        match = lambda w: w.rlike(pattern)
    elif case_sensitive:
        match = lambda w: w.contains(F.lit(term))
    else:
        match = lambda w: F.lower(w).contains(F.lit(term.lower()))
    toks = words(col(text))
    docs = corpus.select(col(key).alias(key), toks.alias("_t")).withColumn(
        "_p", F.filter(F.transform("_t", lambda w, i: F.when(match(w), i)), lambda p: p.isNotNull())
    )
    docs = docs.where(F.size("_p") > 0)
    if first_per_doc:
        docs = docs.withColumn("_p", F.slice("_p", 1, 1))
    if max_results is not None:
        # Every kept document has a hit, so the first ``max_results`` documents are enough.
        docs = docs.orderBy(key).limit(max_results)
        before = F.sum(F.size("_p")).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
        docs = docs.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < max_results)
    hits = docs.select(key, "_t", F.explode("_p").alias("position"))
    p = F.col("position")
    left_start = F.greatest(p - window, F.lit(0))
    return hits.select(
        key, "position",
        F.array_join(F.slice("_t", left_start + 1, p - left_start), " ").alias("left"),
        F.get("_t", p).alias("hit"),
        F.array_join(F.slice("_t", p + 2, F.lit(window)), " ").alias("right"),
    )


def auto_text_eda(corpus: DataFrame, top_k: int = 20, max_words: int = 150, text: str = "text", key: str = "doc_id") -> dict:
    return {
        "n_docs": corpus.agg(F.count(col(text)).alias("n_docs")),
        "word_histogram": length_histogram(corpus, "word_count", 50, text, key),
        "char_histogram": length_histogram(corpus, "char_count", 50, text, key),
        "unigrams": ngram_freq(corpus, 1, top_k, text),
        "bigrams": ngram_freq(corpus, 2, top_k, text),
        "word_weights": word_weights(corpus, max_words, (), text),
    }


# ---- vectors -----------------------------------------------------------------------------------------

@dataclass
class Vectorizer:
    """Fitted vocabulary ``(term, index, idf)``; transforms give ``(doc_id, index, term, weight)`` rows.

    The vocabulary holds at most ``max_features`` rows, which bounds what is broadcast.
    """

    vocabulary: DataFrame
    weighting: str
    low: int
    high: int
    size: int

    def term_counts(self, corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        grams = tx.ngram_range(tx.word_tokens(col(text)), self.low, self.high)
        exploded = corpus.select(col(key).alias("doc_id"), F.explode(grams).alias("term"))
        known = exploded.join(self.vocabulary, "term")  # max_features rows: broadcast by size
        return known.groupBy("doc_id", "index", "term", "idf").agg(F.count(F.lit(1)).alias("tf"))

    def transform(self, corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        counts = self.term_counts(corpus, key, text)
        if self.weighting == "count":
            return counts.select("doc_id", "index", "term", F.col("tf").cast("double").alias("weight"))
        raw = counts.withColumn("w", (1 + F.log("tf")) * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))  # one document's terms
        return raw.select("doc_id", "index", "term", (F.col("w") / norm).alias("weight"))

    def vectors(self, corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, features sparse vector); documents without known terms get an empty vector."""
        long = self.transform(corpus, key, text).groupBy("doc_id").agg(
            F.array_sort(F.collect_list(F.struct("index", "weight"))).alias("cells")
        )
        docs = corpus.select(col(key).alias("doc_id")).join(long, "doc_id", "left")
        return docs.select("doc_id", sparse_vector(self.size)("cells").alias("features"))


def sparse_vector(size: int):
    from pyspark.ml.linalg import Vectors, VectorUDT

    @F.udf(VectorUDT())
    def build(cells):
        cells = cells or []
        return Vectors.sparse(size, [c["index"] for c in cells], [c["weight"] for c in cells])

    return build


def fit_vectorizer(
    corpus: DataFrame, weighting: str = "tfidf", ngram: tuple[int, int] = (1, 1), max_features: int = 10_000,
    key: str = "doc_id", text: str = "text",
) -> Vectorizer:
    """Vocabulary = the most frequent terms of the corpus (ties in term order), numbered alphabetically."""
    grams = tx.ngram_range(tx.word_tokens(col(text)), *ngram)
    # Occurrences and documents of a term in one explode; both sums combine before the shuffle.
    marks = lambda terms, t, d: F.transform(terms, lambda g: F.struct(g.alias("term"), F.lit(t).alias("t"), F.lit(d).alias("d")))
    docs = corpus.select(grams.alias("_g"))
    exploded = docs.select(F.inline(F.concat(marks(F.col("_g"), 1, 0), marks(F.array_distinct("_g"), 0, 1))))
    terms = exploded.groupBy("term").agg(F.sum("t").alias("total"), F.sum("d").alias("df"))
    top = terms.orderBy(F.desc("total"), "term").limit(max_features)
    n = corpus.agg(F.count(F.lit(1))).first()[0]
    idf = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0
    rows = top.withColumn("index", (F.row_number().over(Window.orderBy("term")) - 1).cast("int")).select(
        "term", "index", "total", "df", idf.alias("idf")
    ).collect()  # max_features rows: the fitted artefact
    vocabulary = corpus.sparkSession.createDataFrame(
        [(r["term"], r["index"], r["idf"]) for r in rows] or [], "term string, index int, idf double"
    )
    return Vectorizer(vocabulary, weighting, *ngram, size=max(1, len(rows)))


def matrix_stats(long: DataFrame, n_docs: int, n_terms: int, top: int = 30) -> tuple[DataFrame, DataFrame]:
    """(sparsity per cent, mean weight of the heaviest terms) of a long document-term matrix."""
    cells = float(n_docs) * n_terms
    sparsity = long.agg(((1 - F.count(F.lit(1)) / F.lit(cells)) * 100.0).alias("sparsity_pct"))
    means = long.groupBy("term").agg((F.sum("weight") / F.lit(float(n_docs))).alias("mean_weight"))
    return sparsity, means.orderBy(F.desc("mean_weight"), "term").limit(top)


# ---- sentiment labels ------------------------------------------------------------------------------------

def sentiment_columns(label: Column | str) -> tuple[Column, Column]:
    """(sentiment, polarity) from a raw model label; unknown labels keep their text and are neutral."""
    raw = (F.col(label) if isinstance(label, str) else label).cast("string")
    low = F.lower(F.trim(raw))
    star = F.regexp_extract(low, r"^([1-5])\s*star\s*s?$", 1)
    sentiment, polarity = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for digit, (name, pol) in STAR_RULES.items():
        sentiment, polarity = sentiment.when(star == digit, name), polarity.when(star == digit, pol)
    for name, spellings in WORD_RULES.items():
        sentiment, polarity = sentiment.when(low.isin(*spellings), name), polarity.when(low.isin(*spellings), name.lower())
    return sentiment.otherwise(raw), polarity.otherwise("neutral")


def polarity_summary(scored: DataFrame, polarity: str = "polarity", confidence: str = "confidence") -> DataFrame:
    return scored.groupBy(polarity).agg(F.count(F.lit(1)).alias("count"), F.avg(confidence).alias("mean_confidence"))


def sentiment_counts(scored: DataFrame, sentiment: str = "sentiment") -> DataFrame:
    from tabloom.operators.relational import sort_by_category

    return sort_by_category(scored.groupBy(sentiment).agg(F.count(F.lit(1)).alias("count")), sentiment, SENTIMENT_ORDER, [sentiment])


