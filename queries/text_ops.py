"""Text (N1-N21, N29, N31) and corpus handling (IO5-IO7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import corpus, query, table
from tabloom.functions import textcols as tx
from tabloom.operators import text as txt

SP = r"[\s\p{Z}]"
W = r"[\p{L}\p{N}_]"
WORDS = r"list_filter(regexp_split_to_array({0}, '[\s\p{{Z}}]+'), lambda w: w <> '')"


def words_sql(c):
    return WORDS.format(c)


def _step(name, step, sql, source="documents", key="doc_id", col="text"):
    def run(spark, d):
        return txt.clean(table(spark, d, source), [step], col, "out").select(key, F.md5("out").alias("cleaned"), F.length("out").alias("chars"))

    query(name, f"SELECT {key}, md5(o) AS cleaned, length(o)::INT AS chars FROM (SELECT {key}, {sql.replace('$', col)} AS o FROM {source})")(run)


def replaces(c, pairs):
    for a, b in pairs:
        qa, qb = a.replace("'", "''"), b.replace("'", "''")
        c = f"replace({c}, '{qa}', '{qb}')"
    return c


STOP = ["the", "and", "of", "to", "in", "that", "is", "was", "for", "on", "la", "le", "de", "der", "die", "und"]
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"

_step("n1_lowercase", "lowercase", "lower($)")
_step("n2_contractions", "contractions", replaces("$", tx.CONTRACTIONS))
_step("n2_contractions_corrected", ("contractions", {"corrected": True}), replaces("$", tx.CONTRACTIONS_WHOLE_FIRST))
_step("n3_remove_urls", "urls", r"regexp_replace($, 'https?://\S+|www\.\S+|(?:\S+@\S+\.\S+)', ' ', 'g')", "pages", "page_id", "html")
_step("n4_remove_markup", "markup", rf"regexp_replace(regexp_replace(regexp_replace($, '<[^>]+>', ' ', 'g'), '@{W}+', ' ', 'g'), '#({W}+)', '\1', 'g')", "pages", "page_id", "html")
_step("n5_remove_punctuation", "punctuation", r"regexp_replace($, '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g')")
_step("n6_remove_digits", "digits", r"regexp_replace($, '\p{Nd}+', ' ', 'g')")
_step("n7_remove_stopwords", ("stopwords", {"stopwords": STOP}), f"array_to_string(list_filter({words_sql('$')}, lambda w: NOT list_contains({STOP_SQL}, lower(w))), ' ')")
_step("n8_drop_short_tokens", "short_tokens", f"array_to_string(list_filter({words_sql('$')}, lambda w: length(w) >= 3), ' ')")


@query("n9_sequential_cleaning", rf"""SELECT doc_id, md5(array_to_string(list_filter({words_sql("regexp_replace(regexp_replace(lower(text), '[^" + chr(92) + "p{L}" + chr(92) + "p{N}" + chr(92) + "p{M}_" + chr(92) + "s]', ' ', 'g'), '" + chr(92) + "p{Nd}+', ' ', 'g')")}, lambda w: length(w) >= 3), ' ')) AS cleaned FROM documents""")
def sequence(spark, d):
    s = txt.CleaningSession(corpus(spark, d)).add("lowercase").add("punctuation").add("digits").add("short_tokens").add("urls").undo()
    return s.result().select("doc_id", F.md5("cleaned_text").alias("cleaned"))


@query("n10_length_change", r"""SELECT round(a, 4) AS mean_before, round(b, 4) AS mean_after, round((b - a) * 100 / a, 4) AS change_pct
FROM (SELECT avg(length(text)) AS a, avg(length(regexp_replace(text, '[^\p{L}\p{N}\p{M}_\s]', '', 'g'))) AS b FROM documents)""")
def length_change(spark, d):
    c = corpus(spark, d).withColumn("cleaned_text", F.regexp_replace("text", r"[^\p{L}\p{N}\p{M}_\s]", ""))
    out = txt.length_change(c)
    return out.withColumns({x: F.round(x, 4) for x in out.columns})


@query("n11_length_stats", f"SELECT doc_id, len({words_sql('text')}) AS word_count, length(text) AS char_count FROM documents")
def length_stats(spark, d):
    return txt.length_stats(corpus(spark, d))


@query("n11_length_histogram", f"""WITH w AS (SELECT len({words_sql('text')})::DOUBLE AS v FROM documents), b AS (SELECT min(v) AS lo, max(v) AS hi FROM w),
h AS (SELECT least(floor((v - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*) AS n FROM w, b GROUP BY 1)
SELECT g.bin, coalesce(n, 0) AS "count" FROM (SELECT range::INT AS bin FROM range(50)) g LEFT JOIN h USING (bin)""")
def length_hist(spark, d):
    return txt.length_histogram(corpus(spark, d)).select("bin", "count")


@query("n12_length_summary", f"""SELECT median(len({words_sql('text')}))::DOUBLE AS median_words, max(len({words_sql('text')})) AS max_words, median(length(text))::DOUBLE AS median_chars,
(SELECT count(DISTINCT w) FROM (SELECT unnest({words_sql('lower(text)')}) AS w FROM documents)) AS vocabulary FROM documents""")
def length_summary(spark, d):
    return txt.length_summary(corpus(spark, d))


def ngram_sql(source, n, base="lower(text)"):
    later = "".join(f", lead(t, {j}) OVER (PARTITION BY d ORDER BY i) AS t{j}" for j in range(1, n))
    gram = "t" + "".join(f" || ' ' || t{j}" for j in range(1, n))
    return f"""SELECT {gram} AS ngram, count(*) AS "count" FROM (SELECT t{later} FROM (SELECT d, unnest(w) AS t, generate_subscripts(w, 1) AS i
FROM (SELECT row_number() OVER () AS d, {words_sql(base)} AS w FROM {source} WHERE text IS NOT NULL))) WHERE {gram} IS NOT NULL GROUP BY 1"""


for _n in (1, 2, 3):
    def _ngram(spark, d, n=_n):
        return txt.ngram_freq(table(spark, d, "documents"), n, 20)
    query(f"n13_ngram_freq_{_n}", ngram_sql("documents", _n) + " ORDER BY 2 DESC, 1 LIMIT 20")(_ngram)


@query("n13_ngram_freq_strip_punct", ngram_sql("conversations", 2, r"lower(regexp_replace(text, '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'))") + " ORDER BY 2 DESC, 1 LIMIT 50")
def ngram_strip(spark, d):
    return txt.ngram_freq(table(spark, d, "conversations"), 2, 50, strip_punct=True)


TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


@query("n14_word_weights", f"""SELECT word, n AS "count", round(n / max(n) OVER (), 6) AS weight FROM (SELECT word, count(*) AS n FROM (SELECT unnest({TOK}) AS word FROM documents)
WHERE NOT list_contains({STOP_SQL}, word) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 150)""")
def word_weights(spark, d):
    return txt.word_weights(corpus(spark, d), 150, STOP).withColumn("weight", F.round("weight", 6))


KWIC = """WITH t AS (SELECT {key}, {words} AS w FROM {source}), h AS (SELECT {key}, w, unnest(range(1, len(w) + 1)) AS p FROM t),
hits AS (SELECT * FROM h WHERE {match}){extra}
SELECT {key}, (p - 1)::INT AS position, array_to_string(w[greatest(p - 7, 1):p - 1], ' ') AS "left", w[p] AS hit, array_to_string(w[p + 1:p + 7], ' ') AS "right" FROM {final}"""
CAP = """, c AS (SELECT doc_id, count(*) AS n FROM hits GROUP BY 1), k AS (SELECT doc_id, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c)"""


@query("n15_kwic", KWIC.format(key="doc_id", words=words_sql("text"), source="documents", match="contains(lower(w[p]), 'tion')", extra=CAP, final="hits JOIN k USING (doc_id) WHERE b < 500"))
def kwic(spark, d):
    return txt.kwic(corpus(spark, d), "Tion")


@query("n15_kwic_all", KWIC.format(key="doc_id", words=words_sql("text"), source="documents", match="contains(w[p], 'The')", extra="", final="hits"))
def kwic_all(spark, d):
    return txt.kwic(corpus(spark, d), "The", case_sensitive=True, max_results=None)


@query("n16_kwic_whole_word", KWIC.format(key="doc_id", words=words_sql("text"), source="documents",
       match=r"regexp_matches(w[p], '(?i)(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])')",
       extra=", f AS (SELECT doc_id, min(p) AS p FROM hits GROUP BY 1 ORDER BY 1 LIMIT 100)", final="hits JOIN f USING (doc_id, p)"))
def kwic_whole(spark, d):
    return txt.kwic(corpus(spark, d), "the", whole_word=True, first_per_doc=True, max_results=100)


@query("n17_auto_text_eda", f"""SELECT 'bigram' AS part, ngram AS term, "count" FROM ({ngram_sql('documents', 2)} ORDER BY 2 DESC, 1 LIMIT 20)
UNION ALL SELECT 'unigram', ngram, "count" FROM ({ngram_sql('documents', 1)} ORDER BY 2 DESC, 1 LIMIT 20) UNION ALL SELECT 'n_docs', '', count(*) FROM documents""")
def auto_text(spark, d):
    out = txt.auto_text_eda(corpus(spark, d))
    uni = out["unigrams"].select(F.lit("unigram").alias("part"), F.col("ngram").alias("term"), "count")
    bi = out["bigrams"].select(F.lit("bigram").alias("part"), F.col("ngram").alias("term"), "count")
    return uni.unionByName(bi).unionByName(out["n_docs"].select(F.lit("n_docs").alias("part"), F.lit("").alias("term"), F.col("n_docs").alias("count")))


VOCAB = f"""tok AS (SELECT doc_id, unnest({TOK}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
voc AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf, row_number() OVER (ORDER BY term) - 1 AS i FROM
(SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10000))"""


@query("n18_count_vectors", f"WITH {VOCAB} SELECT doc_id, i::INT AS index, term, tf::DOUBLE AS weight FROM tf JOIN voc USING (term)")
def count_vectors(spark, d):
    c = corpus(spark, d)
    return txt.fit_vectorizer(c, "count").transform(c)


@query("n18_count_vectors_bigrams", f"""WITH t AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {TOK} AS w FROM documents)),
g AS (SELECT doc_id, t AS term FROM t UNION ALL SELECT doc_id, t || ' ' || lead(t) OVER (PARTITION BY doc_id ORDER BY i) FROM t),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g WHERE term IS NOT NULL GROUP BY 1, 2),
voc AS (SELECT term FROM tf GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 10000) SELECT doc_id, term, tf::DOUBLE AS weight FROM tf JOIN voc USING (term)""")
def bigram_vectors(spark, d):
    c = corpus(spark, d)
    return txt.fit_vectorizer(c, "count", (1, 2)).transform(c).drop("index")


TFIDF = "SELECT doc_id, i::INT AS index, term, round((1 + ln(tf)) * idf / sqrt(sum(((1 + ln(tf)) * idf) ** 2) OVER (PARTITION BY doc_id)), 6) AS weight"


@query("n19_tfidf", f"WITH {VOCAB} {TFIDF} FROM tf JOIN voc USING (term)")
def tfidf(spark, d):
    c = corpus(spark, d)
    return txt.fit_vectorizer(c, "tfidf").transform(c).withColumn("weight", F.round("weight", 6))


@query("n20_transform_fitted", f"""WITH {VOCAB}, nt AS (SELECT item_id AS doc_id, term, count(*) AS tf FROM (SELECT item_id, unnest({TOK}) AS term FROM benchmark) GROUP BY 1, 2)
{TFIDF} FROM nt JOIN voc USING (term)""")
def transform_fitted(spark, d):
    fitted = txt.fit_vectorizer(corpus(spark, d), "tfidf")
    return fitted.transform(table(spark, d, "benchmark"), "item_id").withColumn("weight", F.round("weight", 6))


@query("n21_matrix_stats", f"""WITH {VOCAB}, m AS (SELECT term, tf FROM tf JOIN voc USING (term)), n AS (SELECT count(*) AS n FROM documents)
SELECT term, round(sum(tf) / any_value(n), 6) AS mean_weight, (SELECT round((1 - count(*) / (any_value(n.n) * (SELECT count(*) FROM voc))) * 100, 6) FROM m, n) AS sparsity_pct FROM m, n GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""")
def matrix_stats(spark, d):
    c = corpus(spark, d)
    fitted = txt.fit_vectorizer(c, "count")
    sparsity, top = txt.matrix_stats(fitted.transform(c), c.count(), fitted.size)
    s = sparsity.first()[0]
    return top.select("term", F.round("mean_weight", 6).alias("mean_weight"), F.round(F.lit(s), 6).alias("sparsity_pct"))


RAW_LABEL = """CASE n_chars % 9 WHEN 0 THEN '1 star' WHEN 1 THEN '5 stars' WHEN 2 THEN 'NEGATIVE' WHEN 3 THEN 'LABEL_1' WHEN 4 THEN 'neu'
WHEN 5 THEN '3 stars' WHEN 6 THEN ' Pos ' WHEN 7 THEN '2 stars' ELSE source END"""
SENTI = f"""s AS (SELECT doc_id, n_chars, raw, CASE raw WHEN '1 star' THEN 'Very Negative' WHEN '5 stars' THEN 'Very Positive' WHEN '2 stars' THEN 'Negative' WHEN 'NEGATIVE' THEN 'Negative'
WHEN 'LABEL_1' THEN 'Positive' WHEN ' Pos ' THEN 'Positive' WHEN 'neu' THEN 'Neutral' WHEN '3 stars' THEN 'Neutral' ELSE raw END AS sentiment,
CASE WHEN raw IN ('1 star', '2 stars', 'NEGATIVE') THEN 'negative' WHEN raw IN ('5 stars', 'LABEL_1', ' Pos ') THEN 'positive' ELSE 'neutral' END AS polarity
FROM (SELECT doc_id, n_chars, {RAW_LABEL} AS raw FROM documents))"""


def scored(spark, d):
    docs = table(spark, d, "documents").withColumn("raw", F.expr(RAW_LABEL))
    sentiment, polarity = txt.sentiment_columns("raw")
    return docs.select("doc_id", "raw", sentiment.alias("sentiment"), polarity.alias("polarity"), ((F.col("n_chars") % 100) / 100.0).alias("confidence"))


@query("n29_sentiment_rules", f"WITH {SENTI} SELECT doc_id, sentiment, polarity FROM s")
def sentiment(spark, d):
    return scored(spark, d).select("doc_id", "sentiment", "polarity")


@query("n31_polarity_summary", f'WITH {SENTI} SELECT polarity, count(*) AS "count", round(avg((n_chars % 100) / 100.0), 6) AS mean_confidence FROM s GROUP BY 1')
def polarity(spark, d):
    return txt.polarity_summary(scored(spark, d)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("n31_sentiment_counts", f'WITH {SENTI} SELECT sentiment, count(*) AS "count" FROM s GROUP BY 1')
def sentiment_counts(spark, d):
    return txt.sentiment_counts(scored(spark, d))


@query("io5_read_text_column", "SELECT text, lang AS label FROM documents WHERE text IS NOT NULL")
def read_text_column(spark, d):
    return txt.read_text_column(table(spark, d, "documents"), "text", "lang")


@query("io6_append_to_corpus", """SELECT (row_number() OVER (ORDER BY part, id) - 1) AS doc_id, text, source FROM (SELECT 0 AS part, doc_id AS id, text, 'documents' AS source FROM documents
UNION ALL SELECT 1, item_id, text, 'benchmark' FROM benchmark)""")
def append_corpus(spark, d):
    first = txt.append_to_corpus(None, table(spark, d, "documents"), "documents", order_by="doc_id")
    return txt.append_to_corpus(first, table(spark, d, "benchmark"), "benchmark", order_by="item_id")


@query("io6_append_three_sources", """WITH c AS (SELECT count(*) AS n FROM pages), b AS (SELECT count(*) AS n FROM benchmark)
SELECT row_number() OVER (ORDER BY page_id) - 1 AS doc_id, url AS text, 'z' AS source, NULL AS label FROM pages
UNION ALL SELECT row_number() OVER (ORDER BY item_id) - 1 + (SELECT n FROM c), text, 'a', NULL FROM benchmark
UNION ALL SELECT row_number() OVER (ORDER BY doc_id) - 1 + (SELECT n FROM c) + (SELECT n FROM b), text, 'm', lang FROM documents""")
def append_three(spark, d):
    first = txt.append_to_corpus(None, table(spark, d, "pages"), "z", "url", order_by="page_id")
    second = txt.append_to_corpus(first, table(spark, d, "benchmark"), "a", order_by="item_id")
    return txt.append_to_corpus(second, table(spark, d, "documents"), "m", order_by="doc_id", label="lang")
