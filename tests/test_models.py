"""Known answers and properties of models, cleaning, text, XML, image and streaming operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import textcols as tx
from tabloom.operators import clean, convert, explore, image, metrics, models, profile, split, text, topics, xml
from tabloom.operators import relational as rel
from tabloom.plans.recipe import Recipe
from tabloom.sources import files, xmldocs


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    x[:, 1] += 0.8 * x[:, 0]
    y = 3 + x @ [2.0, -1.0] + rng.normal(size=200) * 0.1
    rows = [(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id bigint, a double, b double, y double").cache(), x, y


def coefs(spark, fit):
    return {r["feature"]: r["coefficient"] for r in models.coefficients(spark, fit).collect()}


def test_ridge_matches_closed_form(spark, linear):
    df, x, y = linear
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 25 * np.eye(2), xc.T @ yc)
    got = coefs(spark, models.fit_regression(df, ["a", "b"], "y", "ridge", 25.0))
    assert [got["a"], got["b"]] == pytest.approx(list(want), rel=1e-5)


def test_lasso_matches_coordinate_descent(spark, linear):
    df, x, y = linear
    xc, yc, w = x - x.mean(0), y - y.mean(), np.zeros(2)
    for _ in range(2000):
        for j in range(2):
            r = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ r / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - 0.5, 0) / (xc[:, j] @ xc[:, j] / len(y))
    got = coefs(spark, models.fit_regression(df, ["a", "b"], "y", "lasso", 0.5))
    assert [got["a"], got["b"]] == pytest.approx(list(w), abs=1e-4)


def test_logistic_matches_newton(spark, linear):
    df, x, y = linear
    t = (y > 3).astype(float)
    z, w = np.c_[x, np.ones(len(x))], np.zeros(3)
    pen = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + pen, z.T @ (p - t) + pen @ w)
    fit = models.fit_classifier(df.withColumn("t", (F.col("y") > 3).cast("double")), ["a", "b"], "t", "logistic")
    lr = fit.model.stages[-1]
    assert list(lr.coefficients) + [lr.intercept] == pytest.approx(list(w), rel=1e-3)


def test_rbf_svm_separates_a_ring(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(300, 2))
    rows = [(i, float(a), float(b), float(a * a + b * b > 1.4)) for i, (a, b) in enumerate(p)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, t double")
    fit = models.fit_classifier(df, ["a", "b"], "t", "svm_rbf", c=10.0)
    assert metrics.accuracy(fit.transform(df), "t").first()["accuracy"] > 0.93


def test_naive_bayes_rejects_negative(spark, linear):
    with pytest.raises(ValueError):
        models.fit_naive_bayes(linear[0].withColumn("t", F.lit(0)), ["a"], "t")


def test_split_sizes_are_exact(spark):
    df = spark.range(1003).withColumn("c", F.when(F.col("id") < 400, "x").otherwise("y"))
    parts = split.train_test_split(df, "id", 0.2, stratify="c")
    assert parts.where("split = 'test'").count() == math.ceil(0.2 * 1003)
    sizes = [r["count"] for r in split.k_fold(df, "id", 4).groupBy("fold").count().collect()]
    assert sum(sizes) == 1003 and max(sizes) - min(sizes) <= 1


def test_recipe_round_trip_and_constant_column(spark):
    df = spark.createDataFrame([(1, 1.0, None, "a"), (2, 1.0, 4.0, None), (3, 1.0, 8.0, "a")], "id int, k double, v double, s string")
    out = clean.auto_preprocess(df, "ridge", exclude=["id"])
    again = Recipe.from_df(out.recipe.to_df(spark)).transform(df)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.df.collect()))
    assert {r["k"] for r in out.df.collect()} == {0.0}
    assert {r["s"] for r in out.df.collect()} == {"a"}


def test_integer_median_that_is_a_fraction(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert sorted(r["v"] for r in clean.fill_missing(df, ["v"], "median").collect()) == [1, 1.5, 2]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    row = profile.dataset_overview(df).first()
    assert (row["unique"], row["missing"], row["missing_pct"]) == (1, 2, 66.7)
    assert profile.histogram(df, "v", 4).agg(F.sum("count")).first()[0] == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "v double, s string")
    assert [r["missing_pct"] for r in profile.dataset_overview(df).collect()] == [0.0, 0.0]
    assert explore.column_utility(df) == [("v", False, "entirely missing", 1.0), ("s", False, "entirely missing", 1.0)]
    assert profile.missing_value_summary(df).count() == 0


def test_identifier_rule_exempts_numbers_and_dates(spark):
    df = spark.range(100).select(
        (F.col("id") * 1.5).alias("reading"), F.col("id").alias("user_id"), F.concat(F.lit("u"), "id").alias("name"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,cast(id as int))").alias("day"), F.lit(1).alias("one"))
    reasons = {c: r for c, _, r, _ in explore.column_utility(df)}
    assert reasons == {"reading": None, "user_id": "identifier", "name": "identifier", "day": None, "one": "near-constant"}


def test_merge_null_keys_and_suffixes(spark):
    a = spark.createDataFrame([(1, "l"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(None, "m"), (2, "r")], "k int, v string")
    got = {tuple(r) for r in rel.merge(a, b, ["k"], "outer").collect()}
    assert got == {(1, "l", None), (None, "n", "m"), (2, None, "r")}


def test_boolean_conversion_variants(spark):
    df = spark.createDataFrame([("false",), ("",), (None,), ("x",)], "s string")
    assert [r[0] for r in convert.convert_dtypes(df, ["s"], "boolean").collect()] == [True, False, True, True]
    assert [r[0] for r in convert.convert_dtypes(df, ["s"], "boolean", truthy=False).collect()] == [False, None, None, None]


def test_contractions_in_both_orders(spark):
    df = spark.createDataFrame([("I won't, can't; it's",)], "t string")
    one = df.select(tx.expand_contractions("t").alias("a"), tx.expand_contractions("t", True).alias("b")).first()
    assert one["a"] == "I wo not, ca not; it is"
    assert one["b"] == "I will not, cannot; it is"


def test_cleaning_steps_are_idempotent(spark):
    df = spark.createDataFrame([("Hello <b>Wörld</b> @you #tag 12 a.b@c.de www.x.y  éà--",)], "text string")
    for step in ("lowercase", "urls", "markup", "punctuation", "digits", "short_tokens"):
        once = text.clean(df, [step], "text", "o")
        twice = text.clean(once, [step], "o", "p").first()
        assert twice["o"] == twice["p"], step


def test_kwic_edges(spark):
    df = spark.createDataFrame([(0, "one two Three"), (1, "none"), (2, "")], "doc_id int, text string")
    got = [tuple(r) for r in text.kwic(df, "ONE", window=1).orderBy("doc_id").collect()]
    assert got == [(0, 0, "", "one", "two"), (1, 0, "", "none", "")]
    assert text.kwic(df, "one", whole_word=True).count() == 1
    assert text.kwic(df, "  ").count() == 0


def test_unseen_terms_and_empty_documents(spark):
    docs = spark.createDataFrame([(0, "red red blue"), (1, "blue green")], "doc_id int, text string")
    fit = text.fit_vectorizer(docs, "tfidf")
    new = spark.createDataFrame([(7, "yellow"), (8, "blue")], "doc_id int, text string")
    assert [(r["doc_id"], r["term"], r["weight"]) for r in fit.transform(new).collect()] == [(8, "blue", 1.0)]
    assert {r["doc_id"]: r["features"].numNonzeros() for r in fit.vectors(new).collect()} == {7: 0, 8: 1}


def test_nmf_separates_two_vocabularies(spark):
    rows = [(i, j, f"t{j}", 1.0) for i in range(20) for j in (range(4) if i % 2 else range(4, 8))]
    fit = topics.fit_nmf(spark.createDataFrame(rows, "doc_id int, index int, term string, weight double"), 8, 2, 100)
    best = {r["doc_id"]: r["topic"] for r in topics.dominant_topic(fit).collect()}
    assert len({best[i] for i in range(0, 20, 2)}) == 1 and best[0] != best[1]
    with pytest.raises(ValueError):
        topics.fit_nmf(spark.createDataFrame([(0, 0, "t", -1.0)], "doc_id int, index int, term string, weight double"), 1, 1)


def test_softmax_and_first_label_wins(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1000.0, 0.0],)], "l array<double>")
    got = [(r["raw_label"], r["confidence"]) for r in topics.label_scores(df, "l", ["a", "b"]).collect()]
    assert got == [("a", 0.5), ("a", 1.0)]


XML = '<r a="1"><x k="1"><y/> <z><w> </w></z>tail</x><x k="2"><y>t</y></x><x k="1"><y/><z><w/></z></x><n:q xmlns:n="u">v</n:q></r>'


@pytest.fixture(scope="module")
def tree(spark):
    docs = spark.createDataFrame([(1, XML), (2, "<broken>"), (3, '<!DOCTYPE r [<!ENTITY a "b">]><r>&a;</r>')], "doc_id int, xml string")
    parsed = xmldocs.parse_elements(docs).cache()
    assert {r["doc_id"] for r in xmldocs.parse_errors(parsed).collect()} == {2, 3}
    return xmldocs.elements(parsed).cache()


def paths(df):
    return sorted(r["path"] for r in df.collect())


def test_xml_rows(tree):
    rows = {r["path"]: r for r in tree.collect()}
    assert rows["/r[1]/q[1]"]["namespace"] == "u" and rows["/r[1]"]["content_text"] == "tail t v"
    assert rows["/r[1]/x[1]"]["last_ord"] == 5 and rows["/r[1]/x[1]/z[1]"]["tail"] == "tail"


def test_xml_empty_cascade_and_dedupe(tree):
    assert paths(xml.drop_empty(tree)) == ["/r[1]", "/r[1]/q[1]", "/r[1]/x[1]", "/r[1]/x[2]", "/r[1]/x[2]/y[1]", "/r[1]/x[3]"]
    by_key = paths(xml.dedupe_by_key(tree, "x", "@k"))
    assert "/r[1]/x[3]" not in by_key and "/r[1]/x[2]/y[1]" in by_key
    # x[1] and x[3] differ by a tail, so exact deduplication keeps both
    assert "/r[1]/x[3]" in paths(xml.dedupe_exact(tree))
    assert "/r[1]/x[3]" not in paths(xml.dedupe_exact(tree.withColumn("tail", F.lit(None).cast("string"))))


def test_xml_renumber_after_removal(tree):
    kept = xml.dedupe_by_key(tree.withColumn("attrs", F.when(F.col("path") == "/r[1]/x[2]", F.create_map(F.lit("k"), F.lit("1"))).otherwise(F.col("attrs"))), "x", "@k")
    assert paths(xml.renumber(kept.where("path <> '/r[1]/x[1]/y[1]'"))) == ["/r[1]", "/r[1]/q[1]", "/r[1]/x[1]", "/r[1]/x[1]/z[1]", "/r[1]/x[1]/z[1]/w[1]"]
    with pytest.raises(ValueError):
        xml.rename_attribute(tree.withColumn("attrs", F.create_map(F.lit("k"), F.lit("1"), F.lit("j"), F.lit("2"))), "k", "j")


def test_xml_refresh_equals_parse(tree):
    again = xml.refresh_content(tree).select("path", "content_text")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, tree.select("path", "content_text").collect()))


def test_flatten_ragged_json(spark):
    docs = spark.createDataFrame([('{"meta": "[1]", "rows": [{"a": 1, "b": [1, 2]}, {"a": 2.5, "b": []}]}',)], "value string")
    flat = files.flatten_nested(files.typed_records(files.json_records(docs)))
    assert sorted(flat.columns) == ["a", "b__0", "b__1"]
    assert sorted(map(str, flat.collect())) == sorted(["Row(a=1.0, b__0=1, b__1=2)", "Row(a=2.5, b__0=None, b__1=None)"])


def test_object_regions_against_flood_fill(spark):
    rng = np.random.default_rng(11)
    rows, masks = [], {}
    for i in range(3):
        g = np.where(rng.random((14, 17)) < 0.45, 20, 220)
        masks[i] = g == 20
        rows += [(i, y, x, int(g[y, x]), int(g[y, x]), int(g[y, x])) for y in range(14) for x in range(17)]
    px = spark.createDataFrame(rows, "image_id int, y int, x int, r int, g int, b int")
    got = sorted((r["image_id"], r["area"], r["x"], r["y"], r["w"], r["h"]) for r in image.object_regions(px, 0).collect())
    want = []
    for i, m in masks.items():
        seen = np.zeros_like(m)
        for y, x in zip(*np.nonzero(m)):
            if not seen[y, x]:
                todo, cells = [(y, x)], []
                seen[y, x] = True
                while todo:
                    a, b = todo.pop()
                    cells.append((a, b))
                    for c in range(max(0, a - 1), min(14, a + 2)):
                        for e in range(max(0, b - 1), min(17, b + 2)):
                            if m[c, e] and not seen[c, e]:
                                seen[c, e] = True
                                todo.append((c, e))
                ys, xs = zip(*cells)
                want.append((i, len(cells), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
    assert got == sorted(want)


def test_streaming_recipe_and_daily_counts(spark, tmp_path):
    from tabloom.streaming import daily

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path / "events")
    src.repartition(3).write.parquet(path)
    fitted = clean.fit_scaler(src, ["value"], "standard")
    stream = spark.readStream.schema(src.schema).parquet(path)
    q = daily.apply_recipe(stream, fitted).writeStream.format("memory").queryName("scaled").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scaled").agg(F.round(F.avg("value"), 6)).first()[0] == 0.0
    q = daily.daily_counts(stream, "ts").writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("days").agg(F.sum("count")).first()[0] == src.count()
