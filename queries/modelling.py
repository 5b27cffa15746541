"""Splits, fits and scores (M1-M5, G1-G10, L1-L14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import LINEITEM_NULLS, lineitem_nulls, query, table, union_all
from tabloom.operators import metrics, models, split


def hashed(key, seed=42):
    return f"md5({key}::VARCHAR || '-{seed}')"


@query("m1_train_test_split", f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {hashed('o_orderkey')}, o_orderkey) <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM orders""")
def plain_split(spark, d):
    return split.train_test_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2)


STRAT = f"""q AS (SELECT c, n, share, floor(share)::BIGINT + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, c) <= total - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM (
SELECT o_orderpriority AS c, count(*) AS n, ceil(0.15 * sum(count(*)) OVER ()) AS total, count(*) * ceil(0.15 * sum(count(*)) OVER ()) / sum(count(*)) OVER () AS share FROM orders GROUP BY 1))"""


@query("m1_stratified_split", f"""WITH {STRAT} SELECT o_orderkey, o_orderpriority, CASE WHEN row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hashed('o_orderkey')}, o_orderkey) <= quota THEN 'test' ELSE 'train' END AS split
FROM orders JOIN q ON c = o_orderpriority""")
def stratified(spark, d):
    return split.train_test_split(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 0.15, stratify="o_orderpriority")


@query("m2_k_fold", f"SELECT o_orderkey, ((row_number() OVER (ORDER BY {hashed('o_orderkey')}, o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def folds(spark, d):
    return split.k_fold(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("m2_stratified_k_fold", f"SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hashed('o_orderkey')}, o_orderkey) - 1) % 3)::INT AS fold FROM orders")
def stratified_folds(spark, d):
    return split.k_fold(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 3, stratify="o_orderstatus").drop("o_orderstatus")


SIZES = ("region", "customer", "labels", "orders")


@query("m3_decide_split", union_all([f"""SELECT '{t}' AS name, CASE WHEN n < 100 THEN 0.3 WHEN n < 500 THEN 0.2 ELSE 0.15 END::DOUBLE AS test_size, n < 500 AS use_cv, CASE WHEN n < 100 THEN 3 ELSE 5 END::INT AS cv_folds FROM (SELECT count(*) AS n FROM {t})""" for t in SIZES]))
def decide(spark, d):
    rows = []
    for t in SIZES:
        plan = split.decide_split(table(spark, d, t).count())
        rows.append((t, plan["test_size"], plan["use_cv"], plan["cv_folds"]))
    return spark.createDataFrame(rows, "name string, test_size double, use_cv boolean, cv_folds int")


@query("m4_complete_cases", f"WITH {LINEITEM_NULLS} SELECT l_orderkey, l_quantity, l_tax FROM lineitem_nulls WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL")
def complete(spark, d):
    return split.complete_cases(lineitem_nulls(spark, d).select("l_orderkey", "l_quantity", "l_tax"), ["l_quantity", "l_tax"])


@query("m5_encode_target", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_size) - 1 AS label FROM part")
def encode(spark, d):
    return split.encode_target(table(spark, d, "part").select("p_partkey", "p_size"), "p_size")[0].select("p_partkey", "label")


@query("m5_encode_text_target", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS label FROM part")
def encode_text(spark, d):
    return split.encode_target(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand")[0].select("p_partkey", "label")


def _li(spark, d):
    return table(spark, d, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_tax")


def _fit_sql(w):
    return f"""WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, covar_pop(l_quantity, l_extendedprice) * count(*) AS sxy, var_pop(l_quantity) * count(*) AS sxx, count(*) AS n FROM lineitem),
w AS (SELECT {w} AS w, mx, my FROM s) SELECT 'l_quantity' AS feature, round(w, 3) AS coefficient FROM w UNION ALL SELECT '(intercept)', round(my - w * mx, 3) FROM w"""


def _regression(name, choice, w, alpha):
    def run(spark, d):
        fit = models.fit_regression(_li(spark, d), ["l_quantity"], "l_extendedprice", choice, alpha)
        return models.coefficients(spark, fit).withColumn("coefficient", F.round("coefficient", 3))

    query(name, _fit_sql(w))(run)


_regression("g1_linear", "linear", "sxy / sxx", 0.0)
_regression("g2_ridge", "ridge", "sxy / (sxx + 1000.0)", 1000.0)
_regression("g3_lasso", "lasso", "greatest(sxy / n - 5000.0, 0) / (sxx / n)", 5000.0)


@query("g4_polynomial")
def polynomial(spark, d):
    li = _li(spark, d)
    fit = models.fit_regression(li, ["l_quantity", "l_discount"], "l_extendedprice", "polynomial", degree=2)
    return metrics.regression_metrics(fit.transform(li), "l_extendedprice")


SCORED = "sc AS (SELECT l_orderkey, l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem)"


def _scored(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))


@query("g5_regression_metrics", f"""WITH {SCORED} SELECT round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, count(*) AS rows FROM sc""")
def regression_metrics(spark, d):
    out = metrics.regression_metrics(_scored(spark, d), "y", "p")
    return out.withColumns({"r2": F.round("r2", 6), "rmse": F.round("rmse", 4), "mae": F.round("mae", 4)})


@query("g6_residuals", f"WITH {SCORED} SELECT l_orderkey, y AS actual, p AS predicted, round(y - p, 4) AS residual FROM sc")
def residuals(spark, d):
    return metrics.residuals(_scored(spark, d), "l_orderkey", "y", "p").withColumn("residual", F.round("residual", 4))


def orders_features(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.count(F.lit(1)).cast("double").alias("items"))
    return table(spark, d, "orders").join(li, "o_orderkey").select("o_orderkey", "o_totalprice", "o_orderstatus", "price", "quantity", "discount", "items")


@query("g7_cross_validation", f"""WITH f AS (SELECT l_orderkey, sum(l_extendedprice)::DOUBLE AS y, sum(l_quantity)::DOUBLE AS q, count(*)::DOUBLE AS i FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
k AS (SELECT *, ((row_number() OVER (ORDER BY {hashed('l_orderkey')}, l_orderkey) - 1) % 3)::INT AS fold FROM f), n AS (SELECT unnest(range(3))::INT AS fold),
s AS (SELECT n.fold, covar_pop(q, q) AS qq, covar_pop(i, i) AS ii, covar_pop(q, i) AS qi, covar_pop(q, y) AS qy, covar_pop(i, y) AS iy, avg(q) AS mq, avg(i) AS mi, avg(y) AS my FROM k, n WHERE k.fold <> n.fold GROUP BY 1),
w AS (SELECT *, (qy * ii - iy * qi) / (qq * ii - qi * qi) AS wq, (iy * qq - qy * qi) / (qq * ii - qi * qi) AS wi FROM s)
SELECT fold, round(1 - sum((y - my - wq * (q - mq) - wi * (i - mi)) ** 2) / (var_pop(y) * count(*)), 8) AS r2, round(sqrt(avg((y - my - wq * (q - mq) - wi * (i - mi)) ** 2)), 4) AS rmse FROM k JOIN w USING (fold) GROUP BY fold""")
def cross_validation(spark, d):
    scores = models.cross_validate_regression(orders_features(spark, d), "o_orderkey", ["quantity", "items"], "price", k=3)
    return scores.select("fold", F.round("r2", 8).alias("r2"), F.round("rmse", 4).alias("rmse"))


@query("g8_coefficients", """WITH f AS (SELECT sum(l_extendedprice) AS price, sum(l_quantity) AS q, count(*)::DOUBLE AS i FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey),
s AS (SELECT covar_pop(q, q) AS qq, covar_pop(i, i) AS ii, covar_pop(q, i) AS qi, covar_pop(q, price) AS qp, covar_pop(i, price) AS ip, avg(q) AS mq, avg(i) AS mi, avg(price) AS mp FROM f),
w AS (SELECT (qp * ii - ip * qi) / (qq * ii - qi * qi) AS wq, (ip * qq - qp * qi) / (qq * ii - qi * qi) AS wi, mq, mi, mp FROM s)
SELECT 'quantity' AS feature, round(wq, 3) AS coefficient FROM w UNION ALL SELECT 'items', round(wi, 3) FROM w UNION ALL SELECT '(intercept)', round(mp - wq * mq - wi * mi, 3) FROM w""")
def coefficients(spark, d):
    fit = models.fit_regression(orders_features(spark, d), ["quantity", "items"], "price")
    return models.coefficients(spark, fit).withColumn("coefficient", F.round("coefficient", 3))


@query("g9_decide_regression_model", """SELECT CASE WHEN r > 0.8 THEN 'ridge' ELSE 'linear' END AS model_choice, round(r, 6) AS max_abs_r FROM (SELECT greatest(abs(corr(l_quantity, l_extendedprice)), abs(corr(l_quantity, l_tax)), abs(corr(l_extendedprice, l_tax))) AS r FROM lineitem)""")
def decide_model(spark, d):
    out = models.decide_regression_model(_li(spark, d), ["l_quantity", "l_extendedprice", "l_tax"])
    return spark.createDataFrame([(out["model_choice"], round(out["max_abs_r"], 6))], "model_choice string, max_abs_r double")


@query("g10_auto_train_regression")
def auto_regression(spark, d):
    return models.auto_train_regression(orders_features(spark, d), "o_orderkey", ["quantity", "items", "discount"], "price")["metrics"]


def label_rows(spark, d):
    """Labelled documents with a few counts as features."""
    docs = table(spark, d, "documents")
    return docs.join(table(spark, d, "labels"), "doc_id").select(
        "doc_id", "quality", F.col("toxic").cast("double").alias("toxic"), F.col("n_chars").cast("double").alias("chars"),
        F.size(F.split("text", " ")).cast("double").alias("blanks"), F.size(F.split("text", "\n")).cast("double").alias("lines"),
        F.size(F.split("text", r"\.")).cast("double").alias("sentences"))


FEATS = ["chars", "blanks", "lines", "sentences"]


def _classifier(name, choice, **kw):
    def run(spark, d):
        data = label_rows(spark, d).withColumn("quality", F.col("quality").cast("double"))
        scaled = data.withColumns({f: F.log1p(f) for f in FEATS})
        fit = models.fit_classifier(scaled, FEATS, "quality", choice, "doc_id", **kw)
        return metrics.accuracy(fit.transform(scaled), "quality")

    query(name)(run)


_classifier("l1_logistic", "logistic")
_classifier("l3_svm_rbf", "svm_rbf")
_classifier("l4_linear_svc", "linear_svc")
_classifier("l5_decision_tree", "decision_tree")
_classifier("l6_random_forest", "random_forest")

FEAT_SQL = """f AS (SELECT doc_id, quality, toxic, n_chars::DOUBLE AS chars, len(string_split(text, ' '))::DOUBLE AS blanks, len(string_split(text, chr(10)))::DOUBLE AS lines, len(string_split(text, '.'))::DOUBLE AS sentences FROM documents JOIN labels USING (doc_id))"""


@query("l2_knn_classifier", """WITH t AS (SELECT *, row_number() OVER (ORDER BY md5(vec_id::VARCHAR || '-42'), vec_id) <= ceil(0.2 * count(*) OVER ()) AS test FROM embeddings),
dist AS (SELECT a.vec_id, b.vec_id AS other, b.label, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS dd FROM t a JOIN t b ON a.test AND NOT b.test),
near AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dd, other) <= 5),
v AS (SELECT vec_id, label, count(*) AS n FROM near GROUP BY 1, 2)
SELECT vec_id, label::DOUBLE AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1""")
def knn(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    parts = split.train_test_split(e, "vec_id", 0.2)
    fit = models.fit_classifier(parts.where("split = 'train'"), [f"e{i}" for i in range(64)], "label", "knn", "vec_id", k=5)
    return fit.transform(parts.where("split = 'test'")).select("vec_id", "prediction")


@query("l7_naive_bayes", f"""WITH {FEAT_SQL}, l AS (SELECT quality, unnest(['chars', 'blanks', 'lines', 'sentences']) AS feature, unnest([chars, blanks, lines, sentences]) AS x FROM f),
s AS (SELECT quality, feature, sum(x) AS s FROM l GROUP BY 1, 2), c AS (SELECT quality, count(*) AS n FROM f GROUP BY 1)
SELECT quality::DOUBLE AS class, round(ln(n / sum(n) OVER (PARTITION BY feature)), 6) AS log_prior, feature, round(ln((s + 1) / (sum(s) OVER (PARTITION BY quality) + 4)), 6) AS log_probability FROM s JOIN c USING (quality)""")
def naive_bayes(spark, d):
    out = models.fit_naive_bayes(label_rows(spark, d), FEATS, "quality").table(spark)
    return out.withColumns({"log_prior": F.round("log_prior", 6), "log_probability": F.round("log_probability", 6)})


PRED = f"{FEAT_SQL}, p AS (SELECT doc_id, quality AS label, CASE WHEN lines > 2 THEN 1 ELSE 0 END AS prediction FROM f)"


def predictions(spark, d):
    return label_rows(spark, d).select("doc_id", F.col("quality").alias("label"), F.when(F.col("lines") > 2, 1).otherwise(0).alias("prediction"))


@query("l8_confusion", f'WITH {PRED} SELECT label AS actual, prediction AS predicted, count(*) AS "count" FROM p GROUP BY 1, 2')
def confusion(spark, d):
    return metrics.confusion(predictions(spark, d))


@query("l8_accuracy", f"WITH {PRED} SELECT round(avg((label = prediction)::INT), 6) AS accuracy, count(*) AS rows FROM p")
def accuracy(spark, d):
    return metrics.accuracy(predictions(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


REPORT = f"""{PRED}, k AS (SELECT c, count(*) FILTER (label = c) AS support, count(*) FILTER (prediction = c) AS chosen, count(*) FILTER (label = c AND prediction = c) AS hits FROM p, (SELECT DISTINCT label AS c FROM p UNION SELECT DISTINCT prediction FROM p) GROUP BY c),
r AS (SELECT c::VARCHAR AS class, CASE WHEN chosen > 0 THEN hits / chosen ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall, CASE WHEN chosen + support > 0 THEN 2 * hits / (chosen + support) ELSE 0 END AS f1, support FROM k)"""


@query("l8_classification_report", f"""WITH {REPORT} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM r
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM r""")
def report(spark, d):
    out = metrics.classification_report(predictions(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("l8_correct_flags", f"WITH {PRED} SELECT doc_id, label AS actual, prediction AS predicted, label = prediction AS correct FROM p")
def flags(spark, d):
    return metrics.correct_flags(predictions(spark, d), "doc_id")


@query("l9_cross_validated_accuracy")
def cv_accuracy(spark, d):
    data = label_rows(spark, d).withColumn("quality", F.col("quality").cast("double"))
    return models.cross_validate_classifier(data, "doc_id", FEATS, "quality", "decision_tree", 3)


@query("l10_feature_importances")
def importances(spark, d):
    data = label_rows(spark, d).withColumn("quality", F.col("quality").cast("double"))
    return models.feature_importances(spark, models.fit_classifier(data, FEATS, "quality", "random_forest"))


@query("l11_decide_classification_model", union_all([f"SELECT '{t}' AS name, CASE WHEN count(*) < 150 THEN 'logistic' ELSE 'random_forest' END AS model_choice FROM {t}" for t in SIZES]))
def decide_classifier(spark, d):
    return spark.createDataFrame([(t, models.decide_classification_model(table(spark, d, t).count())["model_choice"]) for t in SIZES], "name string, model_choice string")


@query("l12_auto_train_classification")
def auto_classification(spark, d):
    return models.auto_train_classification(label_rows(spark, d), "doc_id", FEATS, "quality")["report"]


@query("l13_predict_classes")
def predict_classes(spark, d):
    rows = label_rows(spark, d)
    out = models.auto_train_classification(rows, "doc_id", FEATS, "quality")
    docs = table(spark, d, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("chars"), F.size(F.split("text", " ")).cast("double").alias("blanks"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"), F.lit(None).cast("double").alias("sentences"))
    return metrics.class_distribution(models.predict_classes(out["fit"], docs, out["mapping"]), "predicted_label")


@query("l14_predict_regression", """WITH w AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem),
s AS (SELECT l_extendedprice AS y, b + a * CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity ELSE 0 END AS p FROM lineitem, w)
SELECT round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, count(*) AS rows FROM s""")
def predict_regression(spark, d):
    fit = models.fit_regression(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    _, m = models.predict_regression(fit, lineitem_nulls(spark, d), "l_extendedprice")
    return m.withColumns({"r2": F.round("r2", 6), "rmse": F.round("rmse", 4), "mae": F.round("mae", 4)})
