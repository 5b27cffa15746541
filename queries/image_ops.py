"""Images (IM1-IM17): every embedding becomes an 8 x 8 colour image."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import SQL, query, table
from queries.io_ops import png_files
from tabloom.operators import image, metrics, models
from tabloom.session import cut_lineage
from tabloom.sources import archives, files


def pixels(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 0.6) * 220).cast("int")))
    return e.select("image_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), v.alias("r")).withColumns(
        {"g": (F.col("r") * 3) % 256, "b": 255 - F.col("r")})


PX = """px AS (SELECT *, floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5)::INT AS gray FROM (SELECT image_id, y, x, r, (r * 3) % 256 AS g, 255 - r AS b FROM (
SELECT vec_id AS image_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, greatest(0, least(255, floor((embedding[i]::DOUBLE + 0.6) * 220)))::INT AS r FROM embeddings, (SELECT unnest(range(1, 65)) AS i))))"""


@query("im1_pixel_table", """SELECT 'img_' || vec_id || '.png' AS image_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, greatest(0, least(255, floor((embedding[i]::DOUBLE + 0.6) * 220)))::INT AS r FROM embeddings, (SELECT unnest(range(1, 65)) AS i)""")
def pixel_table(spark, d):
    folder = files.scratch_path(spark, "images")
    archives.store_files(png_files(spark, d), folder).agg(F.sum("size")).collect()
    images = archives.read_images(spark, folder).select(F.col("name").alias("image_id"), "image")
    return image.pixel_table(images).where("r = g AND g = b").select("image_id", "y", "x", "r")


@query("im2_channel_stats", f"""WITH {PX} SELECT image_id, max(x)::INT + 1 AS "Width", max(y)::INT + 1 AS "Height", round((max(x) + 1) / (max(y) + 1), 3) AS "Aspect_Ratio", """ + ", ".join(
    f'round(avg({c}), 2) AS "{n}_Mean", round(stddev_pop({c}), 2) AS "{n}_Std"' for c, n in (("r", "Red"), ("g", "Green"), ("b", "Blue"), ("gray", "Gray"))) + " FROM px GROUP BY 1")
def channel_stats(spark, d):
    return image.basic_stats(pixels(spark, d)).drop("Gray_Skewness")


@query("im3_gray_skewness", f"""WITH {PX}, m AS (SELECT image_id, avg(gray) AS mu FROM px GROUP BY 1) SELECT image_id, round(avg((gray - mu) ** 3) / avg((gray - mu) ** 2) ** 1.5, 3) AS "Gray_Skewness" FROM px JOIN m USING (image_id) GROUP BY 1""")
def skewness(spark, d):
    return image.basic_stats(pixels(spark, d)).select("image_id", "Gray_Skewness")


@query("im4_gray", f"WITH {PX} SELECT image_id, y, x, gray AS v FROM px")
def gray(spark, d):
    return image.channel(pixels(spark, d), "gray")


@query("im5_glcm", f"""WITH {PX}, p AS (SELECT image_id, gray // 16 AS i, lead(gray) OVER (PARTITION BY image_id, y ORDER BY x) // 16 AS j FROM px),
s AS (SELECT image_id, i, j FROM p WHERE j IS NOT NULL UNION ALL SELECT image_id, j, i FROM p WHERE j IS NOT NULL),
c AS (SELECT image_id, i, j, count(*)::DOUBLE AS n, (sum(count(*)) OVER (PARTITION BY image_id))::DOUBLE AS t, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY image_id) AS p FROM s GROUP BY 1, 2, 3),
m AS (SELECT image_id, sum(i * p) AS mu FROM c GROUP BY 1), v AS (SELECT image_id, sum((i - mu) ** 2 * p) AS var FROM c JOIN m USING (image_id) GROUP BY 1)
SELECT image_id, round(sum(n * (i - j) ** 2) / any_value(t), 4) AS "GLCM_Contrast", round(sum(n * abs(i - j)) / any_value(t), 4) AS "GLCM_Dissimilarity", round(sum(n / (1 + (i - j) ** 2)) / any_value(t), 4) AS "GLCM_Homogeneity",
round(sum(n * n) / any_value(t * t), 4) AS "GLCM_Energy_ASM", round(CASE WHEN any_value(var) > 1e-12 THEN sum(p * (i - mu) * (j - mu)) / any_value(var) ELSE 0 END, 4) AS "GLCM_Correlation" FROM c JOIN m USING (image_id) JOIN v USING (image_id) GROUP BY 1""")
def glcm(spark, d):
    return image.glcm(pixels(spark, d))


HU = f"""{PX}, m AS (SELECT image_id, """ + ", ".join(
    f"sum(gray::DOUBLE * x::DOUBLE ** {p} * y::DOUBLE ** {q}) AS m{p}{q}" for p in range(4) for q in range(4 - p)) + """ FROM px GROUP BY 1),
c AS (SELECT *, m10 / m00 AS cx, m01 / m00 AS cy FROM m),
n AS (SELECT image_id, (m20 - cx * m10) / (m00 * m00) AS n20, (m11 - cx * m01) / (m00 * m00) AS n11, (m02 - cy * m01) / (m00 * m00) AS n02,
(m30 - 3 * cx * m20 + 2 * cx * cx * m10) / (m00 * m00 * sqrt(m00)) AS n30, (m21 - 2 * cx * m11 - cy * m20 + 2 * cx * cx * m01) / (m00 * m00 * sqrt(m00)) AS n21,
(m12 - 2 * cy * m11 - cx * m02 + 2 * cy * cy * m10) / (m00 * m00 * sqrt(m00)) AS n12, (m03 - 3 * cy * m02 + 2 * cy * cy * m01) / (m00 * m00 * sqrt(m00)) AS n03 FROM c),
h AS (SELECT image_id, n20 + n02 AS h1, (n20 - n02) * (n20 - n02) + 4 * n11 * n11 AS h2, (n30 - 3 * n12) * (n30 - 3 * n12) + (3 * n21 - n03) * (3 * n21 - n03) AS h3,
(n30 + n12) * (n30 + n12) + (n21 + n03) * (n21 + n03) AS h4,
(n30 - 3 * n12) * (n30 + n12) * ((n30 + n12) * (n30 + n12) - 3 * (n21 + n03) * (n21 + n03)) + (3 * n21 - n03) * (n21 + n03) * (3 * (n30 + n12) * (n30 + n12) - (n21 + n03) * (n21 + n03)) AS h5,
(n20 - n02) * ((n30 + n12) * (n30 + n12) - (n21 + n03) * (n21 + n03)) + 4 * n11 * (n30 + n12) * (n21 + n03) AS h6,
(3 * n21 - n03) * (n30 + n12) * ((n30 + n12) * (n30 + n12) - 3 * (n21 + n03) * (n21 + n03)) - (n30 - 3 * n12) * (n21 + n03) * (3 * (n30 + n12) * (n30 + n12) - (n21 + n03) * (n21 + n03)) AS h7 FROM n)"""


@query("im6_hu_moments", f"WITH {HU} SELECT image_id, " + ", ".join(f'round(CASE WHEN h{k} = 0 THEN 0 ELSE -sign(h{k}) * log10(abs(h{k})) END, 4) AS "Hu_Moment_{k}"' for k in range(1, 8)) + " FROM h")
def hu(spark, d):
    return image.hu_moments(pixels(spark, d))


def grad_sql(side, centre, replicate=False):
    """Neighbours by position in one list per image, with mirrored (or clamped) coordinates: another route than the windows."""
    mirror = lambda c, k: f"CASE WHEN {c} + ({k}) < 0 THEN 1 WHEN {c} + ({k}) > 7 THEN 6 ELSE {c} + ({k}) END"
    if replicate:
        mirror = lambda c, k: f"greatest(0, least(7, {c} + ({k})))"
    at = lambda dx, dy: f"g[({mirror('y', dy)}) * 8 + ({mirror('x', dx)}) + 1]"
    gx = f"({side} * ({at(1, -1)} - {at(-1, -1)}) + {centre} * ({at(1, 0)} - {at(-1, 0)}) + {side} * ({at(1, 1)} - {at(-1, 1)}))::DOUBLE"
    gy = f"({side} * ({at(-1, 1)} - {at(-1, -1)}) + {centre} * ({at(0, 1)} - {at(0, -1)}) + {side} * ({at(1, 1)} - {at(1, -1)}))::DOUBLE"
    return f"""{PX}, im AS (SELECT image_id, list(gray ORDER BY y, x) AS g FROM px GROUP BY 1), pos AS (SELECT image_id, g, y::INT AS y, x::INT AS x FROM im, range(8) a(y), range(8) b(x)),
gr AS (SELECT image_id, y, x, {gx} AS gx, {gy} AS gy FROM pos)"""


@query("im7_gradient_edge_ratio", f"WITH {grad_sql(1, 2)} SELECT image_id, round(avg((sqrt(gx * gx + gy * gy) >= 100)::INT), 4) AS gradient_edge_ratio FROM gr GROUP BY 1")
def edge_ratio(spark, d):
    return image.gradient_edge_ratio(pixels(spark, d))


@query("im7_canny_edge_ratio", f"""WITH RECURSIVE {grad_sql(1, 2, True)}, mg AS (SELECT *, abs(gx) + abs(gy) AS m, CASE WHEN abs(gy) * 32768 < abs(gx) * 13573 THEN 'row' WHEN abs(gy) * 32768 > abs(gx) * 79109 THEN 'column' ELSE 'diagonal' END AS way FROM gr),
st AS (SELECT *, CASE way WHEN 'row' THEN 1 WHEN 'column' THEN 0 ELSE CASE WHEN gx * gy < 0 THEN -1 ELSE 1 END END AS dx, CASE way WHEN 'row' THEN 0 ELSE 1 END AS dy FROM mg),
cand AS (SELECT s.image_id, s.y, s.x, s.m FROM st s LEFT JOIN mg a ON a.image_id = s.image_id AND a.y = s.y - s.dy AND a.x = s.x - s.dx LEFT JOIN mg b ON b.image_id = s.image_id AND b.y = s.y + s.dy AND b.x = s.x + s.dx
WHERE s.m > 100 AND s.m > coalesce(a.m, 0) AND CASE s.way WHEN 'diagonal' THEN s.m > coalesce(b.m, 0) ELSE s.m >= coalesce(b.m, 0) END),
ed AS (SELECT image_id, y, x FROM cand WHERE m > 200 UNION SELECT c.image_id, c.y, c.x FROM ed JOIN cand c ON c.image_id = ed.image_id AND abs(c.y - ed.y) <= 1 AND abs(c.x - ed.x) <= 1)
SELECT i.image_id, round(count(ed.x) / 64, 4) AS "Edge_Pixel_Ratio" FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN ed ON ed.image_id = i.image_id GROUP BY 1""")
def canny_ratio(spark, d):
    return image.canny_edge_ratio(pixels(spark, d))


@query("im8_intensity_histogram", f'WITH {PX} SELECT image_id, channel, value, count(*) AS "count" FROM (' + " UNION ALL ".join(f"SELECT image_id, '{c}' AS channel, {c} AS value FROM px" for c in ("r", "g", "b", "gray")) + ") GROUP BY 1, 2, 3")
def histogram(spark, d):
    return image.intensity_histogram(pixels(spark, d))


@query("im8_log_histogram", f'WITH {PX} SELECT image_id, channel, value, round(ln(1 + count(*)), 6) AS "count" FROM (' + " UNION ALL ".join(f"SELECT image_id, '{c}' AS channel, {c} AS value FROM px" for c in ("r", "g", "b", "gray")) + ") GROUP BY 1, 2, 3")
def log_histogram(spark, d):
    return image.intensity_histogram(pixels(spark, d), True).withColumn("count", F.round("count", 6))


@query("im9_orientation_histogram", f"""WITH {grad_sql(1, 2)} SELECT image_id, least(floor(CASE WHEN degrees(atan2(gy, gx)) < 0 THEN degrees(atan2(gy, gx)) + 360 ELSE degrees(atan2(gy, gx)) END / 40.0::DOUBLE), 8)::INT AS bin,
round(sum(sqrt(gx * gx + gy * gy)), 4) AS weight FROM gr GROUP BY 1, 2""")
def orientation(spark, d):
    return image.orientation_histogram(pixels(spark, d)).withColumn("weight", F.round("weight", 4))


OTSU = f"""{PX}, hh AS (SELECT image_id, gray AS v, count(*)::DOUBLE AS n FROM px GROUP BY 1, 2),
cc AS (SELECT *, sum(n) OVER u AS w, sum(n * v) OVER u AS s, sum(n) OVER a AS t, sum(n * v) OVER a AS st FROM hh WINDOW u AS (PARTITION BY image_id ORDER BY v), a AS (PARTITION BY image_id)),
ot AS (SELECT image_id, v AS threshold FROM cc QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN t > w THEN (s * t - st * w) * (s * t - st * w) / (w * (t - w)) ELSE 0 END DESC, v) = 1)"""


@query("im10_otsu_threshold", f"WITH {OTSU} SELECT * FROM ot")
def otsu(spark, d):
    return image.otsu_thresholds(pixels(spark, d))


@query("im10_binarize_otsu_inverted", f"WITH {OTSU} SELECT image_id, y, x, CASE WHEN gray > threshold THEN 0 ELSE 255 END::INT AS v FROM px JOIN ot USING (image_id)")
def otsu_inverted(spark, d):
    return image.binarize(pixels(spark, d), None, True)


@query("im10_binarize_global", f"WITH {PX} SELECT image_id, y, x, CASE WHEN gray > 128 THEN 255 ELSE 0 END::INT AS v FROM px")
def binarize(spark, d):
    return image.binarize(pixels(spark, d), 128)


@query("im11_equalize", f"""WITH {PX}, hh AS (SELECT image_id, gray AS v, count(*) AS n FROM px GROUP BY 1, 2),
lut AS (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS cdf, sum(n) OVER (PARTITION BY image_id) AS total, first_value(n) OVER (PARTITION BY image_id ORDER BY v) AS low FROM hh)
SELECT image_id, y, x, CASE WHEN total = low THEN gray ELSE floor((cdf - low) * 255.0::DOUBLE / (total - low) + 0.5) END::INT AS v FROM px JOIN lut USING (image_id) WHERE lut.v = gray""")
def equalize(spark, d):
    return image.equalize(pixels(spark, d))


@query("im11_gamma", f"WITH {PX} SELECT image_id, y, x, " + ", ".join(f"floor(pow({c} / 255.0::DOUBLE, 1.0::DOUBLE / 1.7::DOUBLE) * 255.0::DOUBLE)::INT AS {c}" for c in "rgb") + " FROM px")
def gamma(spark, d):
    return image.gamma_correct(pixels(spark, d), 1.7)


@query("im11_brightness_contrast", f"WITH {PX} SELECT image_id, y, x, " + ", ".join(f"least(round_even(abs({c} * 1.3::DOUBLE - 20.0::DOUBLE), 0), 255)::INT AS {c}" for c in "rgb") + " FROM px")
def brightness(spark, d):
    return image.brightness_contrast(pixels(spark, d), 1.3, -20.0)


@query("im12_sobel", f"WITH {grad_sql(1, 2)} SELECT image_id, y, x, gx, gy, round(sqrt(gx * gx + gy * gy), 6) AS magnitude FROM gr")
def sobel(spark, d):
    return image.gradients(pixels(spark, d)).drop("v").withColumn("magnitude", F.round("magnitude", 6))


@query("im12_scharr", f"WITH {grad_sql(3, 10)} SELECT image_id, y, x, gx, gy, round(sqrt(gx * gx + gy * gy), 6) AS magnitude FROM gr")
def scharr(spark, d):
    return image.gradients(pixels(spark, d), image.SCHARR).drop("v").withColumn("magnitude", F.round("magnitude", 6))


@query("im13_channel_split", f"WITH {PX} SELECT image_id, y, x, b AS v FROM px")
def channel_split(spark, d):
    return image.channel(pixels(spark, d), "b")


@query("im14_dominant_colours")
def dominant(spark, d):
    return image.dominant_colours(pixels(spark, d))


@query("im15_object_regions")
def regions(spark, d):
    return image.object_regions(pixels(spark, d), 3)


@query("im16_feature_table", "SELECT * FROM " + " JOIN ".join(f"({SQL[n]})" + (" USING (image_id)" if i else "") for i, n in enumerate(
    ("im2_channel_stats", "im3_gray_skewness", "im5_glcm", "im6_hu_moments", "im7_gradient_edge_ratio", "im7_canny_edge_ratio"))))
def feature_table(spark, d):
    return image.feature_table(pixels(spark, d))


@query("im17_image_classifier")
def classifier(spark, d):
    feats = ["Red_Mean", "Red_Std", "Gray_Mean", "Gray_Std", "GLCM_Contrast", "GLCM_Correlation"]
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    data = cut_lineage(image.feature_table(pixels(spark, d)).join(labels, "image_id"))
    out = models.auto_train_classification(data, "image_id", feats, "label")
    return metrics.accuracy(out["scored"])
