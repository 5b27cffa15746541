"""Image collections as a pixel table (image_id, y, x, r, g, b): one row per pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import cut_lineage

from tabloom.functions.scalars import signed_log10


def pixel_table(images: DataFrame, image: str = "image", key: str = "image_id") -> DataFrame:
    """Explode decoded images (channel bytes in blue, green, red order; grey images have one channel)."""
    rows = images.select(
        key, image, F.explode(F.sequence(F.lit(0), F.col(f"{image}.height") * F.col(f"{image}.width") - 1)).alias("i")
    )
    n = F.col(f"{image}.nChannels")
    base = F.col("i") * n + 1
    cut = lambda shift: F.when(n >= 3, F.lit(shift)).otherwise(0)
    byte = lambda pos: F.ascii(F.decode(F.substring(F.col(f"{image}.data"), pos, F.lit(1)), "ISO-8859-1"))
    return rows.select(
        key, F.floor(F.col("i") / F.col(f"{image}.width")).cast("int").alias("y"), (F.col("i") % F.col(f"{image}.width")).alias("x"),
        byte(base + cut(2)).alias("r"), byte(base + cut(1)).alias("g"), byte(base).alias("b"),
    )


GREY_LEVELS = 16
TAN_22 = 13573  # fixed value: tangent of 22.5 degrees, times 32768; that of 67.5 degrees is larger by 2
SOBEL, SCHARR = (1.0, 2.0), (3.0, 10.0)  # fixed values: side and centre weights of the 3 x 3 kernels


def with_gray(pixels: DataFrame) -> DataFrame:
    """Adds ``gray`` = rounded 0.299 r + 0.587 g + 0.114 b."""
    return pixels.withColumn("gray", F.floor(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b") + 0.5).cast("int"))


def channel(pixels: DataFrame, name: str) -> DataFrame:
    """One channel (r, g, b or gray) as ``v``."""
    src = with_gray(pixels) if name == "gray" and "gray" not in pixels.columns else pixels
    return src.select("image_id", "y", "x", F.col(name).alias("v"))


def basic_stats(pixels: DataFrame) -> DataFrame:
    """Size, aspect ratio, mean and population deviation per channel, skewness of gray: one aggregate."""
    p = with_gray(pixels)
    names = {"r": "Red", "g": "Green", "b": "Blue", "gray": "Gray"}
    aggs = [(F.max("x") + 1).alias("Width"), (F.max("y") + 1).alias("Height")]
    for c, n in names.items():
        aggs += [F.round(F.avg(c), 2).alias(f"{n}_Mean"), F.round(F.stddev_pop(c), 2).alias(f"{n}_Std")]
    out = p.groupBy("image_id").agg(*aggs, F.round(F.skewness("gray"), 3).alias("Gray_Skewness"))
    return out.withColumn("Aspect_Ratio", F.round(F.col("Width") / F.col("Height"), 3))


def horizontal_pairs(values: DataFrame) -> DataFrame:
    """Adds ``right_v``, the value of the right neighbour (null in the last column)."""
    return values.withColumn("right_v", F.lead("v").over(Window.partitionBy("image_id", "y").orderBy("x")))


def glcm(pixels: DataFrame) -> DataFrame:
    """Texture of horizontally adjacent gray levels (16 levels, symmetric): five features per image."""
    near = horizontal_pairs(channel(pixels, "gray"))
    pairs = (
        near.select("image_id", F.floor(F.col("v") / GREY_LEVELS).alias("i"), F.floor(F.col("right_v") / GREY_LEVELS).alias("j"))
        .where("j IS NOT NULL").groupBy("image_id", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    )
    sides = pairs.select("image_id", F.inline(F.array(F.struct("i", "j", "n"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("n").alias("n")))))
    cells = sides.groupBy("image_id", "i", "j").agg(F.sum("n").cast("double").alias("n"))  # at most 256 rows per image
    i, j, n, d = F.col("i"), F.col("j"), F.col("n"), F.col("i") - F.col("j")
    s = cells.groupBy("image_id").agg(
        F.sum("n").alias("t"), F.sum(n * d * d).alias("c"), F.sum(n * F.abs(d)).alias("ds"), F.sum(n / (1.0 + d * d)).alias("h"),
        F.sum(n * n).alias("e"), F.sum(n * i).alias("si"), F.sum(n * i * i).alias("sii"), F.sum(n * i * j).alias("sij"))
    mean = F.col("si") / F.col("t")
    var = F.col("sii") / F.col("t") - mean * mean
    return s.select(
        "image_id", F.round(F.col("c") / F.col("t"), 4).alias("GLCM_Contrast"), F.round(F.col("ds") / F.col("t"), 4).alias("GLCM_Dissimilarity"),
        F.round(F.col("h") / F.col("t"), 4).alias("GLCM_Homogeneity"), F.round(F.col("e") / (F.col("t") * F.col("t")), 4).alias("GLCM_Energy_ASM"),
        F.round(F.when(var > 1e-12, (F.col("sij") / F.col("t") - mean * mean) / var).otherwise(0.0), 4).alias("GLCM_Correlation"))


def hu_moments(pixels: DataFrame) -> DataFrame:
    """Seven Hu moments of gray as signed -log10, from ten raw moments in one aggregate."""
    x, y, v = F.col("x").cast("double"), F.col("y").cast("double"), F.col("v").cast("double")
    power = lambda c, k: F.lit(1.0) if k == 0 else c if k == 1 else c * c if k == 2 else c * c * c
    orders = [(p, q) for p in range(4) for q in range(4 - p)]
    m = channel(pixels, "gray").groupBy("image_id").agg(*[F.sum(v * power(x, p) * power(y, q)).alias(f"m{p}{q}") for p, q in orders])
    m00, m10, m01, m20, m11, m02, m30, m21, m12, m03 = (F.col(f"m{k}") for k in ("00", "10", "01", "20", "11", "02", "30", "21", "12", "03"))
    m = m.where(m00 > 0).withColumns({"cx": m10 / m00, "cy": m01 / m00})
    cx, cy = F.col("cx"), F.col("cy")
    m = m.withColumns({
        "n20": (m20 - cx * m10) / (m00 * m00), "n11": (m11 - cx * m01) / (m00 * m00), "n02": (m02 - cy * m01) / (m00 * m00),
        "n30": (m30 - 3 * cx * m20 + 2 * cx * cx * m10) / (m00 * m00 * F.sqrt(m00)),
        "n21": (m21 - 2 * cx * m11 - cy * m20 + 2 * cx * cx * m01) / (m00 * m00 * F.sqrt(m00)),
        "n12": (m12 - 2 * cy * m11 - cx * m02 + 2 * cy * cy * m10) / (m00 * m00 * F.sqrt(m00)),
        "n03": (m03 - 3 * cy * m02 + 2 * cy * cy * m01) / (m00 * m00 * F.sqrt(m00)),
    })
    n20, n11, n02, n30, n21, n12, n03 = (F.col(c) for c in ("n20", "n11", "n02", "n30", "n21", "n12", "n03"))
    a, b, c, e = n30 + n12, n21 + n03, n30 - 3 * n12, 3 * n21 - n03
    hu = [
        n20 + n02,
        (n20 - n02) * (n20 - n02) + 4 * n11 * n11,
        c * c + e * e,
        a * a + b * b,
        c * a * (a * a - 3 * b * b) + e * b * (3 * a * a - b * b),
        (n20 - n02) * (a * a - b * b) + 4 * n11 * a * b,
        e * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b),
    ]
    return m.select("image_id", *[F.round(signed_log10(h), 4).alias(f"Hu_Moment_{k + 1}") for k, h in enumerate(hu)])


def gradients(pixels: DataFrame, kernel: tuple[float, float] = SOBEL, name: str = "gray", replicate: bool = False) -> DataFrame:
    """(image_id, y, x, v, gx, gy, magnitude): 3 x 3 derivatives, borders mirrored without the edge row (or replicated).

    Windows run over one row and then over one column of an image, so a large image spreads over tasks.
    """
    side, centre = F.lit(kernel[0]), F.lit(kernel[1])
    src = channel(pixels, name)
    row = Window.partitionBy("image_id", "y").orderBy("x")
    column = Window.partitionBy("image_id", "x").orderBy("y")

    def around(c, w):
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        own = F.col(c).cast("double")
        if replicate:
            return F.coalesce(before, own), F.coalesce(after, own)
        return F.coalesce(before, after, own), F.coalesce(after, before, own)

    src = src.withColumn("v", F.col("v").cast("double"))
    left, right = around("v", row)
    work = src.withColumns({"_l": left, "_r": right}).select(
        "image_id", "y", "x", "v", (F.col("_r") - F.col("_l")).alias("_d"), (side * F.col("_l") + centre * F.col("v") + side * F.col("_r")).alias("_s"))
    du, dd = around("_d", column)
    su, sd = around("_s", column)
    work = work.withColumns({"_du": du, "_dd": dd, "_su": su, "_sd": sd})
    gx, gy = side * F.col("_du") + centre * F.col("_d") + side * F.col("_dd"), F.col("_sd") - F.col("_su")
    return work.select("image_id", "y", "x", "v", gx.alias("gx"), gy.alias("gy")).withColumn(
        "magnitude", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def gradient_edge_ratio(pixels: DataFrame, threshold: float = 100.0) -> DataFrame:
    """Share of pixels whose Sobel magnitude reaches the threshold; ``canny_edge_ratio`` thins and connects them."""
    return gradients(pixels).groupBy("image_id").agg(F.round(F.avg((F.col("magnitude") >= threshold).cast("double")), 4).alias("gradient_edge_ratio"))


def canny_edges(pixels: DataFrame, low: float = 100.0, high: float = 200.0) -> DataFrame:
    """(image_id, y, x) of the Canny edges: |gx| + |gy| of replicated Sobel derivatives, largest across the edge.

    Across is horizontal up to 22.5 degrees, vertical from 67.5, else diagonal; of two equal neighbours in a
    row or column the first is taken, in a diagonal none. Pixels above ``low`` stay if eight-connected to
    one above ``high``; what is outside the image counts as 0.
    """
    row = Window.partitionBy("image_id", "y").orderBy("x")
    column = Window.partitionBy("image_id", "x").orderBy("y")
    beside = lambda f, c, w: F.coalesce(f(c).over(w), F.lit(0.0))
    m, wide, high_side = F.col("m"), F.abs("gx"), F.abs("gy") * 32768
    work = gradients(pixels, replicate=True).withColumn("m", F.abs("gx") + F.abs("gy"))
    work = work.withColumns({"_l": beside(F.lag, "m", row), "_r": beside(F.lead, "m", row)})
    work = work.withColumns({f"_{way}{c}": beside(f, c, column) for way, f in (("u", F.lag), ("d", F.lead)) for c in ("m", "_l", "_r")})
    falling = (F.col("gx") >= 0) == (F.col("gy") >= 0)
    largest = (
        F.when(high_side < wide * TAN_22, (m > F.col("_l")) & (m >= F.col("_r")))
        .when(high_side > wide * (TAN_22 + 65536), (m > F.col("_um")) & (m >= F.col("_dm")))
        .when(falling, (m > F.col("_u_l")) & (m > F.col("_d_r")))
        .otherwise((m > F.col("_u_r")) & (m > F.col("_d_l")))
    )
    found = work.where((m > low) & largest).select("image_id", "y", "x", (m > high).cast("int").alias("strong"))
    runs = _connected_runs(found, F.max("strong").alias("strong"))
    sure = runs.groupBy("component").agg(F.max("strong").alias("_s")).where("_s = 1").select("component")
    return runs.join(sure, "component", "left_semi").select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def canny_edge_ratio(pixels: DataFrame, low: float = 100.0, high: float = 200.0) -> DataFrame:
    """Share of Canny edge pixels, one row per image."""
    size = pixels.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    edges = canny_edges(pixels, low, high).groupBy("image_id").agg(F.count(F.lit(1)).alias("_e"))
    ratio = F.round(F.coalesce("_e", F.lit(0)) / F.col("_n"), 4)
    return size.join(edges, "image_id", "left").select("image_id", ratio.alias("Edge_Pixel_Ratio"))


def orientation_histogram(pixels: DataFrame, bins: int = 9) -> DataFrame:
    """(image_id, bin, weight): gradient directions over 0-360 degrees, weighted by magnitude."""
    angle = F.degrees(F.atan2("gy", "gx"))
    turned = F.when(angle < 0, angle + 360.0).otherwise(angle)
    slot = F.least(F.floor(turned / F.lit(360.0 / bins)), F.lit(bins - 1)).cast("int")
    return gradients(pixels).groupBy("image_id", slot.alias("bin")).agg(F.sum("magnitude").alias("weight"))


def intensity_histogram(pixels: DataFrame, log_scale: bool = False) -> DataFrame:
    """(image_id, channel, value, count) for red, green, blue and gray."""
    p = with_gray(pixels)
    long = p.select("image_id", F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in ("r", "g", "b", "gray")])))
    out = long.groupBy("image_id", "channel", "value").agg(F.count(F.lit(1)).alias("count"))
    return out.withColumn("count", F.log1p("count")) if log_scale else out


def _gray_counts(pixels: DataFrame) -> DataFrame:
    return channel(pixels, "gray").groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))  # at most 256 rows per image


def otsu_thresholds(pixels: DataFrame) -> DataFrame:
    """(image_id, threshold) with the largest between-class variance; the smallest such threshold."""
    upto = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("image_id")
    h = _gray_counts(pixels).withColumns({
        "w": F.sum("n").over(upto).cast("double"), "s": F.sum(F.col("n") * F.col("v")).over(upto).cast("double"),
        "t": F.sum("n").over(whole).cast("double"), "st": F.sum(F.col("n") * F.col("v")).over(whole).cast("double")})
    rest = F.col("t") - F.col("w")
    gap = F.col("s") * F.col("t") - F.col("st") * F.col("w")
    score = F.when(rest > 0, gap * gap / (F.col("w") * rest)).otherwise(0.0)
    return h.withColumn("score", score).groupBy("image_id").agg(F.min_by("v", F.struct(-F.col("score"), F.col("v"))).alias("threshold"))


def binarize(pixels: DataFrame, threshold: int | None = None, inverted: bool = False) -> DataFrame:
    """0 / 255 by a global threshold, or by Otsu's per image."""
    p = channel(pixels, "gray")
    on, off = (0, 255) if inverted else (255, 0)
    if threshold is None:
        p = p.join(otsu_thresholds(pixels), "image_id")
        return p.select("image_id", "y", "x", F.when(F.col("v") > F.col("threshold"), on).otherwise(off).alias("v"))
    return p.select("image_id", "y", "x", F.when(F.col("v") > threshold, on).otherwise(off).alias("v"))


def equalize(pixels: DataFrame) -> DataFrame:
    """Histogram equalisation of gray through a lookup table per image (at most 256 rows each)."""
    upto = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("image_id")
    h = _gray_counts(pixels).withColumns({"cdf": F.sum("n").over(upto), "total": F.sum("n").over(whole), "low": F.min_by("n", "v").over(whole)})
    spread = F.col("total") - F.col("low")
    table = h.select("image_id", "v", F.when(spread == 0, F.col("v")).otherwise(F.floor((F.col("cdf") - F.col("low")) * 255.0 / spread + 0.5)).cast("int").alias("out"))
    return channel(pixels, "gray").join(table, ["image_id", "v"]).select("image_id", "y", "x", F.col("out").alias("v"))


def gamma_correct(pixels: DataFrame, gamma: float = 1.2) -> DataFrame:
    fix = lambda c: F.floor(F.pow(F.col(c) / 255.0, F.lit(1.0 / gamma)) * 255.0).cast("int")
    return pixels.withColumns({c: fix(c) for c in ("r", "g", "b")})


def brightness_contrast(pixels: DataFrame, alpha: float = 1.2, beta: float = 10.0) -> DataFrame:
    fix = lambda c: F.least(F.rint(F.abs(F.col(c) * F.lit(alpha) + F.lit(beta))), F.lit(255.0)).cast("int")
    return pixels.withColumns({c: fix(c) for c in ("r", "g", "b")})


def dominant_colours(pixels: DataFrame, k: int = 4, n_init: int = 5, seed: int = 42) -> DataFrame:
    """(image_id, colour, share): one palette for the collection, the best of ``n_init`` starts.

    The palette is fitted on all pixels, as distinct colours weighted by how often they occur: at most
    2^24 rows for any number of pixels.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rgb = ["r", "g", "b"]
    weighted = pixels.groupBy(*rgb).agg(F.count(F.lit(1)).cast("double").alias("n"))
    vectors = VectorAssembler(inputCols=rgb, outputCol="features").transform(weighted).persist()
    fits = [KMeans(k=k, seed=seed + i, weightCol="n").fit(vectors) for i in range(n_init)]
    model = min(fits, key=lambda f: f.summary.trainingCost)
    colours = [tuple(int(x) for x in c) for c in model.clusterCenters()]
    names = F.array(*[F.lit("#%02x%02x%02x" % c) for c in colours])
    palette = cut_lineage(model.transform(vectors).select(*rgb, F.get(names, F.col("prediction")).alias("colour")))
    vectors.unpersist()
    counts = pixels.groupBy("image_id", *rgb).agg(F.count(F.lit(1)).alias("n")).join(palette, rgb).groupBy("image_id", "colour").agg(F.sum("n").alias("n"))
    return counts.select("image_id", "colour", (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("image_id"))).alias("share"))


def _connected_runs(marked: DataFrame, *aggregates: Column) -> DataFrame:
    """(image_id, y, x0, x1, ..., component) of runs of ``marked`` pixels, eight-connected.

    Each image row is cut into runs; runs of adjacent rows that touch are the edges of a component
    search over all images at once.
    """
    from tabloom.operators.components import connected_components
    from tabloom.operators.ranking import global_row_number

    row = Window.partitionBy("image_id", "y").orderBy("x")
    runs = marked.withColumn("_g", F.col("x") - F.row_number().over(row)).groupBy("image_id", "y", "_g").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), *aggregates).drop("_g")
    runs = cut_lineage(global_row_number(runs, [F.col("image_id"), F.col("y"), F.col("x0")], "run"))
    below = runs.select("image_id", (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("run").alias("v"))
    touching = runs.join(below, ["image_id", "y"]).where("b0 <= x1 + 1 AND b1 >= x0 - 1").select(F.col("run").alias("u"), "v")
    loops = runs.select(F.col("run").alias("u"), F.col("run").alias("v"))
    comp = connected_components(touching.unionByName(loops), single_task_rows=200_000)
    return runs.join(comp.select(F.col("node").alias("run"), "component"), "run").drop("run")


def object_regions(pixels: DataFrame, min_area: int = 30) -> DataFrame:
    """Dark regions (inverse Otsu, 8-connected): pixel count, boundary pixels, circularity, bounding box."""
    mask = binarize(pixels, None, inverted=True)
    row = Window.partitionBy("image_id", "y").orderBy("x")
    column = Window.partitionBy("image_id", "x").orderBy("y")
    sides = [F.lag("v").over(row), F.lead("v").over(row), F.lag("v").over(column), F.lead("v").over(column)]
    inner = sides[0] + sides[1] + sides[2] + sides[3] == 4 * 255
    fg = mask.withColumn("_edge", F.when(F.coalesce(inner, F.lit(False)), 0).otherwise(1)).where("v = 255")
    runs = _connected_runs(fg, F.count(F.lit(1)).alias("n"), F.sum("_edge").alias("boundary"))
    regions = runs.groupBy("image_id", "component").agg(
        F.sum("n").alias("area"), F.sum("boundary").alias("boundary_pixels"), F.min("x0").alias("x"), F.min("y").alias("y"),
        (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    round_ness = F.round(F.lit(4 * 3.141592653589793) * F.col("area") / (F.col("boundary_pixels") * F.col("boundary_pixels")), 3)
    return regions.where(F.col("area") > min_area).withColumn("circularity", round_ness).drop("component")


def feature_table(pixels: DataFrame) -> DataFrame:
    """All features, one row per image."""
    parts = [basic_stats(pixels), glcm(pixels), hu_moments(pixels), gradient_edge_ratio(pixels), canny_edge_ratio(pixels)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "image_id", "left")
    return out
