"""Bounds of the training samples for null and repeated ids; letters that Python does not know yet."""

from pyspark.sql import functions as F

from tabloom.llm import bpe, gam, langid


def test_one_id_brings_no_more_labelled_rows_than_its_share(spark, monkeypatch):
    docs = spark.range(4000).select(F.concat(F.lit("some words of text "), F.col("id") % 2000).alias("text"))
    free = spark.range(40).withColumnRenamed("id", "doc_id").where(~gam.held_out()).first().doc_id
    docs = docs.withColumn("doc_id", F.lit(free).cast("bigint"))
    labels = spark.createDataFrame([(free, 1), (free, 0), (free, 1), (None, 1)], "doc_id bigint, quality int")
    taken = []
    monkeypatch.setattr(gam, "fit", lambda x, y: taken.append((len(x), y.sum())))
    gam.train(docs, labels, sample=40)
    gam.train(docs, labels, sample=10**6)
    assert 10 <= taken[0][0] <= 90 and taken[1] == (4000, 2000)  # 2,000 different rows, two labels each
    gam.train(docs.unionByName(docs), labels, sample=10**6)
    assert taken[2] == taken[1]


def test_null_ids_bring_no_more_texts_than_the_sample(spark, monkeypatch):
    docs = spark.range(3000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("wort"), F.col("id")).alias("text"), F.lit("de").alias("lang"))
    seen, cut = [], langid.cut_lineage
    monkeypatch.setattr(langid, "cut_lineage", lambda df: (seen.append(df.agg(F.count_distinct("word"), F.sum("n")).first()), cut(df))[1])
    langid.fit(docs, sample=100, rounds=1)
    assert 50 <= seen[0][1] <= 250


def test_every_code_point_like_the_library(spark):
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.load(bpe.default_path()))
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = " ".join(f"a{chr(c)}b" for c in points[at:at + 4096])
        (ids, decoded), want = encoder.encode([text])[0], library.encode(text, add_special_tokens=False).ids
        assert bytes(ids) == b"".join(i.to_bytes(4, "little") for i in want), hex(points[at])
