"""Token counts from flat token files: a scan for the end-of-document id, block by block.

A token file is a plain sequence of little-endian 16-bit ids without index or header; an
end-of-document id closes every document. Files are read in blocks of a fixed number of bytes, each
block finds its separators in numpy, and one summary row per block carries how many separators it
has and where its last one is. A prefix scan over the summaries tells every block which document it
continues and where that began. A document may span any number of blocks.

``write_token_files`` makes such files from texts: id 0 is the end of a document and token t is
stored as t + 1. A file is filled up to whole blocks with the id 65535, which is no token.

Nulls and empties: a null or empty text is a document of no tokens. A file that ends without a
separator has one more document of what is left; padding is none. An empty folder gives no rows.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.blocks import as_texts, cut
from tabloom.session import checkpoint_dir

EOD, PAD = 0, 0xFFFF
BLOCK = 1 << 18  # bytes of a block; a file is a whole number of them


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) + 1 >= PAD:
        raise ValueError("the ids must fit 16 bits next to the two reserved ones")
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, block: int = BLOCK) -> None:
    """One flat token file per input partition under ``folder``, written by Spark's text writer.

    A row is the bytes of one document and the line separator is the end-of-document id, so the files
    hold nothing else.
    """
    path = path or default_path()

    def run(batches):
        encode = tokenizer(path).encode_ordinary
        written = 0
        for batch in batches:
            for part in cut(batch):
                rows = [(np.array(encode(t), dtype=np.int64) + 1).astype("<u2").tobytes() for t in as_texts(part.column("text"))]
                written += sum(map(len, rows)) + 2 * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
        rest = -written % block
        if rest:
            # The filling is one more row; the writer closes it with a separator like any other.
            fill = np.full((rest + block * (rest == 2)) // 2 - 1, PAD, dtype="<u2").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([fill], pa.binary())], ["value"])

    rows = docs.select("text").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", "\0\0").text(folder)


def read_blocks(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """(file, block, data): the files under ``folder`` in blocks, read in splits by any of Spark's file systems."""
    records = spark.sparkContext.binaryRecords(folder, block).map(lambda data: (bytearray(data),))
    rows = spark.createDataFrame(records, T.StructType([T.StructField("data", T.BinaryType())]))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select(F.input_file_name().alias("file"), ((F.input_file_block_start() / block).cast("bigint") + within).alias("block"), "data")


def scan_blocks(blocks: DataFrame, eod: int = EOD, pad: int = PAD) -> DataFrame:
    """(file, block, n_ids, n_seps, last_sep, ends, after): separators of each block by binary comparison of all ids.

    ``ends`` are positions of separators within the block, ``last_sep`` the last of them (null: none),
    ``pads`` the number of padding ids in the document that each separator closes, ``after`` ids and
    ``after_pads`` padding ids after the last separator.
    """

    def run(batches):
        for batch in batches:
            out = []
            for file, number, data in zip(*[batch.column(c).to_pylist() for c in ("file", "block", "data")]):
                ids = np.frombuffer(data, dtype="<u2")
                ends = np.flatnonzero(ids == eod)
                padding = np.concatenate(([0], np.cumsum(ids == pad)))
                marks = padding[ends]
                out.append({
                    "file": file, "block": number, "n_ids": len(ids), "n_seps": len(ends), "last_sep": int(ends[-1]) if len(ends) else None,
                    "ends": ends.tolist(), "pads": np.diff(marks, prepend=0).tolist(), "after_pads": int(padding[-1] - (marks[-1] if len(ends) else 0)),
                })
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n_ids", pa.int64()), ("n_seps", pa.int64()), ("last_sep", pa.int64()),
                        ("ends", pa.list_(pa.int64())), ("pads", pa.list_(pa.int64())), ("after_pads", pa.int64())])
    return blocks.mapInArrow(run, "file string, block bigint, n_ids bigint, n_seps bigint, last_sep bigint, ends array<bigint>, pads array<bigint>, after_pads bigint")


def documents_of(scanned: DataFrame) -> DataFrame:
    """(file, document, start, n_tokens): documents in file order, from the block summaries.

    The window runs over one row per block of a file. ``start`` counts ids from the start of the file.
    Filling (a document of padding only) is left out.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("file").orderBy("block")
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = scanned.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    last = F.col("base") + F.col("last_sep")
    base = base.withColumns({
        "first_document": F.coalesce(F.sum("n_seps").over(before), F.lit(0)),
        "open_at": F.coalesce(F.max(last).over(before) + 1, F.lit(0)),
        # Padding ids since the last separator of earlier blocks: all so far, less those up to that separator.
        "all_pads": F.sum(F.aggregate("pads", F.lit(0).cast("bigint"), lambda a, b: a + b) + F.col("after_pads")).over(upto),
    })
    base = base.withColumn("closed_pads", F.when(F.col("n_seps") > 0, F.col("all_pads") - F.col("after_pads")))
    carried = F.coalesce(F.lag("all_pads").over(order), F.lit(0)) - F.coalesce(F.max("closed_pads").over(before), F.lit(0))
    base = base.withColumns({"open_pads": carried, "is_last": F.lead("block").over(order).isNull()})
    starts = F.concat(F.array("open_at"), F.transform("ends", lambda e: e + F.col("base") + 1))
    padded = F.concat(F.transform("pads", lambda p, i: p + F.when(i == 0, F.col("open_pads")).otherwise(F.lit(0))),
                      F.array(F.col("after_pads") + F.when(F.col("n_seps") == 0, F.col("open_pads")).otherwise(F.lit(0))))
    stops = F.concat(F.transform("ends", lambda e: e + F.col("base")), F.array(F.col("base") + F.col("n_ids")))
    pieces = base.select("file", "first_document", "n_seps", "is_last", F.posexplode(F.arrays_zip(starts.alias("start"), stops.alias("stop"), padded.alias("pad"))))
    length = F.col("col.stop") - F.col("col.start")
    closed = F.col("pos") < F.col("n_seps")
    rest = F.col("is_last") & (length > F.col("col.pad"))  # ids after the last separator of the file
    whole = (closed & ((F.col("col.pad") == 0) | (length > F.col("col.pad")))) | (~closed & rest)
    return pieces.where(whole).select("file", (F.col("first_document") + F.col("pos")).alias("document"), F.col("col.start").alias("start"),
                                      (length - F.col("col.pad")).alias("n_tokens"))


def count_tokens(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """(file, document, start, n_tokens) of all token files under ``folder``."""
    return documents_of(scan_blocks(read_blocks(spark, folder, block)))


def corpus_token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token files of ``docs`` in the shared checkpoint folder, scanned."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, folder, path)
    return count_tokens(spark, folder)
