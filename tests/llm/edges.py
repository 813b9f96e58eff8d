"""Tables of awkward rows: nulls, empty and long texts, ties, repeated rows, extra columns, nothing."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    long = " ".join(f"w{k % 997}" for k in range(30_000))
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", None, 0),
        (3, "   \n\t ", None, "a", 6),
        (4, "one", "en", "a", 3),
        (5, "the quick brown fox jumps over the lazy dog near the river bank", "en", "a", 63),
        (6, "the quick brown fox jumps over the lazy dog near the river bank", "de", "b", 63),
        (6, "the quick brown fox jumps over the lazy dog near the river bank", "de", "b", 63),
        (7, long, "en", "a", len(long)),
        (8, "a" * 50_000, "fr", "a", 50_000),
        (9, "\U0001f600 \x00 <|endoftext|> \x00 é", "fr", "a", 0),
        (10, "42 17 !!! ??", "en", "a", 12),
        (None, "a text that has no id at all", None, None, None),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("ids", "score", "component_id", "class_id", "band", "hash", "shard", "n", "start", "length", "word", "item_id", "kind", "label"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def empty(spark):
    return documents(spark).limit(0)


def saved(df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
