"""Benchmark items inside documents (operator 7), by functions of Spark SQL alone.

Items and documents are sets of shingles of five words (lower case; white space separates words; a
shorter text is one shingle). Where items of one to four words exist, documents also have the shingles of just these lengths, so
that such an item is found wherever its words stand in a row. An item of q shingles is contained in a document to the
degree of the share of its shingles that the document has.

Items are partitioned by size: class c holds those of 2^c to 2^(c+1) - 1 shingles. The signature of an
item is its k least shingle hashes (bottom-k MinHash), k being set by its class: one more than the most
shingles that any item of the class may miss at the threshold. So whatever the length of a document, it
cannot contain an item, as defined here, without one of the signature's hashes among its own: the search loses nothing,
and its cost does not depend on how short an item is beside a document. Only items have signatures and
size classes; documents are neither sketched nor partitioned by size, as all their shingles are looked up. Documents that meet a signature
are verified by exact containment of the shingles' words.

The signatures and the items' shingles are broadcast up to a bound of bytes and joined by a shuffle
beyond it (``common.small``).

Defined results: null or empty texts contain nothing, and items without a word are found nowhere; rows
without doc_id or item_id are not searched; rows with equal doc_id count as one document that has all
their shingles (items likewise); empty tables give no row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, written

WORDS = 5
CONTAINMENT = 0.8
SPACE = r"[ \t\n\r\f\x0B]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPACE), "")


def with_shingles(df: DataFrame, text: str, words: int, hashed: bool) -> DataFrame:
    """One row per place, with ``s``: a shingle's hash, or its words joined by a space."""
    kept = [c for c in df.columns if c != text]
    rows = df.select(*kept, words_of(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    rows = rows.select(*kept, "_w", F.posexplode("_w").alias("_i", "_first"))
    rows = rows.where(F.col("_i") <= F.greatest(F.size("_w") - words, F.lit(0)))
    parts = [F.get("_w", F.col("_i") + k) for k in range(1, words)]
    s = F.xxhash64("_first", *parts) if hashed else F.concat_ws(" ", "_first", *parts)
    return rows.select(*kept, s.alias("s"))


def short_lengths(items: DataFrame, words: int) -> list[int]:
    """The numbers of words, below ``words``, that items have."""
    n = F.size(words_of(F.col("text")))
    return sorted(r[0] for r in items.select(n.alias("n")).where(F.col("n").between(1, words - 1)).distinct().collect())


def document_shingles(docs: DataFrame, words: int, short: list[int], hashed: bool) -> DataFrame:
    """(doc_id, s): shingles of ``words`` words and of the lengths ``short``."""
    rows = with_shingles(docs, "text", words, hashed)
    for n in short:
        rows = rows.unionByName(with_shingles(docs, "text", n, hashed))
    return rows


def signatures(items: DataFrame, containment: float = CONTAINMENT, words: int = WORDS) -> DataFrame:
    """(item_id, q, size_class, s): the least hashes of each item's shingles."""
    hashes = with_shingles(items.select("item_id", "text"), "text", words, hashed=True).distinct()
    sizes = hashes.groupBy("item_id").agg(F.count("*").alias("q"))
    placed = hashes.join(sizes, "item_id").withColumn("place", F.expr("row_number() over (partition by item_id order by s)"))
    size_class = F.floor(F.log2("q")).cast("int")
    most = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    k = F.floor(F.lit(1 - containment) * most + F.lit(1e-9)) + 1
    return placed.withColumn("size_class", size_class).where(F.col("place") <= k).select("item_id", "q", "size_class", "s")


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, words: int = WORDS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of all pairs that reach the threshold."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    items = items.select("item_id", "text").where("item_id is not null")
    signed = written(signatures(items, containment, words), "items-signed")
    short = short_lengths(items, words)
    places = document_shingles(docs, words, short, hashed=True)
    met = places.join(small(signed.select("item_id", "s")), "s").select("doc_id", "item_id").distinct()
    met = written(met, "items-met")
    # Verification reads again the documents that were met, and no others.
    ids = met.select("doc_id").distinct()
    again = docs.join(small(ids), "doc_id", "left_semi")
    in_docs = document_shingles(again, words, short, hashed=False).distinct()
    in_items = written(with_shingles(items, "text", words, hashed=False).distinct(), "items-shingles")
    sizes = in_items.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    shared = in_docs.join(small(in_items), "s").join(met, ["doc_id", "item_id"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    out = shared.join(small(sizes), "item_id").withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    return out.where(F.col("n_shared") >= F.col("n_shingles") * containment - 1e-9).select("doc_id", "item_id", "n_shared", "n_shingles", "containment")


def without_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    found = written(contained_items(docs, items, containment).select("doc_id").distinct(), "items-found")
    return docs.join(small(found), "doc_id", "left_anti").select(*docs.columns)


def op7_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LIST = "list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')"


def shingles_sql(source: str, key: str, words: int = WORDS) -> str:
    """Distinct (key, s) of a table with a text column, for another engine."""
    return f"""select distinct {key}, array_to_string(w[i : i + {words - 1}], ' ') s
from (select {key}, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) i from (select {key}, {_LIST} w from {source} where {key} is not null and text is not null) where len(w) > 0)"""


def short_shingles_sql(source: str, key: str, words: int = WORDS) -> str:
    """Distinct (key, s) of the runs of each number of words, below ``words``, that an item has."""
    return f"""select distinct {key}, array_to_string(w[i : i + n - 1], ' ') s
from (select {key}, w, n, unnest(range(1, len(w) - n + 2)) i from (select {key}, {_LIST} w from {source} where {key} is not null and text is not null) join
  (select distinct len({_LIST}) n from benchmark where item_id is not null and text is not null) on len(w) >= n and n between 1 and {words - 1})"""


def oracle(docs: str = "documents") -> str:
    return f"""with d as ({shingles_sql(docs, 'doc_id')} union {short_shingles_sql(docs, 'doc_id')}), q as ({shingles_sql('benchmark', 'item_id')}),
sizes as (select item_id, count(*) n_shingles from q group by item_id),
shared as (select doc_id, item_id, count(*) n_shared from d join q using (s) group by doc_id, item_id)
select doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles containment from shared join sizes using (item_id) where n_shared >= n_shingles * {CONTAINMENT} - 1e-9"""


