"""What filters remove alone, together and after each other (operator 13), by a trie of all orders of them.

A node of the trie is the set of filters applied so far, whatever their order: the survivors of a set are
the same in every order, so the node is made once and shared by all prefixes that lead to it. The trie is
walked depth first. The survivors of the node at hand and of its ancestors are persisted (one for each
filter at most) and are made from those of the parent by one more filter; at every edge it is counted what
the next filter removes of them, part by part. Counts of a node are written before the walk goes on, so
nothing but the persisted survivors is lost with an executor, and these are made again from the written flags.

What an order does at a step is the edge from the set of the filters before it. The rest follows from
counted edges: what fails a filter is what it removes first, what fails it alone is what it removes last, and
its Shapley sum is what it removes at its step of each order.

Whether a text fails a filter does not depend on other filters, so that is decided once a text, in one
pass; the filter of repeated texts compares SHA-256 digests over the whole table.

Defined results: a null text counts as empty and so repeats other empty ones; a null or an empty lang is
the part ''; rows without a doc_id repeat nothing and have no label; rows that repeat a doc_id and its text do
not repeat each other; a doc_id whose labels differ is good if any says so, and toxic likewise; an empty table
has no parts and gives no row; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import new_path
from .common import dropped, join_hot, table, written

FILTERS = ("A", "B", "C", "D", "E")
FEWEST_WORDS = 200
LEAST_DISTINCT = 50  # distinct words of a hundred
MOST_CAPITALS = 3  # capitals of a hundred code points
# White space between words, signs of the fourth filter.
SPACE = r"[\x20\x09-\x0D]+"
SIGNS = r"[#$%&*|]"


def text_flags(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, A, B, C, D): which of the first four filters each whole text fails, and what tells texts apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    words = F.array_remove(F.split("text", SPACE), "")
    read = read.select("doc_id", "part", "text", words.alias("words"))
    n, capitals = F.size("words"), F.length(F.regexp_replace("text", "[^A-Z]++", ""))
    return read.select(
        "doc_id",
        "part",
        F.sha2("text", 256).alias("digest"),
        (n < FEWEST_WORDS).alias("A"),
        (F.size(F.array_distinct("words")) * 100 < n * LEAST_DISTINCT).alias("B"),
        (capitals * 100 > F.length("text") * MOST_CAPITALS).alias("C"),
        F.col("text").rlike(SIGNS).alias("D"),
    )


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of every row of ``docs``, written once."""
    flags = written(text_flags(docs), "audit-texts")
    firsts = written(flags.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "audit-firsts")
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = join_hot(flags, firsts, ["digest"], "n").join(marked, "doc_id", "left")
    no = F.lit(False)
    rows = rows.select("part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    out = written(rows, "audit-flags")
    dropped(flags, firsts)
    return out


def _name(state: frozenset[str]) -> str:
    return ",".join(sorted(state))


def counted_edges(rows: DataFrame, filters: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """(part, state, filter, held, removed, a count of those removed for each mark): a row for every part that has survivors in a set of filters (``state``) and every filter outside it."""
    spark = rows.sparkSession
    path, seen, schema = new_path(spark, "audit-edges"), set(), None

    def visit(state: frozenset[str], survivors: DataFrame) -> None:
        nonlocal schema
        seen.add(state)
        held = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        left = [f for f in filters if f not in state]
        removals = [F.struct(F.lit(f).alias("filter"), F.count_if(F.col(f)).alias("removed"), *[F.count_if(F.col(f) & F.col(m)).alias(m) for m in marks]) for f in left]
        counts = held.groupBy("part").agg(F.count(F.lit(1)).alias("held"), F.array(*removals).alias("edges"))
        counts = counts.select("part", F.lit(_name(state)).alias("state"), "held", F.explode("edges").alias("edge")).select("part", "state", "held", "edge.*")
        counts.write.mode("append").parquet(path)
        schema = counts.schema
        for f in left[: len(left) if len(left) > 1 else 0]:
            if (after := state | {f}) not in seen:
                visit(after, held.where(~F.col(f)))
        held.unpersist()

    visit(frozenset(), rows)
    return spark.read.schema(schema).parquet(path)


def audit(rows: DataFrame, filters: Sequence[str], marks: Sequence[str] = ()) -> DataFrame:
    """One row per part, order of the filters and step: (part, filter_order, step, kept, removed, redundant, unique_fails, ``<mark>_lost`` for each mark, shapley).

    ``rows`` has a ``part`` and a boolean column, without nulls, for each filter (true: removed by it) and mark.
    The number of orders, and so of rows a part, is the factorial of the number of filters.
    """
    edges = counted_edges(rows, filters, marks)
    steps = [("".join(order), k + 1, f, _name(frozenset(order[:k]))) for order in itertools.permutations(filters) for k, f in enumerate(order)]
    steps = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, state string")
    first = edges.where("state = ''").select("part", "filter", F.col("removed").alias("fails"))
    last = edges.where(F.size(F.split("state", ",")) == len(filters) - 1) if len(filters) > 1 else edges
    last = last.where("state <> ''") if len(filters) > 1 else last
    last = last.select("part", "filter", F.col("removed").alias("alone"))
    # Every part fails or passes every filter at the root, so ``first`` has each of them and every order follows from it.
    out = first.join(last, ["part", "filter"], "left").join(F.broadcast(steps), "filter").join(edges, ["part", "state", "filter"], "left")
    zero = F.lit(0).cast("long")
    removed = F.coalesce("removed", zero)
    sums = edges.join(F.broadcast(steps), ["state", "filter"]).groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return out.join(sums, ["part", "filter"]).select(
        "part",
        "filter_order",
        "step",
        (F.coalesce("held", zero) - removed).alias("kept"),
        removed.alias("removed"),
        (F.col("fails") - removed).alias("redundant"),
        F.coalesce("alone", zero).alias("unique_fails"),
        *[F.coalesce(m, zero).alias(f"{m}_lost") for m in marks],
        "shapley",
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(rows, FILTERS, ("good", "toxic"))


def oracle() -> str:
    letters = [f"l{k}" for k in range(len(FILTERS))]
    apart = " and ".join(f"{a}.i <> {b}.i" for a, b in itertools.combinations(letters, 2))
    prefixes = ", ".join(f"(power(2, {x}.i)::int, ({' + '.join([f'power(2, {y}.i)' for y in letters[:k]] or ['0'])})::int, {k + 1}, {x}.i)" for k, x in enumerate(letters))
    return rf"""
with texts as (select doc_id, coalesce(lang, '') part, coalesce(text, '') text from documents),
worded as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') words from texts),
marked as (select doc_id, bool_or(coalesce(quality = 1, false)) good, bool_or(coalesce(toxic = 1, false)) toxic from labels group by doc_id),
flagged as (
  select part, (len(words) < {FEWEST_WORDS})::int + 2 * (100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(text))::int + 8 * regexp_matches(text, '{SIGNS}')::int
    + 16 * coalesce(w.doc_id > min(w.doc_id) over (partition by text), false)::int fails, coalesce(good, false) good, coalesce(toxic, false) toxic
  from worded w left join marked m on w.doc_id = m.doc_id),
cells as (select part, fails, count(*) n, count_if(good) good, count_if(toxic) toxic from flagged group by all),
l(i) as (select * from range({len(FILTERS)})),
orders as (select {' || '.join(f"chr(65 + {x}.i::int)" for x in letters)} filter_order, unnest([{prefixes}]) s from {', '.join(f'l {x}' for x in letters)} where {apart}),
steps as (select filter_order, s[1] bit, s[2] before, s[3]::int step from orders),
counted as (
  select part, filter_order, step, bit, sum(case when fails & (before | bit) = 0 then n else 0 end) kept, sum(case when fails & before = 0 and fails & bit > 0 then n else 0 end) removed,
    sum(case when fails & before > 0 and fails & bit > 0 then n else 0 end) redundant, sum(case when fails = bit then n else 0 end) unique_fails,
    sum(case when fails & before = 0 and fails & bit > 0 then good else 0 end) good_lost, sum(case when fails & before = 0 and fails & bit > 0 then toxic else 0 end) toxic_lost
  from steps, cells group by part, filter_order, step, bit)
select part, filter_order, step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails, good_lost::bigint good_lost, toxic_lost::bigint toxic_lost,
  (sum(removed) over (partition by part, bit))::bigint shapley from counted"""
