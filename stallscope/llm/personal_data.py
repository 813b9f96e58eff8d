"""Personal data by fixed patterns and bootstrapped contexts (operator 8), by functions of Spark SQL alone.

Base spans: leftmost non-overlapping matches of one pattern per kind, those that fail their check being
dropped. The patterns below match what the plain ones of the kind match but cannot be slow on any text:
repetitions give nothing back, and a match starts only where a run of its characters starts.

Bootstrapping: instances are the base spans and, elsewhere, tokens (between white space) that hold a
digit or an @, of which what is left of the last run of letters, digits and ``._@+-`` is the label. Base spans are seeds
of their kind. A fifth kind, ``secret`` (keys, passwords, access tokens), has no base spans; its seeds are runs of
16 letters and digits or more that change between the two at least three times, or twice without a small letter. Such a
run may as well be a digest or the number of a model, so by itself it is no span: like any other instance it becomes one
where a pattern around it is sure. What stands around an
instance are its lexical patterns: the word before, two words before, the words on both sides, the label,
and the first four letters with the length. Digits in them count as equal and words of any length count. Instances and
patterns are a graph on which scores are iterated, kind by kind, over the instances of a form that the kind can
have: a pattern's confidence is the mean score of its distinct instances, damped so that it needs
several; an instance that is not a seed scores the best confidence among its patterns. Instances
of patterns of high confidence become spans of that kind, unless they overlap a base span.

Spans are in code points, the end exclusive. Defined results: null texts count as empty and have no
span; every row gives one row, whatever its doc_id; an empty table gives no row; other columns are not
read by ``find_spans`` and are kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, small, table, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
# The base patterns, in a form without give-back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}"
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TOKEN = r"[^\s0-9@](?<!\S\S)[^\s0-9@]*+[0-9@]\S*+|[0-9@](?<!\S\S)\S*+"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
ROUNDS = 3
CONFIDENT = 0.8
DAMPING = 2.0  # added to the number of instances that a confidence is the mean of
LEAST_SEEDS = 3
LONGEST_WORD = 64  # longer words are known by their digest


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right; digits are counted from the last."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", hit.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
        .when(kind == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(True)
    )


def _matches(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(row, keys, kind, hit, start, end, l1, l2, r1): every match of every pattern, and the words around it; rows of ``docs`` without any have one of nulls.

    Places are running sums of the lengths of the matches and of what lies between them, so they cost a
    pass however many there are. Only this pass reads texts, and it leaves what was matched.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *keys, text.alias("text"))
    needs = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+")}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "token": TOKEN}
    none = F.lit(None).cast("array<string>")

    def hits(kind: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(patterns[kind]), F.lit(0))
        return F.when(needs[kind], found).otherwise(none) if kind in needs else found

    rows = rows.select("row", *keys, "text", *[hits(k).alias(k) for k in patterns])
    gaps = [F.when(F.size(k) > 0, F.split("text", p, -1)).otherwise(none).alias(f"{k}_gaps") for k, p in patterns.items()]
    rows = rows.select("row", *keys, *patterns, *gaps)
    shape = "struct<kind:string,i:int,hit:string,moved:int,left:string,right:string>"

    def listed(kind: str) -> Column:
        between = F.col(f"{kind}_gaps")

        def one(hit: Column, i: Column) -> Column:
            before, after = F.get(between, i), F.get(between, i + 1)
            # Beyond a gap lies another match of the kind, which is a word of the context too.
            left = F.regexp_extract(F.concat(F.coalesce(F.get(F.col(kind), i - 1), F.lit("")), before), r"(?:^|\s)(\S++\s++\S++|\S++)\s*+$", 1)
            right = F.regexp_extract(F.concat(after, F.coalesce(F.get(F.col(kind), i + 1), F.lit(""))), r"^\s*+(\S++)", 1)
            return F.struct(F.lit(kind).alias("kind"), i.alias("i"), hit.alias("hit"), (F.length(before) + F.length(hit)).alias("moved"), left.alias("left"), right.alias("right"))

        return F.when(F.size(kind) > 0, F.transform(kind, one)).otherwise(F.array()).cast(f"array<{shape}>")

    rows = rows.select("row", *keys, F.explode_outer(F.concat(*map(listed, patterns))).alias("m")).select("row", *keys, "m.*")
    upto = W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("moved").over(upto)).withColumn("start", F.col("end") - F.length("hit"))
    l1, before = F.regexp_extract("left", r"(\S++)$", 1), F.regexp_extract("left", r"^(\S++)\s", 1)
    return rows.select("row", *keys, "kind", "hit", "start", "end", _word(l1).alias("l1"), _word(before).alias("l2"), _word(F.col("right")).alias("r1"))


def _word(word: Column) -> Column:
    """As patterns know it: lower case, digits alike; null if empty."""
    plain = F.regexp_replace(F.lower(word), "[0-9]", "0")
    return F.when(word != "", F.when(F.length(word) > LONGEST_WORD, F.md5(plain)).otherwise(plain))


def _forms(kind: str, hit: Column) -> Column:
    """Whether something that is not a base span can be of the kind."""
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(hit, "[^A-Za-z]", ""))
    return {
        "email": hit.contains("@") & (letters > 0),
        "ip": hit.rlike(r"^[0-9]++(?:[.:-][0-9]++){3}"),
        "card": (letters == 0) & digits.between(12, 19),
        "phone": (letters == 0) & digits.between(7, 15),
        "secret": hit.rlike("^[A-Za-z0-9_-]++$") & (letters > 0) & (digits > 0) & (F.length(hit) >= 8),
    }[kind]


def _instances(found: DataFrame) -> DataFrame:
    """(row, start, end, instance, seed, kinds, patterns): base spans, and the last runs of the tokens that none of them overlaps."""
    is_base = F.col("kind") != "token"
    seen = found.where("kind is not null").withColumn("late", F.when(is_base, 0).otherwise(1))
    past = W.partitionBy("row").orderBy("start", "late").rowsBetween(W.unboundedPreceding, 0)
    future = W.partitionBy("row").orderBy(F.desc("start"), F.desc("late")).rowsBetween(W.unboundedPreceding, 0)
    seen = seen.withColumn("covered_to", F.max(F.when(is_base, F.col("end"))).over(past)).withColumn("next", F.min(F.when(is_base, F.col("start"))).over(future))
    covered = F.coalesce(F.col("covered_to") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    seen = seen.where(is_base | ~covered)
    backward = F.reverse("hit")
    run = r"^([^A-Za-z0-9]*+)([A-Za-z0-9._@+-]*+)"
    seen = seen.withColumn("tail", F.length(F.regexp_extract(backward, run, 1))).withColumn("run", F.reverse(F.regexp_extract(backward, run, 2)))
    value = F.when(is_base, F.col("hit")).otherwise(F.col("run"))
    end = F.when(is_base, F.col("end")).otherwise(F.col("end") - F.col("tail"))
    label = F.when(~is_base, F.expr("substring(hit, 1, length(hit) - tail - length(run))"))
    seen = seen.withColumn("value", value).withColumn("label", label).withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).where("value <> ''")
    changes = F.length(F.regexp_replace("value", "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", " ")) - F.length("value")
    secret = F.col("value").rlike("^[A-Za-z0-9_-]{16,}+$") & ((changes >= 3) | (changes == 2) & ~F.col("value").rlike("[a-z]"))
    seed = F.when(is_base, F.col("kind")).when(secret, "secret")
    kinds = F.filter(F.array(*[F.when(_forms(k, F.col("value")), F.lit(k)) for k in KINDS]), lambda k: k.isNotNull())
    kinds = F.when(seed.isNotNull(), F.array(seed)).otherwise(kinds)
    first = F.regexp_extract("value", "^([A-Za-z]{4})[A-Za-z0-9]++$", 1)
    patterns = F.array(
        F.concat(F.lit("l:"), "l1"),
        F.concat(F.lit("ll:"), "l2", F.lit(" "), "l1"),
        F.concat(F.lit("lr:"), "l1", F.lit(" _ "), "r1"),
        F.when(F.col("label").rlike("[A-Za-z]"), F.concat(F.lit("in:"), _word(F.col("label")))),
        F.when(first != "", F.concat(F.lit("px:"), F.lower(first), F.lit(":"), F.length("value").cast("string"))),
    )
    digest = F.when(F.length("value") > LONGEST_WORD, F.md5("value")).otherwise(F.lower("value"))
    return seen.select("row", "start", "end", digest.alias("instance"), seed.alias("seed"), kinds.alias("kinds"), F.array_compact(patterns).alias("patterns"))


def induced(instances: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that are sure of a kind."""
    edges = instances.select("instance", F.explode("kinds").alias("kind"), "patterns").select("instance", "kind", F.explode("patterns").alias("pattern")).distinct()
    edges = written(edges, "pii-edges")
    seeds = written(instances.where("seed is not null").select("instance", F.col("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0)), "pii-seeds")
    degree = written(edges.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n")), "pii-degree")
    scores, old = seeds, []
    for _ in range(rounds):
        held = edges.join(scores, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("held"), F.count(F.lit(1)).alias("scored"))
        held = held.where(F.col("scored") >= LEAST_SEEDS).join(degree, ["pattern", "kind"]).withColumn("confidence", F.col("held") / (F.col("n") + DAMPING))
        patterns = written(held.where(F.col("confidence") >= confident).select("pattern", "kind", "confidence"), "pii-patterns")
        found = edges.join(small(patterns), ["pattern", "kind"]).groupBy("instance", "kind").agg(F.max("confidence").alias("score"))
        found = found.join(seeds.select("instance", "kind"), ["instance", "kind"], "left_anti").select("instance", "kind", "score")
        dropped(*old)
        scores = written(seeds.unionByName(found), "pii-scores")
        old = [scores, patterns]
    dropped(edges, seeds, degree, scores)
    return patterns


def find_spans(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and ``spans`` of every row: an array of (start, rank, kind, end, is_base) by start and kind."""
    matches = _matches(docs, keys)
    ok = F.coalesce(_valid(F.col("kind"), F.col("hit")), F.lit(True))
    found = written(matches.where(ok), "pii-matches")
    base = found.where(F.col("kind") != "token").select("row", "kind", "start", "end", F.lit(True).alias("is_base"))
    instances = written(_instances(found), "pii-instances")
    unseen = instances.where("seed is null or seed = 'secret'").select("row", "start", "end", F.explode("kinds").alias("kind"), "patterns").select("row", "start", "end", "kind", F.explode("patterns").alias("pattern"))
    new = unseen.join(small(induced(instances)), ["pattern", "kind"]).groupBy("row", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    spans = base.unionByName(new.select("row", "best.kind", "start", "end", F.lit(False).alias("is_base")))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    spans = spans.select("row", F.struct("start", rank.alias("rank"), "kind", "end", "is_base").alias("span"), *[F.lit(None).cast(found.schema[k].dataType).alias(k) for k in keys])
    # Every row of ``docs`` has a match or the row of nulls, and so its keys, here.
    rows = found.select("row", F.lit(None).cast(spans.schema["span"].dataType).alias("span"), *keys)
    return rows.unionByName(spans).groupBy("row").agg(*[F.max(k).alias(k) for k in keys], F.array_sort(F.collect_list("span")).alias("spans")).drop("row")


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["is_base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    spans = F.col("spans")
    found_more = F.filter("spans", lambda s: ~s["is_base"])
    more = (F.size("spans").cast("long").alias("n_spans"), F.size(found_more).cast("long").alias("n_found"))
    return found.withColumn("base", base).select("doc_id", *counts, F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(spans).alias("spans"), *more)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets; overlapping spans become one.

    Rows without a span, and all other columns, stay as they are, but for n_chars, which follows its text.
    """
    key = "_pii_text_key"
    keyed = docs.withColumn(key, F.md5("text"))
    spans = find_spans(keyed.select("doc_id", "text", key), ["doc_id", key]).where(F.size("spans") > 0)
    spans = spans.dropDuplicates(["doc_id", key]).select(F.col("doc_id").alias("_pii_id"), F.col(key).alias("_pii_key"), F.col("spans").alias("_pii_spans"))
    met = keyed.join(spans, keyed["doc_id"].eqNullSafe(spans["_pii_id"]) & (keyed[key] == spans["_pii_key"]), "left")

    def step(state: Column, s: Column) -> Column:
        apart = s["start"] >= state["at"]
        more = F.concat(F.substring(F.col("text"), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(apart, F.concat(state["out"], more)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = F.aggregate("_pii_spans", start, step, lambda state: F.concat(state["out"], F.substring(F.col("text"), (state["at"] + 1).cast("int"), F.length("text"))))
    changed = F.col("_pii_spans").isNotNull()
    met = met.withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        met = met.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return met.select(*docs.columns)
