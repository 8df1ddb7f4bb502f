"""Personal data: fixed patterns, and identifiers found from their contexts by bootstrapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import common

KINDS = ["email", "ip", "card", "phone"]
#: The fixed patterns, written so that a match starts where the plain pattern's leftmost match would and no start is tried twice:
#: runs are possessive, and a run is entered at its beginning or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier: a run up to white space or a quote that has a digit, or whatever stands after = or :, of any length.
CANDIDATE = r"(?<=[=:][\x20\"']{0,3})[^\s\"']+|(?<![^\s\"'=:(])(?=[^\s\"'=:(]*[0-9])[^\s\"'=:(]{4,}"
#: Punctuation at the end of a run is not part of it.
TAIL = r"[.,;:!?)\]}>]+$"
#: Seed entities beside the spans of the fixed kinds: strings that are keys by their form (hexadecimal digests and the public formats of
#: access keys and tokens).
KEY_FORMS = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*)$"
#: Lexical patterns of a candidate: the word before it with what stands between, and the two words before it with the marks after it.
#: They are looked for in so many characters before and after.
NEAR, WIDE, AFTER = r"([\p{L}_]+[^\p{L}\p{N}]*)$", r"([\p{L}_]+[^\p{L}\p{N}]+[\p{L}_]+[^\p{L}\p{N}]*)$", r"^([^\p{L}\p{N}]*)"
CONTEXT_CHARS, AFTER_CHARS = 48, 16
#: Every place where a near pattern stands, whatever follows.
PLACE = r"[\p{L}_]+[^\p{L}\p{N}]*"
#: A pattern is trusted with this much support (sum of its known instances' confidence) and this confidence (that sum by all that it extracts).
SUPPORT, CONFIDENCE = 3.0, 0.5
#: Up to so many patterns (some tens of bytes each) go to every task.
PATTERNS_SENT = 500_000
#: Matches that are appended to one block, so that the work on a text grows with its matches and not with their square.
BLOCK = 512


def matches(text: Column, pattern: str) -> Column:
    """Array of (s, e, v, before, after): the leftmost non-overlapping matches, in code points, end exclusive, and what lies beside them.

    Positions are sums of the lengths of matches and of what lies between them, so nothing is searched again.
    """
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))
    one = "s:int,e:int,v:string,before:string,after:string"
    none, blocks = F.array().cast(f"array<struct<{one}>>"), F.array().cast(f"array<array<struct<{one}>>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["v"]), F.lit(0))
        found = F.struct(start.alias("s"), end.alias("e"), x["v"].alias("v"), F.right(x["gap"], F.lit(CONTEXT_CHARS)).alias("before"), F.left(x["next"], F.lit(AFTER_CHARS)).alias("after"))
        full = F.size(acc["block"]) >= BLOCK
        block = F.when(x["v"].isNull(), acc["block"]).when(full, F.array(found)).otherwise(F.array_append(acc["block"], found))
        return F.struct(end.alias("at"), block.alias("block"), F.when(full & x["v"].isNotNull(), F.array_append(acc["out"], acc["block"])).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), none.alias("block"), blocks.alias("out"))
    return F.aggregate(parts, start, add, lambda acc: F.flatten(F.array_append(acc["out"], acc["block"])))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether digits pass Luhn's check."""
    n = F.char_length(number)

    def worth(i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = 2 * d
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def holds(kind: str, v: Column) -> Column:
    """Whether a match of the fixed pattern counts."""
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        d = digits(v)
        return F.char_length(d).between(13, 19) & F.when(F.char_length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits(v)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of a kind, with a cheap test first so that most texts don't meet the pattern at all."""
    may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, F.col("__digits"))
    found = F.transform(F.filter(matches(text, PATTERNS[kind]), lambda m: holds(kind, m["v"])), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e")))
    return F.when(may, found).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def plain(c: Column) -> Column:
    """A lexical pattern: lower-cased, white space as one space."""
    return F.regexp_replace(F.lower(c), r"\s+", " ")


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text_hash, one column of spans for each kind, seen): seen lists the candidates (s, e, v, near, wide)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"))
    rows = rows.withColumn("__digits", F.col("t").rlike("[0-9]"))
    none = F.array().cast("array<struct<s:int,e:int,v:string,before:string,after:string>>")
    may = F.col("__digits") | F.contains("t", F.lit("=")) | F.contains("t", F.lit(":"))
    rows = rows.select("id", "text_hash", *[base_spans(F.col("t"), k).alias(k) for k in KINDS], F.when(may, matches(F.col("t"), CANDIDATE)).otherwise(none).alias("found"))

    def told(x: Column) -> Column:
        v = F.regexp_replace(x["v"], TAIL, "")
        wide = F.concat(F.regexp_extract(x["before"], WIDE, 1), F.lit("_"), F.regexp_extract(F.concat(F.substring(x["v"], F.char_length(v) + 1, F.lit(AFTER_CHARS)), F.coalesce(x["after"], F.lit(""))), AFTER, 1))
        return F.struct(x["s"].alias("s"), (x["s"] + F.char_length(v)).alias("e"), v.alias("v"), plain(F.regexp_extract(x["before"], NEAR, 1)).alias("near"), F.when(F.regexp_extract(x["before"], WIDE, 1) != "", plain(wide)).alias("wide"))

    return rows.select("id", "text_hash", *KINDS, F.filter(F.transform("found", told), lambda x: x["e"] > x["s"]).alias("seen"))


def candidates(found: DataFrame) -> DataFrame:
    """Rows (id, text_hash, s, e, v, near, wide, seed): candidates that meet no span of the fixed kinds, and the seeds.

    A candidate that begins a span of a fixed kind is a seed (with its contexts; s and e null, as its span is there already);
    others that meet one are dropped. Spans and candidates of a text are compared in the order of their places, not pair by pair.
    """
    every = F.concat(*[F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(None).cast("string").alias("v"), F.lit(None).cast("string").alias("near"), F.lit(None).cast("string").alias("wide"))) for k in KINDS])
    rows = found.where(F.size("seen") > 0).select("id", "text_hash", F.explode(F.concat(every, "seen")).alias("x")).select("id", "text_hash", "x.*").distinct()
    fixed = F.col("v").isNull()
    order = Window.partitionBy("id", "text_hash").orderBy("s", F.col("v").isNotNull())
    upto, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("reach", F.max(F.when(fixed, F.col("e"))).over(upto)).withColumn("begun", F.max(F.when(fixed, F.col("s"))).over(upto)).withColumn("next", F.min(F.when(fixed, F.col("s"))).over(after)).where(~fixed)
    meets = (F.coalesce(F.col("reach") > F.col("s"), F.lit(False))) | F.coalesce(F.col("next") < F.col("e"), F.lit(False))
    begins = F.coalesce(F.col("begun") == F.col("s"), F.lit(False))
    rows = rows.withColumn("meets", meets).where(~F.col("meets") | begins)
    seed = F.col("meets") | F.col("v").rlike(KEY_FORMS)
    place = lambda c: F.when(~F.col("meets"), F.col(c)).alias(c)
    return rows.select("id", "text_hash", place("s"), place("e"), F.lower("v").alias("v"), "near", "wide", seed.alias("seed"))


def edges_of(seen: DataFrame) -> DataFrame:
    """Rows (pattern, v, seed): the pattern-instance graph. Near patterns begin with "1", wide ones with "2"."""
    patterns = F.array_compact(F.array(F.when(F.col("near") != "", F.concat(F.lit("1"), "near")), F.concat(F.lit("2"), "wide")))
    return seen.select(F.explode(patterns).alias("pattern"), "v", "seed")


def blanks(docs: DataFrame, text_col: str, patterns: DataFrame) -> DataFrame:
    """Rows (pattern, places): how often each near pattern stands in the texts, whatever follows it.

    patterns is written before. Places of other patterns are dropped where they are met, so that only counts are shuffled.
    """
    few = patterns.limit(PATTERNS_SENT + 1).count() <= PATTERNS_SENT
    at = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(PLACE), F.lit(0))).alias("w"))
    near = at.select(F.concat(F.lit("1"), plain(F.right("w", F.lit(CONTEXT_CHARS)))).alias("p"))
    wanted = patterns.select("pattern")
    return near.join(F.broadcast(wanted) if few else wanted, F.expr("p = pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("places"))


def trusted(edges: DataFrame, places: DataFrame | None = None, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """edges: pattern, v, seed. Returns the trusted patterns (pattern, conf) and the known instances (v, conf) once bootstrapping has settled.

    An instance's confidence is 1 for a seed, else that not all trusted patterns that extract it are wrong, 1 - prod(1 - conf). A round
    scores every pattern by the sum of its instances' confidence over all that it extracts; what stands in `places` without a
    candidate after it counts as wrong extractions. Patterns of enough support and confidence are trusted from then on, with
    the confidence they had. Rounds end when one adds no pattern. Ties don't matter: all patterns above the bounds enter.
    """
    graph = common.materialise(edges.groupBy("pattern", "v").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("times")), "graph")
    sizes = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("times"))
    if places is not None:
        sizes = sizes.join(places.withColumnRenamed("pattern", "p"), F.expr("pattern = p"), "left").withColumn("n", F.col("n") + F.greatest(F.lit(0), F.coalesce("places", F.lit(0)) - F.col("times")))
    sizes = common.materialise(sizes.where(F.col("n") >= support).select("pattern", "n"), "pattern-sizes")
    known = common.materialise(graph.where("seed").select("v").distinct().withColumn("conf", F.lit(1.0)), "known")
    good = None
    while True:
        told = graph.join(known.withColumnRenamed("v", "k"), F.expr("v = k")).groupBy("pattern").agg(F.sum(F.col("conf").cast("decimal(28,12)")).cast("double").alias("mass"))
        scored = told.join(sizes.withColumnRenamed("pattern", "p"), F.expr("pattern = p")).withColumn("score", F.col("mass") / F.col("n"))
        better = scored.where((F.col("mass") >= support - 1e-9) & (F.col("score") >= confidence)).select("pattern", F.least("score", F.lit(0.999)).alias("conf"))
        fresh = common.materialise(better if good is None else better.join(good, "pattern", "left_anti"), "patterns")
        if fresh.isEmpty():
            return (fresh if good is None else good), known
        good = fresh if good is None else common.materialise(good.unionByName(fresh), "patterns")
        wrong = F.sum(F.log(1 - F.col("conf")).cast("decimal(28,12)")).cast("double")
        led = graph.join(good.withColumnRenamed("pattern", "p"), F.expr("pattern = p")).groupBy("v").agg(F.max("seed").alias("seed"), (1 - F.exp(wrong)).alias("conf"))
        learnt = led.where("not seed").select("v", "conf").join(known.where("conf = 1").select("v"), "v", "left_anti")
        known = common.materialise(known.where("conf = 1").unionByName(learnt), "known")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text_hash, email, ip, card, phone, id_spans): spans of the fixed kinds and of identifiers found by their contexts.

    One row for each row of docs. Null and empty texts have no spans. An identifier is reported if it is a key by its form, if a
    trusted pattern extracts it, or if the same value is known from elsewhere; it never meets a span of the fixed kinds, which all stay. Of
    identifiers that meet each other the one that begins first is reported. Very long texts and many matches cost in proportion.
    """
    found = common.materialise(spans_of(docs, id_col, text_col), "spans")
    seen = common.materialise(candidates(found), "candidates")
    edges = common.materialise(edges_of(seen), "edges")
    # near patterns that could reach the support are counted over all texts
    some = edges.where("pattern like '1%'").groupBy("pattern").agg(F.countDistinct("v").alias("n")).where(F.col("n") >= SUPPORT)
    good, known = trusted(edges, common.materialise(blanks(docs, text_col, common.materialise(some, "near-patterns")), "places"))
    fresh = seen.where("s is not null")
    led = fresh.join(good.select(F.col("pattern").alias("p1")), F.expr("p1 = concat('1', near)"), "left").join(good.select(F.col("pattern").alias("p2")), F.expr("p2 = concat('2', wide)"), "left")
    named = led.join(known.select(F.col("v").alias("k")), F.expr("v = k"), "left").where("seed or p1 is not null or p2 is not null or k is not null").select("id", "text_hash", "s", "e").distinct()
    order = Window.partitionBy("id", "text_hash").orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    first = named.withColumn("reach", F.max("e").over(order)).where("reach is null or reach <= s")
    added = first.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("id_spans")).withColumnsRenamed({"id": "i", "text_hash": "h"})
    return found.join(added, F.expr("id <=> i and text_hash = h"), "left").select("id", "text_hash", *KINDS, F.coalesce("id_spans", F.array().cast("array<struct<s:int,e:int>>")).alias("id_spans"))


def listed(column: str, kind: str) -> Column:
    return F.transform(column, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with counts and digest of the base spans, and all spans."""
    found = find_pii(common.table(spark, sf_dir, "documents"))
    base = F.concat(*[listed(k, k) for k in KINDS])
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, listed("id_spans", "id")), ",").alias("spans"),
    )
