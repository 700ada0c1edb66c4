"""Personal data by bootstrapped contextual extraction, in column functions throughout.

Seed entities come from four patterns with their checks. Their mentions induce lexical patterns: the word before and the
word after. A graph links each pattern to the distinct values it surrounds, seeds and candidates alike; candidates
are strings shaped like an identifier that no seed covers: an address without a dotted host, a telephone number without its
plus, a colon-separated network address, a run of digits as long as a card's that fails its check or is parted otherwise. Spark scores the graph round by round: a pattern by the part of all
occurrences of its word in the corpus that stand beside confident values, a value by the patterns it occurs in. After the last round candidates above the
threshold join the seeds as spans.

Only documents that hold a digit, an at sign or a colon are split at all, and the graph is grouped by (pattern, value) before any join, so
a value or a context that fills a third of the table is one edge. Offsets are code points, end exclusive. Defined results: null
and empty texts have no spans; repeated rows are found each on their own; a null id is kept; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import table, with_text
from storyloom.llm.registry import query
from storyloom.session import materialize

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
MIN_CONFIDENCE, SMOOTHING, MIN_SUPPORT = 0.8, 1.0, 3  # of a candidate; pseudo-count of non-members; distinct seed values of a pattern
CONTEXT = 80  # code points looked at on either side of a mention

# Patterns whose matches, left to right without overlap, are the seeds' (possessive and anchored forms, which find the same
# matches in time linear in the text)
SEEDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]{2}", "phone": "[0-9]"}  # what a text must hold to be searched for a kind
GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}+"  # of a colon address, on one side of its gap
CANDIDATES = {
    "email": r"(?<![^\s])[^\s@]++@[^\s@]++",
    "phone": r"(?<![^\s])\(?[0-9][0-9().-]*+(?:\x20[0-9(][0-9().-]*+)*+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){3,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
          rf"|(?<![0-9A-Za-z:])(?:{GROUPS})?::(?:{GROUPS})?(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?<![0-9][\x20./_-])[0-9](?:[\x20./_-]?[0-9]){12,18}+(?![\x20./_-]?[0-9])",
}
MAY_NEED = NEEDS | {"ip": ":[0-9A-Fa-f:]"}  # the same for candidates
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits: every second digit from the right is doubled, nine taken off if it has two places."""
    n = F.length(digits)

    def place(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), place), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    digits = _digits(s)
    n = F.length(digits)
    if kind == "ip":
        return s.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of a pattern's matches: what lies between the matches gives the places."""
    steps = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern), lambda v, gap: F.struct(v.alias("value"), F.length(gap).cast("long").alias("gap")))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long,value:string>>").alias("out"))

    def step(a: Column, m: Column) -> Column:
        start = a["at"] + m["gap"]
        end = start + F.coalesce(F.length(m["value"]).cast("long"), F.lit(0).cast("long"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value")))).alias("out"))

    return F.aggregate(steps, begin, step, lambda a: F.filter(a["out"], lambda m: m["value"].isNotNull()))


def _found(text: Column, kind: str, pattern: str, need: str) -> Column:
    """Matches as (kind, start, end, value); a text without what the kind needs is not searched."""
    spans = F.transform(located(text, pattern), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return F.when(text.rlike(need), spans).otherwise(F.array().cast(SPANS))


def _passing(spans: str, kind: str, test) -> Column:
    return F.filter(spans, lambda m: test(kind, m["value"]))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda m: m["kind"] == kind)).cast("long")


SPANS = "array<struct<kind:string,start:long,end:long,value:string>>"


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, near): the seeds of each document, and every mention of a seed or candidate with its context."""
    text = F.col("text")
    seeds = docs.select("doc_id", "text", *(_found(text, k, SEEDS[k], NEEDS[k]).alias(f"s_{k}") for k in KINDS),
                        *(_found(text, k, CANDIDATES[k], MAY_NEED[k]).alias(f"c_{k}") for k in CANDIDATES))
    checked = seeds.select(
        "doc_id", "text",
        F.concat(*(_passing(f"s_{k}", k, _valid) for k in KINDS)).alias("base"),
        F.concat(*(_passing(f"c_{k}", k, _plausible) for k in CANDIDATES)).alias("cand"))
    free = checked.select("doc_id", "text", "base", F.filter(
        "cand", lambda c: ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))).alias("cand"))

    def near(m: Column, seed: bool) -> Column:
        left = F.lower(F.substring(text, F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT))))
        right = F.lower(F.substring(text, m["end"] + 1, F.lit(CONTEXT)))
        return F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.lower(m["value"]).alias("value"), F.lit(seed).alias("seed"),
                        F.regexp_extract(left, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$", 1).alias("before"),
                        F.regexp_extract(right, r"^[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", 1).alias("after"))

    return free.select("doc_id", F.xxhash64("text").alias("text_key"), "base", F.concat(
        F.transform("base", lambda m: near(m, True)), F.transform("cand", lambda m: near(m, False))).alias("near"))


def _plausible(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    if kind == "phone":
        return (n >= 7) & (n <= 15)
    if kind == "card":
        return (n >= 13) & (n <= 19)
    return s.rlike("[0-9A-Fa-f]") if kind == "ip" else F.lit(True)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, total): how often each white-space word, in lower case, occurs in all texts; summed on the map side."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word"))
    return words.filter("word <> ''").groupBy("word").agg(F.count("*").alias("total"))


def confident_values(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value) of candidates that the pattern graph is confident of. `edges(kind, side, word, value, n)` counts mentions of a
    value beside a word, `seed` tells whether the value is a seed of that kind."""
    links = materialize(edges.join(totals, "word"), "pattern-links")
    values = links.groupBy("kind", "value").agg(F.max("seed").alias("seed")).withColumn("conf", F.col("seed").cast("double"))
    for _ in range(rounds):
        scored = links.drop("seed").join(values, ["kind", "value"])
        patterns = scored.groupBy("kind", "side", "word").agg(
            (F.sum(F.col("n") * F.col("conf")) / (F.greatest(F.max("total"), F.sum("n")) + SMOOTHING)).alias("trust"), F.sum(F.col("seed").cast("int")).alias("support"))
        useful = patterns.filter(F.col("support") >= MIN_SUPPORT).select("kind", "side", "word", F.least("trust", F.lit(0.999)).alias("trust"))
        fresh = links.filter("not seed").join(useful, ["kind", "side", "word"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("raised"))
        values = materialize(values.join(fresh, ["kind", "value"], "left").select(
            "kind", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("raised", F.lit(0.0))).alias("conf")), "pattern-values")
    return values.filter((~F.col("seed")) & (F.col("conf") >= MIN_CONFIDENCE)).select("kind", "value")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, added) of every document; base and added are arrays of (kind, start, end, value)."""
    docs = with_text(docs)
    found = materialize(mentions(docs), "mentions")
    each = found.filter(F.size("near") > 0).select("doc_id", "text_key", F.explode("near").alias("m")).select("doc_id", "text_key", "m.*")
    sides = each.select("kind", "value", "seed", F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("before").alias("word")), F.struct(F.lit("after").alias("side"), F.col("after").alias("word")))).alias("p"))
    raw = sides.select("kind", "value", "seed", "p.side", "p.word").filter("word <> ''")
    edges = raw.groupBy("kind", "side", "word", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    sure = confident_values(edges, word_counts(docs))
    new = each.filter("not seed").join(sure, ["kind", "value"]).groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set(F.struct("kind", "start", "end", "value"))).alias("added"))
    joined = found.alias("f").join(new.alias("n"), F.col("f.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("f.text_key") == F.col("n.text_key")), "left")
    return joined.select("f.doc_id", "f.text_key", "f.base", F.coalesce("n.added", F.array().cast(SPANS)).alias("added"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    ordered = F.sort_array(F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, m: Column) -> Column:
        apart = F.concat(a["out"], F.substring(text, a["at"] + 1, m["start"] - a["at"]), F.lit("<"), F.upper(m["kind"]), F.lit(">"))
        return F.struct(F.greatest(a["at"], m["end"]).alias("at"), F.when(m["start"] >= a["at"], apart).otherwise(a["out"]).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(ordered, begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))))


def _joined(spans: Column) -> Column:
    """kind:start:end, by kind in the fixed order, then by start, joined with commas."""
    rank = lambda m: sum((F.when(m["kind"] == k, i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))
    keyed = F.sort_array(F.transform(spans, lambda m: F.struct(rank(m).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


@query("op10_pii")
def op10_pii(spark, sf_dir):
    found = personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [_count("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                        _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
