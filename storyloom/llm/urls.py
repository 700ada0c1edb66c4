"""URL filter: host rules first, then a ratio of two character language models.

Rules judge the hosts and paths they name. They also label URLs, and from those two smoothed variable-order Markov models are
fitted, one of accepted and one of rejected URLs: the chance of a character after a context is interpolated from the longest
context seen down to the empty one, each order weighted by how often and how diversely its context was followed (Witten-Bell).
A URL without a rule is judged by the difference of its two log-likelihoods, divided by its length, against a threshold chosen
on labelled URLs that were held out of the fit.

All distinct labelled URLs count: four of five, by a hash, fit the models, the others choose the threshold. The counts are a table, made by
grouped sums, and the URLs meet it in joins on their runs of characters; only counts per 1/`STEPS` of a score come to the driver, and
thresholds lie on that grid. `CharModel` and `UrlJudge` are the same models over lists. Defined results: a null URL or one without `://` has
an empty host and path and no rule; it and an empty one score 0 and are allowed only if the threshold is not above 0; repeated rows are
judged each and count once in the fit; without labelled URLs of both verdicts everything without a rule is allowed; other columns are not
read.
"""

from __future__ import annotations

from collections import Counter
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import fold, table
from storyloom.llm.registry import query
from storyloom.session import materialize

ORDER, ALPHABET = 5, 256
STEPS = 4096  # thresholds are multiples of 1 / STEPS
EXACT = 1 << 30  # log-ratios are summed as whole multiples of 1 / EXACT, so that a sum does not depend on its order
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without it."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule whose host is the URL's or a parent of it and whose path begins the URL's; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


class CharModel:
    """Counts of characters after contexts of up to `order` characters, with Witten-Bell interpolation."""

    def __init__(self, texts: list[str], order: int = ORDER):
        self.order, self.follow, self.total, self.kinds = order, Counter(), Counter(), Counter()
        for t in texts:
            t = "\x02" * order + t + "\x03"
            for i in range(order, len(t)):
                for k in range(order + 1):
                    self.follow[t[i - k : i + 1]] += 1
        for gram, n in self.follow.items():
            self.total[gram[:-1]] += n
            self.kinds[gram[:-1]] += 1

    def log_likelihood(self, text: str) -> float:
        t, out = "\x02" * self.order + text + "\x03", 0.0
        for i in range(self.order, len(t)):
            p = 1 / ALPHABET
            for k in range(self.order + 1):
                total = self.total.get(t[i - k : i])
                if not total:
                    break  # longer contexts have not been seen either
                kinds = self.kinds[t[i - k : i]]
                p = (self.follow.get(t[i - k : i + 1], 0) + kinds * p) / (total + kinds)
            out += log(p)
        return out


def best_cut(values: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the best mean accuracy over both kinds, of the best the one nearest to 0: `good[i]` accepted and `bad[i]` rejected
    URLs score `values[i]`, which ascend; a cut lies between two of them or beyond them."""
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    below = lambda n: np.concatenate([[0], np.cumsum(n)]) / n.sum()
    value = 1 - below(good) + below(bad)
    best = cuts[value >= value.max() - 1e-12]
    return float(best[np.argmin(np.abs(best))])


class UrlJudge:
    def __init__(self, accepted: list[str], rejected: list[str]):
        """Fits on four of five URLs of each kind; the threshold is the one with the best mean accuracy over both on the fifth."""
        fit = lambda urls: [u for i, u in enumerate(urls) if i % 5]
        held = lambda urls: [u for i, u in enumerate(urls) if not i % 5]
        self.ready = bool(accepted and rejected)
        self.threshold = 0.0
        self.models = (CharModel(fit(accepted) or accepted), CharModel(fit(rejected) or rejected))
        if self.ready:
            good, bad = ([self.score(u) for u in held(x)] for x in (accepted, rejected))
            values, place = np.unique(good + bad, return_inverse=True)
            self.threshold = best_cut(values, *(np.bincount(x, minlength=len(values)) for x in (place[: len(good)], place[len(good) :])))

    def score(self, url: str) -> float:
        """Difference of the log-likelihoods for a character of the URL."""
        return (self.models[0].log_likelihood(url) - self.models[1].log_likelihood(url)) / len(url) if url else 0.0


def _grams(urls: DataFrame, *columns: str) -> DataFrame:
    """A row for each character of `url` and one for its end: `gram` is it and the `ORDER` characters before it."""
    chars = urls.select(*columns, F.split(F.concat(F.lit("\x02" * ORDER), "url", F.lit("\x03")), "").alias("chars"))
    at = F.sequence(F.lit(1), F.size("chars") - ORDER)
    return chars.select(*columns, F.explode(F.transform(at, lambda i: F.array_join(F.slice("chars", i, ORDER + 1), ""))).alias("gram"))


def gram_counts(fit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both models of `fit(url, verdict)` as tables: (own, allow, block), how often each run of 1 to `ORDER` + 1 characters was seen, and
    (context, allow_total, allow_kinds, block_total, block_kinds), how often and how diversely each run was followed."""
    verdicts = ("allow", "block")
    whole = _grams(fit, "verdict").groupBy("gram").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in verdicts])
    ends = F.explode(F.array(*[F.right("gram", F.lit(k + 1)) for k in range(ORDER + 1)])).alias("own")
    follow = materialize(whole.select(ends, *verdicts).groupBy("own").agg(*[F.sum(v).alias(v) for v in verdicts]), "url-grams")
    context = follow.groupBy(F.expr("left(own, length(own) - 1)").alias("context")).agg(
        *[x for v in verdicts for x in (F.sum(v).alias(f"{v}_total"), F.count_if(F.col(v) > 0).alias(f"{v}_kinds"))])
    return follow, materialize(context, "url-contexts")  # the empty context meets every run: a table is broadcast, or its join is split


def gram_worths(grams: DataFrame, follow: DataFrame, context: DataFrame) -> DataFrame:
    """(gram, worth): difference of the log-chances, in 1 / `EXACT`, that the models give the last character after the others."""
    k = F.col("k")
    parts = grams.select("gram", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k")).select(
        "gram", "k", F.right("gram", k + 1).alias("own"), F.substring("gram", F.lit(ORDER + 1) - k, k).alias("context"))
    met = parts.join(follow, "own", "left").join(context, "context", "left")
    seen = met.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("k", *follow.columns[1:], *context.columns[1:]))).alias("orders"))

    def longer(p: Column, order: Column, v: str) -> Column:
        total, kinds, n = (F.coalesce(order[c], F.lit(0)) for c in (f"{v}_total", f"{v}_kinds", v))
        return F.when(total > 0, (n + kinds * p) / (total + kinds)).otherwise(p)  # longer contexts have not been seen either

    chance = lambda v: F.aggregate("orders", F.lit(1 / ALPHABET), lambda p, order: longer(p, order, v))
    return seen.select("gram", F.round((F.ln(chance("allow")) - F.ln(chance("block"))) * EXACT).cast("long").alias("worth"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; score is the models' difference, null where a rule decides."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    columns = ["page_id", "host", "path", "fit.rule"]
    once = parsed.filter("url <> ''").select("url", "fit.verdict").distinct()
    urls = materialize(once.select(F.monotonically_increasing_id().alias("number"), "url", "verdict", (fold(F.col("url")) == 0).alias("held")), "urls")
    sizes = {(r.verdict, r.held): r.n for r in urls.filter("verdict is not null").groupBy("verdict", "held").agg(F.count("*").alias("n")).collect()}
    if len({verdict for verdict, _ in sizes}) < 2:
        return parsed.select(*columns, F.coalesce("fit.verdict", F.lit("allow")).alias("verdict"), F.when(F.col("fit").isNull(), 0.0).alias("score"))

    def labelled(held: bool) -> Column:
        """URLs that were held out, or were not; of a verdict without any such, all."""
        return (F.col("held") == held) | ~F.col("verdict").isin([v for v, h in sizes if h == held])

    fit, cut = urls.filter(F.col("verdict").isNotNull() & labelled(False)), urls.filter(F.col("verdict").isNull() | labelled(True))
    grams = _grams(cut, "number")
    worths = materialize(gram_worths(grams.select("gram").distinct(), *gram_counts(fit)), "gram-worths")
    sums = grams.join(worths, "gram").groupBy("number").agg(F.sum("worth").alias("worth"))
    scored = materialize(cut.join(sums, "number").select("url", "verdict", (F.col("worth") / EXACT / F.length("url")).alias("score")), "url-scores")
    steps = scored.filter("verdict is not null").groupBy(F.floor(F.col("score") * STEPS).alias("step")).agg(
        F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad")).orderBy("step").collect()
    threshold = float(np.ceil(best_cut(*(np.array([r[c] for r in steps]) for c in ("step", "good", "bad"))))) / STEPS
    judged = lambda score: F.when(score >= threshold, "allow").otherwise("block")
    ruled = parsed.filter("fit is not null or coalesce(url, '') = ''").select(
        *columns, F.coalesce("fit.verdict", judged(F.lit(0.0))).alias("verdict"), F.when(F.col("fit").isNull(), 0.0).alias("score"))
    others = parsed.filter("fit is null and url <> ''").join(scored.filter("verdict is null").select("url", "score"), "url")
    return ruled.unionByName(others.select(*columns, judged(F.col("score")).alias("verdict"), "score"))


@query("op5_url_filter")
def op5_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"))
