"""URL filter: longest fitting rule, else a ratio of two character language models.

URLs that a rule judges are the labelled rows. Two variable-order Markov models with Witten-Bell smoothing are
counted over all accepted and all rejected ones, less a held-out fifth on which the threshold is calibrated.
A URL's score is the difference of its log-likelihoods, divided by its number of characters.

Scoring is one join. With v(g) the log-ratio of the models' probabilities for the last character of a seen gram
g, and u(c) the log-ratio of their back-off weights after a seen context c, a character with contexts c_1..c_K
and longest seen gram g_j scores v(g_j) + sum of u(c_k) for k > j. As every suffix of a seen gram is seen, that
equals the sum of v(g_k) - v(g_{k-1}) - u(c_k) over all its seen grams plus the sum of u over all its contexts:
each substring has one fixed weight, and a URL's score is the sum over its substrings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans import scratch

ORDER = 3  # the most characters of context
BEGIN, END = "\u0002", "\u0003"
ALPHABET = 256  # of the uniform distribution under order 0
BIN = 0.02  # width of the bins in which the threshold is looked for
BROADCAST_ROWS = 2_000_000  # of at most ORDER + 1 characters and a double each
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end.
    Both are empty for a null or where there is no ://."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, *_LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (its string, its verdict) that fits, else nulls. `rules` are pairs like ("allow",
    "example.com/en/"): up to the first / the host, which also stands for its subdomains, then the path's start.
    The list is a parameter of the job, held in the plan: a few hundred rules at most."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        suffix, slash, start = rule.partition("/")
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(slash + start)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """A row for each substring of up to ORDER + 1 characters of the padded URL that ends at a character of it, at
    its end mark or just before it, and an empty one for each character and the end mark: columns `keep` and g."""
    padded = F.concat(F.lit(BEGIN * ORDER), F.col("s"), F.lit(END))
    at = F.sequence(F.lit(ORDER), F.length("s") + ORDER + 1)
    grams = F.flatten(F.transform(at, lambda i: F.array(*[F.substring(F.col("p"), i - k + 1, F.lit(k)) for k in range(1, ORDER + 1)], F.when(i > ORDER, F.substring(F.col("p"), i - ORDER, F.lit(ORDER + 1))), F.when(i > ORDER, ""))))
    return urls.withColumn("p", padded).select(*keep, F.explode_outer(grams).alias("g")).where("g IS NOT NULL")


def model(labelled: DataFrame) -> DataFrame:
    """The weight of each substring: columns g, w. `labelled` has s (text), n (times seen) and ok (accepted)."""
    n = F.col("n")
    counts = _grams(labelled, "n", "ok").groupBy("g").agg(F.sum(F.when(F.col("ok"), n).otherwise(0)).alias("a"), F.sum(F.when(F.col("ok"), 0).otherwise(n)).alias("b"))
    counts = scratch.cut(counts, "grams")
    seen = counts.where((F.col("g") != "") & ~F.col("g").endswith(BEGIN))
    contexts = seen.groupBy(F.expr("substring(g, 1, length(g) - 1)").alias("c")).agg(
        F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum((F.col("a") > 0).cast("long")).alias("ta"), F.sum((F.col("b") > 0).cast("long")).alias("tb")
    )
    contexts = scratch.cut(contexts.select("c", "na", "nb", "ta", "tb", (_back("na", "ta") - _back("nb", "tb")).alias("u")), "contexts")
    levels = []
    for k in range(1, ORDER + 2):
        level = seen.where(F.length("g") == k).withColumn("c", F.expr("substring(g, 1, length(g) - 1)")).join(contexts, "c")
        if k == 1:
            level = level.select("*", F.lit(1 / ALPHABET).alias("pa0"), F.lit(1 / ALPHABET).alias("pb0"), F.lit(0.0).alias("v0"))
        else:
            below = levels[-1].select(F.col("g").alias("h"), F.col("pa").alias("pa0"), F.col("pb").alias("pb0"), F.col("v").alias("v0"))
            level = level.join(below, F.expr("substring(g, 2, length(g) - 1)") == F.col("h"))
        level = level.select("g", "u", "v0", _mixed("a", "na", "ta", "pa0").alias("pa"), _mixed("b", "nb", "tb", "pb0").alias("pb"))
        levels.append(scratch.cut(level.withColumn("v", F.log("pa") - F.log("pb")), f"level{k}"))
    as_gram = reduce(DataFrame.unionByName, [x.select("g", (F.col("v") - F.col("v0") - F.col("u")).alias("w")) for x in levels])
    as_context = contexts.select(F.col("c").alias("g"), F.col("u").alias("w"))
    return as_gram.unionByName(as_context).groupBy("g").agg(F.sum("w").alias("w"))


def _back(n: str, t: str) -> Column:
    return F.when(F.col(n) > 0, F.log(F.col(t) / (F.col(n) + F.col(t)))).otherwise(0.0)


def _mixed(count: str, n: str, t: str, below: str) -> Column:
    return F.when(F.col(n) > 0, (F.col(count) + F.col(t) * F.col(below)) / (F.col(n) + F.col(t))).otherwise(F.col(below))


def score(urls: DataFrame, weights: DataFrame) -> DataFrame:
    """Columns s, score: the log-likelihood difference of each distinct s, divided by its characters and end mark."""
    weights = scratch.small(weights, BROADCAST_ROWS)
    sums = _grams(urls.select("s"), "s").join(weights, "g").groupBy("s").agg(F.sum("w").alias("sum"))
    return sums.select("s", (F.col("sum") / (F.length("s") + 1)).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The cut of the best balanced accuracy over held-out rows (score, n, ok), in steps of BIN; of equals that next
    to 0. It is 0 where one of the two classes has no held-out row. At most 1,001 bins come to the driver."""
    at = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(-500)), F.lit(500))
    rows = scored.groupBy(at.alias("bin")).agg(F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("ok"), 0).otherwise(F.col("n"))).alias("b")).collect()
    good, bad = sum(r.a for r in rows), sum(r.b for r in rows)
    if not good or not bad:
        return 0.0
    cuts = sorted({r.bin for r in rows} | {r.bin + 1 for r in rows})
    return max(cuts, key=lambda c: (round(sum(r.a for r in rows if r.bin >= c) / good + sum(r.b for r in rows if r.bin < c) / bad, 9), -abs(c))) * BIN


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict (allow or block) and score (null where a rule decides) to each row.

    A null or empty URL has an empty host and path, and no rule can fit it; the models judge it as the empty text.
    Where rules accept no URL or reject none, there is nothing to learn and the rest is allowed. Repeated rows
    each get the same verdict, and each counts in the models. URLs of any length are judged whole; an empty table gives
    an empty one. Columns of those names in the input are replaced.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    host, path = host_path(F.col(url))
    base = pages.select(*[pages[c] for c in kept], host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    whole = F.coalesce(F.col(url), F.lit(""))
    text = F.lower(F.substring(whole, F.when(F.locate("://", whole) > 0, F.locate("://", whole) + 3).otherwise(1), F.length(whole)))
    base = base.select("*", rule.alias("rule"), verdict.alias("__q_by"), text.alias("__q_s"))

    urls = base.groupBy(F.col("__q_s").alias("s"), (F.col("__q_by") == "allow").alias("ok")).agg(F.count("*").alias("n"))
    urls = scratch.cut(urls.withColumn("held", F.pmod(F.xxhash64("s"), F.lit(5)) == 0), "urls")
    classes = {r.ok for r in urls.where("ok IS NOT NULL").select("ok").distinct().collect()}
    if len(classes) < 2:
        return base.select(*kept, "host", "path", "rule", F.coalesce("__q_by", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    weights = scratch.cut(model(urls.where("ok IS NOT NULL AND NOT held")), "weights")
    scored = scratch.cut(score(urls.where("ok IS NULL OR held").select("s").distinct(), weights), "scores")
    cut = threshold(scored.join(urls.where("ok IS NOT NULL AND held"), "s"))
    found = scored.select(F.col("s").alias("__q_k"), F.col("score").alias("__q_score"))
    out = base.join(found, (base["__q_s"] == found["__q_k"]) & base["__q_by"].isNull(), "left")
    by_model = F.when(F.col("__q_score") >= cut, "allow").otherwise("block")
    return out.select(*kept, "host", "path", "rule", F.coalesce("__q_by", by_model).alias("verdict"), F.col("__q_score").alias("score"))
