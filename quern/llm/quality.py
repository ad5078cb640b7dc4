"""Quality rules of documents, with verdicts on their hosts.

Each document gets rule figures and a base verdict. The failures of each rule are summed by host (for documents: their
source). For each rule a beta prior is fitted to the hosts' rates by moments, less the variance that hosts of their size
have by chance, and each host's rate is shrunk towards the mean by it. A host is rejected, with all of its documents, if
its shrunk rate for some rule is beyond the prior's mean plus DEVIATIONS of its standard deviations, and beyond MOST. So
where hosts differ no more than by chance, none is an outlier, and a host of few documents needs all of them to fail.
Everything is built-in Column functions; the words of a text never leave its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans import scratch

SEPARATORS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
DEVIATIONS = 2.0
MOST = 0.5  # the rate of failures that a host may have in any case
BROADCAST_ROWS = 50_000


def words(text: Column) -> Column:
    """The runs of characters other than space and U+0009 to U+000D."""
    return F.array_remove(F.split(F.translate(text, SEPARATORS[1:], " " * 5), " "), "")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the rule figures: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed; and
    __q_lines, the number of lines with a word. A null text counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    bare = [c for c in docs.columns if c not in RULES]
    out = docs.select(*[docs[c] for c in bare], body.alias("__q_text"), words(body).alias("__q_words"))
    w = F.col("__q_words")
    grams = F.transform(F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))), lambda c, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), c))
    lines = F.filter(F.split("__q_text", "\n"), lambda x: F.length(F.translate(x, SEPARATORS, "")) > 0)
    out = out.select(*bare, F.col("__q_text"), F.size(w).cast("long").alias("n_words"), grams.alias("__q_grams"), lines.alias("__q_lines"))
    g = F.col("__q_grams")
    out = out.select(
        *bare,
        "n_words",
        F.length(F.translate("__q_text", SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length("__q_text") - F.length(F.translate("__q_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__q_lines").cast("long").alias("__q_lines"),
        (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__q_pairs"),
    )
    # each step has its own select: a lambda would compute an expression of its outer row again for every element
    p = F.col("__q_pairs")
    twice = F.transform(p, lambda x, k: F.when((F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]), x["i"]))
    out = out.withColumn("__q_at", twice).drop("__q_pairs")
    at = F.sort_array(F.filter("__q_at", lambda i: i.isNotNull()))
    covered = F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")))["n"]
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__q_at")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def failures() -> dict[str, Column]:
    """The rules that are counted by host, over the columns of `features`: few words, words in repeated runs, symbols (more than a
    tenth of the characters), repeated lines (more than three tenths)."""
    return {
        "few": F.col("n_words") < 50,
        "runs": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("__q_lines"),
    }


def host_verdicts(judged: DataFrame, host: str = "source", deviations: float = DEVIATIONS, most: float = MOST) -> DataFrame:
    """One row per host: host, docs, for each rule its failures and rate_ (shrunk), and rejected. Null hosts have no row.

    A rule's prior is Beta(m k, (1 - m) k) with m the mean of the hosts' rates and k = m (1 - m) / v - 1, where v is their
    variance less m (1 - m) times the mean of 1 / docs; k is 1 at least, and 1e6 where v is next to nothing. The shrunk
    rate is (failures + m k) / (docs + k), and the prior's standard deviation the root of m (1 - m) / (k + 1).
    """
    rules = failures()
    hosts = judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("docs"), *[F.count_if(c).alias(r) for r, c in rules.items()])
    hosts = scratch.cut(hosts, "hosts")
    rate = {r: F.col(r) / F.col("docs") for r in rules}
    fit = hosts.agg(F.avg(1 / F.col("docs")).alias("chance"), *[f(rate[r]).alias(f"{n}_{r}") for r in rules for n, f in (("m", F.avg), ("v", F.var_pop))]).first()
    bad = F.lit(False)
    for r in rules:
        m = fit[f"m_{r}"] or 0.0
        v = (fit[f"v_{r}"] or 0.0) - m * (1 - m) * (fit.chance or 0.0)
        k = 1e6 if v <= m * (1 - m) / 1e6 else max(1.0, m * (1 - m) / v - 1)
        hosts = hosts.withColumn(f"rate_{r}", (F.col(r) + F.lit(m * k)) / (F.col("docs") + F.lit(k)))
        bad = bad | (F.col(f"rate_{r}") > max(most, m + deviations * (m * (1 - m) / (k + 1)) ** 0.5))
    return hosts.withColumn("rejected", bad)


def judge(docs: DataFrame, text: str = "text", host: str = "source", deviations: float = DEVIATIONS, most: float = MOST, carry: list[str] | None = None) -> DataFrame:
    """The rows of `docs` with the rule figures, base_failed and kept: not base_failed, and the host not rejected.

    `carry` names the columns of `docs` that the result has, all by default; the figures are computed once, and written
    with those columns to the shared folder. Null and empty texts have no words and fail; texts of any length are
    handled whole. A null host has no verdict, so the base rules alone decide. Repeated rows each count. Columns of the
    names that are added are replaced. An empty table gives an empty one. Only rejected hosts are joined back: broadcast
    if they are few, else by a join whose hot hosts Spark splits.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (*RULES, "kept")]
    judged = features(docs.drop("kept").withColumn("__q_by", docs[host]), text).select(*carry, "__q_by", *RULES, "__q_lines")
    judged = scratch.cut(judged, "quality")
    bad = host_verdicts(judged, "__q_by", deviations, most).where("rejected").select(F.col("host").alias("__q_host"), F.lit(True).alias("__q_bad"))
    bad = scratch.small(scratch.cut(bad, "rejected"), BROADCAST_ROWS)
    out = judged.join(bad, judged["__q_by"] == bad["__q_host"], "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("__q_bad").isNull()).select(*carry, *RULES, "kept")
