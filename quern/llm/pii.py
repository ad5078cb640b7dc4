"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give it away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Beside them, keys are spans of the method's
own: runs of KEY or more ASCII letters and digits, both of them, of which the self-information alone (over 100 bits)
identifies a holder. What is protected are these classes: that a text holds an e-mail address, an IP address, a card
number, a phone number, a key, or any of them. Over all documents, those
of a class c, those that hold a term t (a run of four letters or more), and those of both are counted. With N documents,
t discloses PMI(c; t) / IC(c) of c, where PMI = ln(p(c | t) / p(c)), p(c) = df_c / N and IC = -ln p(c). Terms beyond
REMOVE for a class are removed, those beyond GENERALISE are replaced by a tag, in every document that holds them, whether
or not it names what they disclose.

Three things keep the estimate sound. Values in all their formats are one entity, and documents that hold the same value
share the weight of one document in all four counts (N, df_c, df_t and both), so that copies of a page are neither
evidence of their own nor against what they hold; documents without a value weigh one each. One document is taken off the
evidence for each pair, so that a document doesn't convict its own words. And p(c | t) is shrunk towards p(c) by PRIOR
documents. No pair is left out, and all counts are sums that are partial before they are shuffled.

All of it is built-in Column functions. Offsets of matches come from the lengths of the matches and of the pieces
between them. The patterns are written with possessive quantifiers and only begin where a run of their characters
begins (or the last match ended), which finds the same matches in linear time and without deep recursion.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans import scratch

KINDS = ["email", "ip", "card", "phone", "term", "key"]
BASE = KINDS[:4]
KEY = 20
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "key": rf"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{{{KEY},}}+",
}
_NEEDS = {"key": rf"[A-Za-z0-9]{{{KEY}}}", "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
TERM = r"(?<=[^\p{L}])\p{L}{4,}+(?=[^\p{L}])"
PRIOR = 20.0  # documents by which the estimate of p(c | t) is shrunk
UNIT = 1 << 20  # a document's weight, in whole numbers, so that sums don't depend on their order
CLASSES = 6  # the kinds of base spans, keys, and any of them
REMOVE, GENERALISE = 0.8, 0.5
BLOCK = 128
BROADCAST_ROWS = 500_000


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.translate(value, "+ ().-", "")).between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text: str, name: str, keys: str) -> DataFrame:
    """Adds an array `name` of structs (start, kind, end, value), by start and then kind as in KINDS: all valid base
    matches of column `text`; and one `keys` of the keys. Offsets are code points, the end is exclusive."""
    kinds = [*BASE, "key"]
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs
    for k in kinds:
        has = t.contains("@") if k == "email" else t.rlike(_NEEDS[k])
        out = out.withColumn(f"__q_m_{k}", F.when(has, F.regexp_extract_all(t, F.lit(_PATTERNS[k]), F.lit(0))))
    out = out.withColumns({f"__q_p_{k}": F.when(F.size(f"__q_m_{k}") > 0, F.split(t, _PATTERNS[k], -1)) for k in kinds})
    # starts are sums over all that is before: by blocks, so that long lists of matches stay cheap
    out = out.withColumns({f"__q_l_{k}": _lengths(k) for k in kinds})
    out = out.withColumns({f"__q_b_{k}": F.expr(f"transform(sequence(0, (size(__q_l_{k}) - 1) div {BLOCK}), b -> aggregate(slice(__q_l_{k}, cast(b * {BLOCK} + 1 AS INT), {BLOCK}), 0, (a, x) -> a + x))") for k in kinds})
    out = out.withColumns({f"__q_c_{k}": F.expr(f"if(size(__q_b_{k}) > 0, transform(__q_b_{k}, (x, i) -> aggregate(slice(__q_b_{k}, 1, i), 0, (a, y) -> a + y)), NULL)") for k in kinds})
    found = []
    for k in kinds:
        i = KINDS.index(k)
        end = f"__q_c_{k}[cast(j div {BLOCK} AS INT)] + aggregate(slice(__q_l_{k}, cast(j - j % {BLOCK} + 1 AS INT), cast(j % {BLOCK} + 1 AS INT)), 0, (a, x) -> a + x)"
        spans = F.expr(f"if(size(__q_c_{k}) > 0 AND size(__q_l_{k}) > 0, transform(__q_m_{k}, (m, j) -> struct({end} - length(m) AS start, {i} AS kind, {end} AS end, m AS value)), NULL)")
        found.append(F.coalesce(_kept(spans, k), F.expr("array()").cast("array<struct<start:int,kind:int,end:int,value:string>>")))
    extra = [f"__q_{x}_{k}" for x in "mplbc" for k in kinds]
    return out.withColumns({name: F.sort_array(F.concat(*found[:4])), keys: found[4]}).drop(*extra)


def _lengths(kind: str) -> Column:
    """For each match, its length and that of the piece before it."""
    return F.transform(f"__q_m_{kind}", lambda m, i: F.length(F.get(f"__q_p_{kind}", i)) + F.length(m))


def _kept(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: _valid(kind, x["value"]))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if scratch.fits(df, BROADCAST_ROWS) else df


def _entity(kind: Column, value: Column) -> Column:
    """One name for all formats of a value."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    plain = F.when(kind == 0, F.lower(value)).when(kind == 1, F.regexp_replace(value, r"(?<![0-9])0++(?=[0-9])", "")).when(kind == KINDS.index("key"), value).otherwise(digits)
    return F.concat_ws(":", kind.cast("string"), plain)


def evidence(spanned: DataFrame, spans: str) -> DataFrame:
    """id, th, w0 to w5 of each document with base spans or keys: its weight in each class, in UNITs. It is the largest of its
    values' weights, and a value's weight is one document's, shared by all rows that hold it."""
    # the class is kept in the three lowest bits of the entity's hash
    of = lambda kind: F.when(kind == KINDS.index("key"), 4).otherwise(kind).cast("long")
    name = lambda x: F.xxhash64(_entity(x["kind"], x["value"])).bitwiseAND(F.lit(-8)).bitwiseOR(of(x["kind"]))
    rows = spanned.where(F.size(spans) > 0).select("id", "th", F.transform(spans, name).alias("e"))
    rows = scratch.cut(rows.select("id", "th", F.explode_outer(F.array_distinct("e")).alias("e")), "entities")
    held = scratch.cut(rows.groupBy("e").agg(F.count("*").alias("df")).withColumnRenamed("e", "same"), "held")
    rows = rows.join(_small(held), F.col("e") == F.col("same")).withColumn("w", F.floor(F.lit(UNIT) / F.col("df")))
    kind = F.col("e").bitwiseAND(F.lit(7))
    each = [F.max(F.when(kind == k, F.col("w")).otherwise(0)).alias(f"w{k}") for k in range(CLASSES - 1)]
    return rows.groupBy("id", "th").agg(*each, F.max("w").alias(f"w{CLASSES - 1}"))


def words_of(docs: DataFrame, text: str) -> DataFrame:
    """id, th, w of each row: the distinct terms of its text, lower case, outside of e-mail addresses and keys (no other
    span holds a letter)."""
    t = F.col(text)
    bare = docs.select("id", "th", F.when(t.contains("@"), F.regexp_replace(t, _PATTERNS["email"], " ")).otherwise(t).alias("t"))
    bare = bare.select("id", "th", F.when(F.col("t").rlike(_NEEDS["key"]), F.regexp_replace("t", _PATTERNS["key"], " ")).otherwise(F.col("t")).alias("t"))
    long = bare.select("id", "th", F.filter(F.split("t", r"[^\p{L}]+"), lambda w: F.length(w) >= 4).alias("w"))
    return long.select("id", "th", F.array_distinct("w").alias("w")).select("id", "th", F.transform("w", lambda w: F.lower(w)).alias("w")).select("id", "th", F.array_distinct("w").alias("w"))


def disclosures(docs: DataFrame, text: str, weights: DataFrame, shares: list[float]) -> DataFrame:
    """term, disclosure (the largest of its classes) of each term of the corpus; `weights` are those of `evidence`, and
    `shares` the p(c) of the classes. A document counts by its weight for any class, or as one if it has none."""
    weights = weights.withColumnsRenamed({"id": "__q_id", "th": "__q_th"})
    rows = words_of(docs, text).join(_small(weights), F.col("id").eqNullSafe(F.col("__q_id")) & (F.col("th") == F.col("__q_th")), "left")
    each = [f"w{k}" for k in range(CLASSES)]
    rows = rows.select(*each, F.explode_outer("w").alias("term")).where("term IS NOT NULL")
    counts = rows.groupBy("term").agg(F.sum(F.coalesce(each[-1], F.lit(UNIT))).alias("df"), *[F.sum(F.coalesce(w, F.lit(0))).alias(w) for w in each])
    beside = lambda w: F.greatest(F.col(w) / UNIT - 1, F.lit(0.0))
    told = [F.lit(0.0)]
    for w, p in zip(each, shares, strict=True):
        if 0 < p < 1:
            given = (beside(w) + PRIOR * p) / (beside("df") + PRIOR)
            told.append(F.log(given / p) / -math.log(p))
    return counts.select("term", F.greatest(*told, F.lit(0.0)).alias("disclosure"))


def places_of(docs: DataFrame, text: str) -> DataFrame:
    """id, th, term (lower case), start, end of each term of the texts. Places are summed by blocks, as in base_spans."""
    rows = docs.select("id", "th", F.concat(F.lit(" "), F.col(text), F.lit(" ")).alias("p"))
    rows = rows.select("id", "th", F.regexp_extract_all("p", F.lit(TERM), F.lit(0)).alias("terms"), F.split("p", TERM, -1).alias("gaps")).where(F.size("terms") > 0)
    rows = rows.withColumn("l", F.transform("terms", lambda m, j: F.length(F.get("gaps", j)) + F.length(m))).drop("gaps")
    rows = rows.withColumn("b", F.expr(f"transform(sequence(0, (size(l) - 1) div {BLOCK}), b -> aggregate(slice(l, cast(b * {BLOCK} + 1 AS INT), {BLOCK}), 0, (a, x) -> a + x))"))
    rows = rows.withColumn("c", F.expr("transform(b, (x, i) -> aggregate(slice(b, 1, i), 0, (a, y) -> a + y))"))
    end = f"c[cast(j div {BLOCK} AS INT)] + aggregate(slice(l, cast(j - j % {BLOCK} + 1 AS INT), cast(j % {BLOCK} + 1 AS INT)), 0, (a, x) -> a + x) - 1"
    rows = rows.select("id", "th", F.explode_outer(F.expr(f"transform(terms, (m, j) -> struct(lower(m) AS term, {end} AS end, length(m) AS n))")).alias("y"))
    return rows.select("id", "th", "y.term", (F.col("y.end") - F.col("y.n")).alias("start"), "y.end")


def find(docs: DataFrame, doc: str = "doc_id", text: str = "text", remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, th (the text's hash), base and added of each row: arrays of structs (start, kind, end), kind by its place
    in KINDS; added, the keys and the telling terms, has the action (remove or generalise) too. Keys are removed.

    A null or empty text has no spans. Very long texts are handled whole, in time linear in their length. Every row
    counts in the corpus and gets its spans, repeated rows too, but rows that hold the same value share one document's
    weight. A null doc_id counts by its text. An empty table gives an empty one. Input columns other than the two are
    ignored. A term of which a base span or a key covers a part is not added.
    """
    source = docs.select(docs[doc].alias("id"), F.coalesce(docs[text], F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    spanned = base_spans(source, "t", "spans", "keys")
    bare = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    found = F.transform("keys", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit("remove").alias("action")))
    kept = scratch.cut(spanned.select("id", "th", bare.alias("base"), F.concat("spans", "keys").alias("spans"), found.alias("keys")), "spans")
    weights = scratch.cut(evidence(kept, "spans"), "evidence")
    mine = weights.withColumnsRenamed({"id": "__q_id", "th": "__q_th"})
    same = F.col("id").eqNullSafe(F.col("__q_id")) & (F.col("th") == F.col("__q_th"))
    sums = kept.where(F.size("spans") > 0).select("id", "th").join(_small(mine), same).agg(*[F.sum(f"w{k}") for k in range(CLASSES)]).first()
    total = kept.where(F.size("spans") == 0).count() + (sums[-1] or 0) / UNIT
    shares = [(s or 0) / UNIT / max(total, 1) for s in sums]
    telling = disclosures(source, "t", weights, shares).where(F.col("disclosure") >= generalise)
    telling = scratch.cut(telling.select(F.col("term").alias("__q_t"), F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action")), "disclosing")
    # only texts that hold such a term are walked term by term
    holding = words_of(source, "t").select("id", "th", F.explode_outer("w").alias("term")).join(_small(telling), F.col("term") == F.col("__q_t"), "left_semi")
    holding = scratch.cut(holding.select(F.col("id").alias("__q_id"), F.col("th").alias("__q_th")).distinct(), "holding")
    texts = source.join(_small(holding), same, "left_semi").dropDuplicates(["id", "th"])
    told = places_of(texts, "t").join(_small(telling), F.col("term") == F.col("__q_t")).select("id", "th", "start", "end", "action")
    told = told.groupBy("id", "th").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "action")).alias("added"))
    told = scratch.cut(told.select(F.col("id").alias("__q_id"), F.col("th").alias("__q_th"), "added"), "added")
    out = kept.select("id", "th", "base", "keys").join(_small(told), same, "left").select("id", "th", "base", "keys", "added")
    none = F.expr("array()").cast("array<struct<start:int,kind:int,end:int,action:string>>")
    overlaps = lambda spans, y: F.exists(spans, lambda x: (x["start"] < y["end"]) & (x["end"] > y["start"]))
    free = F.filter("added", lambda y: ~overlaps("base", y) & ~overlaps("keys", y))
    return out.select(F.col("id").alias(doc), "th", "base", F.sort_array(F.concat("keys", F.coalesce(free, none))).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def all_spans() -> Column:
    """Base and added spans of `find` in one array, by start and kind."""
    bare = F.transform("added", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.sort_array(F.concat("base", bare))


def sanitise(docs: DataFrame, found: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with each base span replaced by its kind as a tag, like [EMAIL], generalised terms by [TERM], and removed
    terms cut out. A span that begins within another one goes with it. Null texts stay null."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in BASE])
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(tags, x["kind"]).alias("tag")))
    added = F.transform("added", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["action"] == "remove", "").otherwise("[TERM]").alias("tag")))
    cuts = found.select(F.col(doc).alias("__q_id"), F.col("th").alias("__q_th"), F.sort_array(F.concat(base, added)).alias("__q_cuts")).where(F.size("__q_cuts") > 0).dropDuplicates(["__q_id", "__q_th"])
    both = docs.join(cuts, docs[doc].eqNullSafe(F.col("__q_id")) & (F.xxhash64(docs[text]) == F.col("__q_th")), "left")
    t = docs[text]
    begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        piece = F.concat(a["done"], F.substring(t, a["at"] + 1, x["start"] - a["at"]), x["tag"])
        inside = x["start"] < a["at"]
        return F.struct(F.when(inside, a["done"]).otherwise(piece).alias("done"), F.when(inside, F.greatest(a["at"], x["end"])).otherwise(x["end"]).alias("at"))

    clean = F.aggregate("__q_cuts", begin, step, lambda a: F.concat(a["done"], F.substring(t, a["at"] + 1, F.length(t))))
    return both.select(*[F.when(F.col("__q_cuts").isNull(), t).otherwise(clean).alias(c) if c == text else docs[c] for c in docs.columns])
