"""Synthetic transactions with known truth, and injected defects with a log of each.

Every choice is a hash of the row's number and a salt, so results don't depend on partitions and repeat exactly.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import cleaning
from quern.plans import scratch
from quern.sources import reference

RATES = {"near": 0.015, "copies": 0.01, "outliers": 0.002, "impossible": 0.001, "parens": 0.02, "usd": 0.12, "no_currency": 0.15, "no_mcc": 0.25, "sentinels": 0.08, "drift": 0.0005}
#: Mean and spread of the logarithm of amounts, for two of three categories by rule; the others take FALLBACK.
AMOUNTS = {category: (4.5 + int(code) * 7 % 40 / 10, 0.3 + int(code) * 3 % 8 / 10) for code, category, _ in reference.MCC if int(code) % 3}
FALLBACK = (6.25, 0.75)
#: By group: the hours around which transactions lie, as (mean, spread, share).
HOURS = {"Food": [(9, 2, 0.5), (19, 2, 0.5)], "Retail": [(15, 3, 1.0)], "Travel": [(8, 2, 0.6), (18, 3, 0.4)], "Home": [(13, 4, 1.0)], "Services": [(12, 4, 1.0)]}
NAMES = [f"{a} {b}" for b in ("Lane", "Corner", "Works", "Market", "Supply", "Trading", "House", "Rooms", "Yard", "Grove") for a in ("Amber", "Birch", "Cedar", "Delta", "Elm", "Fern", "Granite", "Harbor", "Indigo", "Juniper", "Kestrel", "Lantern")]
#: Cities with their codes; spellings are a table made from these.
CITIES = {"Ashford": "ASH", "Brookvale": "BRK", "Clearwater": "CLW", "Dunmore": "DNM", "Eastport": "EPT", "Fairhaven": "FHV", "Glenbrook": "GLB", "Highgate": "HGT", "Ironbridge": "IRB", "Jasper Falls": "JSP", "Kingsmead": "KGM", "Lakeside": "LKS"}
VARIANTS = {c: [c, c.upper(), c.lower(), f" {c}", code, f"{c} City", c.replace("o", "oo", 1), c[:4] + c[5:]] for c, code in CITIES.items()}
STATES = re.findall(r"[A-Z]{2}", next(p for p, _ in cleaning.DESCRIPTOR_RULES if "NY" in p))
#: What stands before names: of every prefix that tier 0 takes off, its forms with a star.
PREFIXES = [f"{name}{star}" for name in re.findall(r"[A-Z]{2,}", next(p for p, _ in cleaning.DESCRIPTOR_RULES if "PAYPAL" in p)) for star in (" *", "* ", "*")]
END = "2024-12-31 23:59:59"
MONTHS = 18
SPAN = 1 << 40


def drawn(salt: str, key: str = "i") -> Column:
    """A whole number below SPAN for each row."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(SPAN))


def uniform(salt: str, key: str = "i") -> Column:
    """A number in [0, 1) for each row."""
    return drawn(salt, key) / float(SPAN)


def smallest(rows: DataFrame, counts: dict[str, int]) -> dict[str, int]:
    """For each salt the number up to which `drawn` is in as many rows as `counts` says: ten bits a round, so that each
    round brings 1,024 counts for a salt to the driver, whatever the number of rows."""
    found = dict.fromkeys(counts, 0)
    left = dict(counts)
    for shift in (30, 20, 10, 0):
        each = F.array(*[F.struct(F.lit(s).alias("s"), F.when(F.shiftright(drawn(s), shift + 10) == (found[s] >> shift + 10), F.shiftright(drawn(s), shift).bitwiseAND(F.lit(1023))).alias("d")) for s in counts])
        bins: dict[str, dict[int, int]] = {s: {} for s in counts}
        for r in rows.select(F.explode(each).alias("x")).select("x.*").where("d IS NOT NULL").groupBy("s", "d").count().collect():
            bins[r.s][r.d] = r["count"]
        for s, by in bins.items():
            digit = 0
            for digit in sorted(by):
                if left[s] <= by[digit]:
                    break
                left[s] -= by[digit]
            found[s] |= digit << shift
    return found


def normal(salt: str) -> Column:
    return F.sqrt(-2 * F.log(uniform(salt + "a") + 1e-12)) * F.cos(2 * math.pi * uniform(salt + "b"))


def pick(values: list, salt: str, weights: list[float] | None = None) -> Column:
    """A value for each row, with equal chances or the given ones."""
    weights = weights or [1.0] * len(values)
    ends = [sum(weights[: i + 1]) / sum(weights) for i in range(len(values) - 1)]
    place = F.size(F.filter(F.array(*[F.lit(x) for x in ends]), lambda x: x <= uniform(salt))) if ends else F.lit(0)
    return F.get(F.array(*[F.lit(v) for v in values]), place)


def truth(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """Clean transactions; of `rows` raw ones, as many as leave room for near-duplicates and copies."""
    n = round(rows / (1 + RATES["near"] + RATES["copies"]))
    s = lambda x: f"{seed}{x}"
    df = spark.range(n).select(F.col("id").alias("i"))
    df = df.withColumn("merchant_name", pick(NAMES, s("merchant"), [1 / (k + 1) for k in range(len(NAMES))]))
    place = F.array_position(F.array(*[F.lit(x) for x in NAMES]), F.col("merchant_name")).cast("int")
    kinds = [(code, category, group, *AMOUNTS.get(category, FALLBACK)) for code, category, group in reference.MCC]
    by = lambda k: F.get(F.array(*[F.lit(x[k]) for x in kinds]), F.pmod(place, F.lit(len(kinds))).cast("int"))
    df = df.withColumns({"merchant_id": F.concat(F.lit("M"), F.lpad(place.cast("string"), 3, "0")), "mcc": by(0), "merchant_category": by(1), "__g": by(2), "__mu": by(3), "__sigma": by(4)})
    hour = F.lit(12.0)
    for g, parts in HOURS.items():
        mean, spread = F.lit(float(parts[-1][0])), F.lit(float(parts[-1][1]))
        if len(parts) > 1:
            first = uniform(s("part")) < parts[0][2]
            mean, spread = F.when(first, float(parts[0][0])).otherwise(mean), F.when(first, float(parts[0][1])).otherwise(spread)
        hour = F.when(F.col("__g") == g, mean + spread * normal(s("hour"))).otherwise(hour)
    day = F.floor(uniform(s("day")) * MONTHS * 30)
    second = F.floor(F.least(F.greatest(F.round(hour), F.lit(0.0)), F.lit(23.0)) * 3600 + uniform(s("sec")) * 3600)
    start = F.date_trunc("day", F.to_timestamp(F.lit(END))) - F.expr(f"INTERVAL {MONTHS * 30 - 1} DAYS")
    df = df.withColumn("txn_timestamp", F.timestamp_seconds(F.unix_timestamp(start) + day * 86400 + second).cast("timestamp_ntz"))
    usd = uniform(s("usd")) < RATES["usd"]
    base = F.exp(F.col("__mu") + F.col("__sigma") * normal(s("amount")))
    df = df.withColumns({"amount_inr": F.round(base, 2), "currency": F.when(usd, "USD").otherwise("INR"), "country": F.when(usd, "US").otherwise("IN")})
    df = df.withColumn("amount", F.round(F.when(usd, F.col("amount_inr") / 83.25).otherwise(F.col("amount_inr")), 2))
    df = df.withColumns(
        {
            "transaction_id": F.regexp_replace(F.substring(F.sha2(F.concat_ws("-", F.lit(str(seed)), "i"), 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
            "account_id": F.format_string("ACC-%05d", F.floor(uniform(s("account")) * 5000)),
            "city": pick(list(CITIES), s("city")),
            "channel": F.when(F.col("__g") == "Travel", pick(["ONLINE", "POS"], s("channel"), [0.7, 0.3])).otherwise(pick(["POS", "ONLINE", "ATM"], s("channel"), [0.6, 0.35, 0.05])),
            "status": pick(["APPROVED", "DECLINED", "REVERSED"], s("status"), [0.95, 0.04, 0.01]),
        }
    )
    return df.drop("__g", "__mu", "__sigma")


def transforms(seed: str) -> list[tuple[str, object]]:
    """The twelve ways to spoil a descriptor: name and Column -> Column."""
    number = lambda x, lo, hi: (F.floor(uniform(seed + x) * (hi - lo)) + lo).cast("string")
    return [
        ("aggregator_prefix", lambda c: F.concat(pick(PREFIXES, seed + "agg"), c)),
        ("truncate", lambda c: F.substring(c, F.lit(1), (F.floor(uniform(seed + "cut") * 9) + 12).cast("int"))),
        ("uppercase", F.upper),
        ("lowercase", F.lower),
        ("drop_vowels", lambda c: F.array_join(F.transform(F.split(c, " "), lambda w: F.when(F.length(w) > 5, F.concat(F.substring(w, 1, 1), F.regexp_replace(F.substring(w, 2, 100), "[aeiouAEIOU]", ""))).otherwise(w)), " ")),
        ("store_number", lambda c: F.concat(c, F.lit(" #"), number("store", 100, 999999))),
        ("phone", lambda c: F.concat(c, F.lit(" 9"), F.lpad(number("phone", 0, 999999999), 9, "0"))),
        ("city", lambda c: F.concat(c, F.lit(" "), F.upper("city"))),
        ("state_code", lambda c: F.concat(c, F.lit(" "), pick(STATES, seed + "state"))),
        ("collapse_spaces", lambda c: F.replace(c, F.lit(" "), F.lit(""))),
        ("url", lambda c: F.concat(F.lower(F.replace(c, F.lit(" "), F.lit(""))), F.lit(".com"))),
        ("unicode_junk", lambda c: F.concat(pick(["​", " ", "™ "], seed + "junk"), c)),
    ]


def spoil_descriptor(df: DataFrame, seed: str = "42") -> DataFrame:
    """merchant_descriptor by one to three different transforms of merchant_name, and their names in __transforms."""
    ways = transforms(seed)
    ranks = F.array(*[F.xxhash64(F.col("i"), F.lit(seed + name)) for name, _ in ways])
    df = df.withColumn("__cut", F.get(F.sort_array(ranks), F.floor(uniform(seed + "ways") * 3).cast("int")))
    text, used = F.col("merchant_name"), []
    df = df.withColumn("merchant_descriptor", text)
    for name, way in ways:
        chosen = F.xxhash64(F.col("i"), F.lit(seed + name)) <= F.col("__cut")
        df = df.withColumn("merchant_descriptor", F.when(chosen, way(F.col("merchant_descriptor"))).otherwise(F.col("merchant_descriptor")))
        used.append(F.when(chosen, name))
    return df.withColumn("__transforms", F.array_compact(F.array(*used))).drop("__cut")


def amount_text(amount: Column, currency: Column, parens: Column, seed: str = "42") -> Column:
    """An amount in one of eight styles, or of three with parentheses."""
    two, plain, whole = F.format_number(amount, 2), F.replace(F.format_number(amount, 2), F.lit(","), F.lit("")), F.format_number(F.floor(amount).cast("double"), 0)
    sign = F.when(currency == "USD", "$").otherwise("₹")
    styles = [plain, two, F.concat(sign, two), F.concat(sign, F.lit(" "), two), F.concat(two, F.lit(" "), sign), F.concat(F.lit(" "), plain, F.lit(" ")), F.concat(currency, F.lit(" "), two), whole]
    wrapped = [F.concat(F.lit("("), x, F.lit(")")) for x in (two, plain, F.concat(sign, two))]
    return F.when(parens, F.get(F.array(*wrapped), F.floor(uniform(seed + "wrap") * 3).cast("int"))).otherwise(F.get(F.array(*styles), F.floor(uniform(seed + "style") * 8).cast("int")))


def date_text(t: Column, seed: str = "42") -> Column:
    formats = ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "MM-dd-yyyy HH:mm:ss", "dd MMM yyyy HH:mm", "yyyyMMdd'T'HHmmss"]
    texts = [F.date_format(t, f) for f in formats] + [F.unix_timestamp(t.cast("timestamp")).cast("string")]
    return F.get(F.array(*texts), F.floor(uniform(seed + "format") * 6).cast("int"))


def corrupt(clean: DataFrame, seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """(raw all-string rows in shuffled order, log of defects: transaction_id, defect_type, defect_detail).

    Each kind of defect hits its rate of the rows, and one row at least: those of the smallest draws.
    """
    share = lambda name, n: max(round(RATES[name] * n), 1)
    n = clean.count()
    most = smallest(clean, {seed + x: share(x, n) for x in ("near", "outliers")})
    hit = lambda name: drawn(seed + name) <= most[seed + name]
    near = clean.where(hit("near")).withColumns({"transaction_id": F.concat("transaction_id", F.lit("-N")), "i": F.col("i") + (1 << 50), "txn_timestamp": F.expr("txn_timestamp + make_dt_interval(0, 0, 0, 1 + pmod(xxhash64(i, 'gap'), 120))")})
    near = near.withColumn("__near", F.lit(True))
    rows = clean.withColumn("__near", F.lit(False)).withColumn("__outlier", hit("outliers"))
    rows = rows.withColumn("amount", F.when(F.col("__outlier"), F.col("amount") * 100).otherwise(F.col("amount"))).unionByName(near.withColumn("__outlier", F.lit(False)))
    kinds = ("impossible", "parens", "no_currency", "no_mcc", "sentinels", "drift", "copies")
    most |= smallest(rows.select("i"), {seed + x: share(x, n + share("near", n)) for x in kinds})
    rows = spoil_descriptor(rows, seed)
    flags = {"__impossible": hit("impossible"), "__parens": hit("parens"), "__no_currency": hit("no_currency"), "__no_mcc": hit("no_mcc"), "__sentinel": hit("sentinels"), "__drift": hit("drift"), "__copy": hit("copies")}
    # cut here: filters over the result would else be moved below twelve nested steps and double at each
    rows = scratch.cut(rows.withColumns(flags), "synthetic")
    token, place = pick(["NA", "N/A", "-", "NULL", "null", "None", "none", "-999"], seed + "token"), F.floor(uniform(seed + "where") * 6)
    spoiled = lambda k, c: F.when(F.col("__sentinel") & ((place == k) | ((uniform(seed + "second") < 0.5) & (F.pmod(place + 1, F.lit(6)) == k))), token).otherwise(c)
    city, d = F.col("city"), F.col("merchant_descriptor")
    country = F.when(F.col("country") == "IN", pick(["IN", "India", "IND", "in"], seed + "country")).otherwise(pick(["US", "USA"], seed + "country"))
    channel = F.when(F.col("channel") == "ONLINE", pick(["ONLINE", "online", "e-comm"], seed + "ch")).otherwise(F.when(uniform(seed + "ch") < 0.5, F.lower("channel")).otherwise(F.col("channel")))
    account = pick([0, 1, 2, 3], seed + "acct")
    spellings = F.create_map(*[x for c, forms in VARIANTS.items() for x in (F.lit(c), F.array(*[F.lit(f) for f in forms]))])
    raw = rows.select(
        "transaction_id",
        spoiled(0, F.when(account == 1, F.lower("account_id")).when(account == 2, F.concat("account_id", F.lit(" "))).when(account == 3, F.concat(F.lit(" "), "account_id")).otherwise(F.col("account_id"))).alias("account_id"),
        F.when(F.col("__impossible"), pick(["2030-06-15 12:00:00", "1900-01-01 00:00:00"], seed + "imp")).otherwise(date_text(F.col("txn_timestamp"), seed)).alias("txn_timestamp"),
        amount_text(F.col("amount"), F.col("currency"), F.col("__parens"), seed).alias("amount"),
        F.when(F.col("__no_currency"), "").otherwise(F.col("currency")).alias("currency"),
        F.when(F.col("__drift") & (F.length(d) > 3), F.concat(F.substring(d, 1, 3), F.lit(","), F.substring(d, 4, 200))).otherwise(d).alias("merchant_descriptor"),
        F.when(F.col("__no_mcc"), pick(["", "0000", "NA", "N/A"], seed + "nomcc")).otherwise(spoiled(1, F.col("mcc"))).alias("mcc"),
        spoiled(2, F.get(F.element_at(spellings, city), F.floor(uniform(seed + "spell") * 8).cast("int"))).alias("city"),
        spoiled(3, country).alias("country"), spoiled(4, channel).alias("channel"), spoiled(5, F.col("status")).alias("status"), "__copy", "i",
    )
    raw = scratch.cut(raw, "raw")
    raw = raw.unionByName(raw.where("__copy")).orderBy(F.xxhash64("i", F.lit(seed + "shuffle"))).drop("__copy", "i")
    entry = lambda flag, kind, detail: F.when(F.col(flag), F.struct(F.lit(kind).alias("t"), detail.cast("string").alias("d")))
    entries = F.array_compact(
        F.array(
            entry("__near", "near_duplicate", F.col("txn_timestamp")), entry("__outlier", "extreme_outlier", F.col("amount")), entry("__impossible", "impossible_date", F.lit("")), entry("__parens", "paren_negative", F.col("amount")),
            entry("__no_currency", "missing_currency", F.col("currency")), entry("__no_mcc", "missing_mcc", F.col("mcc")), entry("__sentinel", "sentinel_null", token), entry("__drift", "schema_drift", F.lit("")), entry("__copy", "exact_duplicate", F.lit("")),
            F.struct(F.lit("descriptor").alias("t"), F.array_join("__transforms", ",").alias("d")), F.struct(F.lit("date_format").alias("t"), F.lit("").alias("d")),
        )
    )
    log = rows.select("transaction_id", F.explode(entries).alias("e")).select("transaction_id", F.col("e.t").alias("defect_type"), F.col("e.d").alias("defect_detail"))
    return raw, log
