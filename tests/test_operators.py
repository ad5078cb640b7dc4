"""Frame operators on small fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from quern.operators import clean, cluster, contracts, gold, metrics, quality, resolve, synth
from quern.operators.components import components
from quern.plans import silver
from quern.sources import reference, transactions

T0 = datetime.datetime(2024, 1, 1, 12)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def test_near_duplicates(spark):
    rows = [("a", "x", "m", 1.0, 0), ("b", "x", "m", 1.0, 120), ("c", "x", "m", 1.0, 241), ("d", None, "m", 1.0, 0), ("e", None, "m", 1.0, 1), ("f", "y", "m", 1.0, 0), ("g", "y", "m", 1.0, 0), ("h", "z", "m", 1.0, 0), ("i", "z", "m", 1.0, 90), ("j", "z", "m", 1.0, 180)]
    df = spark.createDataFrame([(*r[:4], at(r[4])) for r in rows], "transaction_id string, account_id string, merchant_id string, amount_inr double, txn_timestamp timestamp_ntz")
    got = {r.transaction_id for r in quality.flag_near(df).where("is_near_duplicate").collect()}
    assert got == set("abfghij")


def test_exact_copies(spark):
    df = spark.createDataFrame([("1", "x", None), ("2", "x", None), ("3", "y", 1)], "transaction_id string, city string, n int")
    assert [r.transaction_id for r in quality.dropped_copies(df).collect()] == ["2"]
    assert quality.drop_copies(df).count() == 2 and quality.drop_copies(df.limit(0)).count() == 0


def test_outliers(spark):
    rows = [("a", 10.0), ("a", 10.0), ("a", 10.0), ("a", 15.1), ("a", 15.2), ("a", -900.0), (None, 1e9)]
    got = quality.flag_outliers(spark.createDataFrame(rows, "mcc string, amount_inr double")).where("is_outlier").collect()
    # median 10, absolute deviations 0, 0, 0, 5.1, 5.2: a MAD of 0 counts as 1, so the limit is 10 + 3.5 / 0.6745 = 15.19
    assert [r.amount_inr for r in got] == [15.2]
    flat = spark.createDataFrame([("a", 10.0)] * 5 + [("a", 20.0)], "mcc string, amount_inr double")
    assert [r.amount_inr for r in quality.flag_outliers(flat).where("is_outlier").collect()] == [20.0]  # a MAD of 0 counts as 1


def test_contracts(spark):
    df = spark.createDataFrame([("", "2030-01-01", "a,b"), ("1", None, None), ("2", "01/01/2030", "x")], "transaction_id string, txn_timestamp string, merchant_descriptor string")
    rows = contracts.judged(df, contracts.bronze())
    assert {r.reject_reason for r in rows.collect()} == {"Empty transaction_id | impossible_date | schema_drift", None}
    assert contracts.conservation(rows).first() == (3, 2, 1)
    with pytest.raises(ValueError):
        contracts.judged(df.drop("transaction_id"), contracts.bronze(), strict=True)
    assert [r.reject_reason for r in contracts.judged(df.drop("transaction_id"), contracts.bronze()).collect()] == ["impossible_date | schema_drift", None, None]
    silver_rows = spark.createDataFrame([("1", "m", -1.0, 1.0, T0, None), ("2", "m", -1.0, 0.0, T0, "APPROVED"), ("3", None, 5.0, 1.5, T0, "APPROVED")], "transaction_id string, merchant_id string, amount_inr double, match_confidence double, txn_timestamp timestamp_ntz, status string")
    reasons = {r.transaction_id: r.reject_reason for r in contracts.judged(silver_rows, contracts.silver()).collect()}
    assert reasons == {"1": None, "2": "amount_inr_lte_zero_for_approved", "3": "Confidence out of bounds | not_nullable_merchant_id"}


def test_tiers_and_imputation(spark):
    words = spark.createDataFrame([("M1", "Blue Cafe", "BLUE CAFE", 1), ("M2", "Red Barn", "RED BARN", 2)], "merchant_id string, canonical_name string, alias string, position int")
    texts = ["BLUE CAFE", "SQ *BLUE CAFE", "BLUE CAFE DOWNTOWN", "RED BARM", "ZORBLATT GOODS A", "ZORBLATT GOODS B", "ZORBLATT GOODS C", "ZORBLATT GOODS C", "QXJ", "", None]
    df = spark.createDataFrame([(str(i), t, "5001" if i == 0 else None) for i, t in enumerate(texts)], "transaction_id string, merchant_descriptor string, mcc string")
    got = {r.transaction_id: r for r in resolve.impute_mcc(resolve.merchants(df, words)).collect()}
    assert [got[str(i)].match_method for i in range(11)] == ["exact", "exact", "fuzzy", "fuzzy" if got["3"].match_confidence >= 0.88 else "unresolved", "cluster", "cluster", "cluster", "cluster", "unresolved", None, None]
    assert got["2"].match_confidence == 1.0 and got["4"].merchant_name == "ZORBLATT GOODS C" and got["8"].merchant_id is None and got["8"].merchant_name == "QXJ"
    assert got["1"].mcc == "5001" and got["1"].mcc_imputed_flag and not got["0"].mcc_imputed_flag and got["8"].mcc == "9999"


def plain_clusters(texts, eps=0.35, least=3):
    """Weights, neighbours, cores and components in plain Python."""
    import math
    from collections import Counter

    bags = []
    for t in texts:
        bag = Counter()
        for w in t.lower().split():
            w = f" {w} "
            for n in (2, 3, 4):
                bag.update(w[i : i + n] for i in range(max(1, len(w) - n + 1)))
                if len(w) <= n:
                    break
        bags.append(bag)
    df = Counter(g for b in bags for g in b)
    vectors = []
    for b in bags:
        v = {g: n * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({g: x / norm for g, x in v.items()})
    near = [[j for j in range(len(texts)) if j == i or sum(x * vectors[j].get(g, 0) for g, x in vectors[i].items()) >= 1 - eps] for i in range(len(texts))]
    core = [len(n) >= least for n in near]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in near[i]:
                if core[i] and core[j]:
                    root[i] = root[j] = min(root[i], root[j])
    out = {t: root[i] for i, t in enumerate(texts) if core[i]}
    for i, t in enumerate(texts):
        cores = [texts[j] for j in near[i] if core[j]]
        if not core[i] and cores:
            out[t] = out[min(cores)]
    groups = {}
    for t, r in out.items():
        groups.setdefault(r, set()).add(t)
    return sorted(map(sorted, groups.values()))


def test_candidates_lose_no_match():
    import random

    from quern.functions.similarity import Candidates, best_match, token_set_ratio

    rng = random.Random(3)
    words = ["BLUE", "CAFE", "RED", "BARN", "ORBIT", "STORES", "INDIA", "AB", "C", "STARBUCKS", "MERIDIAN"]
    choices = [" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(150)]
    for least in (70.0, 88.0):
        index = Candidates(choices, least)
        for _ in range(1500):
            text = list(rng.choice(choices))
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(text) + 1)
                text[at : at + rng.randint(0, 1)] = rng.choice(["", "X", "A", "E"])
            text = "".join(text)
            assert best_match(text, choices, token_set_ratio, least) == best_match(text, choices, token_set_ratio, least, index.of(text)), text


def test_job(spark, tmp_path):
    from quern import job

    out = f"file://{tmp_path}"
    reference.write_lists(spark, f"{out}/lists", "/root/testdata/sf0.001")
    transactions.from_orders(spark, "/root/testdata/sf0.001").write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{out}/raw")
    (tmp_path / "job.toml").write_text(f"[paths]\nraw = '{out}/raw'\nreference = '{out}/lists'\nout = '{out}/out'\nlog = '{tmp_path}/job.log'\n[options]\ntiers = ['exact']\nfuzzy_cities = false\n")
    tables = job.run(spark, job.load(str(tmp_path / "job.toml")))
    assert spark.table("fct_transactions").count() == tables["fct_transactions"].count() == spark.read.parquet(f"{out}/out/silver").count() > 0
    log = (tmp_path / "job.log").read_text()
    assert all(f"{gate}: " in log for gate in ("raw", "bronze", "parse", "copies", "silver")) and "sentinels in city: " in log
    assert (tmp_path / "out/reports/scorecard.json").exists() and spark.table("v_category_mix").count() > 0
    lists = reference.read_lists(spark, f"{out}/lists")
    assert lists.merchants.groupBy("merchant_id").count().where("count <> 3").count() == 0 and lists.merchants.agg(F.countDistinct("position")).first()[0] == lists.merchants.count()
    with pytest.raises(RuntimeError):
        job.check({"raw": (3, 3, 0), "bronze": (2, 2, 0), "parse": (2, 2, 0), "copies": (2, 2, 0), "silver": (2, 2, 0)})
    (tmp_path / "bad.toml").write_text("[paths]\nraw = 'x'\n")
    with pytest.raises(ValueError):
        job.load(str(tmp_path / "bad.toml"))


def test_each_defect_hits_its_share(spark):
    rows = spark.range(5000).select(F.col("id").alias("i"))
    limits = synth.smallest(rows, {"a": 1, "b": 250, "c": 5000})
    assert [rows.where(synth.drawn(s) <= limits[s]).count() for s in "abc"] == [1, 250, 5000]


def test_clusters_by_brute_force(spark):
    texts = [f"ORBITAL COFFEEHOUSE {a}{b}" for a in "ABC" for b in "XY"] + ["LONE WOLF", "PINE TREE SHOP", "PINE TREE SHOPS", "PINETREE SHOPS", "A", "ORBITAL HOUSE"]
    got = {}
    for r in cluster.density_clusters(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect():
        got.setdefault(r.cluster, []).append(r.t)
    want = plain_clusters(texts)
    assert sorted(map(sorted, got.values())) == want and want


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 6), (7, None), (10, 9), (9, 8), (8, 11), (11, 3)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 1, 9: 1, 10: 1, 11: 1}


def test_cities(spark):
    names = spark.createDataFrame([("Mumbai",), ("Delhi",)], "canonical_city string")
    df = spark.createDataFrame([("MUMBAI ",), ("mumbay",), ("Paris",), ("",), (None,)], "city string")
    assert [r.city_canonical for r in clean.cities(df, names).collect()].count("Mumbai") == 2
    assert sorted(r.city_canonical for r in clean.cities(df, names).collect()) == ["", "", "Mumbai", "Mumbai", "Paris"]


def test_fan_out_of_the_dimension(spark):
    df = spark.createDataFrame([("1", "m", "M", "5001", 10.0), ("2", "m", "M", "5002", 5.0)], "transaction_id string, merchant_id string, merchant_name string, mcc string, amount_inr double")
    codes = reference.mcc_map(spark)
    assert gold.dim_merchant(df, codes).count() == 2 and gold.dim_merchant_unique(df, codes).first().mcc == "5001"


def test_views_of_nothing(spark):
    raw = spark.createDataFrame([], transactions.SCHEMA)
    names = spark.createDataFrame([], "canonical_city string")
    words = spark.createDataFrame([], "merchant_id string, canonical_name string, alias string, position int")
    got = silver.run(raw, words, reference.fx_rates(spark), names)
    fct = gold.fact(got.silver)
    assert gold.duplicate_exposure(fct).first() == (0, None) and gold.top_merchants(fct, gold.dim_merchant(got.silver, reference.mcc_map(spark))).count() == 0
    assert metrics.accuracy(fct, fct).first().f1 == 0.0


def test_generator_and_conservation(spark, tmp_path):
    clean_rows = synth.truth(spark, 3000)
    raw, log = synth.corrupt(clean_rows)
    assert clean_rows.select("transaction_id").distinct().count() == clean_rows.count() == round(3000 / 1.025)
    kinds = {r.defect_type for r in log.select("defect_type").distinct().collect()}
    assert {"near_duplicate", "exact_duplicate", "missing_mcc", "sentinel_null", "descriptor", "date_format"} <= kinds
    raw = transactions.blank_missing(raw)
    words = clean_rows.select("merchant_id", F.col("merchant_name").alias("canonical_name"), F.upper("merchant_name").alias("alias"), F.expr("CAST(substr(merchant_id, 2) AS INT) AS position")).distinct()
    names = clean_rows.select(F.col("city").alias("canonical_city")).distinct()
    got = silver.run(raw, words, reference.fx_rates(spark), names)
    gone = contracts.rejected(got.bronze).count() + contracts.rejected(got.parsed).count() + contracts.rejected(got.checked).count() + got.dropped.count()
    assert got.silver.count() + gone == raw.count()
    both = got.silver.join(clean_rows.select("transaction_id", F.col("merchant_id").alias("true_id")), "transaction_id")
    assert both.where("merchant_id = true_id").count() / both.count() > 0.85
    silver.write(spark, got, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/silver").count() == got.silver.count()


def test_amounts_row_by_row_agree(spark):
    rows = ["1,234.50", "(12.5)", "₹ 7", "$3", "-999", "", None, "abc", "5 ₹", "(1,0.5)"]
    df = spark.createDataFrame([(r,) for r in rows], "amount string")
    told = metrics.amount_benchmark(df, 1)
    assert told["rows"] == len(rows) and told["expression_seconds"] > 0
    from quern.functions import cleaning

    assert [r[0] for r in df.select(cleaning.parse_amount(F.col("amount"))).collect()] == [metrics._plain_amount(r) for r in rows]
