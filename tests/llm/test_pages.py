"""URL filters and WARC archives."""

import base64
import gzip
import hashlib
import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quern.llm import catalog, oracles, urls, warc


def plain_models(labelled):
    """Per class, P(char | context) with Witten-Bell back-off, in plain Python."""
    out = {}
    for ok in (True, False):
        n, kinds = Counter(), defaultdict(set)
        for text, label in labelled:
            if label == ok:
                p = urls.BEGIN * urls.ORDER + text + urls.END
                for i in range(urls.ORDER, len(p)):
                    for k in range(urls.ORDER + 1):
                        n[p[i - k : i + 1]] += 1
                        n[p[i - k : i], None] += 1
                        kinds[p[i - k : i]].add(p[i])

        out[ok] = plain_probability(n, kinds)
    return out


def plain_probability(n, kinds):
    def prob(c, context):
        below = prob(c, context[1:]) if context else 1 / urls.ALPHABET
        total, t = n[context, None], len(kinds[context])
        return (n[context + c] + t * below) / (total + t) if total else below

    return prob


def test_scores_equal_the_plain_models(spark):
    rng = random.Random(2)
    labelled = [(f"{rng.choice(['good', 'fine', 'news'])}{rng.randrange(30)}.example.com/a", True) for _ in range(40)] + [(f"{rng.choice(['cheap', 'pills', 'bets'])}{rng.randrange(30)}.example.net/b", False) for _ in range(30)]
    rows = [(t, n, ok) for (t, ok), n in Counter(labelled).items()]
    weights = urls.model(spark.createDataFrame(rows, "s string, n long, ok boolean"))
    probe = ["good1.example.org/x", "cheap-pills.example.org/y", "", "zzzé", labelled[0][0]]
    got = {r.s: r.score for r in urls.score(spark.createDataFrame([(p,) for p in probe], "s string"), weights).collect()}
    models = plain_models(labelled)
    for p in probe:
        padded = urls.BEGIN * urls.ORDER + p + urls.END
        logs = sum(math.log(models[True](padded[i], padded[i - urls.ORDER : i]) / models[False](padded[i], padded[i - urls.ORDER : i])) for i in range(urls.ORDER, len(padded)))
        assert abs(got[p] - logs / (len(p) + 1)) < 1e-9
    assert got["good1.example.org/x"] > got["cheap-pills.example.org/y"]


def test_rules(spark):
    given = ["http://A.Example.com/en/x", "http://www.example.com/en/1", "http://x.www.example.com/fr", "ftp://b.net/es/?q", "http://net/fr/", "http://dotcom/", "http://a.com", "http://a.com?x/", None, "no scheme.com/", "http://", "http://b.net/de/1#x"]
    rows = urls.judge(spark.createDataFrame([(i, u, "old") for i, u in enumerate(given)], "page_id long, url string, rule string"), catalog.RULES).orderBy("page_id").collect()
    assert [r.rule for r in rows] == ["example.com/en/", "www.example.com/en/", "com/", "net/es/", "net/fr/", None, None, None, None, None, None, None]
    assert [(r.host, r.path) for r in rows[:4]] == [("a.example.com", "/en/x"), ("www.example.com", "/en/1"), ("x.www.example.com", "/fr"), ("b.net", "/es/")]
    assert (rows[7].host, rows[7].path, rows[8].host, rows[9].host) == ("a.com", "", "", "") and all(r.verdict in ("allow", "block") for r in rows)
    only = urls.judge(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), catalog.RULES).first()
    assert only.verdict == "allow" and urls.judge(spark.createDataFrame([], "page_id long, url string"), catalog.RULES).count() == 0


def test_verdicts_equal_the_plain_threshold(spark):
    rng = random.Random(5)
    rows = [(i, f"http://{rng.choice(['good', 'fine', 'news'])}{rng.randrange(40)}.com/{rng.choice(['a', 'b'])}") for i in range(90)]
    rows += [(100 + i, f"http://{rng.choice(['cheap', 'pills', 'bets'])}{rng.randrange(40)}.net/{rng.choice(['es', 'fr'])}/x") for i in range(90)]
    rows += [(200 + i, f"http://{rng.choice(['good', 'pills', 'bets', 'fine', 'odd'])}{rng.randrange(90)}.org/{i}") for i in range(40)]
    rows += [(300, None), (301, ""), (302, "x" * 100_000), (303, "http://new\nline.org/a\nb"), rows[0], rows[0], rows[205]]
    judged = urls.judge(spark.createDataFrame([(*r, "old", 1) for r in rows], "page_id long, url string, verdict string, n int"), catalog.RULES)
    assert judged.columns == ["page_id", "url", "n", "host", "path", "rule", "verdict", "score"] and judged.count() == len(rows)
    text = lambda u: (u or "").partition("://")[2].lower() if "://" in (u or "") else (u or "").lower()
    got = judged.collect()
    held = {r.s for r in spark.createDataFrame([(text(u),) for _, u in rows], "s string").where("pmod(xxhash64(s), 5) = 0").collect()}
    labelled = [(text(r.url), r.verdict == "allow") for r in got if r.rule]
    models = plain_models([x for x in labelled if x[0] not in held])

    def score(t):
        padded = urls.BEGIN * urls.ORDER + t + urls.END
        return sum(math.log(models[True](padded[i], padded[i - urls.ORDER : i]) / models[False](padded[i], padded[i - urls.ORDER : i])) for i in range(urls.ORDER, len(padded))) / (len(t) + 1)

    tried = [(math.floor(score(t) / urls.BIN), ok) for t, ok in labelled if t in held]
    good, bad = sum(ok for _, ok in tried), sum(not ok for _, ok in tried)
    cuts = {b for b, _ in tried} | {b + 1 for b, _ in tried}
    balance = lambda c: round(sum(ok for b, ok in tried if b >= c) / good + sum(not ok for b, ok in tried if b < c) / bad, 9)
    cut = max(sorted(cuts), key=lambda c: (balance(c), -abs(c))) * urls.BIN
    for r in got:
        if not r.rule and len(r.url or "") < 1000:
            assert abs(r.score - score(text(r.url))) < 1e-9 and r.verdict == ("allow" if r.score >= cut else "block")
    assert balance(round(cut / urls.BIN)) > 1.6


def test_rules_equal_the_sql(spark):
    from tests.llm import plain

    rng = random.Random(8)
    parts = ["http://", "://", "ftp:", "com", "net", "example.com", "www.example.com", "a.", ".", "/", "en/", "/es/", "/fr/x", "?q", "#", "É", "\n", " "]
    given = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))) for i in range(600)] + [(900, None)]
    host, path = urls.host_path(F.col("url"))
    rows = spark.createDataFrame(given, "page_id long, url string").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = urls.rule_of(F.col("host"), F.col("path"), catalog.RULES)
    got = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    assert sorted((tuple(sorted(r.asDict().items())) for r in got.collect()), key=repr) == plain.by_sql(oracles.URL_RULES, pages=(("page_id", "url"), given))


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archives_round_trip(spark):
    rows = [(5, "http://a/", "<p>é</p>"), (2, "http://b/\r\nX: y", "<p>é</p>"), (3, None, None), (4, "http://d/", ""), (9, "u", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\n"), (2, "again", "<p>é</p>"), (None, "n", "<p>é</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    from quern.plans import scratch

    path = scratch.new_path(spark, "t")
    warc.write(df, path, size=1 << 13)
    got = warc.read(spark, path, payloads=True)
    assert warc.gaps(got).count() == 0
    found = Counter((r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.records(got).collect())
    two, name = "<urn:x-page:2>", lambda i: f"<urn:x-page:{i}>"
    n = len("<p>é</p>".encode())
    assert found == Counter({(name(5), "revisit", n, digest(rows[0][2]), two): 1, (two, "response", n, digest(rows[0][2]), None): 2, (name("none"), "revisit", n, digest(rows[0][2]), two): 1, (name(3), "response", 0, digest(""), None): 1, (name(4), "revisit", 0, digest(""), name(3)): 1, (name(9), "response", len(rows[4][2]), digest(rows[4][2]), None): 1})
    assert {bytes(r.payload).decode() for r in warc.records(got).collect() if r.payload} == {rows[0][2], rows[4][2]}


def record(i, body=b"hello"):
    sha = base64.b32encode(hashlib.sha1(body).digest())
    return b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, sha, len(body), body)


def ids(found):
    return [x["record_id"] for _, _, x in found if isinstance(x, dict)]


def test_salvage():
    good = [record(i, b"x" * (i + 1)) for i in range(4)]
    assert ids(warc.salvage(b"".join(good))) == [f"<urn:{i}>" for i in range(4)]
    for damaged in (good[1].replace(b"xx\r\n\r\n", b"xy\r\n\r\n"), good[1][:60], good[1].replace(b"Content-Length: 2", b"Content-Length: 999999"), good[1].replace(b"WARC-Type", b"Warp-Type"), b"junk\x00\xff" * 5 + b"\n"):
        data = good[0] + damaged + good[2] + good[3]
        found = list(warc.salvage(data))
        assert ids(found) == ["<urn:0>", "<urn:2>", "<urn:3>"]
        (gap,) = [x for x in found if isinstance(x[2], str)]
        assert gap[0] == len(good[0]) and gap[0] + gap[1] == len(good[0] + damaged)
    zipped = [gzip.compress(r) for r in good]
    assert ids(warc.salvage(b"".join(zipped))) == [f"<urn:{i}>" for i in range(4)]
    broken = bytearray(zipped[1])
    broken[len(broken) // 2] ^= 0xFF
    found = list(warc.salvage(zipped[0] + bytes(broken) + zipped[2] + zipped[3][:-4]))
    assert ids(found) == ["<urn:0>", "<urn:2>", "<urn:3>"] and sum(isinstance(x[2], str) for x in found) == 2
    assert list(warc.salvage(b"")) == [] and ids(warc.salvage(b"\r\n" + good[0])) == ["<urn:0>"]


def test_salvage_within_a_member():
    many = [record(i, bytes([65 + i % 26]) * 3000 + b"%d" % i) for i in range(400)]
    noise = random.Random(1)
    whole = gzip.compress(b"".join(record(i, noise.randbytes(500)) for i in range(200)))
    found = list(warc.salvage(whole[: len(whole) // 2]))
    n = len(ids(found))
    assert 90 < n < 110 and ids(found) == [f"<urn:{i}>" for i in range(n)]
    (gap,) = [x for x in found if isinstance(x[2], str)]
    assert gap[0] == 0 and gap[1] == len(whole) // 2
    zipped = gzip.compress(b"".join(many))
    assert ids(warc.salvage(zipped)) == [f"<urn:{i}>" for i in range(400)]


def test_salvage_is_linear():
    import time

    def seconds(data):
        begin = time.perf_counter()
        list(warc.salvage(data))
        return time.perf_counter() - begin

    noise = random.Random(2)
    body = [record(i, noise.randbytes(9000)) for i in range(1600)]
    damaged = [x if i % 2 else x.replace(b"WARC-Type", b"Warp-Type") for i, x in enumerate(body)]
    for parts in ([gzip.compress(x, 1) for x in body], damaged):
        half, full = (min(seconds(b"".join(parts[:n])) for _ in range(3)) for n in (len(parts) // 2, len(parts)))
        assert full < 2.6 * half + 0.05, (half, full)


def test_odd_pages(spark):
    from quern.plans import scratch

    df = spark.createDataFrame([], "page_id long, url string, html string, payload_bytes int")
    path = scratch.new_path(spark, "t")
    warc.write(df, path)
    assert warc.records(warc.read(spark, path)).count() == 0
    big = "<p>é</p>" * 400_000
    rows = [(1, None, big, 7), (2, "u", big, 7), (3, "u" * 100_000, "x", 7), (3, "v", "x", 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    assert warc.plan_records(df).columns == ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    path = scratch.new_path(spark, "t")
    warc.write(df, path)
    got = warc.read(spark, path, payloads=True)
    assert warc.gaps(got).count() == 0
    rows = sorted((r.record_id, r.record_type, r.payload_bytes) for r in warc.records(got).collect())
    assert rows == [("<urn:x-page:1>", "response", len(big.encode())), ("<urn:x-page:2>", "revisit", len(big.encode())), ("<urn:x-page:3>", "response", 1), ("<urn:x-page:3>", "response", 1)]
