"""The document operators against brute force, on hand-made and generated rows."""

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from quern.llm import bpe, decontamination, jaccard, oracles, pii, quality, substrings, templates, token_counts
from quern.plans import scratch
from tests.llm import plain

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (4, "one"), (None, "no id here at all"), (5, "a  b c\n\n\nd"), (6, "É" * 300 + " \U0001f600​ x" * 20)]


def sentences(rng, n, words=None):
    words = words or [a + b for a in ("ka", "lo", "mi", "ne", "ru", "ta") for b in ("ban", "dor", "fel", "gim", "hos", "jut")]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [sentences(rng, rng.randint(3, 160)) for _ in range(60)]
    rows = list(enumerate(base))
    for i in range(60, 150):
        words = base[rng.randrange(8)].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = "edit%d" % rng.randrange(9)
        rows.append((i, " ".join(words).title() if i % 7 == 0 else "  ".join(words)))
    return rows + [(200, None), (201, ""), (202, " \n "), (203, "two words"), (204, "Two  WORDS"), (205, base[0] + " " + base[1])]


def test_bpe(spark):
    reference = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
    rows = [*ODD, (7, "<|endoftext|> isn't  special\n\n\t x" + " word" * 40_000), (8, "x" * 3000)]
    df = spark.createDataFrame([(*r, "old", i) for i, r in enumerate(rows)], SCHEMA + ", ids_le string, extra int")
    done = bpe.round_trip(df, RANKS, PATTERN)
    assert done.columns == ["doc_id", "text", "extra", "n_tokens", "ids_le", "decoded", "same"]
    for r in done.collect():
        want = reference.encode_ordinary(r.text or "")
        assert r.n_tokens == len(want) and list(memoryview(r.ids_le).cast("I")) == want and r.decoded.decode() == (r.text or "") and r.same
    again = bpe.decode(done.select("doc_id", "ids_le"), RANKS, PATTERN)
    assert sorted(r.decoded for r in again.collect()) == sorted((t or "").encode() for _, t in rows)
    assert bpe.round_trip(df.limit(0), RANKS, PATTERN).count() == 0


def test_pieces_join_to_the_text():
    text = "aa bb  cc\n dd ee" * 50
    assert "".join(bpe.pieces(text, 7)) == text and list(bpe.pieces("x" * 30, 7)) == ["x" * 30]


def test_long_white_space(monkeypatch):
    tokenizer, whole = bpe.encoding(RANKS, PATTERN), lambda: bpe.encoding(RANKS, r"\s+")
    for blank in (" ", "\n", "\t \r\n", "\u3000", "\x85\xa0"):
        for text in (blank * (5_000_000 // len(blank)), "a" + blank * (5_000_000 // len(blank)) + "b"):
            ids = bpe.encode(text, tokenizer, whole)
            assert tokenizer.decode_bytes(ids.tolist()) == text.encode()
    # short runs, taken as if they were long, equal the library's own ids
    monkeypatch.setattr(bpe, "RUN", 3)
    monkeypatch.setattr(bpe, "_LONG", regex.compile(r"\s{3,}+"))
    rng = random.Random(1)
    some = [" ", "\n", "\t", "\r", "\x0b", "\x85", "\xa0", "\u2003", "\u3000", "\x1c", "\u200b", "a", "b", "1", "!", "'s"]
    for _ in range(4000):
        text = "".join(rng.choice(some) * rng.choice([1, 1, 2, 6]) for _ in range(rng.randint(1, 8)))
        assert list(bpe.encode(text, tokenizer, whole)) == tokenizer.encode_ordinary(text)


def test_rows_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text UNION ALL SELECT 2L, 'fine'")
    assert {r.doc_id: (r.same, bytes(r.decoded)) for r in bpe.round_trip(df, RANKS, PATTERN).collect()} == {1: (False, "a\ufffdb".encode()), 2: (True, b"fine")}


def test_token_counts(spark):
    import regex

    scores = token_counts.zipf_scores(RANKS)

    def viterbi(token):
        data = token.encode()
        best = [(0.0, 0)] + [(-1e18, 0)] * len(data)
        for end in range(1, len(data) + 1):
            for start in range(end):
                if data[start:end] in scores:
                    now = (best[start][0] + scores[data[start:end]], best[start][1] + 1)
                    if now[0] > best[end][0] or now[0] == best[end][0] and now[1] < best[end][1]:
                        best[end] = now
        return best[-1][1]

    rows = [*ODD, (9, "unbelievable unbelievably unbeliever don't 12345 naïve")]
    df = spark.createDataFrame(rows, SCHEMA)
    for most in (token_counts.MAX_NODES, 5):
        for r in token_counts.count(df, RANKS, PATTERN, most=most).collect():
            tokens = regex.findall(PATTERN, r.text or "")
            assert (r.n_pretokens, r.n_tokens) == (len(tokens), sum(map(viterbi, tokens)))


def quality_rows():
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a", good), (2, "a", None), (3, None, good), (4, "a", "x y z " * 30), (5, "a", good + "\nsame line\nsame line\n \nsame line #$%"), (6, "a", ""), (7, "b", " \n\t"), (8, "b", "w " * 60_000)]
    rows += [(100 * h + i, f"h{h}", f"{good} {h} {i}") for h in range(1, 14) for i in range(5)]
    rows += [(2000 + i, "short", "short" if i < 30 else good) for i in range(33)]
    rows += [(3000 + i, "signs", good + " $$$$ &&&& ####" * (9 if i < 30 else 0)) for i in range(33)]
    return rows + [(4000, "tiny", "short"), (1, "a", good), (5000, None, "short")]


def test_quality_rules(spark):
    rows = quality_rows()
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, source string, text string, kept boolean")
    judged = quality.judge(df)
    got = {r.doc_id: r for r in judged.collect()}
    assert got[1].kept and got[3].kept and got[5].kept and not got[2].kept and not got[4].kept and not got[6].kept
    assert (got[5].n_dup_lines, got[5].n_symbols, got[2].n_words, got[4].n_repeat_words, got[8].n_repeat_words) == (1, 3, 0, 90, 60_000)
    for i in (2032, 3032):  # their hosts are rejected
        assert not got[i].kept and not got[i].base_failed
    hosts = {r.host: r.rejected for r in quality.host_verdicts(quality.features(df.drop("kept"))).collect()}
    assert {h for h, bad in hosts.items() if bad} == {"short", "signs"} and None not in hosts
    digest = judged.select("doc_id", *quality.RULES, "kept")
    assert sql_rows(digest) == plain.by_sql(oracles.OP8, documents=(("doc_id", "source", "text"), rows))
    assert quality.judge(df.limit(0)).count() == 0 and quality.judge(df, carry=["text"]).columns == ["text", *quality.RULES, "kept"]
    texts = [t for _, _, t in rows[:60] if t and len(t) < 5000]
    for t in texts:
        w = plain.WORD.findall(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert next(r for r in got.values() if r.text == t).n_repeat_words == len(covered)


@pytest.mark.parametrize("small", [24, 2])
def test_jaccard_components(spark, corpus, small, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", small)
    df = spark.createDataFrame(corpus, SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(df).collect()}
    assert got == plain.linked(corpus)
    assert {r.doc_id for r in jaccard.keep_one(df, jaccard.link(df)).collect()} == {c for _, c in got.values()}


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard_counts_all_links(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    sets = {d: frozenset(plain.shingle_set(t)) for d, t in corpus}
    classes = {s for s in sets.values() if s}
    want = {s: sum(t != s and 100 * len(s & t) >= 80 * len(s | t) for t in classes) for s in classes}
    got = {r.doc_id: r.n_links for r in jaccard.link(spark.createDataFrame(corpus, SCHEMA)).collect()}
    assert got == {d: want.get(s, 0) for d, s in sets.items()} and max(got.values()) > 4


def test_jaccard_odd_rows(spark):
    rows = [*ODD, (None, "one")]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", n_shingles int")).collect()]
    assert len(got) == len(rows) and (None, 1, 4) in got and (None, 1, None) in got and got.count((4, 1, 4)) == 2 and (1, 0, 1) in got
    assert jaccard.link(spark.createDataFrame([], SCHEMA)).count() == 0


def test_decontamination(spark, corpus):
    rng = random.Random(9)
    items = [(i, sentences(rng, rng.randint(3, 40))) for i in range(12)] + [(50, None), (51, "the same gram the same gram the same gram the same gram"), (52, "two words"), (53, " one\tmore of those "), (54, "absent")]
    rows = list(corpus) + [(250, "so one more\nOF those"), (251, "two"), (252, "gram " + "the same gram " * 9)]
    for i, (_, t) in enumerate(items):
        if t:
            words = t.split()
            if i % 3 == 0 and len(words) > 10:
                words[len(words) // 2] = "changed"
            rows.append((300 + i, sentences(rng, 30) + "\n" + " ".join(words).upper() + " " + sentences(rng, 25)))
            rows.append((400 + i, " ".join(words[:-1])))
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontamination.find(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain.decontaminated(rows, items)
    assert got == want and len(want) > 8
    left = decontamination.drop(spark.createDataFrame([*rows, (None, items[0][1])], SCHEMA), spark.createDataFrame([(300,), (None,)], "doc_id long"))
    assert left.where("doc_id = 300").count() == 0 and left.where("doc_id IS NULL").count() == 1
    assert decontamination.find(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_by_long_items(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(90_000)}" for _ in range(200_000))
    flat = "same five words go on " * 30_000
    docs = [(1, "before " + long), (2, long[:-40] + " after all"), (3, long[: len(long) // 2]), (4, flat), (5, None)]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.find(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(7, long), (8, flat)], "item_id long, text string")).collect()}
    assert set(got) == {(1, 7), (2, 7), (4, 8)} and got[1, 7] == got[4, 8] == 1.0


def sql_rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)


def test_repeated_units(spark):
    rows = [(3, "Opening words.\n  Same  LINE here\tyes \n\nA"), (1, "same line here yes\nother\nSame line HERE yes"), (2, "x same line here yes\nÉtÉ"), (4, None), (5, ""), (6, " \n\n\t"), (7, "été\nA\n" + "w " * 50_000), (8, "w " * 50_000)]
    df = spark.createDataFrame([(*r, "kept", 1) for r in rows], SCHEMA + ", kept string, h1 int")
    found = substrings.repeats(df)
    assert sql_rows(found) == plain.by_sql(oracles.OP7, documents=(("doc_id", "text"), rows)) and found.count() == 5
    clean = {r.doc_id: r.text for r in substrings.strip(df, found).collect()}
    texts = dict(rows)
    assert clean[3] == "Opening words.\n  \n\nA" and clean[1] == "same line here yes\nother\n" and clean[8] == "" and clean[4] is None
    assert all(clean[k] == texts[k] for k in (2, 5, 6))
    # rows of one doc_id are one document; a null id ranks last; ids may be strings
    again = spark.createDataFrame([("b", "unit one"), ("b", "unit one"), (None, "unit one"), ("a", "else"), (None, "lone"), (None, "lone")], "doc_id string, text string")
    assert Counter((r.doc_id, r.kept_doc_id) for r in substrings.repeats(again).collect()) == Counter({(None, "b"): 1})
    assert substrings.repeats(df.limit(0)).count() == 0
    two = spark.createDataFrame([(1, "one\ntwo\n\nthree"), (2, "three\n\nONE\n two")], SCHEMA)
    assert sorted((r.doc_id, r.start, r.end) for r in substrings.repeats(two, unit="paragraph").collect()) == [(2, 0, 5), (2, 7, 15)]
    assert substrings.repeats(two, unit="sentence", least_words=2).count() == 0


def test_repeated_passages(spark):
    rng = random.Random(6)
    text = lambda n: [f"{a}É{b}" for a, b in ((rng.randrange(99), rng.randrange(99)) for _ in range(n))]
    long, short, alone = text(140), text(50), text(300)
    rows = [(1, " ".join([*text(30), *long[:80], *text(9)])), (2, " ".join([*text(4), *long[20:140]]) + "\n x"), (3, "\n ".join([*text(3), *[w.upper() for w in long[:51]], "y", *long[60:120]]))]
    rows += [(4, " ".join(short)), (5, " ".join(short)), (6, " ".join(alone)), (7, "of " * 400), (8, "x " + "of " * 60), (9, " ".join([*alone[9:61], *alone[9:61]])), (10, None), (11, ""), (12, " ".join([*long, *alone])), (13, " ".join(long[:50]))]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", th int")
    found = substrings.passages(df)
    assert sql_rows(found) == plain.by_sql(oracles.OP7_PASSAGES, documents=(("doc_id", "text"), rows))
    # of passages that begin within lines `repeats` sees none, but for words of document 3 that are lines of their own
    assert {r.doc_id for r in found.collect()} == {2, 3, 7, 8, 9, 12} and {r.doc_id for r in substrings.repeats(df).collect()} == {3, 5}
    clean = {r.doc_id: r.text for r in substrings.strip(df, found).collect()}
    assert clean[1] == rows[0][1] and clean[3].split()[3:] == ["y"] and clean[13] == rows[-1][1]
    # rows of one doc_id are one document; a null id ranks last; ids may be strings
    again = spark.createDataFrame([(i, " ".join(long)) for i in ("b", "b", None, "c")], "doc_id string, text string")
    assert Counter((r.doc_id, r.kept_doc_id) for r in substrings.passages(again).collect()) == Counter({(None, "b"): 1, ("c", "b"): 1})
    assert substrings.passages(df.limit(0)).count() == 0


def test_passages_by_brute_force(spark):
    rng = random.Random(8)
    for size, letters in ((1, "abcdef"), (3, "ab"), (5, "abcdefghijklmnopqrst")):
        base = [[rng.choice(letters) for _ in range(60)] for _ in range(4)]
        rows = []
        for d in range(25):
            words = []
            for _ in range(rng.randrange(4)):
                at = rng.randrange(60)
                words += [*rng.choice(base)[at : at + rng.randrange(40)], *[rng.choice(letters) for _ in range(rng.randrange(3))]]
            rows.append((d, " ".join(words)))
        found = substrings.passages(spark.createDataFrame(rows, SCHEMA), words=size).select("doc_id", "start", "end", "kept_doc_id")
        assert sorted(tuple(r) for r in found.collect()) == plain.passages(rows, size)


def test_passages_of_copies_take_few_rows(spark, monkeypatch):
    """Not a row for each run of each copy: that was beyond the disk budget."""
    rng, written, cut = random.Random(9), [], scratch.cut
    monkeypatch.setattr(scratch, "cut", lambda df, label: [done := cut(df, label), written.append(done.count())][0])
    text = [f"w{rng.randrange(9999)}" for _ in range(400)]
    rows = [(d, " ".join([*text[: 9 * d], "other", *text[9 * d + 1 :]])) for d in range(40)]
    found = substrings.passages(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "start", "end", "kept_doc_id")
    assert sorted(tuple(r) for r in found.collect()) == plain.passages(rows, 51)
    assert sum(written) < 40 * 350 / 2  # of the runs of all texts


def template_rows():
    rng = random.Random(3)
    rows = [(i, f"{sentences(rng, 40)}\nPage {i} of {i + 9} was viewed {i * 7} times today\n{sentences(rng, 30)}\nAll rights reserved by the owner\nMenu\n") for i in range(8)]
    rows += [(20, None), (21, ""), (22, "Page 1 of 2 was viewed 3 times today"), (23, "a b"), (24, "2020\n\n77 88\nMenu"), (25, "2021\n\n79 80")]
    rows += [(30 + i, f"user login event {x} seen by {y}") for i, (x, y) in enumerate([("ann", "bob"), ("cid", "dan"), ("eve", "fay")])]
    rows[-1] = (32, rows[-1][1] + "\nuser login event eve seen by gus\nuser login event eve seen by hal")
    long = [sentences(rng, 26) for _ in range(6)]
    whole = "\n".join([*long[:4], "All rights reserved by the owner"])
    rows += [(40 + i, whole) for i in range(3)]
    for i in range(4):
        words = whole.split(" ")
        words[7 * i + 3] = f"edited{'xyz'[i % 3]}"
        rows.append((50 + i, " ".join(words)))
    return rows + [(60, long[0] + "\n" + sentences(rng, 60)), (61, long[5]), (62, f"{sentences(rng, 50)}\n{long[4]}"), (63, f"{sentences(rng, 50)}\n{long[4]}")]


def test_line_templates(spark):
    rows = template_rows()
    columns = ("doc_id", "text")
    done = templates.drop_lines(spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", n_lines int, line string"), count=True)
    assert done.columns == ["doc_id", "text", "line", "n_lines", "n_dropped"]
    digest = done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))
    assert sql_rows(digest) == plain.by_sql(oracles.OP10, documents=(columns, rows))
    got = {r.doc_id: r for r in done.collect()}
    texts = dict(rows)
    for i in range(8):
        assert (got[i].n_lines, got[i].n_dropped) == (6, 3) and got[i].text == "\n".join([*texts[i].split("\n")[:3:2], ""])
    assert [got[i].text for i in (30, 31, 32)] == [""] * 3 and got[32].n_dropped == 3  # one document's lines count once
    assert got[22].text == "" and got[23].text == "a b" and got[24].text == "2020\n\n77 88" and got[20].text is None
    # copies keep what only they have, and lose what others have
    assert got[40].text == got[41].text == "\n".join(texts[40].split("\n")[1:4]) and got[52].n_dropped == 2 - (got[52].text.count("edited") and "edited" in texts[52].split("\n")[0])
    assert got[61].text == texts[61] and got[62].n_dropped == got[63].n_dropped == 1


def test_line_templates_odd_rows(spark):
    rows = [(1, "the same line is here"), (1, "the same line is here"), (None, "the same line is here"), (None, "own words\nthe common line is here"), (2, "and the rest of it\nthe common line is here"), (None, None)]
    done = [(r.doc_id, r.text) for r in templates.drop_lines(spark.createDataFrame(rows, SCHEMA)).collect()]
    # equal texts are copies, whatever their ids
    assert Counter(done) == Counter({(1, rows[0][1]): 2, (None, rows[0][1]): 1, (None, "own words"): 1, (2, "and the rest of it"): 1, (None, None): 1})
    long = "\n".join(f"line {'x' * (i % 50)} number{i} of it" for i in range(40_000))
    done = {r.doc_id: r.n_dropped for r in templates.drop_lines(spark.createDataFrame([(1, long), (2, "line x of it\nline xxx number7 of it")], SCHEMA), count=True).collect()}
    assert done == {1: 40_000 // 50, 2: 1} or done[2] >= 1
    assert templates.drop_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    strings = spark.createDataFrame([("a", "first\nMenu bar"), ("b", "second thing\nMenu bar")], "doc_id string, text string")
    assert sorted(r.text for r in templates.drop_lines(strings).collect()) == ["first", "second thing"]


def test_pii_base_spans(spark):
    rows = [
        *ODD, (20, "mail a.b@x.co.uk, a@b, +1 (499) 555-6503 or 10.0.0.255 and 10.0.0.256; é 4432507379035540 4432-5073 79035540."),
        (21, "1.2.3.4.5.6.7.8 +12345678 +123456789 x@y.z@w.v_q@r.s"), (22, "9" * 30_000 + " " + "a." * 20_000 + "@" + " +1" + "(" * 20_000), (23, " ".join(f"{i % 256}.1.2.3" for i in range(400))),
    ]
    for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect():
        texts = [t for d, t in rows if d == r.doc_id]
        assert [(x.start, x.kind, x.end) for x in r.base] == plain.base_spans(texts[0])


def pii_rows():
    rng = random.Random(4)
    rows = [(i, f"{sentences(rng, 12)} call zanzibar ops{i}@corp.example.com {sentences(rng, 5)}") for i in range(16)]
    rows += [(20 + i, f"{sentences(rng, 12)} reach quagga +1 (499) 555-65{i:02} {sentences(rng, 5)}") for i in range(12)]
    rows += [(40 + i, f"{sentences(rng, 8)} copied okapis 10.0.0.7 and {sentences(rng, 3)}") for i in range(9)]  # one value
    rows += [(100 + i, sentences(rng, 30) + (" okapis" if i < 5 else "")) for i in range(150)]
    rows += [(300 + i, f'{sentences(rng, 9)} secret = "{rng.getrandbits(160):040x}" {sentences(rng, 4)}') for i in range(14)]
    rows += [(330, "secret alone; " + "Donaudampfschifffahrtsgesellschaft 12345678901234567890123 a1b2c3d4e5f6g7h8i9j a1b2c3d4e5f6g7h8i9j0 éA1234567890123456789é")]
    return rows + [(400, "ZANZIBAR alone, where nothing is named; xzanzibar zanzibar"), (401, None), (402, ""), rows[3], rows[3], (None, "quagga without an id")]


def test_pii_terms(spark):
    rows = pii_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", base string, id int")
    want, disclosure = plain.told(rows)
    found = pii.find(df).collect()
    assert len(found) == len(rows)
    got = Counter((r.doc_id, tuple((x.start, x.end, x.action) for x in r.added)) for r in found)
    assert got == Counter((d, tuple(w)) for (d, _), w in zip(rows, want, strict=True))
    texts = dict(rows)
    told = {texts[r.doc_id][x.start : x.end].lower() for r in found for x in r.added if x.kind == 4}
    assert {texts[330][x.start : x.end] for r in found if r.doc_id == 330 for x in r.added} == {"secret", "a1b2c3d4e5f6g7h8i9j0", "A1234567890123456789"}
    assert told == {"zanzibar", "quagga", "call", "reach", "secret"} and disclosure["okapis"] < 0.5  # one value is one document's evidence
    assert [len(r.added) for r in found if r.doc_id == 400] == [2]
    clean = {r.doc_id: r.text for r in pii.sanitise(df, pii.find(df)).collect()}
    assert "zanzibar" not in clean[0] and "[EMAIL]" in clean[0] and "xzanzibar" in clean[400] and "ZANZIBAR" not in clean[400] and clean[401] is None
    assert pii.find(df.limit(0)).count() == 0


def test_pii_copies_are_no_evidence_against(spark):
    """Copies of a page share one document's weight in the counts of terms and documents too."""
    rng = random.Random(8)
    page = f"{sentences(rng, 12)} call zanzibar ops99@corp.example.com {sentences(rng, 5)}"
    rows = [(i, f"{sentences(rng, 12)} call zanzibar ops{i}@corp.example.com {sentences(rng, 5)}") for i in range(16)]
    rows += [(100 + i, sentences(rng, 30)) for i in range(150)]

    def spans(copies):
        df = spark.createDataFrame([*rows, *[(400 + i, page) for i in range(copies)]], SCHEMA)
        return {(r.doc_id, tuple((x.start, x.end, x.action) for x in r.added)) for r in pii.find(df).collect() if r.doc_id <= 400}

    one = spans(1)
    assert {len(added) for d, added in one if d < 100} == {2}  # call and zanzibar
    assert spans(64) == one


def test_clean_rows_match_digest(spark):
    df = spark.createDataFrame([(1, "abc")], SCHEMA)
    assert bpe.round_trip(df, RANKS, PATTERN).select(F.sha2("decoded", 256).alias("x")).first().x == hashlib.sha256(b"abc").hexdigest()
