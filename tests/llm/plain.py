"""Brute-force versions of the operators, in plain Python."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def linked(docs, percent=80):
    """doc_id -> (n_shingles, component_id), by an inverted index over all shingles."""
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for d, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(d)
    for d in sorted(sets):
        if not sets[d]:
            continue
        shared = {}
        for g in sets[d]:
            for e in index[g]:
                if e < d:
                    shared[e] = shared.get(e, 0) + 1
        for e, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def passages(docs, size):
    """(doc_id, start, end, kept_doc_id) of the repeated runs of `size` words, those that overlap or touch as one."""
    words = {d: [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(t or "")] for d, t in docs}
    run = lambda d, k: tuple(w for _, _, w in words[d][k : k + size])
    first, out = {}, []
    for d in sorted(words):
        for k in range(len(words[d]) - size + 1):
            first.setdefault(run(d, k), (d, k))
    for d in words:
        last = None
        for k in range(len(words[d]) - size + 1):
            kept, at = first[run(d, k)]
            if kept == d and k < at + size:
                continue
            if last and k <= last[1] + size:
                last[1:] = k, min(last[2], kept)
            else:
                out.append((d, last := [k, k, kept]))
    return sorted((d, words[d][a][0], words[d][b + size - 1][1], kept) for d, (a, b, kept) in out)


def decontaminated(docs, items, threshold=0.8):
    """(doc_id, item_id) -> best multiset Jaccard similarity over all item-sized windows."""
    from collections import Counter

    def grams(words):
        return [tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 0))]

    def split(text):
        return WORD.findall((text or "").lower())

    out = {}
    wanted = [(i, split(t)) for i, t in items]
    for d, t in docs:
        g = grams(w := split(t))
        have = set(g)
        for i, iw in wanted:
            if 0 < len(iw) < 5:
                if any(w[s : s + len(iw)] == iw for s in range(len(w))):
                    out[d, i] = 1.0
                continue
            want = Counter(grams(iw))
            if sum(x in have for x in want) < 1:
                continue
            size = len(iw) - 4
            best = 0.0
            for s in range(max(1, len(w) - len(iw) + 1)):
                win = Counter(g[s : s + size])
                best = max(best, sum((win & want).values()) / sum((win | want).values()))
            if best >= threshold:
                out[d, i] = max(out.get((d, i), 0), round(best, 9))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    """(start, kind, end) of the valid base matches, by start and kind."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m.group()))


def entity(kind, value):
    if kind == 4:
        return kind, value
    if kind == 0:
        return kind, value.lower()
    if kind == 1:
        return kind, ".".join(str(int(x)) for x in value.split("."))
    return kind, re.sub("[^0-9]", "", value)


def told(rows, prior=20.0, remove=0.8, generalise=0.5, unit=1 << 20):
    """For each row the spans (start, end, action) of keys and of the terms that disclose a class, and the disclosures of
    all terms."""
    import math

    import regex

    rows = [(d, t or "") for d, t in rows]
    key = r"(?<![A-Za-z0-9])(?=[A-Za-z0-9]*[0-9])(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{20,}"
    keys = [[(m.start(), m.end(), "remove") for m in re.finditer(key, t)] for _, t in rows]
    base = [base_spans(t) + [(s, 4, e) for s, e, _ in k] for (_, t), k in zip(rows, keys, strict=True)]
    held = [{entity(k, t[s:e]) for s, k, e in found} for (_, t), found in zip(rows, base, strict=True)]
    df = {}
    for names in held:
        for e in names:
            df[e] = df.get(e, 0) + 1
    weights = [[max([unit // df[e] for e in names if k in (e[0], None)] or [0]) for k in range(5)] for names in held]
    weights = [[*w, max(w)] for w in weights]
    shares = [sum(w[k] for w in weights) / unit / len(rows) for k in range(6)]
    word = regex.compile(r"\p{L}+")
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    counts = {}
    for (_, t), w in zip(rows, weights, strict=True):
        for term in {x.lower() for x in word.findall(re.sub(key, " ", re.sub(email, " ", t))) if len(x) >= 4}:
            n = counts.setdefault(term, [0] * 7)
            n[6] += 1
            for k in range(6):
                n[k] += w[k]
    disclosure = {}
    for term, n in counts.items():
        best = 0.0
        for k, p in enumerate(shares):
            if 0 < p < 1:
                given = (max(n[k] / unit - 1, 0) + prior * p) / (n[6] - 1 + prior)
                best = max(best, math.log(given / p) / -math.log(p))
        disclosure[term] = best
    spans = []
    for (_, t), found, own in zip(rows, base, keys, strict=True):
        terms = [(m.start(), m.end(), disclosure.get(m.group().lower(), 0)) for m in word.finditer(t) if len(m.group()) >= 4]
        free = [(s, e, "remove" if x >= remove else "generalise") for s, e, x in terms if x >= generalise and not any(a < e and b > s for a, _, b in found)]
        spans.append(sorted(own + free))
    return spans, disclosure


def by_sql(sql, **tables):
    """The rows of DuckDB SQL over tables given as (names, rows), by column name."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        con.register(f"raw_{name}", pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype="Int64" if c.endswith("_id") else object) for i, c in enumerate(columns)}))
        kinds = ", ".join(f"CAST({c} AS {'BIGINT' if c.endswith('_id') else 'VARCHAR'}) AS {c}" for c in columns)
        con.execute(f"CREATE TABLE {name} AS SELECT {kinds} FROM raw_{name}")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    return sorted((tuple(sorted(zip(names, row, strict=True))) for row in found.fetchall()), key=repr)
