"""Plain definitions that the operators are compared with."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, n=5):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_components(rows, percent=75):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(ids, pairs).items()}


def base_counts(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    marked = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def within_one(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 20 or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :])


def line_dedup(rows):
    """Texts after dedup; rows have distinct ids (null first)."""
    order = sorted(((-(2**63) if k is None else k, i, c) for k, t in rows if t is not None for i, line in enumerate(t.split("\n")) if (c := line.strip(" \t\n\v\f\r"))), key=lambda x: x[:2])
    gone = {(k, i) for n, (k, i, c) in enumerate(order) if any(within_one(c, e) for _, _, e in order[:n])}
    return {k: None if t is None else "\n".join(line for i, line in enumerate(t.split("\n")) if (-(2**63) if k is None else k, i) not in gone) for k, t in rows}


def repeated_spans(rows, size=50):
    found = {k: [(m.group(), m.start(), m.end()) for m in WORD.finditer(t or "")] for k, t in rows}
    texts = dict(rows)
    where = {}
    for k, w in found.items():
        for i in range(len(w) - size + 1):
            where.setdefault(tuple(x[0] for x in w[i : i + size]), set()).add(k)
    copies, out = Counter(t for _, t in rows), set()
    for k, w in found.items():
        if len(w) >= size and copies[texts[k]] > 1:
            out.add((k, 0, len(texts[k])))
            continue
        span = None
        for i in range(len(w) - size + 1):
            if len(where[tuple(x[0] for x in w[i : i + size])]) > 1:
                if span and i <= span[1] + size:
                    span[1] = i
                else:
                    if span:
                        out.add((k, w[span[0]][1], w[span[1] + size - 1][2]))
                    span = [i, i]
        if span:
            out.add((k, w[span[0]][1], w[span[1] + size - 1][2]))
    return out
