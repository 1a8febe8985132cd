"""Plain versions of the contracts, on lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(docs, items, size=13):
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            grams[tuple(w[i : i + size])].add(item)
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= {*range(i, i + n)}
                    found |= {str(x) for x in grams[g] if x is not None}
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def personal(text):
    def fine(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return kind != "phone" or 8 <= len(digits) <= 15

    return {k: [m.span() for m in r.finditer(text or "") if fine(k, m[0])] for k, r in KINDS.items()}


def near(docs, size=4, percent=80):
    """{doc_id: (set size of its last text, smallest reachable doc_id)} over all pairs."""
    rows = []
    for doc, text in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
        rows.append((doc, frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()))
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for i, (a, s) in enumerate(rows):
        if a is None:
            continue
        shared = Counter(j for gram in s for j in seen[gram])
        for j, both in shared.items():
            b, t = rows[j]
            if 100 * both >= percent * (len(s) + len(t) - both):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
        for gram in s:
            seen[gram].append(i)
    return [(d, len(s), None if d is None else root(d)) for d, s in rows]
