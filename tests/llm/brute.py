"""Plain restatements of what each operator has to return."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text, low=False):
    return WORD.findall((text or "").translate(LOW) if low else text or "")


def quality(text):
    w = words(text)
    count = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for k in range(len(w) - 2):
        if count[w[k], w[k + 1], w[k + 2]] > 1:
            covered |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def near(docs, size=4):
    """id -> (set size, smallest id reachable), by sets of runs of ``size`` words."""
    sets = {}
    for i, t in docs:
        w = words(t, low=True)
        sets[i] = frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def substring(rows, size=35):
    """Per row: (words, words removed, digest of the rest)."""
    split = [words(t) for t in rows]
    count = Counter(tuple(w[j : j + size]) for w in split for j in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = set()
        for j in range(len(w) - size + 1):
            if count[tuple(w[j : j + size])] > 1:
                gone |= set(range(j, j + size))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode("utf-8")).hexdigest()))
    return out


def leaks(rows, items, size=10):
    """Per row: (words, words hit, items, digest of their ids)."""
    phrases = defaultdict(set)
    for name, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        n = min(size, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            phrases[tuple(w[j : j + n])].add(str(name))
    out = []
    for t in rows:
        w = ALNUM.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(p) for p in phrases}:
            for j in range(len(w) - n + 1):
                if names := phrases.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    found |= names
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def crc(text):
    return zlib.crc32((text or "").encode())
