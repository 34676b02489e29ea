"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re

import numpy as np
import xxhash


def small_letters(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", small_letters(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fingerprints, radius=2):
    """Index of the first row that chains of close fingerprints reach, for each row."""
    values = np.array(fingerprints, np.uint64)
    out = [None] * len(values)
    for i in range(len(values)):
        if out[i] is None:
            front = [i]
            out[i] = i
            while front:
                near = np.flatnonzero(np.bitwise_count(values ^ values[front.pop()]) <= radius)
                for j in near.tolist():
                    if out[j] is None:
                        out[j] = i
                        front.append(j)
    return out


BASE = [
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def secrets(text, rules):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, g, least) in enumerate(rules) for m in p.finditer(text or "") if len(m[g]) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items, size=13):
    """n_words, n_hit and sorted item ids, from windows written out."""
    words = _WORD.findall(small_letters(text))
    hit, ids = set(), set()
    for item_id, item in items:
        own = _WORD.findall(small_letters(item))
        n = min(size, len(own))
        wanted = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1) if own else ():
            if tuple(words[i : i + n]) in wanted:
                hit |= set(range(i, i + n))
                ids.add(item_id)
    return len(words), len(hit), sorted(str(x) for x in ids if x is not None)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def firsts_of_near_copies(texts, size=5, least=0.8):
    """Indices of the first text of each group that pairs of at least this Jaccard similarity of word shingles join."""
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", small_letters(text))
        sets.append(frozenset(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset())
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and least * max(len(a), len(b)) <= min(len(a), len(b)) and len(a & b) >= least * len(a | b) - 1e-9):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [i for i in range(len(sets)) if top(i) == i]
