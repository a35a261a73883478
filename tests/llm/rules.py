"""Plain rules that the operators are compared with."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def shingles(w, size):
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or {tuple(w)}


def components(sets, num, den):
    """Smallest reachable key of each key; sets that meet ``den * both >= num * either`` are linked."""
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in sets}


def without_repeats(docs, size):
    """{key: (words, words kept)} after removing windows that start earlier elsewhere."""
    seen, out = {}, {}
    for key, text in sorted(docs):
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if seen.setdefault(tuple(w[s : s + size]), (key, s)) != (key, s):
                gone[s : s + size] = [True] * size
        out[key] = (w, [x for x, g in zip(w, gone, strict=True) if not g])
    return out
