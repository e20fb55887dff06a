"""Brute-force versions of the operators, over lists of (doc_id, text)."""

import re

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def white(text):
    return WHITE.findall(text or "")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def repeats(docs, width):
    """doc_id to (words, removed flags); ids are distinct."""
    least = {}
    for i, t in docs:
        w = white(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, t in docs:
        w = white(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (w, gone)
    return out


def hits(docs, items, width):
    """Per document: words, words hit, items."""
    windows = {}
    for i, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = alnum(t)
        hit, found = set(), set()
        for key, own in windows.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k : k + len(key)]) == key:
                    hit |= set(range(k, k + len(key)))
                    found |= own
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def components(docs, width=5, percent=75):
    """doc_id to (size of the set, least linked id); ids are distinct."""
    sets = {}
    for i, t in docs:
        w = white((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def counts(text):
    w = white(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WHITE.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for k in range(len(w) - 4):
        places.setdefault(tuple(w[k : k + 5]), []).append(k)
    mark = [False] * len(w)
    for own in places.values():
        if len(own) > 1:
            for k in own:
                mark[k : k + 5] = [True] * 5
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, sum(mark)
