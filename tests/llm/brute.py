"""Plain re-statements of what the operators return, for small inputs."""

import collections
import hashlib
import re

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width):
    w = WORD.findall(fold(text))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(ids, pairs):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near_duplicates(docs, width=3, threshold=85):
    """{id: (set size, component)} of {id: text}."""
    sets = {i: shingles(t, width) for i, t in docs.items()}
    seen, pairs = collections.defaultdict(list), []
    for i, s in sets.items():
        count = collections.Counter()
        for g in s:
            count.update(seen[g])
            seen[g].append(i)
        pairs += [(i, j) for j, n in count.items() if 100 * n >= threshold * (len(s) + len(sets[j]) - n)]
    comp = components(docs, pairs)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def repeats(docs, length=50):
    """{id: (bytes, removed, spans, digest)} of {id: text}."""
    first, raw = {}, {i: (t or "").encode() for i, t in docs.items()}
    for i, b in raw.items():
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(i, first.get(b[p : p + length], i))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def secrets(text):
    """(start, kind, end) of the fixed patterns, written out once more."""
    text = text or ""
    found = []
    for m in re.finditer(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[1]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def cosine(vectors, least=0.95):
    """{id: (links, component)} of {id: list or None}."""
    ok = {i: np.array(v, float) for i, v in vectors.items() if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    pairs, ids = [], list(ok)
    n = dict.fromkeys(vectors, 0)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            if len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= least:
                pairs.append((i, j))
                n[i] += 1
                n[j] += 1
    comp = components(vectors, pairs)
    return {i: (n[i], comp[i]) for i in vectors}
