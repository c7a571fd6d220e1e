"""Plain definitions of what the operators compute, for small inputs."""

import hashlib
import re


def order(i):
    return float("inf") if i is None else i


def digest(x):
    return hashlib.sha256(x).hexdigest()


def without_repeated_bytes(rows, window=100):
    """(id, text's bytes, which of them go) of rows (id, text)."""
    bodies = [(order(i), (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in bodies:
        for s in range(len(b) - window + 1):
            x = b[s : s + window]
            first[x] = min(first.get(x, (i, s)), (i, s))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if first[b[s : s + window]] < (i, s):
                gone[s : s + window] = b"\1" * window
        out.append((i, b, gone))
    return out


def bytes_report(rows):
    out = without_repeated_bytes(rows)
    return sorted((i, len(b), sum(g), len(re.findall(b"\1+", bytes(g))), digest(bytes(x for x, y in zip(b, g) if not y))) for i, b, g in out)


def words_report(rows, window=50):
    bodies, first, out = [(order(i), re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows], {}, []
    for i, w in bodies:
        for s in range(len(w) - window + 1):
            x = tuple(w[s : s + window])
            first[x] = min(first.get(x, i), i)
    for i, w in bodies:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), digest(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return sorted(out)


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def near_classes(rows, similar=0.8):
    """The smallest id of each row's class of near copies."""
    sets, label = [shingles(t) for _, t in rows], [order(i) for i, _ in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j])]
    again = True
    while again:
        again = False
        for i, j in links:
            low = min(label[i], label[j])
            again |= (label[i], label[j]) != (low, low)
            label[i] = label[j] = low
    return label
