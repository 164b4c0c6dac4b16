"""Plain versions of what the operators compute."""

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower_ascii(text))


def shingle_set(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def jaccard_components(rows, k, num, den):
    """rows: (id, text) -> for each row (size, smallest id reachable)."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {r: min((d for d in x if d is not None), default=None) for r, x in ids.items()}
    return [(len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def cosine_neighbours(vectors, query, k):
    scores = [(sum(x * v.get(t, 0.0) for t, x in query.items()), i) for i, v in enumerate(vectors)]
    return sorted(((s, i) for s, i in scores if s > 0), key=lambda x: (-x[0], x[1]))[:k]


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def base_scores(rows, train):
    """rows: (id, text), train: flags -> (n_tokens, n_known, base score) per row, and N."""
    tokens = [[*words(t), None] for _, t in rows]
    c = Counter(w for t, y in zip(tokens, train) if y for w in t)
    n, v = sum(c.values()), len(c)
    return [(len(t), sum(c[w] > 0 for w in t), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for t in tokens], n
