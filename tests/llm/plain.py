"""Row-by-row versions of the operators' definitions, for comparison."""

import collections
import random
import re
import unicodedata


def plain(s):
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn")


def words(s):
    return re.findall(r"[^\W_]+", plain(s or ""))


def bare(s):
    return "".join(c for c in plain(s) if unicodedata.category(c)[0] in "LN")


def likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def groups(links):
    """(smallest id, id) of every component with two members or more."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    by = collections.defaultdict(list)
    for x in list(parent):
        by[find(x)].append(x)
    return {(k, x) for k, v in by.items() if len(v) > 1 for x in v}


def sentence_maker(seed=0, vocabulary=800):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzçãé") for _ in range(r.randint(3, 9))) for _ in range(vocabulary)]
    return r, lambda n: [r.choice(vocab) for _ in range(n)]
