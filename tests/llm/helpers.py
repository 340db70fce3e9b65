"""Small inputs with the awkward cases, and brute-force versions."""

from itertools import combinations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, sources=None):
    """documents of (doc_id, text) pairs with a clashing extra column or two."""
    rows = [(i, t, "en", None if sources is None else sources[k], None if t is None else len(t)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def components(nodes, linked):
    """The smallest node that each reaches, over all pairs."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in nodes}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]
