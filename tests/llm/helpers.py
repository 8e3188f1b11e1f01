"""Plain forms of what the operators compute, for small tables."""

import re
from collections import defaultdict

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def shingles(text, width):
    w = [x for x in re.split("[\x20\x09-\x0d]+", ascii_lower(text or "")) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def groups(ids, links):
    """Smallest reachable id of each id."""
    low = {i: i for i in ids}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i
    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near(texts, width=5, percent=80):
    """id -> component over {id: text}."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in pairs
             if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return groups(sets, links)


def tokens(text):
    return [t for t in re.split(r"[^\w]|_", (text or "").lower()) if t]


def leaks(text, items, window=20, percent=80, least=8, span=11):
    """Ids of the items that stand in the text with few substitutions, all offsets tried."""
    doc, out = tokens(text), []
    for item, words in items.items():
        n, best = len(words), 0
        size = min(window, n)
        for at in range(-n + 1, len(doc)):
            same = [0 <= at + k < len(doc) and doc[at + k] == words[k] for k in range(n)]
            best = max(best, max(sum(same[k:k + size]) for k in range(n - size + 1)))
        need = n if n < span else -(-size * percent // 100)
        if n >= least and best >= need:
            out.append(item)
    return sorted(out)
