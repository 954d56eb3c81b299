"""Plain versions of the operators, for small tables."""

import re
from collections import defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingle_set(text, width):
    w = words(text)
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def shared(sets):
    """For each set, in order, how much it shares with each earlier one that it meets."""
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        counts = defaultdict(int)
        for v in s:
            for j in lists[v]:
                counts[j] += 1
        yield i, counts
        for v in s:
            lists[v].append(i)


def components(rows, width, percent=80):
    """doc_id to (size of its set, component) for rows (doc_id, text)."""
    rows = sorted(rows)
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, counts in shared(sets):
        for j, k in counts.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {rows[i][0]: (len(sets[i]), rows[root(i)][0]) for i in range(len(rows))}


def deduped_lines(rows, percent=80):
    """doc_id to the text that is left."""
    places, sets = [], []
    for d, t in sorted(rows):
        for n, line in enumerate((t or "").split("\n")):
            if s := frozenset(words(line)):
                places.append((d, n))
                sets.append(s)
    gone = {places[i] for i, counts in shared(sets) if any(100 * k >= percent * (len(sets[i]) + len(sets[j]) - k) for j, k in counts.items())}
    return {d: "\n".join(x for n, x in enumerate((t or "").split("\n")) if (d, n) not in gone) for d, t in rows}


def windows(text, items, size=10):
    """(words, hit words, item ids) of a text; items: (item_id, text)."""
    w, hit, found = item_words(text), set(), set()
    for name, t in items:
        v = item_words(t)
        n = min(size, len(v))
        grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in grams:
                hit.update(range(k, k + n))
                found.add(str(name))
    return len(w), len(hit), sorted(found)
