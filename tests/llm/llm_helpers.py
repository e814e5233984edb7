"""Inputs and plain helpers of these tests."""

from collections import Counter

LONG = " ".join(f"word{k} of the" for k in range(30_000))
EDGE = [(1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "one", "b"), (None, "null id text here", "b"), (None, None, None), (5, LONG, "a"), (6, "tie tie tie", "b"), (6, "tie tie tie", "b"),
        (7, "héÉ à la carte\r\nNEXT line", "c")]


def plain(rows, *columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else ({tuple(words)} if words else set())


def kept_by_hand(rows):
    """Smallest ids of the groups of documents whose 5-word n-grams agree to 80 percent; rows are ids, texts and more."""
    sets = [grams(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    first = {}
    for k, (i, _, _) in enumerate(rows):
        first.setdefault(find(k), []).append(i)
    return sorted(min(ids) for ids in first.values())
