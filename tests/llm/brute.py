"""Plain counterparts of the operators, for small inputs."""

from collections import Counter


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_components(rows):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def spans(rows, length=50):
    """doc_id -> [(first word, end)] covered by windows that stand at two places at least."""
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + length]) for _, w in texts for k in range(len(w) - length + 1))
    out = {}
    for i, w in texts:
        found = out.setdefault(i, [])
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                if found and k <= found[-1][1]:
                    found[-1][1] = k + length
                else:
                    found.append([k, k + length])
    return {i: [tuple(x) for x in f] for i, f in out.items() if f}
