"""Plain restatements of the operators, for small inputs."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i, j):
        a, b = sorted((self.root(i), self.root(j)))
        self.up[b] = a


def text_components(rows, percent=80, width=5):
    """rows: (id, text); returns (id, size, component) per row."""
    sets = [shingle_set(t, width) for _, t in rows]
    posts, union, seen = {}, Union(len(rows)), set()
    for i, s in enumerate(sets):
        for g in s:
            posts.setdefault(g, []).append(i)
    for ids in posts.values():
        for x, i in enumerate(ids):
            for j in ids[x + 1 :]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    common = len(sets[i] & sets[j])
                    if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                        union.join(i, j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = union.root(i)
        if key is not None:
            least[r] = min(key, least.get(r, key))
    return sorted(((k, len(s), least.get(union.root(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)
