"""Plain versions of the operators for small inputs."""

import collections
import hashlib


def components(rows, width, percent):
    """{doc_id: (set size, smallest reachable id)} over all pairs."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    lists, common, parent = collections.defaultdict(list), collections.Counter(), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for v in s:
            lists[v].append(i)
    for members in lists.values():
        for k, a in enumerate(members):
            for b in members[k + 1:]:
                common[a, b] += 1
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(rows, length=50):
    """{doc_id: (bytes, removed, runs, digest of the rest)} by looking up every string."""
    first, out = {}, {}
    for i, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            first[data[k:k + length]] = min(i, first.get(data[k:k + length], i))
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first[data[k:k + length]] < i:
                gone[k:k + length] = b"\1" * length
        runs = sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest())
    return out


def occurrence(item, data):
    """Smallest edit distance of ``item`` to any part of ``data``."""
    before = [0] * (len(data) + 1)
    for r, c in enumerate(item):
        now = [r + 1]
        for k, d in enumerate(data):
            now.append(min(before[k] + (c != d), before[k + 1] + 1, now[k] + 1))
        before = now
    return min(before)
