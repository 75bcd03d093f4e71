"""Plain-Python versions of the discovery operators, for small tables."""

from itertools import combinations


def count(rows, mask):
    cols = [i for i in range(len(rows[0])) if mask >> i & 1] if rows else []
    return len({tuple(r[i] for i in cols) for r in rows})


def fds(rows, n):
    found = []
    for size in range(n):
        for picked in combinations(range(n), size):
            x = sum(1 << i for i in picked)
            for a in range(n):
                if x >> a & 1 or any(b == a and y & x == y for y, b in found):
                    continue
                if count(rows, x) == count(rows, x | 1 << a):
                    found.append((x, a))
    return set(found)


def uccs(rows, n):
    found = []
    for size in range(n + 1):
        for picked in combinations(range(n), size):
            x = sum(1 << i for i in picked)
            if not any(y & x == y for y in found) and count(rows, x) == len(rows):
                found.append(x)
    return set(found)


def agree(rows, n):
    return {sum(1 << i for i in range(n) if a[i] == b[i]) for a, b in combinations(rows, 2)}


def swap(rows, context, a, b, descending=False):
    key = lambda v: (v is not None, v if v is not None else 0)
    for r in rows:
        for s in rows:
            if all(r[i] == s[i] for i in context) and key(r[a]) < key(s[a]):
                if key(r[b]) < key(s[b]) if descending else key(r[b]) > key(s[b]):
                    return True
    return False


def ods(rows, n, descending=False):
    found = []
    for size in range(n - 1):
        for x in combinations(range(n), size):
            m = sum(1 << i for i in x)
            rest = [i for i in range(n) if i not in x]
            for a, b in combinations(rest, 2):
                if any(p == a and q == b and y & m == y for y, p, q in found):
                    continue
                if count(rows, m) in (count(rows, m | 1 << a), count(rows, m | 1 << b)):
                    continue
                if not swap(rows, x, a, b, descending):
                    found.append((m, a, b))
    return set(found)
