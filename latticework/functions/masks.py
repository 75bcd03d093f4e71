"""Column sets as integer bitmasks, and the set searches on them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


def bits(mask: int) -> Iterator[int]:
    """Positions of the ones, lowest first."""
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def minimal(sets: Iterable[int]) -> list[int]:
    """The sets that contain no other of them."""
    out: list[int] = []
    for s in sorted(set(sets), key=lambda x: (x.bit_count(), x)):
        if not any(t & s == t for t in out):
            out.append(s)
    return out


def maximal(sets: Iterable[int]) -> list[int]:
    """The sets that no other of them contains."""
    out: list[int] = []
    for s in sorted(set(sets), key=lambda x: (-x.bit_count(), x)):
        if not any(s & t == s for t in out):
            out.append(s)
    return out


def hitting_sets(sets: Iterable[int], most: int | None = None, group=None) -> list[int]:
    """All minimal sets that share a member with each given set. ``most`` bounds
    their size; ``group(bit)`` allows one member of a group only. An empty set
    can't be hit: then there are none."""
    covers = [0]
    for s in minimal(sets):
        if not s:
            return []
        hit = [c for c in covers if c & s]
        grown = []
        for c in (c for c in covers if not c & s):
            if most is not None and c.bit_count() >= most:
                continue
            taken = {group(b) for b in bits(c)} if group else ()
            for b in bits(s):
                if group and group(b) in taken:
                    continue
                grown.append(c | 1 << b)
        keep = [g for g in set(grown) if not any(h & g == h for h in hit)]
        covers = hit + minimal(keep)
    return covers


def next_level(level: Iterable[int]) -> list[int]:
    """Sets one larger all of whose parts are in the level: pairs of sets that
    differ only in their highest member are joined."""
    level = set(level)
    blocks: dict[int, list[int]] = {}
    for s in level:
        blocks.setdefault(s & ~(1 << s.bit_length() - 1) if s else 0, []).append(s)
    out = []
    for block in blocks.values():
        block.sort()
        for i, a in enumerate(block):
            for b in block[i + 1 :]:
                both = a | b
                if all(both & ~(1 << k) in level for k in bits(both)):
                    out.append(both)
    return sorted(out)


def invert_agree_sets(agree: Iterable[int], n: int, most: int | None = None) -> list[tuple[int, int]]:
    """Minimal (lhs, rhs) from the agree sets of row pairs: lhs must differ
    wherever rhs does."""
    agree, full = set(agree), (1 << n) - 1
    out = []
    for a in range(n):
        differ = [full & ~s & ~(1 << a) for s in maximal(s for s in agree if not s >> a & 1)]
        out += [(lhs, a) for lhs in hitting_sets(differ, most)]
    return out


def invert_for_keys(agree: Iterable[int], n: int, most: int | None = None) -> list[int]:
    """Minimal keys from the agree sets of row pairs."""
    full = (1 << n) - 1
    return hitting_sets([full & ~s for s in maximal(agree)], most)
