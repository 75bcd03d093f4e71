from itertools import combinations

from hypothesis import given, strategies as st

from latticework.functions.masks import bits, hitting_sets, invert_agree_sets, maximal, minimal, next_level


@given(st.sets(st.integers(1, 63), max_size=8))
def test_hitting_sets_are_the_minimal_ones(sets):
    every = [x for x in range(64) if all(x & s for s in sets)]
    assert set(hitting_sets(sets)) == set(minimal(every))


@given(st.sets(st.integers(0, 63), max_size=12))
def test_minimal_and_maximal(sets):
    assert set(minimal(sets)) == {s for s in sets if not any(t != s and t & s == t for t in sets)}
    assert set(maximal(sets)) == {s for s in sets if not any(t != s and t & s == s for t in sets)}


def test_empty_set_cannot_be_hit():
    assert hitting_sets([0, 3]) == []
    assert hitting_sets([]) == [0]


def test_bounds_and_groups():
    assert set(hitting_sets([0b11, 0b1100], most=1)) == set()
    assert hitting_sets([0b01, 0b10], group=lambda b: 0) == []


def test_next_level_needs_all_parts():
    level = [sum(1 << i for i in p) for p in combinations(range(4), 2)]
    assert next_level(level) == sorted(sum(1 << i for i in p) for p in combinations(range(4), 3))
    assert next_level([0b011, 0b101]) == []
    assert list(bits(0b1010)) == [1, 3]


def test_inversion_of_no_pairs_is_the_empty_lhs():
    assert set(invert_agree_sets(set(), 2)) == {(0, 0), (0, 1)}
