from itertools import product

import pytest

from latticework.functions.predicates import OUTCOMES, Predicate, Relations, composed, implied, inverse, minimize, symmetric, text

TEST = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@pytest.mark.parametrize("op", OUTCOMES)
def test_operator_algebra(op):
    for a, b in product(range(3), repeat=2):
        assert TEST[op](a, b) != TEST[inverse(op)](a, b)
        assert TEST[op](a, b) == TEST[symmetric(op)](b, a)
        for weaker in implied(op):
            assert not TEST[op](a, b) or TEST[weaker](a, b)
    for other in OUTCOMES:
        c = composed(op, other)
        for x, y, z in product(range(4), repeat=3):
            if TEST[op](x, y) and TEST[other](y, z) and c:
                assert TEST[c](x, z)


def p(column, op):
    return Predicate(column, op, column)


def test_swap_and_text():
    assert p("a", "<").swapped() == p("a", ">")
    assert text([p("a", "<"), p("b", "=")]) == text([p("b", "="), p("a", ">")])


def test_contradictions_and_entailment():
    assert Relations([p("a", "<"), p("a", ">=")]).contradictory
    r = Relations([p("a", "<="), p("a", ">=")])
    assert r.entails(p("a", "=")) and not r.entails(p("a", "<"))
    chain = Relations([Predicate("a", "<", "b", 0, 0), Predicate("b", "<=", "c", 0, 0)])
    assert chain.entails(Predicate("a", "<", "c", 0, 0))


def test_minimize():
    wide, narrow, swapped = frozenset([p("a", "<=")]), frozenset([p("a", "<")]), frozenset([p("a", ">=")])
    assert minimize([narrow, wide, swapped, frozenset([p("b", "<"), p("b", ">")])]) == [wide] or text(minimize([narrow, wide, swapped])[0]) == text(wide)
    assert len(minimize([narrow, wide, swapped])) == 1
