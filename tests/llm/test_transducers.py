"""Composition against enumerated paths, and the grammar's rules against sentences."""

import random
from itertools import product

from attestra.llm import toxicity
from attestra.llm.transducers import Transducer, between, compose, read, within


def paths(transducer, symbols):
    """All paths by naive enumeration over the arcs: (written, product of weights)."""
    found = [(transducer.start, (), 1.0)]
    for x in symbols:
        following = []
        for state, written, weight in found:
            arcs = [arc for (q, y), arc in transducer.arcs.items() if q == state and y == x] or [(x, 1.0, state)]
            following += [(to, (*written, y), weight * w) for y, w, to in arcs]
        found = following
    return [(written, round(weight, 9)) for _, written, weight in found]


def drawn(rng, states=3):
    return Transducer(0, {(q, x): (rng.choice("abc"), rng.choice([0.5, 1.0, 2.0]), rng.randrange(states)) for q in range(states) for x in "abc" if rng.random() < 0.7})


def test_composition_equals_enumerated_paths():
    rng = random.Random(1)
    for _ in range(25):
        parts = [drawn(rng) for _ in range(3)]
        whole = compose(*parts)
        for n in range(5):
            for symbols in product("abc", repeat=n):
                want = [(symbols, 1.0)]
                for part in parts:
                    want = [(out, round(w * more, 9)) for given, w in want for out, more in paths(part, given)]
                weights = [1.0] * n
                written = tuple(read(whole, list(symbols), weights))
                total = 1.0
                for w in weights:
                    total *= w
                assert [(written, round(total, 9))] == want


def test_backwards_is_forwards_mirrored():
    rng = random.Random(2)
    for _ in range(30):
        part, symbols = drawn(rng), rng.choices("abc", k=6)
        a, b = [1.0] * 6, [1.0] * 6
        assert read(part, symbols, a, backwards=True)[::-1] == read(part, symbols[::-1], b) and a[::-1] == b


def test_within_and_between_equal_brute_force():
    rules = {"h": ("H", 0.5)}
    near, inside = within(2, ["m"], rules, ["."], "hmox.H()"), between(["("], [")"], rules, ["."])
    for symbols in product("hmo.", repeat=6):
        want = []
        for i, x in enumerate(symbols):
            before = symbols[max(0, i - 2) : i]
            before = before[len(before) - 1 - before[::-1].index(".") + 1 :] if "." in before else before
            want.append("H" if x == "h" and "m" in before else x)
        assert read(near, list(symbols), [1.0] * 6) == want
    for symbols in product("h().", repeat=6):
        want, on = [], False
        for x in symbols:
            on = True if x == "(" else False if x in ")." else on
            want.append("H" if x == "h" and on else x)
        assert read(inside, list(symbols), [1.0] * 6) == want
    assert read(near, [], []) == []


def test_scope_of_clauses_and_quotations():
    g = toxicity.Grammar({"=idiot": 4.0})
    score = lambda t: round(g.match(t)[0], 6)
    assert score("this idiot came") == score('a 5" pipe. it is long. this idiot came') == 4.0  # a lone mark opens nothing
    assert score('"this idiot came') == 4.0 and score('"this\nidiot" came') == 4.0  # a line ends a quotation
    assert score('she wrote it: "this idiot came"') == score("an « idiot » here") == score("an „idiot“ here") == 4.0 * toxicity.REPORTED
    assert score("idiot. we left") == score("idiot. you left") == 4.0  # a clause ends a target's reach
    assert score("you're an idiot") == score("idiot, you") == score("you idiot, you") == 4.0 * toxicity.TARGETED
    assert score("idiot he is not") == 4.0 * toxicity.TARGETED * toxicity.NEGATED == score("he is not idiot")
    assert score("the idiot's friend") == 4.0 and score("not. idiot") == 4.0
    assert score("i will hurt you") == toxicity.THREAT * toxicity.TARGETED and score("he said i will hurt you") == toxicity.THREAT * toxicity.TARGETED * toxicity.REPORTED
    assert score("idiot " * 40) == 160.0  # no cap
