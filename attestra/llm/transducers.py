"""Weighted finite-state transducers over small alphabets: arcs, composition by rule, and a reader of sequences.

A transducer reads a symbol in a state and writes a symbol, with a weight and a next state; a pair without an arc keeps the
symbol and the state, with weight 1. It is deterministic, so that a sequence has one path, whose weights belong to the
symbols they are written with. `compose` gives the transducer that feeds what one writes to the next. A transducer may
read backwards, which lets it act on what follows.

Defined cases: an empty sequence gives an empty one; symbols of any kind that hashes are allowed; sequences of any length
are read in one pass with one state.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable

Symbol, State = Hashable, Hashable


class Transducer:
    """arcs: (state, symbol read) -> (symbol written, weight, next state)."""

    def __init__(self, start: State, arcs: dict[tuple[State, Symbol], tuple[Symbol, float, State]]) -> None:
        self.start, self.arcs = start, arcs

    def step(self, state: State, symbol: Symbol) -> tuple[Symbol, float, State]:
        return self.arcs.get((state, symbol), (symbol, 1.0, state))


class Composed(Transducer):
    """Two transducers, the second reading what the first writes. Its states are pairs, its arcs the composed ones, made
    when they are first needed."""

    def __init__(self, first: Transducer, second: Transducer) -> None:
        super().__init__((first.start, second.start), {})
        self.first, self.second = first, second

    def step(self, state: State, symbol: Symbol) -> tuple[Symbol, float, State]:
        arc = self.arcs.get((state, symbol))
        if arc is None:
            between, weight, left = self.first.step(state[0], symbol)
            written, more, right = self.second.step(state[1], between)
            arc = self.arcs[state, symbol] = (written, weight * more, (left, right))
        return arc


def compose(*transducers: Transducer) -> Transducer:
    """The transducers one after the other, as one."""
    whole = transducers[0]
    for following in transducers[1:]:
        whole = Composed(whole, following)
    return whole


def read(transducer: Transducer, symbols: list[Symbol], weights: list[float], backwards: bool = False) -> list[Symbol]:
    """What it writes for symbols. weights, one for each, are multiplied by those of the path."""
    state, step, out = transducer.start, transducer.step, list(symbols)
    places: Iterable[int] = range(len(symbols) - 1, -1, -1) if backwards else range(len(symbols))
    for i in places:
        out[i], weight, state = step(state, out[i])
        if weight != 1.0:
            weights[i] *= weight
    return out


def within(span: int, marks: Iterable[Symbol], rules: dict[Symbol, tuple[Symbol, float]], ends: Iterable[Symbol], alphabet: Iterable[Symbol]) -> Transducer:
    """Acts for `span` symbols after one of marks: writes and weighs by rules what it reads there. ends begin anew. What
    a rule has written may itself be a mark."""
    marks, ends, arcs = frozenset(marks), frozenset(ends), {}
    for symbol in alphabet:
        for left in range(span + 1):
            written, weight = rules.get(symbol, (symbol, 1.0)) if left else (symbol, 1.0)
            following = 0 if symbol in ends else span if symbol in marks else max(0, left - 1)
            arcs[left, symbol] = (written, weight, following)
    return Transducer(0, arcs)


def between(opening: Iterable[Symbol], closing: Iterable[Symbol], rules: dict[Symbol, tuple[Symbol, float]], ends: Iterable[Symbol]) -> Transducer:
    """Acts from one of opening to one of closing or of ends."""
    arcs = {}
    for symbol in opening:
        arcs[False, symbol] = (symbol, 1.0, True)
    for symbol in (*closing, *ends):
        arcs[True, symbol] = (symbol, 1.0, False)
    for symbol, (written, weight) in rules.items():
        arcs[True, symbol] = (written, weight, True)
    return Transducer(False, arcs)
