"""Regular expressions to one minimal deterministic byte automaton for many rules.

The syntax is what secret rules need: ASCII literals, `[...]` classes with ranges and `^`, `\\xHH` and escaped
signs, groups, `|`, `?`, `*`, `+`, `{n}`, `{n,}`, `{n,m}`. A rule's automaton is built as a tree, then as a
nondeterministic automaton, and all rules together, each free to start at every byte or at the first one only, read forward or backward, are made
deterministic by subset construction and minimised by partition refinement over byte classes.
"""

from __future__ import annotations

EPS = -1


class _Parser:
    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def either(self):
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("or", branches)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("and", parts)

    def repeated(self):
        node = self.atom()
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            if sign == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                least, most = int(low), int(low) if not comma else int(high) if high else None
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
            node = ("times", node, least, most)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            node = self.either()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.p}")
            return node
        if c == "[":
            return ("set", self.folded(self.members()))
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", self.folded({self.escaped() if c == "\\" else ord(c)}))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def members(self) -> set[int]:
        out, other = set(), self.peek() == "^"
        if other:
            self.take()
        while (c := self.take()) != "]":
            low = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                d = self.take()
                out.update(range(low, (self.escaped() if d == "\\" else ord(d)) + 1))
            else:
                out.add(low)
        return set(range(256)) - out if other else out

    def folded(self, members: set[int]) -> frozenset[int]:
        if not self.fold:
            return frozenset(members)
        return frozenset(members | {b ^ 32 for b in members if chr(b).isalpha() and b < 128})


def parse(pattern: str, fold: bool = False):
    """The tree of a pattern; fold: ASCII letters stand for both cases."""
    parser = _Parser(pattern, fold)
    tree = parser.either()
    if parser.i != len(pattern):
        raise ValueError(f"cannot read {pattern}")
    return tree


def cut(tree, keep: int = 1):
    """The tree without needless repetitions at its end: a match of it starts wherever one of the tree starts. A tree that is one repeated
    set of bytes is cut to `keep` of them, for it has no shorter match to tell from the start of a longer one."""
    if tree[0] == "and" and tree[1] and tree[1][-1][0] == "times" and tree[1][-1][3] is None:
        _, part, least, _ = tree[1][-1]
        n = max(least, keep) if len(tree[1]) == 1 and part[0] == "set" else least
        return ("and", [*tree[1][:-1], ("times", part, n, n)])
    return tree


def _turned(tree):
    """The tree that reads the same texts backward."""
    kind = tree[0]
    if kind == "and":
        return ("and", [_turned(t) for t in reversed(tree[1])])
    if kind == "or":
        return ("or", [_turned(t) for t in tree[1]])
    return ("times", _turned(tree[1]), *tree[2:]) if kind == "times" else tree


class _Nfa:
    def __init__(self):
        self.edges: list[list[tuple[frozenset[int] | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def add(self, node, at: int) -> int:
        """Builds node from state `at`; returns its end."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.edges[at].append((node[1], end))
            return end
        if kind == "and":
            for part in node[1]:
                at = self.add(part, at)
            return at
        if kind == "or":
            end = self.state()
            for branch in node[1]:
                start = self.state()
                self.edges[at].append((None, start))
                self.edges[self.add(branch, start)].append((None, end))
            return end
        _, part, least, most = node
        for _ in range(least):
            at = self.add(part, at)
        if most is None:
            loop = self.state()
            self.edges[at].append((None, loop))
            self.edges[self.add(part, loop)].append((None, loop))
            return loop
        end = self.state()
        for _ in range(most - least):
            self.edges[at].append((None, end))
            at = self.add(part, at)
        self.edges[at].append((None, end))
        return end


def compile_rules(rules: list[tuple[str, bool]], most_states: int = 60_000) -> tuple[list[list[int]], list[int]]:
    """[(pattern, either case)] -> (transitions by state and byte, bit mask of the rules that a state accepts).

    State 0 is the start. After each byte the state accepts a rule if some match of it ends there."""
    return compile_trees([parse(*r) for r in rules], most_states=most_states)


def compile_trees(trees: list, free: bool = True, backward: bool = False, most_states: int = 60_000) -> tuple[list[list[int]], list[int]]:
    """As compile_rules; free: a match may start at each byte, else at the first one only; backward: the bytes come from the end of the text to its start."""
    nfa = _Nfa()
    start, accepts = nfa.state(), {}
    for k, tree in enumerate(trees):
        first = nfa.state()
        nfa.edges[start].append((None, first))
        accepts[nfa.add(_turned(tree) if backward else tree, first)] = 1 << k

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for on, to in nfa.edges[todo.pop()]:
                if on is None and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(s for s in seen if s in accepts or any(on is not None for on, _ in nfa.edges[s]))

    # bytes that no rule tells apart share a class
    sets = {on for edges in nfa.edges for on, _ in edges if on is not None}
    signature = {b: tuple(b in s for s in sets) for b in range(256)}
    kinds = {sig: i for i, sig in enumerate(dict.fromkeys(signature.values()))}
    class_of = [kinds[signature[b]] for b in range(256)]
    sample = {c: b for b, c in enumerate(class_of)}

    home = closure({start})
    number, table, todo = {home: 0}, [], [home]
    while todo:
        here = todo.pop(0)
        row = []
        for c in range(len(kinds)):
            moved = {to for s in here for on, to in nfa.edges[s] if on is not None and sample[c] in on}
            there = closure(moved) | home if free else closure(moved)
            if there not in number:
                number[there] = len(number)
                if len(number) > most_states:
                    raise ValueError("the rules need too many states")
                todo.append(there)
            row.append(number[there])
        table.append(row)
    masks = [0] * len(number)
    for states, n in number.items():
        for s in states:
            masks[n] |= accepts.get(s, 0)

    # partition refinement: states stay together while their masks and the parts they lead to agree
    part = {m: i for i, m in enumerate(dict.fromkeys(masks))}
    group, n_groups = [part[m] for m in masks], len(part)
    while True:
        seen: dict[tuple, int] = {}
        finer = [seen.setdefault((group[s], *(group[t] for t in table[s])), len(seen)) for s in range(len(table))]
        if len(seen) == n_groups:
            break
        group, n_groups = finer, len(seen)
    rows, out_masks = [[] for _ in range(n_groups)], [0] * n_groups
    for s, g in enumerate(group):
        if not rows[g]:
            rows[g], out_masks[g] = [group[table[s][class_of[b]]] for b in range(256)], masks[s]
    # state 0 first
    swap = group[0]
    order = [swap, *(g for g in range(n_groups) if g != swap)]
    place = {g: i for i, g in enumerate(order)}
    return [[place[t] for t in rows[g]] for g in order], [out_masks[g] for g in order]
