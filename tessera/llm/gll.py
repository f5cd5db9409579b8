"""Generalised LL recognition with a graph-structured stack.

A grammar in extended BNF becomes one recursive transition network.  All
alternatives - and the rules of several dialects or contents side by side - are
followed at once, token by token.  What is still possible after a token is a
front: the states reached, each with the stack node it returns to.  A stack node
is the set of its callers, so calls of a nonterminal at one position share a node,
stacks that differ only further down share their top, and equal stacks met at
other positions or in other files are the same node.  Hence a front does not
depend on where it was reached, and the step from a front by a token kind is
worked out once and then looked up: a run over n tokens takes n look-ups.

Notation: ``Name: alternative | alternative`` with ``( ) * + ?``; ``'x'`` is the
token kind x, ``Name`` a nonterminal, ``@p`` a zero-width condition on the next
token, and ``{:A}``, ``(:A)``, ``[:A]``, ``<:A>`` a bracketed group whose content
derives A.  The stack of a left-recursive rule is a cycle, whose nodes only a
position tells apart; grammars with such rules are run by descriptors.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_TOKEN = re.compile(r"\s*(?:(?P<group>[({\[<]):(?P<inside>\w+)[)}\]>]|'(?P<lit>[^']+)'|@(?P<pred>\w+)|(?P<name>\w+)|(?P<op>[()*+?|]))")
END = -1
#: Fronts kept; with more, the table starts anew before the next file.
FRONTS = 50_000


class Front(dict):
    """Token kind to the next front; fills itself.  A front without states stays so."""

    __slots__ = ("net", "states", "_accepts")

    def __init__(self, net: "Network", states: dict[int, frozenset]):
        self.net, self.states, self._accepts = net, states, None

    def __missing__(self, kind: int) -> "Front":
        self[kind] = out = self.net.advance(self.states, kind)[0] if self.states else self
        return out

    @property
    def accepts(self) -> frozenset[str]:
        """The nonterminals of the start that derive exactly the tokens so far."""
        if self._accepts is None:
            self._accepts = self.net.advance(self.states, END)[1]
        return self._accepts


class Network:
    """``matches(kind, terminal)`` and ``holds(kind, predicate)`` say what a token kind is; kind END is the end."""

    def __init__(self, text: str, matches: Callable[[int, tuple], bool], holds: Callable[[int, str], bool]):
        self.matches, self.holds = matches, holds
        self.eps: list[list[int]] = []
        self.arcs: list[list[tuple]] = []
        self.entry: dict[str, int] = {}
        self.exit: dict[str, int] = {}
        rules: dict[str, str] = {}
        name = None
        for line in text.splitlines():
            line = line.split("  #")[0].rstrip()
            head = re.match(r"(\w+):\s(.*)", line)
            if head and not line[0].isspace():
                name = head[1]
                rules[name] = head[2]
            elif line.strip():
                rules[name] += " " + line.strip()
        self.names = set(rules)
        for name in rules:
            self.entry[name], self.exit[name] = self._state(), self._state()
        self.exits = set(self.exit.values())
        for name, body in rules.items():
            self.rest = list(_TOKEN.finditer(body))
            a, b = self._choice()
            if self.rest:
                raise ValueError(f"{name}: {self.rest[0][0]}")
            self.eps[self.entry[name]].append(a)
            self.eps[b].append(self.exit[name])
        self.closed = [self._closure([s]) for s in range(len(self.eps))]
        self._first()
        self._order()
        self.starts: dict[tuple[str, int], bool] = {}
        self.empty: dict[tuple[str, int], bool] = {}
        self.cores: dict[frozenset[int], int] = {}
        self.members: list[frozenset[int]] = []
        self.tail: list[bool] = []
        self.begin = {n: self._core([self.entry[n]]) for n in self.names}
        self.steps: dict[tuple[int, int], tuple] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all fronts; those handed out must not be used any more."""
        self.nodes: dict[frozenset, int] = {}
        self.callers: list[frozenset] = []
        self.fronts: dict[frozenset, Front] = {}
        self.begun: dict[tuple[str, ...], Front] = {}

    # -- the network --------------------------------------------------------

    def _state(self) -> int:
        self.eps.append([])
        self.arcs.append([])
        return len(self.eps) - 1

    def _choice(self) -> tuple[int, int]:
        a, b = self._state(), self._state()
        while True:
            s, e = self._sequence()
            self.eps[a].append(s)
            self.eps[e].append(b)
            if not self.rest or self.rest[0]["op"] != "|":
                return a, b
            self.rest.pop(0)

    def _sequence(self) -> tuple[int, int]:
        start = end = self._state()
        while self.rest and self.rest[0]["op"] not in ("|", ")"):
            m = self.rest.pop(0)
            if m["op"] == "(":
                a, b = self._choice()
                self.rest.pop(0)
            else:
                a, b = self._state(), self._state()
                if m["group"]:
                    self.arcs[a].append(("t", (m["group"], m["inside"]), b))
                elif m["lit"]:
                    self.arcs[a].append(("t", ("", m["lit"]), b))
                elif m["pred"]:
                    self.arcs[a].append(("p", m["pred"], b))
                else:
                    if m["name"] not in self.names:
                        raise ValueError(m["name"])
                    self.arcs[a].append(("c", m["name"], b))
            if self.rest and self.rest[0]["op"] in ("*", "+", "?"):
                op = self.rest.pop(0)["op"]
                x, y = self._state(), self._state()
                self.eps[x].append(a)
                self.eps[b].append(y)
                if op != "+":
                    self.eps[x].append(y)
                if op != "?":
                    self.eps[b].append(a)
                a, b = x, y
            self.eps[end].append(a)
            end = b
        return start, end

    def _closure(self, states: Iterable[int]) -> list[int]:
        seen = set(states)
        todo = list(seen)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return list(seen)

    def _edge(self, name: str) -> tuple[set, set[str], bool]:
        """Terminals and nonterminals at the left edge of a rule, and whether its end may be reached without a token."""
        reach, todo, terms, calls = set(), [self.entry[name]], set(), set()
        while todo:
            for c in self.closed[todo.pop()]:
                if c in reach:
                    continue
                reach.add(c)
                for how, what, to in self.arcs[c]:
                    if how == "t":
                        terms.add(what)
                    elif how == "p":
                        todo.append(to)
                    else:
                        calls.add(what)
                        if what in self.nullable:
                            todo.append(to)
        return terms, calls, self.exit[name] in reach

    def _first(self) -> None:
        self.nullable: set[str] = set()
        self.first: dict[str, set] = {n: set() for n in self.names}
        changed = True
        while changed:
            changed = False
            for name in self.names:
                terms, calls, null = self._edge(name)
                terms = terms.union(*(self.first[c] for c in calls))
                if terms != self.first[name] or null != (name in self.nullable):
                    changed = True
                    self.first[name] = terms
                    if null:
                        self.nullable.add(name)

    def _order(self) -> None:
        """Nonterminals, each before those that it may begin with."""
        left = {n: self._edge(n)[1] for n in self.names}
        self.cyclic = False
        done: dict[str, bool] = {}
        order: list[str] = []

        def visit(name: str) -> None:
            self.cyclic = self.cyclic or done.get(name) is False
            if name not in done:
                done[name] = False
                for c in sorted(left[name]):
                    visit(c)
                done[name] = True
                order.append(name)

        for n in sorted(self.names):
            visit(n)
        self.rank = {n: i for i, n in enumerate(reversed(order))}

    # -- single states ------------------------------------------------------

    def _core(self, states: Iterable[int]) -> int:
        """A number for a set of states of one rule."""
        key = frozenset(states)
        found = self.cores.get(key)
        if found is None:
            found = self.cores[key] = len(self.members)
            self.members.append(key)
            all_ = self._closure(key)
            self.tail.append(all(not self.arcs[c] for c in all_) and any(c in self.exits for c in all_))
        return found

    def _may_start(self, name: str, kind: int) -> bool:
        key = (name, kind)
        if key not in self.starts:
            self.starts[key] = kind != END and any(self.matches(kind, t) for t in self.first[name])
        return self.starts[key]

    def _reach(self, states: Iterable[int], kind: int) -> set[int]:
        """States reached without a token where the next is of this kind."""
        seen, todo = set(), list(states)
        while todo:
            for c in self.closed[todo.pop()]:
                if c in seen:
                    continue
                seen.add(c)
                for how, what, to in self.arcs[c]:
                    if how == "p" and self.holds(kind, what) or how == "c" and self._may_be_empty(what, kind):
                        todo.append(to)
        return seen

    def _may_be_empty(self, name: str, kind: int) -> bool:
        key = (name, kind)
        if key not in self.empty:
            self.empty[key] = name in self.nullable and self.exit[name] in self._reach([self.entry[name]], kind)
        return self.empty[key]

    def _step(self, core: int, kind: int) -> tuple:
        """The set of states after this kind (or None), the calls it may begin with, and whether the rule may end before it."""
        shift, calls, final = set(), {}, False
        for c in self._reach(self.members[core], kind):
            final = final or c in self.exits
            for how, what, to in self.arcs[c]:
                if how == "t":
                    if kind != END and self.matches(kind, what):
                        shift.add(to)
                elif how == "c" and self._may_start(what, kind):
                    calls.setdefault(what, set()).add(to)
        self.steps[core, kind] = out = (self._core(shift) if shift else None, [(n, self._core(t)) for n, t in calls.items()], final)
        return out

    # -- fronts -------------------------------------------------------------

    def start(self, *names: str) -> Front:
        """The front before the first token, for all these nonterminals at once."""
        if self.cyclic:
            raise ValueError("a left-recursive grammar has no fronts")
        found = self.begun.get(names)
        if found is None:
            states: dict[int, set] = {}
            for n in names:
                states.setdefault(self.begin[n], set()).add((END, n))
            found = self.begun[names] = self._front(states)
        return found

    def _front(self, states: dict[int, set]) -> Front:
        fixed = {s: frozenset(c) for s, c in states.items()}
        key = frozenset(fixed.items())
        found = self.fronts.get(key)
        if found is None:
            found = self.fronts[key] = Front(self, fixed)
        return found

    def _node(self, callers: set) -> int:
        key = frozenset(callers)
        found = self.nodes.get(key)
        if found is None:
            found = self.nodes[key] = len(self.callers)
            self.callers.append(key)
        return found

    def advance(self, states: dict[int, frozenset], kind: int) -> tuple[Front | None, frozenset[str]]:
        """The front after a token of this kind, and the nonterminals of the start that end before it."""
        steps = self.steps
        here: dict[int, set] = {s: set(c) for s, c in states.items()}
        ended = set()
        todo = list(here)
        while todo:  # ends of rules: back to their callers
            s = todo.pop()
            if not (steps.get((s, kind)) or self._step(s, kind))[2]:
                continue
            for back, node in list(here[s]):
                if back == END:
                    ended.add(node)
                    continue
                known = here.setdefault(back, set())
                more = self.callers[node] - known
                if more:
                    known |= more
                    todo.append(back)
        if kind == END:
            return None, frozenset(ended)
        after: dict[int, set] = {}
        calls: dict[str, set] = {}

        def follow(core: int, callers: set) -> None:
            shift, called, _ = steps.get((core, kind)) or self._step(core, kind)
            if shift is not None:
                after.setdefault(shift, set()).update(callers)
            for name, back in called:
                if self.tail[back]:  # nothing is left to do behind this call
                    calls.setdefault(name, set()).update(callers)
                else:
                    calls.setdefault(name, set()).add((back, self._node(callers)))

        for s, callers in here.items():
            follow(s, callers)
        while calls:
            name = min(calls, key=self.rank.__getitem__)
            follow(self.begin[name], calls.pop(name))
        return self._front(after), frozenset(ended)

    def derives(self, name: str, kinds: Iterable[int]) -> bool:
        """Whether the nonterminal derives exactly these tokens."""
        if self.cyclic:
            return self.descends(name, tuple(kinds))
        front = self.start(name)
        for k in kinds:
            front = front[k]
        return name in front.accepts

    def descends(self, name: str, kinds: tuple[int, ...]) -> bool:
        """The same for any grammar, by descriptors (state, node, position) whose nodes belong to positions."""
        n = len(kinds)
        root: tuple[list, set] = ([], set())
        nodes = {(name, 0): root}
        todo = [(self.entry[name], root, 0)]
        seen = set()
        while todo:
            state, node, at = todo.pop()
            if (state, id(node), at) in seen:
                continue
            seen.add((state, id(node), at))
            kind = kinds[at] if at < n else END
            for c in self.closed[state]:
                if c in self.exits and at not in node[1]:
                    if node is root and at == n:
                        return True
                    node[1].add(at)
                    todo += [(to, caller, at) for to, caller in node[0]]
                for how, what, to in self.arcs[c]:
                    if how == "t":
                        if kind != END and self.matches(kind, what):
                            todo.append((to, node, at + 1))
                    elif how == "p":
                        if self.holds(kind, what):
                            todo.append((to, node, at))
                    elif what in self.nullable or self._may_start(what, kind):
                        child = nodes.get((what, at))
                        if child is None:
                            child = nodes[what, at] = ([], set())
                            todo.append((self.entry[what], child, at))
                        child[0].append((to, node))
                        todo += [(to, node, left) for left in child[1]]
        return False
