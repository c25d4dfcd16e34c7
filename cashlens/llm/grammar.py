"""LR parsing with a graph-structured stack: tables of a grammar, and the stacks that symbols lead to."""

from __future__ import annotations

END = "$"
Grammar = list[tuple[str, tuple[str, ...]]]


class Tables:
    """SLR(1) tables with every action of a conflict: the grammar may be any context-free one."""

    def __init__(self, grammar: Grammar):
        self.rules = [("", (grammar[0][0],)), *grammar]
        self.names = {left for left, _ in self.rules}
        self.terminals = sorted({s for _, right in grammar for s in right} - self.names)
        self._follow = self._follows()
        self.shift: list[dict[str, int]] = []
        self.reduce: list[dict[str, list[int]]] = []
        self._build()

    def _firsts(self) -> tuple[set[str], dict[str, set[str]]]:
        empty: set[str] = set()
        first: dict[str, set[str]] = {n: set() for n in self.names}
        changed = True
        while changed:
            changed = False
            for left, right in self.rules:
                found: set[str] = set()
                for symbol in right:
                    found |= first.get(symbol, {symbol})
                    if symbol not in empty:
                        break
                else:
                    changed |= left not in empty
                    empty.add(left)
                changed |= not found <= first[left]
                first[left] |= found
        return empty, first

    def _follows(self) -> dict[str, set[str]]:
        empty, first = self._firsts()
        follow: dict[str, set[str]] = {n: set() for n in self.names}
        follow[""].add(END)
        changed = True
        while changed:
            changed = False
            for left, right in self.rules:
                after = set(follow[left])
                for symbol in reversed(right):
                    if symbol in self.names:
                        changed |= not after <= follow[symbol]
                        follow[symbol] |= after
                        after = first[symbol] | (after if symbol in empty else set())
                    else:
                        after = {symbol}
        return follow

    def _closure(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        items, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            right = self.rules[rule][1]
            if dot < len(right):
                new = {(i, 0) for i, (left, _) in enumerate(self.rules) if left == right[dot]} - items
                items |= new
                todo += new
        return frozenset(items)

    def _build(self) -> None:
        states = [self._closure({(0, 0)})]
        for state in states:  # grows
            moves: dict[str, set[tuple[int, int]]] = {}
            reductions: dict[str, list[int]] = {}
            for rule, dot in sorted(state):
                left, right = self.rules[rule]
                if dot < len(right):
                    moves.setdefault(right[dot], set()).add((rule, dot + 1))
                else:
                    for symbol in self._follow[left]:
                        reductions.setdefault(symbol, []).append(rule)
            shift = {}
            for symbol, items in sorted(moves.items()):
                target = self._closure(items)
                if target not in states:
                    states.append(target)
                shift[symbol] = states.index(target)
            self.shift.append(shift)
            self.reduce.append(reductions)


class Stacks:
    """The graph of all stacks reached so far. A stack is a node: a state on top of another node.

    Stacks with equal contents are one node, and all that lies below a top is shared. Where a symbol leads is kept, so
    the graph is walked once for each node and symbol.
    """

    def __init__(self, grammar: Grammar):
        self.tables = Tables(grammar)
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self._known = {(0, -1): 0}
        self._steps: dict[tuple[int, str], tuple[int, ...]] = {}

    def _push(self, state: int, below: int) -> int:
        if (state, below) not in self._known:
            self._known[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self._known[state, below]

    def _reduced(self, node: int, symbol: str) -> set[int]:
        """The node and all that reductions before `symbol` make of it; a set ends a cycle of empty rules."""
        found, todo = {node}, [node]
        while todo:
            top = todo.pop()
            for rule in self.tables.reduce[self.nodes[top][0]].get(symbol, []):
                left, right = self.tables.rules[rule]
                below = top
                for _ in right:
                    below = self.nodes[below][1]
                if left and left in self.tables.shift[self.nodes[below][0]]:
                    to = self._push(self.tables.shift[self.nodes[below][0]][left], below)
                    if to not in found:
                        found.add(to)
                        todo.append(to)
        return found

    def step(self, node: int, symbol: str) -> tuple[int, ...]:
        """Nodes after the terminal `symbol`."""
        if (node, symbol) not in self._steps:
            tops = sorted(self._reduced(node, symbol))
            to = [self._push(self.tables.shift[self.nodes[t][0]][symbol], t) for t in tops if symbol in self.tables.shift[self.nodes[t][0]]]
            self._steps[node, symbol] = tuple(dict.fromkeys(to))
        return self._steps[node, symbol]

    def accepts(self, node: int) -> bool:
        """Whether the input may end here."""
        return any(0 in self.tables.reduce[self.nodes[n][0]].get(END, []) for n in self._reduced(node, END))
