"""Packrat parsing-expression grammars over tokens.

A grammar is text; it is compiled once into Python functions that return the place after what they matched, or -1. Choices
are ordered; an alternative whose first token can't match is skipped. Rules marked ``!`` keep their results by place, which is
what makes the parser a packrat parser: wherever alternatives try the same rule at the same place, it is parsed once.
Rules marked ``@`` record the places where they matched. A second compilation also notes the furthest failure; it runs only
over inputs that the first rejects.

    rule = a 'b' (c / d)* e? &f !g     sequence, ordered choice, repetition, option, lookahead
    'x'      a token of that kind      "x"      a NAME with that text
    #nl #nonl #joined                  a line end before the token, none, no space before the token
    #arrow                             the bracket at this place is closed before an arrow
    list<x>                            x (',' x)*        'any'   one token that is no bracket
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

_TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<lit>'[^']+')|(?P<soft>\"[^\"]+\")|(?P<pred>#\w+)|(?P<op>[/()*+?&!]|<[^>]*>))")
_RULE = re.compile(r"^(\w+)([!@]*)\s*=", re.M)
sys.setrecursionlimit(max(sys.getrecursionlimit(), 60_000))

ANY = None  # a first set that can't be told


class Node:
    """A parsing expression."""

    def __init__(self, op: str, *args) -> None:
        self.op, self.args = op, args


def _parse_expression(text: str) -> Node:
    tokens, pos = [], 0
    while pos < len(text.rstrip()):
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(f"bad grammar: {text[pos : pos + 40]!r}")
        tokens.append((m.lastgroup, m.group(m.lastgroup)))
        pos = m.end()
    tokens.append(("end", ""))
    at = 0

    def choice() -> Node:
        nonlocal at
        items = [sequence()]
        while tokens[at] == ("op", "/"):
            at += 1
            items.append(sequence())
        return items[0] if len(items) == 1 else Node("choice", items)

    def sequence() -> Node:
        items = []
        while tokens[at][0] != "end" and tokens[at][1] not in ("/", ")"):
            items.append(prefix())
        return items[0] if len(items) == 1 else Node("seq", items)

    def prefix() -> Node:
        nonlocal at
        if tokens[at][0] == "op" and tokens[at][1] in "&!":
            kind = tokens[at][1]
            at += 1
            return Node("and" if kind == "&" else "not", prefix())
        out = primary()
        while tokens[at][0] == "op" and tokens[at][1] in "*+?":
            kind = tokens[at][1]
            at += 1
            out = Node({"*": "star", "+": "plus", "?": "opt"}[kind], out)
        return out

    def primary() -> Node:
        nonlocal at
        kind, value = tokens[at]
        at += 1
        if kind == "name":
            if value == "list" and tokens[at][1].startswith("<"):
                inner = _parse_expression(tokens[at][1][1:-1])
                at += 1
                return Node("seq", [inner, Node("star", Node("seq", [Node("lit", ","), inner]))])
            return Node("ref", value)
        if kind == "lit":
            return Node("lit", value[1:-1])
        if kind == "soft":
            return Node("soft", value[1:-1])
        if kind == "pred":
            return Node("pred", value[1:])
        if value == "(":
            out = choice()
            at += 1
            return out
        raise ValueError(f"bad grammar near {value!r}")

    return choice()


@dataclass
class Tokens:
    """The tokens of a text: kinds, texts, offsets, and what stands before them. The last kind is ``$``.

    A ``BAD`` kind stands where the lexer could not go on; ``problem`` says why.
    """

    kinds: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    newline: list[bool] = field(default_factory=list)
    joined: list[bool] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)
    problem: str = ""

    def add(self, kind: str, text: str, offset: int, newline: bool = False, joined: bool = False) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.offsets.append(offset)
        self.newline.append(newline)
        self.joined.append(joined)


class Grammar:
    """A compiled grammar. ``parse`` tells whether its first rule matches all tokens."""

    def __init__(self, text: str) -> None:
        text = re.sub(r"(?m)^\s*--.*$", "", text)
        heads = list(_RULE.finditer(text))
        self.rules: dict[str, Node] = {}
        self.memo, self.marked = set(), set()
        for m, after in zip(heads, [*heads[1:], None]):
            self.rules[m[1]] = _parse_expression(text[m.end() : after.start() if after else len(text)])
            self.memo |= {m[1]} if "!" in m[2] else set()
            self.marked |= {m[1]} if "@" in m[2] else set()
        self.start = heads[0][1]
        self._first: dict[str, tuple[frozenset[str] | None, bool]] = {n: (frozenset(), False) for n in self.rules}
        while True:
            now = {n: self.first(e) for n, e in self.rules.items()}
            if now == self._first:
                break
            self._first = now
        self.fast, self.slow = self._compiled(False), self._compiled(True)

    def first(self, e: Node) -> tuple[frozenset[str] | None, bool]:
        """The kinds an expression can begin with (ANY if unknown), and whether it can match nothing."""
        op = e.op
        if op == "lit":
            return (ANY if e.args[0] == "any" else frozenset([e.args[0]])), False
        if op == "soft":
            return frozenset(["NAME"]), False
        if op in ("pred", "and", "not"):
            return frozenset(), True
        if op == "ref":
            return self._first[e.args[0]]
        if op in ("star", "opt"):
            return self.first(e.args[0])[0], True
        if op == "plus":
            return self.first(e.args[0])
        if op == "choice":
            sets = [self.first(x) for x in e.args[0]]
            return (ANY if any(s is ANY for s, _ in sets) else frozenset().union(*(s for s, _ in sets))), any(n for _, n in sets)
        out: frozenset[str] = frozenset()
        for x in e.args[0]:
            s, nullable = self.first(x)
            if s is ANY:
                return ANY, False
            out |= s
            if not nullable:
                return out, False
        return out, True

    def _compiled(self, slow: bool) -> dict:
        lines: list[str] = []
        self._sets: dict[frozenset[str], str] = {}
        fresh = iter(range(10**9))

        def miss(i: str) -> str:
            return f"note({i})" if slow else "pass"

        def guard(s: frozenset[str] | None, nullable: bool, i: str) -> str | None:
            if s is ANY or nullable:
                return None
            if len(s) == 1:
                return f"T[{i}] == {next(iter(s))!r}"
            return f"T[{i}] in {self._sets.setdefault(s, f'S{len(self._sets)}')}"

        def emit(e: Node, i: str, out: str, pad: str) -> None:
            """Code that sets ``out`` to the place after e at ``i``, or -1. ``i`` is not changed."""
            op = e.op
            put = lambda x: lines.append(pad + x)
            if op == "lit":
                put(f"if T[{i}] {'not in BRACKETS' if e.args[0] == 'any' else f'== {e.args[0]!r}'}: {out} = {i} + 1")
                put("else:")
                put(f"    {out} = -1; {miss(i)}")
            elif op == "soft":
                put(f"if T[{i}] == 'NAME' and X[{i}] == {e.args[0]!r}: {out} = {i} + 1")
                put("else:")
                put(f"    {out} = -1; {miss(i)}")
            elif op == "pred":
                test = {"nl": f"N[{i}]", "nonl": f"not N[{i}]", "joined": f"J[{i}]", "arrow": f"A[{i}]"}[e.args[0]]
                put(f"{out} = {i} if {test} else -1")
            elif op == "ref":
                put(f"{out} = r_{e.args[0]}({i})")
            elif op in ("and", "not"):
                v = f"v{next(fresh)}"
                if slow:
                    put(f"far{v} = F[0]")
                emit(e.args[0], i, v, pad)
                if slow:
                    put(f"F[0] = far{v}")
                put(f"{out} = {i} if {v} {'>=' if op == 'and' else '<'} 0 else -1")
            elif op == "opt":
                g = guard(*self.first(e.args[0]), i)
                inner = pad
                put(f"{out} = {i}")
                if g:
                    put(f"if {g}:")
                    inner += "    "
                v = f"v{next(fresh)}"
                emit(e.args[0], i, v, inner)
                lines.append(f"{inner}if {v} >= 0: {out} = {v}")
                if g and slow:
                    put(f"else: {miss(i)}")
            elif op in ("star", "plus"):
                v = f"v{next(fresh)}"
                g = guard(*self.first(e.args[0]), out)
                if op == "plus":
                    emit(e.args[0], i, out, pad)
                    put(f"while {out} >= 0:")
                else:
                    put(f"{out} = {i}")
                    put("while True:")
                if g:
                    put(f"    if not ({g}):")
                    put(f"        {miss(out)}; break")
                emit(e.args[0], out, v, pad + "    ")
                put(f"    if {v} <= {out}: break")
                put(f"    {out} = {v}")
            elif op == "choice":
                label = f"c{next(fresh)}"
                put(f"{out} = -1")
                depth = pad
                items = e.args[0]
                if all((g := guard(*self.first(x), i)) for x in items) and not slow:
                    firsts = [self.first(x)[0] for x in items]
                    if sum(map(len, firsts)) == len(frozenset().union(*firsts)):  # disjoint: no fall through
                        for k, x in enumerate(items):
                            put(f"{'if' if not k else 'elif'} {guard(*self.first(x), i)}:")
                            emit(x, i, out, pad + "    ")
                        return
                put(f"while True:  # {label}")
                depth = pad + "    "
                for x in items:
                    g = guard(*self.first(x), i)
                    if g:
                        lines.append(f"{depth}if {g}:")
                        emit(x, i, out, depth + "    ")
                        lines.append(f"{depth}    if {out} >= 0: break")
                        if slow:
                            lines.append(f"{depth}else: {miss(i)}")
                    else:
                        emit(x, i, out, depth)
                        lines.append(f"{depth}if {out} >= 0: break")
                lines.append(f"{depth}break")
            elif op == "seq":
                if not e.args[0]:
                    put(f"{out} = {i}")
                    return
                v = f"v{next(fresh)}"
                put("while True:")
                now = i
                for x in e.args[0]:
                    emit(x, now, v, pad + "    ")
                    put(f"    if {v} < 0: {out} = -1; break")
                    w = f"v{next(fresh)}"
                    put(f"    {w} = {v}")
                    now = w
                put(f"    {out} = {now}; break")

        for name, e in self.rules.items():
            lines.append(f"def r_{name}(i):")
            pad = "    "
            if name in self.memo:
                lines.append(f"    o = M_{name}.get(i)")
                lines.append("    if o is not None: return o")
            g = guard(*self.first(e), "i")
            if g:
                lines.append(f"    if not ({g}):")
                if slow:
                    lines.append("        note(i)")
                lines.append("        return -1")
            emit(e, "i", "o", pad)
            if name in self.marked:
                lines.append(f"    if o >= 0: C.add(({name!r}, i))")
            if name in self.memo:
                lines.append(f"    M_{name}[i] = o")
            lines.append("    return o")
        space: dict = {"F": [0], "C": set(), "BRACKETS": frozenset("()[]{}$") | {"BAD"}} | {f"M_{n}": {} for n in self.memo}
        space["note"] = lambda i: F.__setitem__(0, i) if i > (F := space["F"])[0] else None
        space |= {name: s for s, name in self._sets.items()}
        exec(compile("\n".join(lines), "<grammar>", "exec"), space)
        return space

    def _run(self, space: dict, tokens: Tokens, arrows: dict | None) -> int:
        space["T"], space["X"], space["N"], space["J"], space["A"] = tokens.kinds, tokens.texts, tokens.newline, tokens.joined, {} if arrows is None else arrows
        space["C"].clear()
        space["F"][0] = 0
        for n in self.memo:
            space[f"M_{n}"].clear()
        try:
            return space[f"r_{self.start}"](0)
        finally:
            for n in self.memo:
                space[f"M_{n}"].clear()

    def accepts(self, tokens: Tokens, arrows: dict | None = None) -> bool:
        """Whether all tokens match."""
        return self._run(self.fast, tokens, arrows) == len(tokens.kinds)

    def parse(self, tokens: Tokens, arrows: dict | None = None) -> tuple[bool, int, set[tuple[str, int]]]:
        """Whether all tokens match; the place of the furthest failure if not; the places of marked rules."""
        end = self._run(self.fast, tokens, arrows)
        if end == len(tokens.kinds):
            return True, -1, set(self.fast["C"])
        self._run(self.slow, tokens, arrows)
        return False, min(self.slow["F"][0], len(tokens.kinds) - 1), set()
