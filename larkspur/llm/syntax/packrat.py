"""A packrat engine for parsing-expression grammars over strings of token classes.

A grammar is text: ``name <- expression`` with ``/`` (ordered choice), sequence, ``* + ?``, ``&``
and ``!`` lookahead, ``<UPPER>`` (the class of the token before), parentheses, "quoted tokens", ``UPPER`` token classes and rule names. Every token class is
one character, so a file is a string and a rule maps a position to the end of its match or -1.

Rules are memoised by position. Parts without rule names become one regular expression with possessive operators,
which has exactly the semantics of ordered choice. Statements and bracketed blocks are memoised across files as well:
the result of a rule depends only on the characters it read, so a stretch that was matched as a whole, without a look beyond it, matches again.
A second, slower build of the same grammar notes the furthest position that any terminal failed at.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

Match = Callable[[str, int, dict], int]
#: Stretches remembered across files per grammar; the memory is cleared beyond it (results stay the same).
REMEMBERED = 400_000
#: The longest stretch remembered.
LONGEST = 4_000
_TOKEN = re.compile(r'\s+|#[^\n]*|"((?:[^"\\]|\\.)*)"|<([A-Z]+)>|([A-Za-z_]\w*)(\s*<-)?|([()/*+?&!.])')


@dataclass
class Node:
    kind: str  # set, behind, ref, seq, alt, star, plus, opt, and, not, any, eof
    items: list["Node"] = field(default_factory=list)
    name: str = ""
    chars: str = ""


def read(text: str, classes: dict[str, str]) -> dict[str, Node]:
    """The rules of a grammar text; `classes` maps tokens and upper-case names to characters (several for a set)."""
    tokens: list[tuple[str, str]] = []
    pos = 0
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(f"bad grammar at {text[pos : pos + 20]!r}")
        pos = m.end()
        if m[1] is not None:
            tokens.append(("lit", m[1].replace('\\"', '"')))
        elif m[2]:
            tokens.append(("behind", m[2]))
        elif m[3]:
            tokens.append(("def" if m[4] else "name", m[3]))
        elif m[5]:
            tokens.append(("op", m[5]))
    rules: dict[str, Node] = {}
    at = 0

    def peek() -> tuple[str, str]:
        return tokens[at] if at < len(tokens) else ("end", "")

    def choice() -> Node:
        nonlocal at
        alts = [sequence()]
        while peek() == ("op", "/"):
            at += 1
            alts.append(sequence())
        return alts[0] if len(alts) == 1 else Node("alt", alts)

    def sequence() -> Node:
        nonlocal at
        parts = []
        while peek()[0] in ("lit", "name", "behind") or peek() in (("op", "("), ("op", "&"), ("op", "!"), ("op", ".")):
            prefix = ""
            if peek() in (("op", "&"), ("op", "!")):
                prefix = peek()[1]
                at += 1
            node = atom()
            while peek()[0] == "op" and peek()[1] in "*+?":
                node = Node({"*": "star", "+": "plus", "?": "opt"}[peek()[1]], [node])
                at += 1
            parts.append(Node("and" if prefix == "&" else "not", [node]) if prefix else node)
        return parts[0] if len(parts) == 1 else Node("seq", parts)

    def atom() -> Node:
        nonlocal at
        kind, value = peek()
        at += 1
        if kind == "lit" or (kind == "name" and value.isupper() and value in classes):
            return Node("set", chars=classes[value], name=value)
        if kind == "behind":
            return Node("behind", chars=classes[value], name=value)
        if kind == "name":
            return Node("ref", name=value)
        if value == ".":
            return Node("any", name="anything")
        node = choice()
        if peek() != ("op", ")"):
            raise ValueError("missing )")
        at += 1
        return node

    while at < len(tokens):
        kind, name = tokens[at]
        if kind != "def":
            raise ValueError(f"rule expected, not {name}")
        at += 1
        rules[name] = choice()
    for rule in list(rules.values()):
        _check(rule, rules)
    return rules


def _check(node: Node, rules: dict[str, Node]) -> None:
    if node.kind == "ref" and node.name not in rules:
        raise ValueError(f"no rule {node.name}")
    for x in node.items:
        _check(x, rules)


class Grammar:
    """A compiled grammar. `reaching` holds tokens whose statements look beyond
    their last character (an if may be followed by else): stretches with them are not remembered. `memo` names the rules worth memoising by position (all, if empty). `cached` maps rules to their closing character or, for rules that begin with a bracket, to its partner."""

    def __init__(self, text: str, classes: dict[str, str], start: str = "file", cached: dict[str, str] | None = None, memo: tuple[str, ...] = (), reaching: str = "") -> None:
        self.rules = read(text, classes)
        self.start, self.cached, self.memo, self.reaching = start, cached or {}, memo, reaching
        self.names = {}
        for name, chars in classes.items():
            if len(chars) == 1:
                self.names.setdefault(chars, name)
        self._nullable = self._fix(lambda n, get: self._null(n, get), False)
        self._first = self._fix(lambda n, get: self._firsts(n, get), frozenset())
        self._plain: dict[str, bool] = {}
        self.known: dict[str, set[str]] = {r: set() for r in self.cached}
        self.fast = self._build(True)
        self.slow = self._build(False)

    # -- analysis -----------------------------------------------------------------------------------------------

    def _fix(self, f, bottom):
        value = {r: bottom for r in self.rules}
        changed = True
        while changed:
            changed = False
            for r, n in self.rules.items():
                new = f(n, value)
                if new != value[r]:
                    value[r], changed = new, True
        return value

    def _null(self, n: Node, get: dict) -> bool:
        if n.kind in ("star", "opt", "and", "not", "behind"):
            return True
        if n.kind == "ref":
            return get[n.name]
        if n.kind == "seq":
            return all(self._null(x, get) for x in n.items)
        if n.kind == "alt":
            return any(self._null(x, get) for x in n.items)
        if n.kind == "plus":
            return self._null(n.items[0], get)
        return False

    def _firsts(self, n: Node, get: dict) -> frozenset | None:
        """Characters a non-empty match may begin with; None for any."""
        if n.kind == "set":
            return frozenset(n.chars)
        if n.kind == "any":
            return None
        if n.kind == "ref":
            return get[n.name]
        if n.kind in ("and", "not", "behind"):
            return frozenset()
        if n.kind in ("star", "plus", "opt"):
            return self._firsts(n.items[0], get)
        out: frozenset | None = frozenset()
        for x in n.items:
            f = self._firsts(x, get)
            out = None if f is None or out is None else out | f
            if n.kind == "seq" and not self._null(x, self._nullable):
                break
        return out

    def _is_plain(self, n: Node, trail: tuple[str, ...] = ()) -> bool:
        """Whether a node needs no recursion, so that a regular expression can stand for it."""
        if n.kind == "ref":
            if n.name in trail or n.name in self.cached:
                return False
            if n.name not in self._plain:
                self._plain[n.name] = self._is_plain(self.rules[n.name], (*trail, n.name))
            return self._plain[n.name]
        return all(self._is_plain(x, trail) for x in n.items)

    def _regex(self, n: Node) -> str:
        k = n.kind
        if k == "set":
            return "[" + "".join(re.escape(c) for c in n.chars) + "]"
        if k == "behind":
            return "(?<=[" + "".join(re.escape(c) for c in n.chars) + "])"
        if k == "any":
            return r"(?s:.)"
        if k == "ref":
            return self._regex(self.rules[n.name])
        if k == "seq":
            return "".join(self._regex(x) for x in n.items)
        if k == "alt":
            if all(x.kind == "set" for x in n.items):
                return self._regex(Node("set", chars="".join(x.chars for x in n.items)))
            return "(?>" + "|".join(self._regex(x) for x in n.items) + ")"
        body = self._regex(n.items[0])
        return {"star": f"(?:{body})*+", "plus": f"(?:{body})++", "opt": f"(?:{body})?+", "and": f"(?={body})", "not": f"(?!{body})"}[k]

    # -- compilation --------------------------------------------------------------------------------------------

    def _build(self, fast: bool) -> dict[str, Match]:
        self._begun: set[str] = set()
        table: dict[str, Match] = {}
        for name in self.rules:
            self._demand(name, table, fast)
        return table

    def _demand(self, name: str, table: dict[str, Match], fast: bool) -> Match | None:
        """A rule's matcher; None while it is being built (the rule is recursive)."""
        if name not in self._begun:
            self._begun.add(name)
            table[name] = self._rule(name, list(self.rules).index(name), self._compile(self.rules[name], table, fast), fast)
        return table.get(name)

    def _rule(self, name: str, number: int, body: Match, fast: bool) -> Match:
        close = self.cached.get(name) if fast else None
        if fast and not close and self.memo and name not in self.memo:
            return body

        def run(s: str, p: int, memo: dict) -> int:
            key = (number, p)
            end = memo.get(key)
            if end is None:
                end = memo[key] = body(s, p, memo)
            return end

        if not close:
            return run
        known, reaching = self.known[name], self.reaching

        def remembered(s: str, p: int, memo: dict) -> int:
            if close == "()":
                q = memo["match"].get(p, -1)
            else:
                q = s.find(close, p)
            if q < 0 or q - p > LONGEST:
                return run(s, p, memo)
            piece = s[p : q + 1]
            if piece in known:
                return q + 1
            end = run(s, p, memo)
            if end == q + 1 and not any(c in piece for c in reaching) and (close == "()" or _balanced(piece)):
                if len(known) > REMEMBERED:
                    known.clear()
                known.add(piece)
            return end

        return remembered

    def _compile(self, n: Node, table: dict[str, Match], fast: bool) -> Match:
        k = n.kind
        if fast and k != "ref" and self._is_plain(n):
            match = re.compile(self._regex(n)).match

            def pattern(s: str, p: int, memo: dict) -> int:
                m = match(s, p)
                return m.end() if m else -1

            return pattern
        if k in ("set", "any"):
            chars, label = n.chars, n.name

            def terminal(s: str, p: int, memo: dict) -> int:
                if p < len(s) and (k == "any" or s[p] in chars):
                    return p + 1
                if p >= memo["far"]:
                    if p > memo["far"]:
                        memo["far"], memo["want"] = p, set()
                    memo["want"].add(label)
                return -1

            return terminal
        if k == "behind":
            before = n.chars

            def behind(s: str, p: int, memo: dict) -> int:
                return p if p and s[p - 1] in before else -1

            return behind
        if k == "ref":
            name = n.name
            if built := self._demand(name, table, fast):
                return built

            def ref(s: str, p: int, memo: dict) -> int:
                return table[name](s, p, memo)

            return ref
        if k == "seq":
            return self._sequence(n, table, fast)
        if k == "alt":
            return self._choice(n, table, fast)
        one = self._compile(n.items[0], table, fast)
        if k in ("star", "plus"):
            least = k == "plus"

            def repeat(s: str, p: int, memo: dict) -> int:
                start, seen = p, not least
                while True:
                    e = one(s, p, memo)
                    if e < 0 or (e == p and seen):
                        break
                    p, seen = e, True
                return p if seen else -1 if least and start == p else p

            return repeat
        if k == "opt":

            def optional(s: str, p: int, memo: dict) -> int:
                e = one(s, p, memo)
                return p if e < 0 else e

            return optional
        wanted = k == "and"

        def look(s: str, p: int, memo: dict) -> int:
            far, want = memo.get("far"), memo.get("want")
            hit = one(s, p, memo) >= 0
            if far is not None:  # lookahead is no progress
                memo["far"], memo["want"] = far, want
            return p if hit == wanted else -1

        return look

    def _sequence(self, n: Node, table: dict[str, Match], fast: bool) -> Match:
        parts: list[Match] = []
        run: list[Node] = []
        for x in [*n.items, None]:
            if x is not None and fast and self._is_plain(x):
                run.append(x)
                continue
            if run:
                parts.append(self._compile(Node("seq", run) if len(run) > 1 else run[0], table, fast))
                run = []
            if x is not None:
                parts.append(self._compile(x, table, fast))
        if len(parts) == 1:
            return parts[0]
        if len(parts) == 2:
            a, b = parts

            def two(s: str, p: int, memo: dict) -> int:
                p = a(s, p, memo)
                return b(s, p, memo) if p >= 0 else -1

            return two

        def sequence(s: str, p: int, memo: dict) -> int:
            for f in parts:
                p = f(s, p, memo)
                if p < 0:
                    return -1
            return p

        return sequence

    def _choice(self, n: Node, table: dict[str, Match], fast: bool) -> Match:
        alts = [(self._compile(x, table, fast), self._firsts(x, self._first), self._null(x, self._nullable)) for x in n.items]
        if not fast:
            plain = [a for a, *_ in alts]

            def ordered(s: str, p: int, memo: dict) -> int:
                for f in plain:
                    e = f(s, p, memo)
                    if e >= 0:
                        return e
                return -1

            return ordered
        heads: dict[str, list[Match]] = {}
        every = frozenset().union(*[f for _, f, _ in alts if f])
        for c in every:
            heads[c] = [a for a, f, null in alts if f is None or null or c in f]
        other = [a for a, f, null in alts if f is None or null]

        def dispatch(s: str, p: int, memo: dict) -> int:
            for f in heads.get(s[p], other) if p < len(s) else other:
                e = f(s, p, memo)
                if e >= 0:
                    return e
            return -1

        return dispatch

    # -- use ----------------------------------------------------------------------------------------------------

    def accepts(self, s: str) -> bool:
        """Whether the start rule consumes all of s."""
        return self.fast[self.start](s, 0, {"match": partners(s)}) == len(s)

    def failure(self, s: str) -> tuple[int, list[str]]:
        """(furthest position that a terminal failed at, what was wanted there) of a string that is not accepted."""
        memo: dict = {"far": 0, "want": set(), "match": {}}
        end = self.slow[self.start](s, 0, memo)
        return max(memo["far"], end, 0), sorted(memo["want"])


_BRACKET = re.compile(r"[()\[\]{}]")
_PAIR = {")": "(", "]": "[", "}": "{"}


def _balanced(piece: str) -> bool:
    return all(piece.count(a) == piece.count(b) for a, b in ("()", "[]", "{}"))


def partners(s: str) -> dict[int, int]:
    """Position of the closing bracket per opening bracket, as far as brackets match."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for m in _BRACKET.finditer(s):
        c = m[0]
        if c in "([{":
            open_.append(m.start())
        elif open_ and s[open_[-1]] == _PAIR[c]:
            out[open_.pop()] = m.start()
        else:
            break
    return out
