"""Lexing of languages with braces into class strings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Characters for tokens longer than one character, in the private range.
_FROM = 0xE000


def classes(keywords: list[str], operators: list[str], extra: dict[str, str]) -> dict[str, str]:
    """One character per keyword and operator; single characters stand for themselves."""
    out = {op: op for op in operators if len(op) == 1}
    for i, t in enumerate([*keywords, *[op for op in operators if len(op) > 1]]):
        out[t] = chr(_FROM + i)
    return out | {"ID": "I", "NUM": "N", "STR": "S", "CHAR": "C", "REGEX": "R", "TBEGIN": "«", "TNEXT": "¦", "TEND": "»", "BAD": "\x00"} | extra


@dataclass
class Lexer:
    keywords: list[str]
    operators: list[str]
    classes: dict[str, str]
    literals: str
    numbers: str
    words: str = r"[^\W\d]\w*"
    comments: str = r"//[^\n]*|/\*(?s:.*?)\*/"
    lead: str = r"[ \t\f\r]*"
    often: str = r"[)\]]|[,;](?!\s*/)"
    line_end: str = "\n"
    known: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        ops = "|".join(re.escape(o) for o in sorted(self.operators, key=len, reverse=True))
        self.master = re.compile(rf"{self.lead}+({self.words}|{self.often}|\n\s*+|{self.comments}|{self.literals}|{self.numbers}|{ops}|(?s:.)|\Z)")
        self.base = {t: self.classes[t] for t in [*self.keywords, *self.operators]}
        self.known.update(self.base)
        self.number = re.compile(rf"(?:{self.numbers})\Z")
        self.word = re.compile(rf"(?:{self.words})\Z")

    def of(self, token: str) -> str:
        """The classes of a token; line ends and comments with line ends give `line_end`."""
        c = self.known.get(token)
        if c is None:
            if len(self.known) > 300_000:
                self.known.clear()
                self.known.update(self.base)
            c = self.known[token] = self.classify(token)
        return c

    def classify(self, token: str) -> str:
        first = token[:1]
        if first == "\n":
            return self.line_end
        if first == "/" and token[1:2] in ("/", "*"):
            return self.line_end if "\n" in token else ""
        if not token or token.isspace():
            return ""
        if self.word.match(token):
            return "I"
        if self.number.match(token):
            return "N"
        if first in "\"'`" and len(token) > 1:
            return "S"
        return "\x00"

    def tokens(self, text: str) -> list[str]:
        of = self.of
        get = self.known.get
        return [get(t) or of(t) for t in self.master.findall(text)]

    def places(self, text: str) -> list[int]:
        """Where each of `tokens` begins."""
        return [m.start(1) for m in self.master.finditer(text)]
