"""Python 3.13: token classes and grammar. Only syntax counts; names, types and control flow are not checked."""

from __future__ import annotations

import io
import re
import tokenize
from collections.abc import Iterator

from larkspur.llm.syntax.packrat import Grammar

KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda"
    " nonlocal not or pass raise return try while with yield match case type"
).split()
OPERATORS = "**= //= >>= <<= ... := -> ** // << >> <= >= == != += -= *= /= %= &= |= ^= @= + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; =".split()
#: One character per token: single-character operators stand for themselves, others are taken from a private range.
CLASSES: dict[str, str] = {op: op for op in OPERATORS if len(op) == 1}
for _i, _t in enumerate([*KEYWORDS, *[op for op in OPERATORS if len(op) > 1]]):
    CLASSES[_t] = chr(0xE000 + _i)
CLASSES |= {"ID": "I", "NUM": "N", "STR": "S", "NL": "\n", "INDENT": "\x01", "DEDENT": "\x02", "FBEGIN": "«", "FNEXT": "¦", "FEND": "»", "BAD": "\x00"}
CLASSES["NAME"] = "I" + CLASSES["match"] + CLASSES["case"] + CLASSES["type"]
CLASSES["AUG"] = "".join(CLASSES[o] for o in "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
CLASSES["BINOP"] = "".join(CLASSES[o] for o in "** // << >> + - * / % @ & | ^".split())
CLASSES["COMPARE"] = "".join(CLASSES[o] for o in "<= >= == != < > in".split())

GRAMMAR = r"""
file <- NL* statement* NL*
statement <- compound / simple
simple <- small (";" small)* ";"? NL
small <- assignment / stars / "return" stars? / import / "raise" (expr ("from" expr)?)? / "pass" / "del" targets / "assert" expr ("," expr)?
  / "break" / "continue" / "global" NAME ("," NAME)* / "nonlocal" NAME ("," NAME)* / "type" NAME typeparams? "=" expr
assignment <- (target / "(" target ")") ":" expr ("=" (yield / stars))?
  / (targets "=")+ (yield / stars) !"="
  / target AUG (yield / stars)
  / "type" NAME typeparams? "=" expr / yield
yield <- "yield" ("from" expr / stars)?
import <- "import" dotted ("as" NAME)? ("," dotted ("as" NAME)?)*
  / "from" ("." / "...")* (dotted / &"import") "import" ("*" / "(" froms ","? ")" / froms)
froms <- NAME ("as" NAME)? ("," NAME ("as" NAME)?)*
dotted <- NAME ("." NAME)*
targets <- startarget ("," startarget)* ","?
startarget <- "*"? target
target <- atom (trailer &("." / "[" / "("))* ("." NAME / "[" slices "]") / NAME / "(" targets? ")" / "[" targets? "]"
trailer <- "." NAME / "(" args? ")" / "[" slices "]"
compound <- if / while / for / try / with / funcdef / classdef / match
  / "async" (for / with / funcdef)
  / decorators ("async"? funcdef / classdef)
decorators <- ("@" named NL)+
block <- NL INDENT statement+ DEDENT / simple
test <- named ":"
if <- "if" test block ("elif" test block)* ("else" ":" block)?
while <- "while" test block ("else" ":" block)?
forhead <- targets "in" stars ":"
for <- "for" forhead block ("else" ":" block)?
try <- "try" ":" block (except+ ("else" ":" block)? ("finally" ":" block)? / "finally" ":" block)
except <- "except" "*"? (expr ("," expr)* ("as" NAME)?)? ":" block
with <- "with" withhead block
withhead <- "(" withitem ("," withitem)* ","? ")" ":" / withitem ("," withitem)* ":"
withitem <- expr ("as" startarget)?
funcdef <- "def" defhead block
defhead <- NAME typeparams? "(" params? ")" ("->" expr)? ":"
classdef <- "class" NAME typeparams? ("(" args? ")")? ":" block
typeparams <- "[" typeparam ("," typeparam)* ","? "]"
typeparam <- ("*" / "**")? NAME (":" expr)? ("=" expr)?
params <- (positional ("," rest)? / rest) ","?
positional <- required ("," required)* ("," "/" ("," required)* ("," optional)* / ("," optional)+ ("," "/" ("," optional)*)?)? / optional ("," optional)* ("," "/" ("," optional)*)?
required <- NAME (":" expr)? !"="
optional <- NAME (":" expr)? "=" expr
rest <- "*" NAME (":" "*"? expr)? ("," keyword)* ("," "**" NAME (":" expr)?)? / "*" ("," keyword)+ ("," "**" NAME (":" expr)?)? / "**" NAME (":" expr)?
keyword <- NAME (":" expr)? ("=" expr)?
match <- "match" stars ":" NL INDENT caseblock+ DEDENT
caseblock <- "case" patterns ("if" named)? ":" block
patterns <- pattern ("," pattern)* ","?
pattern <- "*" NAME / orpattern ("as" NAME)?
orpattern <- closed ("|" closed)*
closed <- ("-"? NUM (("+" / "-") NUM)?) / STR+ / "None" / "True" / "False"
  / NAME ("." NAME)* ("(" (keypattern ("," keypattern)* ","?)? ")")?
  / "(" patterns? ")" / "[" patterns? "]" / "{" ((mappattern ("," mappattern)* ","?)?) "}"
keypattern <- NAME "=" pattern / pattern
mappattern <- "**" NAME / closed ":" pattern
stars <- starexpr ("," starexpr)* ","?
starexpr <- "*" operand (BINOP operand)* / named
named <- NAME ":=" expr / expr
expr <- lambda / disjunction ("if" disjunction "else" expr)?
lambda <- "lambda" ((lpositional ("," lrest)? / lrest) ","?)? ":" expr
lpositional <- lrequired ("," lrequired)* ("," "/" ("," lrequired)* ("," loptional)* / ("," loptional)+ ("," "/" ("," loptional)*)?)? / loptional ("," loptional)* ("," "/" ("," loptional)*)?
lrequired <- NAME !"="
loptional <- NAME "=" expr
lrest <- "*" NAME ("," lkeyword)* ("," "**" NAME)? / "*" ("," lkeyword)+ ("," "**" NAME)? / "**" NAME
lkeyword <- NAME ("=" expr)?
disjunction <- operand (("or" / "and" / COMPARE / BINOP / "not" "in" / "is") operand)*
sum <- operand (BINOP operand)*
operand <- ("+" / "-" / "~" / "not")* "await"? primary
primary <- atom trailer*
atom <- NAME / NUM / string+ / "None" / "True" / "False" / "..."
  / parens / list / braces
string <- STR / FBEGIN fexpr? (FNEXT fexpr?)* FEND
fexpr <- (yield / stars) "="?
parens <- "(" (yield / starexpr comp / stars)? ")"
list <- "[" (starexpr comp / stars)? "]"
braces <- "{" ("**" sum / expr ":" expr comp? / starexpr comp?)? ("," ("**" sum / expr ":" expr / starexpr))* ","? "}"
comp <- ("async"? "for" targets "in" disjunction ("if" condition)*)+
condition <- NAME ":=" expr / lambda / disjunction
args <- (arg !"=" comp !"," / arg ("," arg)* ("," starred)* ("," kwarg)* / starred ("," starred)* ("," kwarg)* / kwarg ("," kwarg)*) ","?
arg <- "*" expr / named !"="
starred <- NAME "=" expr / "*" expr
kwarg <- "**" expr / NAME "=" expr
slices <- slice ("," slice)* ","?
slice <- expr? ":" expr? (":" expr?)? / "*" sum / named
"""

PYTHON = Grammar(GRAMMAR, CLASSES, cached={"simple": "\n", "test": ":", "forhead": ":", "withhead": ":", "defhead": ":"}, memo=("atom", "trailer", "primary", "expr", "stars", "targets", "params", "args"))

_NUMBER = r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
_PLAIN = r"(?:[rRbBuU]|[rR][bB]|[bB][rR])?"
_STRING = (
    rf"{_PLAIN}(?:\"\"\"(?:[^\"\\]|\\(?s:.)|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\(?s:.)|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\n]|\\(?s:.))*\"|'(?!'')(?:[^'\\\n]|\\(?s:.))*')"
)
# f-strings whose replacement fields have no quotes, braces or line ends; others take the slow way
_FSTRING = r"(?:[fF][rR]?|[rR][fF])(?:\"(?!\"\")(?:[^\"\\\n{}]|\\[^\n]|\{\{|\}\}|\{[^{}\"\n\\]*\})*\"|'(?!'')(?:[^'\\\n{}]|\\[^\n]|\{\{|\}\}|\{[^{}'\n\\]*\})*')"
# names, brackets and line ends come first as the most frequent tokens
_MASTER = re.compile(
    rf"[ \t\f]*+((?:[^\W\d]\w*+(?![\"']))|[()\[\]{{}},]|\.(?![\d.])|:(?!=)|=(?!=)|(?:#[^\n]*+)?\n(?:[ \t\f]*+(?:#[^\n]*+)?\n)*+[ \t\f]*+|{_FSTRING}|{_STRING}|(?:[fFtT][rR]?|[rR][fFtT])[\"']|[^\W\d]\w*|{_NUMBER}|\*\*=?|//=?|>>=?|<<=?|\.\.\.|:=|->|[<>=!+\-*/%&|^@]=|[+\-*/%@&|^~<>()\[\]{{}},:.;=]"
    r"|#[^\n]*|\\\n|\Z|(?s:.))"
)
_FIELD = re.compile(r"\{\{|\}\}|\{([^{}]*)\}")
_known: dict[str, str] = {}
_known.update({t: CLASSES[t] for t in [*KEYWORDS, *OPERATORS]})


def _classify(token: str) -> str:
    """The classes of a token that is no keyword, operator or line end."""
    c = token[:1]
    if not token:
        return ""
    if c.isidentifier() and token.isidentifier():
        return "I"
    if c.isdigit() or (c == "." and len(token) > 1):
        return "N"
    if c in "\"'" and len(token) > 1:
        return "S"
    if token.startswith("#"):
        return ""
    if token == "\\\n":
        return ""
    q = re.match(r"[A-Za-z]{1,2}[\"']", token)
    if q and len(token) > len(q[0]):
        prefix = token[: len(q[0]) - 1].lower()
        return _fields(token) if "f" in prefix else "S"
    return "\x00"


def _fields(token: str) -> str:
    """An f-string with simple fields: FBEGIN, the fields' expressions with FNEXT between, FEND."""
    parts = []
    for m in _FIELD.finditer(token):
        if m[1] is None:
            continue
        inner = re.sub(r"(![rsa])?(:(?!=).*)?$", "", m[1]) if not re.search(r"[\[({]|lambda", m[1]) else _cut(m[1])
        if not inner.strip():
            return "\x00"
        parts.append(_line(inner))
    return "«" + "¦".join(parts) + "»" if parts else "S"


def _cut(field_: str) -> str:
    """The expression of a field: up to a conversion or format outside all brackets."""
    depth = 0
    for i, c in enumerate(field_):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif depth == 0 and (c == ":" or (c == "!" and field_[i + 1 : i + 2] != "=")):
            return field_[:i]
    return field_


def _line(text: str) -> str:
    return "".join("" if t[:1] in ("\n", "#") or t == "\\\n" else _class(t) for t in _MASTER.findall(text))


def _class(token: str) -> str:
    c = _known.get(token)
    if c is None:
        if len(_known) > 300_000:
            _known.clear()
            _known.update({t: CLASSES[t] for t in [*KEYWORDS, *OPERATORS]})
        c = _known[token] = _classify(token)
    return c


def _widths(indent: str) -> tuple[int, int]:
    """An indentation's width with tabs to multiples of 8 and with tabs of 1; a form feed starts anew."""
    indent = indent.rsplit("\f", 1)[-1]
    if "\t" not in indent:
        return len(indent), len(indent)
    a = 0
    for c in indent:
        a = a // 8 * 8 + 8 if c == "\t" else a + 1
    return a, len(indent)


def _traced(text: str, pos: int, span: list[int]) -> Iterator[str]:
    """The tokens from pos on; `span` holds start and end of the one given last."""
    for m in _MASTER.finditer(text, pos):
        span[:] = m.start(1), m.end()
        yield m[1]


def lex(text: str, at: list[int] | None = None) -> str:
    """The class string of a file (BAD where it has no tokens); `at` receives the place in the text of each class."""
    if "\x00" in text:
        return "\x00"
    out: list[str] = []
    stack = [(0, 0)]
    depth = 0
    fresh = True
    add, known = out.append, _known.get
    span = [0, 0]
    if at is not None:

        def add(c: str) -> None:
            out.append(c)
            at.extend([span[c in "\x00\x01\x02"]] * len(c))

    text = text if text.endswith("\n") else text + "\n"
    first = re.match(r"(?:[ \t\f]*(?:#[^\n]*)?\n)*([ \t\f]*)", text)
    if first[1] and first.end() < len(text):
        add("\x01")
    for token in _MASTER.findall(text, first.end()) if at is None else _traced(text, first.end(), span):
        c = known(token)
        if c is None:
            if token[:1] == "\n" or (token[:1] == "#" and "\n" in token):
                if depth:
                    continue
                if not fresh:
                    add("\n")
                    fresh = True
                here = _widths(token[token.rfind("\n") + 1 :])
                if here == stack[-1]:
                    continue
                if here[0] > stack[-1][0] and here[1] > stack[-1][1]:
                    stack.append(here)
                    add("\x01")
                    continue
                while here[0] < stack[-1][0]:
                    stack.pop()
                    add("\x02")
                if here != stack[-1]:
                    add("\x00")
                continue
            if token == "":
                continue
            if token[-1] in "\"'" and token[0] not in "\"'" and len(token) <= 3 and token[:-1].isalpha():
                return _slow(text, at)
            c = _class(token)
        add(c)
        if c:
            fresh = False
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if depth < 0:
                    add("\x00")
                    depth = 0
    if depth:
        return "".join(out)
    while len(stack) > 1:  # the last line end closed nothing if the file ends in an indented comment
        stack.pop()
        add("\x02")
    return "".join(out)


def _slow(text: str, at: list[int] | None = None) -> str:
    """The class string by the standard tokenizer, which knows nested f-strings."""
    out: list[str] = []
    if at is not None:
        at.clear()
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
    open_: list[list[list]] = []  # per f-string its open fields, each [start of the expression, in conversion or format]
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            kind = tokenize.tok_name[t.type]
            if at is not None:  # what the token before gave begins where that began
                at.extend([place] * (sum(map(len, out)) - len(at)) if out else [])
                place = starts[min(t.start[0], len(starts)) - 1] + t.start[1]
            if kind in ("NL", "COMMENT", "ENDMARKER", "FSTRING_MIDDLE", "TSTRING_MIDDLE"):
                continue
            if kind in ("FSTRING_START", "TSTRING_START"):
                open_.append([])
                out.append("«")
                continue
            if kind in ("FSTRING_END", "TSTRING_END"):
                open_.pop()
                out.append("»")
                continue
            if open_:
                fields = open_[-1]
                if t.string == "{" and (not fields or fields[-1][1]):
                    if out[-1] != "«":
                        out.append("¦")
                    fields.append([len(out), False])
                    continue
                if fields and t.string == "}" and (fields[-1][1] or _even(out[fields[-1][0] :])):
                    fields.pop()
                    continue
                if fields and not fields[-1][1] and t.string in ("!", ":") and _even(out[fields[-1][0] :]):
                    fields[-1][1] = True
                    continue
                if not fields or fields[-1][1]:
                    continue
            out.append({"NEWLINE": "\n", "INDENT": "\x01", "DEDENT": "\x02", "NUMBER": "N", "STRING": "S"}.get(kind) or _class(t.string))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return "".join(out) + "\x00"
    return "".join(out)


def _even(classes: list[str]) -> bool:
    s = "".join(classes)
    return all(s.count(a) == s.count(b) for a, b in ("()", "[]", "{}"))
