"""JavaScript (module or script) and TypeScript with or without JSX: token classes, line ends and grammar."""

from __future__ import annotations

import re

from larkspur.llm.syntax.braces import Lexer, classes
from larkspur.llm.syntax.packrat import Grammar

KEYWORDS = (
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return"
    " super switch this throw try typeof var void while with null true false enum"
    " let static async await yield of get set from as satisfies type interface namespace module declare abstract readonly public private protected"
    " override implements keyof infer is assert asserts unique global accessor out using target meta constructor"
).split()
SOFT = KEYWORDS[KEYWORDS.index("let") :]
OPERATORS = (
    ">>>= **= <<= >>= &&= ||= ??= ... === !== => ** ++ -- << && || ?? ?. == != <= >= += -= *= /= %= &= |= ^= + - * / % & | ^ ! ~ < > = ? : ; , . @ # ( ) [ ] { }"
).split()
CLASSES = classes(KEYWORDS, OPERATORS, {"HASHBANG": "H", "MARK": "\n"})
CLASSES["NAME"] = "I" + "".join(CLASSES[k] for k in SOFT)
CLASSES["LABEL"] = "I" + "".join(CLASSES[k] for k in SOFT if k not in ("let", "await", "yield", "async"))
CLASSES["WORD"] = "I" + "".join(CLASSES[k] for k in KEYWORDS)
CLASSES["ASSIGN"] = "".join(CLASSES[k] for k in "= += -= *= /= %= &= |= ^= **= <<= >>= >>>= &&= ||= ??=".split())
CLASSES["BIN"] = "".join(CLASSES[k] for k in "&& || ?? === !== == != <= >= < + - * / % & | ^ ** << in instanceof".split())
CLASSES["SIGN"] = "".join(CLASSES[k] for k in "delete void typeof + - ! ~".split())
CLASSES["LOGICAL"] = CLASSES["&&"] + CLASSES["||"]
CLASSES["ARITHMETIC"] = "".join(c for c in CLASSES["BIN"] if c not in CLASSES["LOGICAL"] + CLASSES["??"])
CLASSES["MODWORD"] = "".join(CLASSES[k] for k in "public private protected static abstract readonly override declare accessor async".split())

GRAMMAR = r"""
file <- (HASHBANG)? skip statement_* skip
skip <- (";" / MARK)*
statement_ <- skip statement
eos <- ";" / MARK / &"}" / !.
block <- "{" statement_* skip "}"
statement <- block / var eos / function / "async" function / class / if / for / while / do / "continue" LABEL? eos / "break" LABEL? eos
  / "return" expr? eos / "throw" expr eos / try / switch / decorators export / "with" "(" expr ")" substatement / "debugger" eos / import / export
  / typed / LABEL ":" statement / !("{" / "function" / "class" / "async" "function") expr eos
substatement <- statement / ";"
typed <- "declare" (var eos / function / "abstract"? class / "const"? enum / namespace / interface / alias / "global" block / "async" function)
  / "global" block / "abstract" class / interface / alias / "const"? enum / namespace
interface <- "interface" NAME typeparams? ("extends" typeref ("," typeref)*)? objecttype
alias <- "type" NAME typeparams? "=" type eos
enum <- "enum" NAME "{" (enumitem ("," enumitem)*)? ","? "}"
enumitem <- (WORD / STR) ("=" assign)?
namespace <- ("namespace" / "module") (NAME ("." NAME)* / STR) (block / eos)
var <- ("var" / "let" / "const" "enum"? / "await"? "using") binding ("," binding)*
binding <- pattern "!"? (":" type)? ("=" assign)?
pattern <- "[" (element? ",")* element? "]" / "{" (property ("," property)*)? ","? "}" / NAME
element <- "..."? pattern ("=" assign)?
property <- "..." pattern / key ":" pattern ("=" assign)? / NAME ("=" assign)?
key <- WORD / STR / NUM / "[" assign "]" / "#" WORD
function <- "function" "*"? NAME? typeparams? params returns? (block / eos)
params <- "(" (param ("," param)*)? ","? ")"
param <- decorator* ("public" / "private" / "protected" / "readonly" / "override")* ("..." )? ("this" / pattern) "?"? (":" type)? ("=" assign)?
  / decorator* ("...")? pattern "?"? (":" type)? ("=" assign)?
returns <- ":" (predicate / type)
predicate <- "asserts" (NAME / "this") ("is" type)? / (NAME / "this") "is" type
if <- "if" "(" expr ")" substatement (skip "else" substatement)?
for <- "for" "await"? "(" (var_in / init) ")" substatement
var_in <- (("var" / "let" / "const" / "await"? "using") pattern (":" type)? / postfix) ("of" assign / "in" expr)
init <- (var_noin / expr)? ";" expr? ";" expr?
var_noin <- var
while <- "while" "(" expr ")" substatement
do <- "do" substatement skip "while" "(" expr ")" eos?
try <- "try" block skip ("catch" ("(" pattern (":" type)? ")")? block (skip "finally" block)? / "finally" block)
switch <- "switch" "(" expr ")" "{" skip (("case" expr / "default") ":" statement_* skip)* "}"
import <- "import" (STR / "type"? clause "from" STR) ("with" object / "assert" object)? eos / "import" NAME "=" expr eos
clause <- NAME ("," (star / names))? / star / names
star <- "*" "as" NAME
names <- "{" (name ("," name)*)? ","? "}"
name <- "type" (WORD / STR) "as" NAME / "type" &(WORD / STR) (WORD / STR) / (WORD / STR) ("as" (WORD / STR))?
export <- "export" (
    "default" ("abstract"? class / function / "async" function / interface / assign eos)
  / "type"? "*" ("as" (WORD / STR))? "from" STR ("with" object)? eos / "type"? names ("from" STR ("with" object)?)? eos / "=" expr eos / "as" "namespace" NAME eos
  / "import" NAME "=" expr eos / var eos / function / "async" function / decorators? class / typed)
decorators <- (decorator MARK? ";"?)+
decorator <- "@" (NAME / "(" expr ")") ("." WORD / call)*
class <- decorators? "abstract"? "class" (!("extends" / "implements") NAME)? typeparams? ("extends" heritage)? ("implements" typeref ("," typeref)*)? classbody
heritage <- primary (("." / "?.") WORD / call / "[" expr "]" / typeargs)*
classbody <- "{" skip (member skip)* "}"
member <- decorators? "static" block
  / decorators? modifiers ("get" / "set") !("(" / "=" / ";" / ":" / "}" / "?" / "!" / "<") key typeparams? params returns? (block / eos)
  / decorators? modifiers "*"? key ("?" / "!")? typeparams? params returns? (block / eos)
  / decorators? modifiers "[" NAME ":" type "]" ":" type eos
  / decorators? modifiers key ("?" / "!")? (":" type)? ("=" assign)? eos
modifiers <- (MODWORD !("(" / "=" / ";" / ":" / "}" / "?" / "!" / "<" / MARK / ","))*
expr <- assign ("," assign)*
assign <- arrow / "yield" "*"? assign? / conditional (ASSIGN assign)?
arrow <- "async"? (NAME / typeparams? params returns?) "=>" (block / !"{" assign)
conditional <- binary ("?" assign ":" assign)?
binary <- unary (("as" / "satisfies") (type / "const") / (BIN / ">" ">" ">" / ">" ">" / ">") MARK? unary)*
unary <- ("await" / "++" / "--")* (SIGN (SIGN / "await" / "++" / "--")* operand !"**" / operand)
operand <- "<" type ">" unary / "#" WORD &"in" / postfix
postfix <- primary tail* ("++" / "--")?
tail <- ("." / "?.") "#"? WORD / ("?." / MARK &"[")? "[" expr "]" / "?."? call / "!" !"=" / template / typeargs &("(" / "." / "?." / ")" / "]" / ":" / ";" / "," / TBEGIN / "}")
call <- typeargs? "(" (argument ("," argument)*)? ","? ")"
argument <- "..."? assign
primary <- "this" / "super" / "null" / "true" / "false" / NUM / STR / REGEX / template / array / object / "(" expr ")"
  / "async"? function / class / "new" ("." "target" / newtarget call?) / "import" ("." "meta" / "(" assign ("," assign)? ","? ")") / NAME
newtarget <- (primary / "new" newtarget) (("." WORD) / "[" expr "]" / typeargs)*
template <- TBEGIN piece? (TNEXT piece?)* TEND
piece <- "..." assign / expr &(TNEXT / TEND) / type
array <- "[" (argument? ",")* argument? "]"
object <- "{" (entry ("," entry)*)? ","? "}"
entry <- "..." assign / ("get" / "set") !(":" / "(" / "," / "}" / "<") key params returns? block / "async"? "*"? key typeparams? params returns? block
  / key ":" assign / NAME ("=" assign)?
typeparams <- "<" typeparam ("," typeparam)* ","? ">"
typeparam <- ("const" / "in" / "out")* NAME ("extends" type)? ("=" type)?
typeargs <- "<" type ("," type)* ","? ">"
typeref <- NAME ("." WORD)* typeargs?
type <- predicate / functype / uniontype ("extends" type "?" type ":" type)?
functype <- "abstract"? "new"? typeparams? params "=>" (predicate / type)
uniontype <- ("|" / "&")? typeunary (("|" / "&") typeunary)*
typeunary <- ("keyof" / "unique" / "readonly") typeunary / "infer" NAME ("extends" typeunary)? / arraytype
arraytype <- typeatom ("[" type? "]")*
typeatom <- "(" type ")" / mapped / objecttype / "[" (tupleitem ("," tupleitem)*)? ","? "]" / "typeof" ("import" "(" STR ")" / (NAME / "this")) ("." "#"? WORD)* typeargs?
  / "import" "(" STR ")" ("." WORD)* typeargs? / template / "-"? NUM / STR / "null" / "true" / "false" / "this" / "void" / functype / typeref
tupleitem <- "..."? (WORD "?"? ":" "..."? type / type "?"?)
mapped <- "{" skip (("+" / "-")? "readonly")? "[" NAME "in" type ("as" type)? "]" (("+" / "-")? "?")? (":" type)? skip "}"
objecttype <- "{" skip (typemember (";" / MARK / "," / &"}") skip)* "}"
typemember <- ("get" / "set") !("(" / ":" / "?" / "<") key params returns?
  / "new"? typeparams? params returns? / "readonly"? "[" NAME ":" type "]" ":" type / ("readonly" !(":" / "?" / "(" ))? key "?"? (typeparams? params returns? / (":" type)?)
"""


#: Rules of plain JavaScript: what may be assigned to, and no ?? beside && or ||.
_STRICTER = {
    "assign": """arrow / "yield" "*"? assign? / conditional !ASSIGN / (array / object) "=" assign / target ASSIGN assign
target <- primary (link &link)* (("." "#"? WORD) / (MARK &"[")? "[" expr "]") / NAME / "(" target ")"
link <- "." "#"? WORD / (MARK &"[")? "[" expr "]" / call / template""",
    "binary": """operation (("??" MARK? operation)+ !LOGICAL / (LOGICAL MARK? operation)* !"??")
operation <- unary ((ARITHMETIC / ">" ">" ">" / ">" ">" / ">") MARK? unary)*""",
}


def _without_types(text: str) -> str:
    """The grammar of plain JavaScript: no rule of the type language matches, and its marks are gone from the others."""
    never = {"typed", "type", "predicate", "typeparams", "typeargs", "typeref", "decorator", "objecttype", "functype", "uniontype", "mapped"}
    out, skipping = [], False
    for line in text.splitlines():
        if " <- " in line:
            name = line.split(" <- ")[0]
            skipping = name in never
            if skipping:
                out.append(f"{name} <- !. .")
                continue
            if name == "param":
                line, skipping = 'param <- "..."? pattern ("=" assign)?', True
                out.append(line)
                continue
            if name == "modifiers":
                line = 'modifiers <- (STATIC !("(" / "=" / ";" / "}" / MARK))* (ASYNC !("(" / "=" / ";" / "}" / MARK))*'
        if not skipping:
            out.append(line)
    plain = "\n".join(out)
    for mark in (' "!"?', ' / "!" !"="', ' ("?" / "!")?', ' "abstract"?', ' "enum"?', ' / "=" expr eos / "as" "namespace" NAME eos', ' / interface / assign eos', ' / "import" NAME "=" expr eos'):
        plain = plain.replace(mark, " / assign eos" if "interface" in mark else "")
    plain = plain.replace('STR / "type"? clause', "STR / clause").replace('"type"? "*"', '"*"').replace('"type"? names', "names")
    plain = plain.replace('name <- "type" (WORD / STR) "as" NAME / "type" &(WORD / STR) (WORD / STR) / ', "name <- ").replace('("as" / "satisfies") (type / "const")', "!. .")
    for rule, body in _STRICTER.items():  # errors that TypeScript's parser leaves to its checker
        plain = re.sub(rf"(?m)^{rule} <- .*$", lambda m, r=rule, b=body: f"{r} <- {b}", plain)
    plain = plain.replace(' / decorators? modifiers "[" NAME ":" type "]" ":" type eos', "")
    return plain.replace("  \n", "\n")


CLASSES["STATIC"], CLASSES["ASYNC"] = CLASSES["static"] + CLASSES["accessor"], CLASSES["async"]
_CACHED = {"block": "()", "statement": ";", "object": "()"}
_MEMO = ("assign", "binary", "postfix", "primary", "type")
TYPESCRIPT = Grammar(GRAMMAR, CLASSES, cached=_CACHED, memo=_MEMO, reaching=CLASSES["if"])
JAVASCRIPT = Grammar(_without_types(GRAMMAR), CLASSES, cached=_CACHED, memo=_MEMO, reaching=CLASSES["if"])

_REGEX = r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
_BEFORE_REGEX = r"=>|\|\||&&|\?\?|[=(,:\[!&|?{};+\-*%~^<>]"
_TEMPLATE = r"`(?:[^`\\$]|\\(?s:.)|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}`]*\})*\})*`"
_WORDS = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:[\w$]|\\u[0-9a-fA-F]{4})*"
LEXER = Lexer(
    KEYWORDS, [o for o in OPERATORS if o not in (">>>=", ">>=", ">=")] + [">>>=", ">>=", ">="], CLASSES,
    literals=rf"(?:{_BEFORE_REGEX})\s*{_REGEX}|\"(?:[^\"\\\n]|\\(?s:.))*\"|'(?:[^'\\\n]|\\(?s:.))*'|{_TEMPLATE}",
    numbers=r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?n?",
    words=_WORDS,
    often=r"[)\]]|\.(?![\d.])|[,;](?!\s*/)|\"(?:[^\"\\\n]|\\(?s:.))*\"|'(?:[^'\\\n]|\\(?s:.))*'",
    line_end="\r",
)
_SPLIT = re.compile(rf"(?s)({_BEFORE_REGEX})\s*({_REGEX})\Z")
_SUBST = re.compile(r"\\(?s:.)|\$\{((?:[^{}`]|\{[^{}`]*\})*)\}")
_C = CLASSES
#: Classes that may end a statement, and those that go on with the one before when they begin a line.
_ENDS = set("INSRC)]»") | {_C[k] for k in [*SOFT, "this", "super", "null", "true", "false", "void", "++", "--", "break", "continue", "return", "debugger"]}
_ENDS -= {_C[k] for k in "async await as satisfies keyof infer is asserts unique declare abstract implements".split()}
_GOES_ON = set(")],.?:}=<>|&^+-*/%([«") | {
    _C[k] for k in "=== !== == != <= >= && || ?? ?. ** => extends implements << += -= *= /= %= &= |= ^= **= <<= >>= >>>= &&= ||= ??= in instanceof".split()
}
_NO_MARK = {_C[k] for k in "else catch finally".split()}
_RESTRICTED = {_C[k] for k in "return break continue throw yield".split()}
_HEADS = {_C[k] for k in "if for while with".split()}


def _classify(token: str) -> str:
    """Tokens that hold others: an operator with a regular expression, a template with expressions."""
    if token[:1] == "`":
        if "${" not in token:
            return "«»" if len(token) > 1 else "\x00"
        parts = [m[1] for m in _SUBST.finditer(token) if m[1] is not None]
        return "«" + "¦".join(_line_ends("".join(_of(t) for t in LEXER.master.findall(p))) for p in parts) + "»" if parts else "«»"
    m = _SPLIT.match(token) if "/" in token and len(token) > 2 else None
    return _of(m[1]) + "R" if m else Lexer.classify(LEXER, token)


LEXER.classify = _classify  # type: ignore[method-assign]
_of = LEXER.of


_BOTH = _ENDS | _RESTRICTED


def _at_line_end(last: str, head: str) -> str:
    """What a line end between two classes is: ; after what can end a statement, a mark after }, or nothing where the next line goes on."""
    if last in "}>":
        return "\n" if (last == "}" or head != "{") and head not in _GOES_ON and head not in _NO_MARK else ""
    if last not in _BOTH or (last not in _RESTRICTED and head in _GOES_ON and head != "["):
        return ""
    if head == "[":
        return "\n"
    return "" if head in "};" or (head == "{" and last not in _RESTRICTED) else ";"


class _Decisions(dict):
    def __missing__(self, pair: str) -> str:
        self[pair] = out = _at_line_end(pair[0], pair[1])
        return out


_DECISIONS = _Decisions()
_RUN = re.compile("\r+")


def _line_ends(classes_: str, at: list[int] | None = None) -> str:
    """The classes with every run of line ends decided; `at`, the place of each class, is brought in line."""
    lines = _RUN.split(classes_)
    if len(lines) == 1:
        return classes_
    out = [lines[0]]
    decided, before = _DECISIONS, lines[0]
    for line in lines[1:]:
        if line:
            if before:
                c = decided[before[-1] + line[0]]
                if c == ";" and before[-1] == ")" and _is_head(out):
                    c = ""
                out.append(c)
            out.append(line)
            before = line
    if at is not None:
        old, at[:] = at[:], []
        i = 0
        for piece, sep in zip([*_RUN.split(classes_), ""], [*_RUN.finditer(classes_), None]):
            at += old[i : i + len(piece)]
            i += len(piece)
            at_sep = old[i] if sep else 0
            i += len(sep[0]) if sep else 0
            at.append(at_sep)
        at[:] = _kept(lines, out, at)
    return "".join(out)


def _kept(lines: list[str], out: list[str], at: list[int]) -> list[int]:
    """The places of `out` from those of `lines` with one place for the end of each."""
    kept: list[int] = []
    i, pieces = 0, iter(out)
    before = ""
    for n, line in enumerate(lines):
        if n == 0:
            next(pieces)
        elif line:
            if before:
                kept += [at[i - 1]] * len(next(pieces))
            next(pieces)
        kept += at[i : i + len(line)]
        before = line or before
        i += len(line) + 1
    return kept


def _is_head(out: list[str]) -> bool:
    """Whether the last ) closes the head of an if, for, while or with."""
    depth, text = 0, ""
    for i in range(len(out) - 1, -1, -1):
        for j in range(len(out[i]) - 1, -1, -1):
            c = out[i][j]
            if c == ")":
                depth += 1
            elif c == "(":
                depth -= 1
                if depth == 0:
                    text = "".join(out[max(0, i - 4) : i]) + out[i][:j]
                    return text[-1:] in _HEADS or (text[-1:] == _C["await"] and text[-2:-1] == _C["for"])
    return False


_MARKUP = re.compile(r"</|/>")
_JSX_START = set("(=?:,&|[{};\n!") | {_C[k] for k in "=> && || ?? return default case".split()}
_TAG = re.compile(r"<\s*(?:([A-Za-z_$][\w$.:-]*)|(?=>))")
_JSX_WORD = re.compile(r"[A-Za-z_$][\w$:.-]*")
_JSX_SPACE = re.compile(r"(?:\s|/\*(?s:.*?)\*/|//[^\n]*\n)*")


_REGEX_AT = re.compile(_REGEX)
#: Classes after which a slash begins a regular expression.
_REGEX_AFTER = set("\r=(,:[!&|?{};+-*%~^<>\x00") | {
    _C[k] for k in "=> && || ?? === !== == != <= >= return typeof case in of delete void throw new else do await yield default instanceof".split()
}
_KEYWORD_SLASH = re.compile("[" + "".join(_C[k] for k in "return typeof case in of delete void throw new else do await yield default instanceof".split()) + "][/]")


def lex(text: str, dialect: str = "tsx", at: list[int] | None = None) -> str:
    """The class string of a file; `dialect` is ts (no markup) or tsx (with markup); `at` receives the place in the text of each class.

    Texts without markup, nested templates and regular expressions after keywords take the fast way; others are scanned with state.
    """
    mark, first = "", 0
    if text.startswith("#!"):
        first = text.find("\n") + 1 or len(text)
        text, mark = text[first:], "H"
    markup = dialect != "ts" and bool(_MARKUP.search(text))
    if not markup:
        tokens = LEXER.tokens(text)
        joined = "".join(tokens)
        if not ("`" in text and "\x00" in joined) and not _KEYWORD_SLASH.search(joined):
            if at is not None:
                at.extend(p for c, p in zip(tokens, LEXER.places(text)) for _ in c)
            return mark + _shifted(joined, first, at)
    starts: list[int] = []
    tokens = _scan(text, 0, markup, starts=starts)[0]
    if at is not None:
        at.extend(p for c, p in zip(tokens, starts) for _ in c)
    return mark + _shifted("".join(tokens), first, at)


def _shifted(joined: str, first: int, at: list[int] | None) -> str:
    """The decided classes; places are counted from the start of the file, of which `first` characters are a hashbang."""
    out = _line_ends(joined, at)
    if at is not None:
        at[:] = ([0] if first else []) + [p + first for p in at]
    return out


def _scan(text: str, pos: int, markup: bool, inside: bool = False, starts: list[int] | None = None) -> tuple[list[str], int]:
    """The classes from pos on, whose places `starts` receives, and the end; `inside` stops after the brace that closes the one at pos (-1 if there is none)."""
    out: list[str] = []
    starts = [] if starts is None else starts
    last, n, depth = "\r", len(text), 0
    match = LEXER.master.match
    while pos < n:
        m = match(text, pos)
        token, at = m[1], m.start(1)
        pieces, end = None, -1
        if token[:1] == "`":
            pieces, end = _template(text, at, markup)
        elif markup and token == "<" and last in _JSX_START and _TAG.match(text, at):
            pieces, end = _element(text, at, markup)
        if end > 0:
            out.append("«" + "¦".join(pieces) + "»")
            starts.append(at)
            last, pos = "»", end
            continue
        if token in ("/", "/=") and last in _REGEX_AFTER:
            r = _REGEX_AT.match(text, at)
            if r:
                out.append("R")
                starts.append(at)
                last, pos = "R", r.end()
                continue
        c = "\x00" if token[:1] == "`" else _of(token)
        pos = (at + 1 if token[:1] == "`" else m.end()) if m.end() > pos else pos + 1
        if inside and c:
            if c[0] == "{":
                depth += 1
                if depth == 1 and len(c) == 1:
                    last = "{"
                    continue
                c = c[1:] if depth == 1 else c
            elif c == "}":
                depth -= 1
                if depth == 0:
                    return out, pos
        if c:
            out.append(c)
            starts.append(at)
            last = c[-1] if c != "\r" else last
    return out, -1 if inside else pos


def _template(text: str, pos: int, markup: bool) -> tuple[list[str], int]:
    """The expressions in a template that begins at pos and its end, or -1."""
    pieces: list[str] = []
    at = pos + 1
    stop = re.compile(r"\\\\|`|\$\{")
    while m := stop.search(text, at):
        if m[0] == "`":
            return pieces, m.end()
        if m[0] == "\\":
            at = m.end() + 1
            continue
        inner, at = _braces(text, m.end() - 1, markup)
        if at < 0:
            return pieces, -1
        pieces.append(inner)
    return pieces, -1


def _element(text: str, pos: int, markup: bool = True) -> tuple[list[str], int]:
    """The expressions in an element that begins at pos and its end, or -1."""
    pieces: list[str] = []
    m = _TAG.match(text, pos)
    if not m:
        return pieces, -1
    name, pos = m[1] or "", m.end()
    while True:  # attributes
        pos = _JSX_SPACE.match(text, pos).end()
        c = text[pos : pos + 1]
        if text.startswith("/>", pos):
            return pieces, pos + 2
        if c == ">":
            pos += 1
            break
        if c == "{":
            inner, pos = _braces(text, pos, markup)
            if pos < 0:
                return pieces, -1
            pieces.append(inner)
            continue
        w = _JSX_WORD.match(text, pos)
        if not w:
            return pieces, -1
        pos = _JSX_SPACE.match(text, w.end()).end()
        if text.startswith("=", pos):
            pos = _JSX_SPACE.match(text, pos + 1).end()
            q = text[pos : pos + 1]
            if q and q in "\"'":
                pos = text.find(q, pos + 1) + 1
                if pos <= 0:
                    return pieces, -1
            elif q == "{":
                inner, pos = _braces(text, pos, markup)
                if pos < 0:
                    return pieces, -1
                pieces.append(inner)
            else:
                more, pos = _element(text, pos, markup)
                if pos < 0:
                    return pieces, -1
                pieces += more
    while True:  # children
        m2 = re.compile(r"[^<{>}]*").match(text, pos)
        pos = m2.end()
        c = text[pos : pos + 1]
        if c == "{":
            inner, pos = _braces(text, pos, markup)
            if pos < 0:
                return pieces, -1
            pieces.append(inner)
        elif text.startswith("</", pos):
            m3 = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>").match(text, pos)
            if not m3 or (m3[1] or "") != name:
                return pieces, -1
            return pieces, m3.end()
        elif c == "<":
            more, pos = _element(text, pos, markup)
            if pos < 0:
                return pieces, -1
            pieces += more
        else:
            return pieces, -1


def _braces(text: str, pos: int, markup: bool) -> tuple[str, int]:
    """The classes between the brace at pos and its partner, and the end."""
    out, end = _scan(text, pos, markup, True)
    return _line_ends("".join(out)), end
