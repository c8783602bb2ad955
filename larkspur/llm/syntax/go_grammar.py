"""Go: token classes, semicolon insertion and grammar."""

from __future__ import annotations

import re

from larkspur.llm.syntax.braces import Lexer, classes
from larkspur.llm.syntax.packrat import Grammar

KEYWORDS = (
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
).split()
OPERATORS = (
    "<<= >>= &^= ... := <- ++ -- && || == != <= >= += -= *= /= %= &= |= ^= &^ << >> + - * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~"
).split()
CLASSES = classes(KEYWORDS, OPERATORS, {})
CLASSES["ASSIGN"] = "".join(CLASSES[k] for k in "= += -= *= /= %= &= |= ^= <<= >>= &^=".split())
CLASSES["BIN"] = "".join(CLASSES[k] for k in "&& || == != <= >= < > + - * / % & | ^ &^ << >>".split())
#: Classes after which a line end is a semicolon.
ENDING = set("INSC)]}") | {CLASSES[k] for k in "break continue fallthrough return ++ --".split()}

_TEXT = r"""
file <- ";"* "package" ID ";" (import ";")* (declaration ";")* ";"*
import <- "import" (importspec / "(" (importspec ";")* importspec? ")")
importspec <- (ID / ".")? STR
declaration <- "const" (constspec / "(" (constspec ";")* constspec? ")") / "var" (varspec / "(" (varspec ";")* varspec? ")")
  / "type" (typespec / "(" (typespec ";")* typespec? ")") / func
constspec <- ids (type? "=" exprs)?
varspec <- ids (type ("=" exprs)? / "=" exprs)
typespec <- ID "=" type / ID typeparams type / ID type
ids <- ID ("," ID)*
func <- "func" parameters? ID typeparams? signature block?
typeparams <- "[" typeparam ("," typeparam)* ","? "]"
typeparam <- ids constraint
constraint <- "~"? type ("|" "~"? type)*
signature <- parameters (parameters / type)?
parameters <- "(" (named ("," named)* ","? / variadic ("," variadic)* ","?)? ")"
named <- ids "..."? type
variadic <- "..."? type
type <- ID ("." ID)? ("[" type ("," type)* ","? "]")? / "*" type / "[" "]" type / "[" ("..." / expr) "]" type / "(" type ")" / "map" "[" type "]" type
  / "<-" "chan" type / "chan" "<-"? type / "func" signature / struct / interface
struct <- "struct" "{" (fielddecl ";")* fielddecl? "}"
fielddecl <- (ids type / "*"? ID ("." ID)? ("[" type ("," type)* "]")? / "(" "*"? ID ")") STR?
interface <- "interface" "{" (element ";")* element? "}"
element <- ID signature / constraint
block <- "{" statements "}"
statements <- line* statement?
line <- statement? ";"
statement <- labeled / declaration / simple_or_other
labeled <- ID ":" statement?
simple_or_other <- "go" expr / "defer" expr / "return" exprs? / "break" ID? / "continue" ID? / "goto" ID / "fallthrough" / block / if / switch / select / for / simple
simple <- ids ":=" ("range" expr / exprs) / exprs ("++" / "--" / "<-" expr / ASSIGN "range" expr / ASSIGN exprs)?
if <- "if" (simple_h? ";")? expr_h block ("else" (if / block))?
simple_h <- ids ":=" exprs_h / exprs_h ("++" / "--" / "<-" expr_h / ASSIGN exprs_h)?
switch <- "switch" (simple_h? ";")? (ID ":=" unary_h "." "(" "type" ")" / typeswitch / expr_h)? "{" case* "}"
typeswitch <- unary_h "." "(" "type" ")"
case <- ("case" cases / "default") ":" statements
cases <- type_or_expr ("," type_or_expr)*
type_or_expr <- expr &("," / ":") / type
select <- "select" "{" (("case" simple / "default") ":" statements)* "}"
for <- "for" (rangeclause block / simple_h? ";" expr_h? ";" simple_h? block / expr_h block / block)
rangeclause <- (ids ":=" / exprs_h "=")? "range" expr_h
exprs <- expr ("," expr)*
expr <- unary (BIN unary)*
unary <- ("+" / "-" / "!" / "^" / "*" / "&" / "<-")* primary
primary <- operand suffix*
operand <- literal / NUM / STR / CHAR / "func" signature block / conversion "(" expr ","? ")" / ID / "(" (expr / type) ")"
conversion <- &("[" / "map" / "chan" / "struct" / "interface" / "func") type
literal <- literaltype literalvalue
literaltype <- "struct" "{" (fielddecl ";")* fielddecl? "}" / "[" ("..." / expr)? "]" type / "map" "[" type "]" type / ID ("." ID)? ("[" type ("," type)* ","? "]")?
literalvalue <- "{" (keyed ("," keyed)* ","?)? ";"? "}"
keyed <- (value ":")? value
value <- literalvalue / expr
suffix <- "." ID / "." "(" type ")" / "[" (index) "]" / "(" (argument ("," argument)* "..."? ","?)? ")"
index <- expr? ":" expr? (":" expr)? / indexed ("," indexed)* ","?
indexed <- expr &("," / "]") / type
argument <- expr &("," / ")" / "...") / type
"""
#: The expression rules once more for headers of if, for and switch, where a brace after a type name opens the block.
_HEADERS = r"""
exprs_h <- expr_h ("," expr_h)*
expr_h <- unary_h (BIN unary_h)*
unary_h <- ("+" / "-" / "!" / "^" / "*" / "&" / "<-")* primary_h
primary_h <- operand_h suffix*
operand_h <- !ID literal / NUM / STR / CHAR / "func" signature block / conversion "(" expr ","? ")" / ID / "(" (expr / type) ")"
"""

GO = Grammar(_TEXT + _HEADERS, CLASSES, cached={"block": "()", "line": ";"}, memo=("expr", "primary", "type", "expr_h", "primary_h"))

LEXER = Lexer(
    KEYWORDS, OPERATORS, CLASSES,
    literals=r"`[^`]*`|\"(?:[^\"\\\n]|\\[^\n])*\"|'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|[abfnrtv\\'\"]))'",
    numbers=r"0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?[\d_]+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?i?",
)


_LINE = re.compile("(?<=[" + "".join(map(re.escape, sorted(ENDING))) + "])\n+")


def lex(text: str, at: list[int] | None = None) -> str:
    """The class string of a file; `at` receives the place in the text of each class."""
    text = text if text.endswith("\n") else text + "\n"
    tokens = LEXER.tokens(text)
    if at is not None:
        last = ""
        for c, p in zip(tokens, LEXER.places(text)):
            if c and (c != "\n" or last in ENDING):
                at.append(p)
            last = c if c != "\n" else "" if last in ENDING else last
    return _LINE.sub(";", "".join(tokens)).replace("\n", "")
