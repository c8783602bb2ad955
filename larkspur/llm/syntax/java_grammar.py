"""Java 17: token classes and grammar."""

from __future__ import annotations

from larkspur.llm.syntax.braces import Lexer, classes
from larkspur.llm.syntax.packrat import Grammar

KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if"
    " implements import instanceof int interface long native new package private protected public return short static strictfp super switch"
    " synchronized this throw throws transient try void volatile while true false null"
    " var record sealed permits non yield module open requires exports opens uses provides to with transitive when"
).split()
SOFT = "var record sealed permits non yield module open requires exports opens uses provides to with transitive when".split()
OPERATORS = "<<= >>= ... -> :: ++ -- && || == != <= += -= *= /= &= |= ^= %= << + - * / & | ^ % ! ~ = < > ? : ; , . @ ( ) [ ] { }".split()
CLASSES = classes(KEYWORDS, OPERATORS, {})
CLASSES["NAME"] = "I" + "".join(CLASSES[k] for k in SOFT)
CLASSES["TYPENAME"] = "I" + "".join(CLASSES[k] for k in SOFT if k not in ("var", "record", "sealed", "permits", "yield"))
CLASSES["PRIMITIVE"] = "".join(CLASSES[k] for k in "boolean byte char double float int long short".split())
CLASSES["MODWORD"] = "".join(CLASSES[k] for k in "public protected private static abstract final native synchronized transient volatile strictfp default".split())
CLASSES["ASSIGN"] = "".join(CLASSES[k] for k in "= += -= *= /= &= |= ^= %= <<= >>=".split())
CLASSES["BIN"] = "".join(CLASSES[k] for k in "&& || == != <= << + - * / & | ^ % <".split())

CLASSES["CALLED"] = ")}" + CLASSES["++"] + CLASSES["--"]

GRAMMAR = r"""
file <- annotations? package? (import / ";")* (type / ";")* !. / annotations? (import / ";")* "open"? "module" dotted "{" directive* "}"
directive <- ("requires" ("transitive" / "static")* / "exports" / "opens" / "uses" / "provides") dotted (("to" / "with") dotted ("," dotted)*)? ";"
package <- "package" dotted ";"
import <- "import" "static"? dotted ("." "*")? ";"
dotted <- NAME ("." NAME)*
annotations <- annotation+
annotation <- "@" dotted ("(" (element ("," element)* ","?)? ")")?
element <- NAME "=" value / value
value <- "{" (value ("," value)*)? ","? "}" / annotation / ternary
modifiers <- (annotation / MODWORD / "sealed" &(MODWORD / "class" / "interface" / "@") / "non" "-" "sealed")*
type <- modifiers (class / interface / enum / record / annotationtype)
class <- "class" TYPENAME typeparams? ("extends" ref)? ("implements" refs)? ("permits" refs)? classbody
interface <- "interface" TYPENAME typeparams? ("extends" refs)? ("permits" refs)? classbody
record <- "record" TYPENAME typeparams? "(" (component ("," component)*)? ")" ("implements" refs)? classbody
component <- modifiers anytype annotations? "..."? NAME
annotationtype <- "@" "interface" TYPENAME "{" (annmember / member)* "}"
annmember <- modifiers anytype NAME "(" ")" dims ("default" value)? ";"
enum <- "enum" TYPENAME ("implements" refs)? "{" (constant ("," constant)*)? ","? (";" member*)? "}"
constant <- annotations? NAME arguments? classbody?
classbody <- "{" member* "}"
member <- ";" / "static"? block / modifiers (class / interface / enum / record / annotationtype)
  / modifiers typeparams? constructor / modifiers typeparams? method / field / modifiers compact
field <- modifiers anytype declarator ("," declarator)* ";"
constructor <- NAME "(" params? ")" throws? block
compact <- NAME block
method <- ("void" / anytype) NAME "(" params? ")" dims throws? (block / ";")
throws <- "throws" ref ("," ref)*
params <- param ("," param)*
param <- modifiers anytype (annotations? "...")? ((NAME ".")* "this" / NAME dims)
declarator <- NAME dims ("=" init)?
init <- arrayinit / expr
arrayinit <- "{" (init ("," init)*)? ","? "}"
dims <- (annotations? "[" "]")*
typeparams <- "<" typeparam ("," typeparam)* ">"
typeparam <- annotations? NAME ("extends" ref ("&" ref)*)?
anytype <- annotations? (PRIMITIVE / ref1) dims
ref <- annotations? (PRIMITIVE dim1 dims / ref1 dims)
dim1 <- annotations? "[" "]"
ref1 <- NAME typeargs? ("." annotations? NAME typeargs?)*
refs <- ref ("," ref)*
typeargs <- "<" (typearg ("," typearg)*)? ">"
typearg <- annotations? ("?" (("extends" / "super") ref)? / ref / anytype)
block <- "{" blockstatement* "}"
blockstatement <- local ";" / modifiers (class / interface / enum / record) / statement
local <- modifiers anytype !"::" !("." / "->") declarator ("," declarator)*
statement <- block / ";" / "if" parens statement ("else" statement)? / "while" parens statement / for
  / "do" statement "while" parens ";" / "try" try / switch / "synchronized" parens block / "return" expr? ";" / "throw" expr ";"
  / "break" NAME? ";" / "continue" NAME? ";" / "assert" expr (":" expr)? ";" / "yield" !("=" / "." / "(" ")" / "++" / "--" / "[") expr ";" / NAME ":" statement / exprstatement ";"
exprstatement <- ("++" / "--") unary / postfix (ASSIGN / ">" ">>=") expr / !(parens ";") postfix <CALLED>
parens <- "(" expr ")"
for <- "for" "(" (modifiers anytype NAME dims ":" expr / (local / exprs)? ";" expr? ";" exprs?) ")" statement
exprs <- expr ("," expr)*
try <- "(" resource (";" resource)* ";"? ")" block catch* finally? / block (catch+ finally? / finally)
resource <- modifiers anytype NAME "=" expr / expr
catch <- "catch" "(" modifiers ref ("|" ref)* NAME ")" block
finally <- "finally" block
switch <- "switch" parens "{" (rule+ / group*) "}"
rule <- label "->" (block / "throw" expr ";" / expr ";")
group <- (label ":")+ blockstatement*
label <- "case" ternary ("," ternary)* / "default"
pattern <- modifiers anytype NAME
expr <- lambda / ternary ((ASSIGN / ">" ">>=") expr)?
lambda <- (NAME / "(" (NAME ("," NAME)*)? ")" / "(" params ")") "->" (block / expr)
ternary <- binary ("?" (lambda / expr) ":" (lambda / ternary))?
binary <- unary (("instanceof" (pattern !"(" / "final"? ref) / (BIN / ">" ">" ">" / ">" ">" / ">" "="? !"=") (lambda / unary)))*
unary <- ("+" / "-" / "++" / "--" / "!" / "~") unary / cast / postfix
cast <- "(" PRIMITIVE dims ")" unary / "(" ref ("&" ref)* ")" (lambda / !("+" / "-" / "++" / "--") unary)
postfix <- primary selector* ("++" / "--")*
selector <- "." (typeargs? NAME arguments? / "new" creator / "this" / "class" / typeargs? "super" arguments? ) / "[" expr "]" / "::" typeargs? (NAME / "new")
arguments <- "(" exprs? ")"
primary <- NUM / STR / CHAR / "true" / "false" / "null" / "this" arguments? / "super" (arguments / &("." / "::"))
  / "new" creator / "switch" parens "{" (rule+ / group*) "}" / "(" expr ")"
  / (PRIMITIVE / "void") dims ("." "class" / "::" "new") / ref1 dim1 dims ("." "class" / "::" "new") / NAME typeargs ("." NAME typeargs?)* "::" ("new" / NAME)
  / NAME arguments / NAME
creator <- annotations? typeargs? (PRIMITIVE / ref1 / NAME "<" ">") ((annotations? "[" expr "]")+ dims / dim1 dims arrayinit / arguments classbody?)
"""

JAVA = Grammar(GRAMMAR, CLASSES, cached={"block": "()", "blockstatement": ";", "member": ";"}, memo=("expr", "postfix", "primary", "anytype", "ref1"), reaching=CLASSES["if"])

LEXER = Lexer(
    KEYWORDS, OPERATORS, CLASSES,
    literals=r"\"\"\"[ \t\f]*\n(?:[^\\\"]|\\(?s:.)|\"(?!\"\"))*\"\"\"|\"(?!\"\")(?:[^\"\\\n]|\\[^\n])*\"|\"\"(?!\")|'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|[^\n]))'",
    numbers=r"0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?\d[\d_]*)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[lLfFdD]?",
    words=r"(?:[^\W\d]|\$)[\w$]*",
)


def lex(text: str, at: list[int] | None = None) -> str:
    """The class string of a file; `at` receives the place in the text of each class."""
    tokens = LEXER.tokens(text)
    if at is not None:
        at.extend(p for c, p in zip(tokens, LEXER.places(text)) if c != "\n" for _ in c)
    return "".join([c for c in tokens if c != "\n"])
