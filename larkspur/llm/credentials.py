"""Credentials in source code and configuration by a linear-chain conditional random field over lexical tokens.

A line is cut into tokens: words, parts of literals, user information and named values of addresses and connection strings, key
block markers. Each token has features of its shape and of its context (the name it is assigned to, the tokens beside it), and
the step from a token to the next depends on whether they stand in one literal, in two joined ones or apart. Any token may be
labelled; the Viterbi path decides, and its spans say which characters are masked. The weights come from
`credentials_training` and lie in ``credentials_model.json``.

Lines without a trigger are not cut into tokens. That loses nothing: without one no token has a secret name, a known key format or a
context that holds credentials, and the weights give every such token less than any path could win back (`Field_.least_margin`,
which a test checks on the shipped weights over all combinations of features).
"""

from __future__ import annotations

import base64
import binascii
import functools
import json
import math
import pkgutil
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = Path(__file__).with_name("credentials_model.json")
#: Beginnings of well-known key formats (fixed values).
PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "sk-", "pk-", "rk-", "npm_", "hf_", "dop_v1_", "SG.", "ya29.", "shpat_", "eyJ")
#: What every line holds that has a token with a secret name, a key format or a context of credentials (see `name_kind`, `shape`, `tokens`); in lower case.
TRIGGER = re.compile(r"pass|pwd|secret|token|key|cred|auth|log_?-?in|sign_?-?in|bearer|basic |://|-----begin |sig=|code=|-u |--user|_live_|_test_|_prod_|" + "|".join(re.escape(p.lower()) for p in PREFIXES))
_NUMBER = re.compile(r" *\d+ \| ?")
_LEX = re.compile(
    r"(?P<pem>-----(?:BEGIN|END) [A-Z0-9 ]+-----)|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`?)|(?P<word>[A-Za-z_$][\w$-]*)|(?P<num>\d[\w.]*)|(?P<op>:=|=>|==|!=|[^\s\w])"
)
_BARE = re.compile(r"^\s*(?:export\s+|set\s+|ENV\s+|-\s+)?(?P<name>[\w.-]+)\s*[=:]\s*(?P<value>[^\s\"'`#{\[(](?:(?![\[(][\"'])\S)*)\s*(?P<rest>\s(?:#|//).*)?$")
_PAIR = re.compile(r"(?:^|(?<=[\s;,&?]))(?P<name>[A-Za-z][\w.-]*(?: [A-Za-z]+)?)\s*=\s*(?:'(?P<quoted>[^']*)'|(?P<value>[^\s;,&\"']+))")
_FLAG = re.compile(r"(?<![\w-])(?:--(?P<flag>[A-Za-z][\w-]*)(?:=|\s+)|(?:-u|--user)(?:=|\s+)(?P<user>[\w.@-]+):)(?P<q>[\"']?)(?P<value>[^\s\"'`]+)")
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z][\w.-]*)(?:\s[^<>]*)?>(?P<value>[^<>]+)</(?P=name)>")
_NETRC = re.compile(r"^\s*(?:machine\s+\S+\s+|default\s+)?login\s+\S+\s+password\s")
_AUTH_CALL = re.compile(r"(?i)log_?in$|sign_?in$|auth(?:enticate|orize)?$")
_COMMENT = re.compile(r"^\s*(?:#|//|/?\*+|--|;)(?P<text>.*)$")
_URL = re.compile(r"[a-z][a-z0-9+.-]*://(?:(?P<user>[^/\s:@]*):(?P<pass>[^/\s@]+)@)?(?P<rest>[^\s\"'`]*)", re.I)
_QUERY = re.compile(r"[?&](?P<name>[\w-]+)=(?P<value>[^&\s#\"'`]+)")
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_SECRET_WORDS = frozenset("password passwd passphrase pwd pass secret secrets token credential credentials apikey passcode".split())
_KEY_BEFORE = frozenset("api auth access webhook signing private encryption service client master admin secret shared account license session ssh deploy staging sas".split())
_OTHER_WORDS = frozenset("digest checksum sha md5 etag hash commit revision uuid guid public fingerprint integrity".split())
_PLACE = re.compile(
    r"^(?:$|\.+|x+|\*+|-+|_+|todo|tbd|none|null|nil|true|false|unset|not[-_ ]set|n/?a|change[-_ ]?me.*|secret|password|token|test|foo|bar)$|<[^>]*>|\{\{|\$\{|\$\(|%\(|(?-i:%[sd])(?![A-Za-z0-9])|\bredacted\b|\bmasked?\b"
    r"|\byour\b|\bhere\b|(?:^|[-_ ])here$|^(?:example|dummy|sample|fake|placeholder|insert|put|replace|enter|change)[-_ ]|(?:example|placeholder|changeme)|x{5,}|\*{3,}|•|…", re.I
)
_POINTER = re.compile(r"^(?:vault|env|file|secrets?-?manager|ssm|kms|arn|op|sops|aws|gcp|azure|k8s|config|keyring)[:+]|^\$[A-Z_]+$|^/run/secrets|^%\w+%$|^~?\.{0,2}/[\w./-]+$", re.I)
_INTEGRITY = re.compile(r"^(?:sha\d{1,3}|md5)[-:]", re.I)
_UUID = re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)
_HEX = re.compile(r"^[0-9a-f]{16,}$", re.I)
_FORMAT = re.compile(r"^(?:[a-z]{2,5}_(?:live|test|prod)_|" + "|".join(re.escape(p) for p in PREFIXES) + r")[\w.=/+-]{10,}$")
_PREFIXED = re.compile(r"^[a-z]{2,4}[.-](?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[A-Z])[\w.=/+-]{10,}$")
_PLAIN = re.compile(r"^[A-Za-z]+(?:[._/:-][A-Za-z]+)*[.!?,;]?$")
_CAMEL = re.compile(r"^[A-Za-z]?[a-z]*(?:[A-Z][a-z]{2,})*$")
_UPPER = re.compile(r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$|^[A-Z]+$")
_HOST = re.compile(r"^[\w-]+(?:\.[a-z]{2,})+(?::\d+)?(?:/\S*)?$")


#: Words that make several words in a row a sentence or a caption rather than a passphrase (fixed values).
_FUNCTION = frozenset(
    "a an and are as at be been by can cannot could do does enter expired failed for from get has have how if in incorrect invalid is it its may missing must no not of on or out"
    " please provided replace required set should that the this to too use used was when where which will with wrong you your".split()
)
CONTEXTS = ("value", "phrase", "words", "comment", "code", "bearer", "basic", "userinfo", "query", "flag", "element", "netrc", "pem")
SHAPES = ("placeholder", "pointer", "integrity", "number", "uuid", "format", "prefixed", "hex", "upper", "plain", "mixed", "host", "random", "identifier", "other")
#: How a token hangs on the one before it.
LINKS = ("apart", "same", "joined")


@dataclass(slots=True)
class Token:
    start: int
    end: int
    text: str
    name: str  # secret, other, neutral: what the token's name says
    context: str  # one of CONTEXTS
    link: str = "apart"  # same: in one literal with the token before; joined: in a literal joined to that of the token before
    sense: str = "single"  # of the literal: single (word), few (two words), sentence, phrase

    @property
    def shape(self) -> str:
        return shape(self.text)


@functools.lru_cache(maxsize=200_000)
def shape(text: str) -> str:
    """The class of a token's characters."""
    if _PLACE.search(text):
        return "placeholder"
    if _POINTER.search(text):
        return "pointer"
    if _INTEGRITY.search(text):
        return "integrity"
    if re.fullmatch(r"[\d.,:_-]+", text):
        return "number"
    if _UUID.match(text):
        return "uuid"
    if _FORMAT.match(text):
        return "format"
    if _PREFIXED.match(text):
        return "prefixed"
    if _HEX.match(text):
        return "hex"
    if _UPPER.match(text):
        return "upper"
    if _PLAIN.match(text):
        return "plain" if all(len(p) < 8 or _CAMEL.match(p) or p.isupper() for p in re.split(r"[._/:-]", text)) else "mixed"
    if _HOST.match(text):
        return "host"
    digit, upper, lower = bool(re.search(r"\d", text)), bool(re.search(r"[A-Z]", text)), bool(re.search(r"[a-z]", text))
    symbol = bool(re.search(r"[^\w]", text))
    if len(text) >= 20 and re.fullmatch(r"[\w+/=.-]+", text) and digit + upper + lower >= 2:
        return "random"
    if digit + upper + lower + symbol >= 3 or (digit and (upper or lower or symbol)):
        return "mixed"
    return "identifier" if re.fullmatch(r"[\w.-]+", text) else "other"


@functools.lru_cache(maxsize=100_000)
def name_kind(name: str) -> str:
    """What an identifier says of its value: secret, other (a digest, an id) or neutral."""
    words = [w.lower() for w in _SPLIT.findall(name)]
    if any(w in _OTHER_WORDS or (w == "id" and i and words[i - 1] not in _KEY_BEFORE) for i, w in enumerate(words)):
        return "other"
    joined = "".join(words)
    if any(w in _SECRET_WORDS for w in words) or any(w in joined for w in ("passw", "passphrase", "apikey", "secretkey", "accesskey", "authkey")):
        return "secret"
    if any(len(w) > 5 and w.endswith(("token", "secret", "pwd")) for w in words):
        return "secret"
    if any(w == "key" and i and words[i - 1] in _KEY_BEFORE for i, w in enumerate(words)):
        return "secret"
    return "neutral"


def _pair(text: str) -> bool:
    """Whether a text is the base64 form of user:password."""
    try:
        return b":" in base64.b64decode(text + "=" * (-len(text) % 4), validate=True)[1:]
    except (binascii.Error, ValueError):
        return False


def _sense(parts: list[str]) -> str:
    """Whether the words of a literal are a sentence, a phrase, a few words or one."""
    if len(parts) == 1:
        return "single"
    if any(p.lower().strip(".,:;!?") in _FUNCTION or re.search(r"[{}<>%]", p) for p in parts) or parts[-1][-1:] in ".:?…" or any(p.endswith((",", ":")) for p in parts):
        return "sentence"
    return "few" if len(parts) == 2 else "phrase"


def _inside(content: str, at: int, name: str, out: list[Token], link: str = "apart") -> None:
    """The tokens of a literal's content that begins at `at`; `link` is how it hangs on the token before."""
    add = out.append
    if "=" in content and "://" not in content and any(name_kind(m["name"]) != "neutral" for m in _PAIR.finditer(content)):
        for m in _PAIR.finditer(content):
            group = "quoted" if m["quoted"] is not None else "value"
            add(Token(at + m.start(group), at + m.end(group), m[group], name_kind(m["name"]), "query"))
        return
    url = _URL.search(content)
    if url and not url["user"] and not _QUERY.search(content) and not _FLAG.search(content):
        add(Token(at, at + len(content), content, "neutral", "words"))
        return
    if url and not _FLAG.search(content):
        for url in _URL.finditer(content):
            if url["pass"]:
                add(Token(at + url.start("user"), at + url.end("user"), url["user"], "neutral", "words"))
                add(Token(at + url.start("pass"), at + url.end("pass"), url["pass"], "secret", "userinfo"))
            for q in _QUERY.finditer(content, url.end("pass") if url["pass"] else url.start(), url.end()):
                kind = "secret" if name_kind(q["name"]) == "secret" or q["name"].lower() in ("sig", "signature", "key", "auth", "code") else "neutral"
                add(Token(at + q.start("value"), at + q.end("value"), q["value"], kind, "query"))
        return
    parts = list(re.finditer(r"\S+", content))
    if len(parts) == 1:
        add(Token(at + parts[0].start(), at + parts[0].end(), parts[0][0].replace("\\n", ""), name, "value", link))
        return
    flags = {m.start("value"): m for m in _FLAG.finditer(content)}
    sense = _sense([p[0] for p in parts]) if parts else ""
    before = ""
    for k, p in enumerate(parts):
        scheme = before.lower() if before.lower() in ("bearer", "basic") else ""
        flag = next((m for i, m in flags.items() if p.start() <= i < p.end()), None)
        if flag:
            _flag(flag, at, out)
            link = "apart"
        elif scheme and k == len(parts) - 1:
            add(Token(at + p.start(), at + p.end(), p[0], "secret", scheme, "same"))
        else:
            add(Token(at + p.start(), at + p.end(), p[0], name, "phrase", link, sense))
            link = "same"
        before = p[0]


def _flag(m: re.Match, at: int, out: list[Token]) -> None:
    """The token of a command's option."""
    kind = "secret" if m["user"] else name_kind(m["flag"])
    out.append(Token(at + m.start("value"), at + m.end("value"), m["value"], kind, "userinfo" if m["user"] else "flag"))


def _words(line: str, begin: int, out: list[Token]) -> None:
    """The tokens of a comment's text from `begin` on."""
    before: list[str] = []
    label = ""
    for w in re.finditer(r"\S+", line[begin:]):
        text, at = w[0], begin + w.start()
        core = text.strip("\"'`,;")
        at += text.find(core) if core else 0
        if label:
            scheme = before[-1].lower() if before and before[-1].lower() in ("bearer", "basic") else ""
            out.append(Token(at, at + len(core), core, "secret", scheme or "comment"))
            label = "" if not scheme else label
        elif before and before[-1].lower() in ("bearer", "basic") and not line[begin + w.end() :].strip():
            out.append(Token(at, at + len(core), core, "secret", before[-1].lower()))
        elif "://" in core:
            _inside(core, at, "neutral", out)
        else:
            out.append(Token(at, at + len(core), core, "neutral", "words"))
        before.append(text.rstrip(":="))
        if text.endswith((":", "=")) and any(name_kind(b) == "secret" or b.lower() in ("key", "login") for b in before[-8:]):
            label = "secret"
        elif "=" in text and name_kind(text.split("=", 1)[0]) == "secret":
            value = text.split("=", 1)[1].strip("\"'`,;")
            where = begin + w.start() + text.find(value, text.find("="))
            out[-1] = Token(where, where + len(value), value, "secret", "comment")


def tokens(line: str, inherited: str = "") -> list[Token]:
    """The tokens of a line of code, configuration or comment; `inherited` is the kind of a name whose value goes on here."""
    out: list[Token] = []
    comment = _COMMENT.match(line)
    if comment and "-----" not in line and not _FLAG.match(line.lstrip()):
        _words(line, comment.start("text"), out)
        return out
    bare = _BARE.match(line)
    if bare and not bare["value"].endswith(("(", "{", "[")) and not bare["value"].startswith(("-----", "+")):
        value = bare["value"].rstrip(",;")
        if "://" in value:
            _inside(value, bare.start("value"), name_kind(bare["name"]), out)
        else:
            out.append(Token(bare.start("value"), bare.start("value") + len(value), value, name_kind(bare["name"]), "value"))
        if bare["rest"]:
            _words(line, bare.start("rest") + len(bare["rest"]) - len(bare["rest"].lstrip(" \t#/")), out)
        return out
    if _NETRC.match(line):
        words = list(re.finditer(r"\S+", line))
        for k, w in enumerate(words):
            named = name_kind(words[k - 1][0]) if k else "neutral"
            out.append(Token(w.start(), w.end(), w[0], named, "netrc" if named == "secret" else "words"))
        return out
    if "</" in line:
        for m in _ELEMENT.finditer(line):
            value = m["value"].strip()
            where = m.start("value") + m["value"].find(value)
            out.append(Token(where, where + len(value), value, name_kind(m["name"]), "element", "apart", _sense(value.split() or [""])))
        if out:
            return out
    name, last, called, glue, typed = inherited, "", "", False, False
    flags = {m.start("value"): m for m in _FLAG.finditer(line)} if "--" in line or "-u" in line else {}
    done = 0
    for m in _LEX.finditer(line):
        kind, text = m.lastgroup, m[0]
        if m.start() < done:
            continue
        if m.start() in flags or (kind == "str" and m.start() + 1 in flags and flags[m.start() + 1].start() < m.start()):
            flag = flags.get(m.start()) or flags[m.start() + 1]
            if flag["user"] or name_kind(flag["flag"]) == "secret":
                _flag(flag, 0, out)
                done = flag.end()
                continue
        if kind == "pem":
            out.append(Token(m.start(), m.end(), text, "secret" if "PRIVATE KEY" in text and "BEGIN" in text else "neutral", "pem" if "PRIVATE KEY" in text else "words"))
        elif kind == "str":
            if called and re.match(r"\s*,", line[m.end() :]) and re.fullmatch(r"[\w.-]{1,40}", text[1:-1]):
                last = text[1:-1]  # an argument that names the next one
                out.append(Token(m.start() + 1, m.end() - 1, last, "neutral", "words"))
                continue
            content = text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:]
            if "-----BEGIN " in content or "-----END " in content:
                private = "PRIVATE KEY" in content and "BEGIN" in content
                out.append(Token(m.start() + 1, m.start() + 1 + len(content), content, "secret" if private else "neutral", "pem" if private else "words"))
            elif content:
                _inside(content, m.start() + 1, name or "neutral", out, "joined" if glue else "apart")
            last = content if _PLAIN.match(content) or re.fullmatch(r"[\w.-]{1,40}", content) else ""
            glue = True
            continue
        elif kind == "word":
            last = text
            out.append(Token(m.start(), m.end(), text, "neutral", "code"))
        elif kind == "op":
            if text == "#" and line[m.start() - 1 : m.start()].isspace() and line[m.end() : m.end() + 1].isspace() or (text == "/" and line[m.start() : m.start() + 2] == "//" and line[m.start() - 1 : m.start()].isspace()):
                _words(line, m.end() + (text == "/"), out)
                return out
            if text == "=" and typed and name == "secret" and name_kind(last) == "neutral":
                typed = False  # what stands between : and = is a type
            elif text in ("=", ":=", ":", "=>", "==", "!=") and last:
                name, called, typed = name_kind(last), "", text == ":"
            elif text == "(":
                called, name = last, name if name_kind(last) == "neutral" else name
            elif text == "," and called and _AUTH_CALL.search(called):
                name = "secret"
            elif text == "," and called and last:
                name = name_kind(last)
            elif text in (",", ";", "{", "}"):
                name = ""
            if text not in ("+", "(", ")"):
                last = "" if text not in (",",) else last
            if text == "+":
                continue
        glue = False
    return out


def features(shape_: str, name: str, context: str, size: str, sense: str, link: str, pair: bool, before: str, after: str) -> list[str]:
    """Shape and context features of a token, and their conjunctions. `before` and `after` are the shapes of the tokens it hangs together with."""
    n = f"|name={name}"
    return [
        f"bias{n}", f"shape={shape_}{n}", f"context={context}{n}", f"size={size}{n}", f"sense={sense}{n}", f"link={link}{n}", f"before={before}{n}", f"after={after}{n}", f"pair={pair}",
        f"shape={shape_}|size={size}{n}", f"shape={shape_}|sense={sense}{n}", f"shape={shape_}|context={context}{n}", f"context={context}|pair={pair}",
    ]


SIZES = ("tiny", "short", "medium", "long")
SENSES = ("single", "few", "sentence", "phrase")


def described(tokens_: list[Token]) -> list[tuple]:
    """Per token the arguments of `features`."""
    shapes = [shape(t.text) for t in tokens_]
    out = []
    for i, t in enumerate(tokens_):
        n = len(t.text)
        tied = i + 1 < len(tokens_) and tokens_[i + 1].link != "apart"
        out.append((
            shapes[i], t.name, t.context, "tiny" if n < 5 else "short" if n < 8 else "medium" if n < 16 else "long", t.sense, t.link, t.context == "basic" and _pair(t.text),
            shapes[i - 1] if i and t.link != "apart" else "", shapes[i + 1] if tied else "",
        ))
    return out


class Field_:
    """A chain of two labels, 0 outside and 1 part of a credential. A step's weight depends on how a token hangs on the one before."""

    def __init__(self, weights: dict[str, float], steps: dict[str, list[list[float]]]) -> None:
        self.weights, self.steps = weights, steps
        self._scores: dict[tuple, float] = {}

    def score(self, described_: tuple) -> float:
        """Weight of label 1 over label 0; remembered, as tokens are described by few values."""
        got = self._scores.get(described_)
        if got is None:
            got = self._scores[described_] = sum(self.weights.get(f, 0.0) for f in features(*described_))
        return got

    def viterbi(self, tokens_: list[Token]) -> list[int]:
        """The best labels."""
        if not tokens_:
            return []
        emit = [self.score(d) for d in described(tokens_)]
        zero, one = 0.0, emit[0]
        back: list[tuple[int, int]] = []
        for t, e in zip(tokens_[1:], emit[1:]):
            (a, b), (c, d) = self.steps[t.link]
            back.append((int(one + c > zero + a), int(one + d > zero + b)))
            zero, one = max(zero + a, one + c), max(zero + b, one + d) + e
        y = int(one > zero)
        labels = [y]
        for came in reversed(back):
            y = came[y]
            labels.append(y)
        return labels[::-1]

    def margins(self) -> dict[tuple[str, str], float]:
        """Per name and shape the most that a token of a line without a trigger adds to a run of labels 1 over labels 0.

        The tokens of such lines have no secret name, no key format and no context of credentials. A run wins the emissions of its tokens
        and the difference of its steps; the bound is for the best first token with the best step out, and for the best token after it.
        """
        s, w = self.steps, self.weights.get
        out = max(0.0, max(x[1][0] - x[0][0] for x in s.values()))
        best: dict[tuple[str, str], float] = {}
        for name in ("neutral", "other"):
            for context in ("value", "phrase", "words", "code", "query", "flag", "element"):
                tied = context in ("value", "phrase")
                after = max(w(f"after={x}|name={name}", 0.0) for x in (("", *SHAPES) if tied else ("",)))
                for sense in SENSES if context == "element" else SENSES[1:] if context == "phrase" else SENSES[:1]:
                    for link in LINKS if tied else LINKS[:1]:
                        into = max(0.0, s[link][0][1] - s[link][0][0]) + out
                        step = max(into, s[link][1][1] - s[link][0][0])
                        for shape_ in (x for x in SHAPES if x != "format"):
                            for size in SIZES:
                                for before in SHAPES if link != "apart" else ("",):
                                    e = sum(w(f, 0.0) for f in features(shape_, name, context, size, sense, link, False, before, "-")) + after + step
                                    best[name, shape_] = max(best.get((name, shape_), -math.inf), e)
        return best

    def least_margin(self) -> float:
        """Below 0 if no line without a trigger can have a label 1."""
        return max(self.margins().values())

    def closed(self, by: float = 0.5) -> Field_:
        """The field with weights of shapes under other than secret names lowered so far that lines without a trigger need no labels."""
        weights = dict(self.weights)
        for (name, shape_), m in self.margins().items():
            if m > -by:
                weights[f"shape={shape_}|name={name}"] = round(weights.get(f"shape={shape_}|name={name}", 0.0) - m - by, 3)
        return Field_(weights, self.steps)


@functools.lru_cache(maxsize=1)
def model() -> Field_:
    """The trained field."""
    data = json.loads(pkgutil.get_data("larkspur.llm", MODEL.name))
    return Field_(data["weights"], data["steps"])


_PEM_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
_GOES_ON = re.compile(r"(?:[:=]|:=|\(|\+|\\|\|)\s*$")


def spans(text: str, field: Field_ | None = None) -> list[tuple[int, int, int, bool]]:
    """(line index, start, end, begins): the credential characters of a text; begins is False where a value of an earlier line goes on.

    Lines of a private key block are credentials up to its end, but only the opening line begins one.
    """
    field = field or model()
    out: list[tuple[int, int, int, bool]] = []
    pos, line_no, counted = 0, 0, 0
    n, lower = len(text), text.lower()
    if len(lower) != n:  # a few letters are longer in lower case
        lower = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    carry, carried = "", -2
    while pos < n:
        m = TRIGGER.search(lower, pos)
        if carried >= 0 and (not m or text.count("\n", pos, m.start()) > 0):
            a = pos  # a value may go on in the very next line
        elif m:
            a = text.rfind("\n", 0, m.start()) + 1
        else:
            break
        b = text.find("\n", a)
        b = n if b < 0 else b
        line_no += text.count("\n", counted, a)
        counted = a
        raw = text[a:b].rstrip("\r")
        lead = _NUMBER.match(raw)
        skip = lead.end() if lead else 0
        line = raw[skip:]
        goes_on = carried == line_no
        found = tokens(line, carry if goes_on else "")
        was = goes_on and bool(out) and out[-1][0] == line_no - 1 and text[counted - 2 : counted - 1] in "+\\"
        last = 0
        for t, y in zip(found, field.viterbi(found)):
            if y and t.end > t.start:
                if last and t.link == "same":  # the blanks between the words of one credential belong to it
                    out[-1] = (*out[-1][:2], a + skip + t.end, out[-1][3])
                else:
                    out.append((line_no, a + skip + t.start, a + skip + t.end, not was))
            last = y
        carry, carried = "", -2
        if _GOES_ON.search(line) and (name := re.search(r"([\w$.-]+)[\"']?\s*(?:=|:=|:)\s*[\"'`(+\\|]*", line)) and name_kind(name[1]) == "secret" and not re.match(r"\s*(?:if|for|while|else|elif|def|class|func|function|case|with|try|except)\b", line):
            carry, carried = "secret", line_no + 1
        pos = b + 1
        if _PEM_BEGIN.search(line):
            end = _PEM_END.search(text, b)
            stop = end.start() if end else n
            k = line_no
            p = b + 1
            while p < stop:
                q = text.find("\n", p)
                q = n if q < 0 else q
                k += 1
                row = text[p : min(q, stop)]
                lead = _NUMBER.match(row)
                body = list(_BODY.finditer(row, lead.end() if lead else 0))
                if not end and not body:
                    break
                out += [(k, p + w.start(), p + w.end(), False) for w in body]
                p = q + 1
            pos = max(pos, end.end() if end else p)
            carried = -2
    return out


def redact(text: str, field: Field_ | None = None) -> str:
    """The text with the characters of credentials replaced by as many asterisks."""
    out, pos = [], 0
    for _, a, b, _ in sorted(spans(text, field), key=lambda s: s[1]):
        if a >= pos:
            out += [text[pos:a], "*" * (b - a)]
            pos = b
    return "".join([*out, text[pos:]])


def _texts(chunks: DataFrame, findings: DataFrame) -> DataFrame:
    """(record_kind, record_id, text) of both tables; null ids and texts have no row."""
    a = chunks.select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_id"), F.col("numbered_code").alias("text"))
    b = findings.select(F.lit("finding").alias("record_kind"), F.col("finding_id").alias("record_id"), F.col("evidence").alias("text"))
    return a.unionByName(b).filter("record_id is not null and text is not null and text != ''")


def _printed(index: int, lines: list[str]) -> int:
    """The number printed on a line of a chunk; one without a number counts on from the last line that has one."""
    for i in range(index, -1, -1):
        if m := re.match(r" *(\d+) \|", lines[i]):
            return int(m[1]) + index - i
    return index + 1


def found(chunks: DataFrame, findings: DataFrame) -> DataFrame:
    """(record_kind, record_id, line_no): every line on which a credential begins, each once.

    The line number is the one printed in a chunk's code (a line without one counts on from the last that has one) and the position in a finding's evidence.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, id_, text in zip(batch["record_kind"], batch["record_id"], batch["text"]):
                begun = sorted({s[0] for s in spans(text) if s[3]})
                if not begun:
                    continue
                lines = text.split("\n") if kind == "chunk" else []
                for i in begun:
                    rows.append((kind, id_, _printed(i, lines) if kind == "chunk" else i + 1))
            yield pd.DataFrame(rows, columns=["record_kind", "record_id", "line_no"]).astype({"record_kind": "object", "record_id": "int64", "line_no": "int32"})

    return _texts(chunks, findings).mapInPandas(run, "record_kind string, record_id bigint, line_no int").distinct()


def values(findings: DataFrame) -> DataFrame:
    """(v): every distinct credential in the evidence of credential findings, quoted or not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"v": sorted({t[a:b] for t in batch["evidence"] for _, a, b, _ in spans(t)})}, dtype="object")

    return findings.filter("issue_key = 'hardcoded-credential' and evidence is not null").select("evidence").distinct().mapInPandas(run, "v string").distinct()


def redacted(chunks: DataFrame, findings: DataFrame) -> DataFrame:
    """(record_kind, record_id, n_spans, text): one row per row of the inputs with an id and a text, credentials masked, all else as it was."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.copy()
            batch["n_spans"] = [len(spans(t)) for t in batch["text"]]
            batch["text"] = [redact(t) if k else t for t, k in zip(batch["text"], batch["n_spans"])]
            yield batch[["record_kind", "record_id", "n_spans", "text"]]

    return _texts(chunks, findings).mapInPandas(run, "record_kind string, record_id bigint, n_spans int, text string")
