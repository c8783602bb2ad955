"""Splitting oversized chunks of code at natural boundaries by lexical cohesion.

Boundaries are the lines at which a top-level statement starts. The similarity of the words in the blocks of lines before and
after a line is low where the topic changes; the depth of such a valley is how far it lies below the peaks on both sides.
Within each size window the boundary with the deepest valley becomes the cut; where a window has none, the deepest
valley between any two lines. Every piece then shows lines of its predecessor and the chunk's context.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Body lines above which a chunk is cut, lines of a piece with its overlap, lines of the predecessor shown, lines compared on each side.
LIMIT, OVERLAP, BLOCK = 250, 5, 14
_BUCKETS = 256
EXTENSIONS = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "java": "java", "go": "go"}
_NUMBERED = re.compile(r"^ *(\d+) \|(?: (.*))?$", re.S)
_WORD = re.compile(r"[A-Za-z]{2,}")
_QUOTED = r"\"(?:[^\"\\\n]|\\(?s:.))*\"|'(?:[^'\\\n]|\\(?s:.))*'"
_HIDE = {
    "python": re.compile(rf"#[^\n]*|\"\"\"(?:[^\"\\]|\\(?s:.)|\"(?!\"\"))*(?:\"\"\"|\Z)|'''(?:[^'\\]|\\(?s:.)|'(?!''))*(?:'''|\Z)|{_QUOTED}"),
    "go": re.compile(rf"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|`[^`]*(?:`|\Z)|{_QUOTED}"),
    "java": re.compile(rf"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|\"\"\"(?s:.*?)(?:\"\"\"|\Z)|{_QUOTED}"),
    "script": re.compile(
        rf"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|`(?:[^`\\]|\\(?s:.))*(?:`|\Z)|{_QUOTED}|(?<=[=(,:\[!&|?{{}};+])[ \t]*/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
    ),
}
_STARTS = {
    "python": re.compile(r"(def|class|async|import|from|@)\b|@"),
    "go": re.compile(r"(func|type|var|const|import)\b"),
    "java": re.compile(r"(public|private|protected|class|interface|enum|abstract|final|import|@)\b|@"),
    "script": re.compile(r"(function|class|const|let|var|export|import|async|interface|type|enum|declare|namespace|abstract)\b|@"),
}
_IMPORTS = {
    "python": re.compile(r"(import|from)\b"), "go": re.compile(r"(import|package)\b"), "java": re.compile(r"import\b"), "script": re.compile(r"import\b(?!\s*[(.])"),
}
_GOES_ON = {
    "python": re.compile(r"(elif|else|except|finally)\b"), "go": re.compile(r"[)\]},.]|else\b"), "java": re.compile(r"[)\]}.,{=&|+*/?:<>-]|(else|catch|finally|extends|implements|permits|throws)\b"),
    "script": re.compile(r"[)\]}.,{=&|+*/?:<>%^(\[-]|(else|catch|finally|extends|implements|instanceof|in|of|as|satisfies)\b"),
}
_OPEN_END = re.compile(r"[,=(\[{+\-*/%&|^<?:.]$|=>$|\b(return|extends|implements|typeof|new|in|of|async|export|default)$")
_MARKER = re.compile(r"(<{7}|\|{7}|={7}|>{7})( |$)")


def _family(language: str | None) -> str:
    return language if language in ("python", "go", "java") else "script"


def _blank(m: re.Match) -> str:
    """Comments become blanks and literals a quote each, line ends stay."""
    t = m[0]
    if t[0] == "#" or t[:2] in ("//", "/*"):
        return "\n" * t.count("\n")
    return '"' + "\n" * t.count("\n") + '"'


def statement_starts(lines: list[str], language: str | None) -> list[int]:
    """Indices of the lines at which top-level statements start, other than imports and Go's package clause.

    Comment lines and decorators directly above a statement belong to it. Unbalanced brackets are given up at the next line
    that begins a definition in the first column; marker lines of merge conflicts are no statements.
    """
    family = _family(language)
    code = _HIDE[family].sub(_blank, "\n".join("" if _MARKER.match(s) else s for s in lines)).split("\n")
    inside = [False] * len(code)  # lines that begin inside a literal
    pos = 0
    text = "\n".join("" if _MARKER.match(s) else s for s in lines)
    line_of = 0
    for m in _HIDE[family].finditer(text):
        line_of += text.count("\n", pos, m.start())
        pos = m.start()
        if "\n" in m[0] and not (m[0][0] == "#" or m[0][:2] in ("//", "/*")):
            for k in range(line_of + 1, line_of + 1 + m[0].count("\n")):
                inside[k] = True
    comment = [not c.strip() and bool(s.strip()) and not i for c, s, i in zip(code, lines, inside)]
    starts: list[int] = []
    depth, ended, decorated, skip = 0, True, False, False
    for i, c in enumerate(code):
        stripped = c.strip()
        if not stripped or inside[i]:
            depth = max(0, depth + _change(c))
            if stripped and inside[i]:
                ended = not _OPEN_END.search(stripped)
            continue
        column = len(c) - len(c.lstrip())
        if depth and column == 0 and _STARTS[family].match(stripped):
            depth, ended = 0, True
        if depth == 0:
            new = ended and not _GOES_ON[family].match(stripped) and (family != "python" or column == 0)
            if new:
                if not decorated:
                    starts.append(i)
                    skip = bool(_IMPORTS[family].match(stripped))
                    if skip:
                        starts.pop()
                decorated = stripped[0] == "@" and not stripped.startswith("@interface")
        depth = max(0, depth + _change(c))
        if decorated and depth == 0 and stripped[0] == "@" and family == "java" and re.search(r"\b(class|interface|enum|record)\b", stripped):
            decorated = False
        if family == "python":
            ended = not stripped.endswith("\\")
        elif family == "go":
            ended = depth == 0 and not _OPEN_END.search(stripped)
        else:
            ended = depth == 0 and not _OPEN_END.search(stripped)
    out = []
    for i in starts:
        while i and comment[i - 1]:
            i -= 1
        out.append(i)
    return sorted(set(out))


def _change(c: str) -> int:
    return c.count("(") + c.count("[") + c.count("{") - c.count(")") - c.count("]") - c.count("}")


def valleys(lines: list[str], block: int = BLOCK) -> np.ndarray:
    """Per line, how deep the similarity of the blocks before and after it lies below the peaks on both sides; 0 at the first."""
    n = len(lines)
    words = [[zlib.crc32(w.lower().encode()) % _BUCKETS for w in _WORD.findall(s)] for s in lines]
    sim = np.zeros(n, dtype=np.float64)
    # two blocks of word counts slide over the lines, so memory does not grow with them: their product and squared lengths change word by word
    before, after = [0] * _BUCKETS, [0] * _BUCKETS
    dot = far = near = 0
    for line in words[:block]:
        for w in line:
            near += 2 * after[w] + 1
            after[w] += 1
    for i in range(n):
        if dot:
            sim[i] = dot / math.sqrt(far * near)
        for w in words[i]:
            after[w] -= 1
            dot += after[w] - before[w]  # leaves the one and enters the other
            near -= 2 * after[w] + 1
            far += 2 * before[w] + 1
            before[w] += 1
        if i + block < n:
            for w in words[i + block]:
                dot += before[w]
                near += 2 * after[w] + 1
                after[w] += 1
        if i >= block:
            for w in words[i - block]:
                before[w] -= 1
                dot -= after[w]
                far -= 2 * before[w] + 1
    left = np.maximum.accumulate(sim)
    right = np.maximum.accumulate(sim[::-1])[::-1]
    # peaks within the reach of a few blocks count, not those at the other end of the chunk
    reach = 4 * block
    for i in range(n):
        left[i] = sim[max(0, i - reach) : i + 1].max()
        right[i] = sim[i : i + reach].max()
    depth = (left - sim) + (right - sim)
    if n:
        depth[0] = 0
    return depth


@dataclass
class Body:
    numbers: list[int]
    lines: list[str]
    context: list[tuple[int, str]]


def read_body(code: str, context: list[tuple[int, int]]) -> Body:
    """The numbered lines in and outside the context ranges; lines without a number (gaps) belong to neither."""
    body, shown = Body([], [], []), []
    for raw in code.split("\n"):
        m = _NUMBERED.match(raw.rstrip("\r"))
        if not m:
            continue
        number, text = int(m[1]), m[2] or ""
        if any(a <= number <= b for a, b in context):
            shown.append((number, text))
        else:
            body.numbers.append(number)
            body.lines.append(text)
    body.context = shown
    return body


def cuts(n: int, starts: list[int], depth: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """First lines of the pieces (0 first): each piece with its overlap has at most `limit` lines."""
    out = [0]
    while n - out[-1] + (overlap if out[-1] else 0) > limit:
        a = out[-1]
        last = a + limit - (overlap if a else 0)
        late = [i for i in starts if a + limit // 2 < i <= last]
        any_ = late or [i for i in starts if a < i <= last]
        pool = any_ or list(range(a + max(1, limit // 2), last + 1))
        out.append(max(pool, key=lambda i: (float(depth[i]), i)))
    return out


def render(body: Body, a: int, b: int, overlap: int) -> str:
    """A piece in the chunk's notation: context, gap, overlap and own lines."""
    first = max(0, a - overlap)
    rows = [(k, t) for k, t in body.context if k < body.numbers[first]] + list(zip(body.numbers[first:b], body.lines[first:b]))
    width = len(str(rows[-1][0]))
    out, before = [], None
    for k, t in rows:
        if before is not None and k != before + 1:
            out.append(" " * width + " | ...")
        out.append(f"{k:>{width}} | {t}")
        before = k
    return "\n".join(out)


def language_of(language: Column, path: Column) -> Column:
    """The language, or for null the one of the path's extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.lower(language), F.try_element_at(known, ext))


def _oversized(chunks: DataFrame, limit: int) -> DataFrame:
    """One row per chunk_id with more than `limit` numbered lines (of equal rows one, else the largest)."""
    long = chunks.filter("chunk_id is not null and numbered_code is not null").select(
        "chunk_id", language_of(F.col("file_language"), F.col("file_path")).alias("language"), F.coalesce("context", F.array()).alias("context"), "numbered_code"
    )
    # more lines than the limit are needed, so that shorter chunks never reach Python
    long = long.filter(F.regexp_count("numbered_code", F.lit(r"(?m)^ *\d+ \|")) > limit)
    return long.groupBy("chunk_id").agg(F.max(F.struct("numbered_code", "language", "context")).alias("c")).select("chunk_id", "c.*")


def _bodies(batch: pd.DataFrame, limit: int) -> Iterator[tuple[int, str | None, Body]]:
    for r in batch.itertuples(index=False):
        ranges = [(c["start_line"], c["end_line"]) for c in r.context if c is not None and c["start_line"] is not None and c["end_line"] is not None]
        body = read_body(r.numbered_code, ranges)
        if len(body.lines) > limit:
            yield r.chunk_id, r.language, body


def boundaries(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, line_no, depth, is_cut): the natural boundaries of every chunk with more than `limit` body lines.

    Depth is the cohesion valley's; is_cut tells whether a piece begins there. The body's first line is no boundary. Chunks with null
    code have none; null lines numbers and context are read from the code itself; repeated rows of a chunk count once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk, language, body in _bodies(batch, limit):
                starts = [i for i in statement_starts(body.lines, language) if i]
                depth = valleys(body.lines)
                chosen = set(cuts(len(body.lines), starts, depth, limit, overlap))
                rows += [(chunk, body.numbers[i], float(depth[i]), i in chosen) for i in starts]
            yield pd.DataFrame(rows, columns=["chunk_id", "line_no", "depth", "is_cut"]).astype({"chunk_id": "int64", "line_no": "int32", "depth": "float64", "is_cut": "bool"})

    return _oversized(chunks, limit).mapInPandas(run, "chunk_id bigint, line_no int, depth double, is_cut boolean")


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, piece, start_line, end_line, overlap_lines, n_lines, numbered_code): the pieces of every oversized chunk in order.

    start_line to end_line are the piece's own lines; before them come the context and `overlap` lines of the predecessor.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk, language, body in _bodies(batch, limit):
                n = len(body.lines)
                starts = [i for i in statement_starts(body.lines, language) if i]
                first = cuts(n, starts, valleys(body.lines), limit, overlap)
                for k, a in enumerate(first):
                    b = first[k + 1] if k + 1 < len(first) else n
                    rows.append((chunk, k, body.numbers[a], body.numbers[b - 1], min(a, overlap), b - a, render(body, a, b, overlap)))
            yield pd.DataFrame(rows, columns=["chunk_id", "piece", "start_line", "end_line", "overlap_lines", "n_lines", "numbered_code"]).astype(
                {"chunk_id": "int64", "piece": "int32", "start_line": "int32", "end_line": "int32", "overlap_lines": "int32", "n_lines": "int32"}
            )

    return _oversized(chunks, limit).mapInPandas(
        run, "chunk_id bigint, piece int, start_line int, end_line int, overlap_lines int, n_lines int, numbered_code string"
    )
