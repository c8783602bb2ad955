"""Column functions: predicates, paths, text, line ranges and normalised values. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur import domain as D

SPACE = r"(?U)\s+"


# -- findings ---------------------------------------------------------------------------------------------------


def is_model_only(sources: Column) -> Column:
    """Every source is a model (true for no sources)."""
    return F.forall(sources, lambda s: s.isin(*D.MODELS))


def has_model(sources: Column) -> Column:
    """Some source is a model."""
    return F.arrays_overlap(sources, F.array(*[F.lit(m) for m in D.MODELS]))


def is_unconfident(sources: Column, confidence: Column, least: float = D.LEAST_CONFIDENCE) -> Column:
    """Found by models alone and below the least confidence; a null confidence is none."""
    return is_model_only(sources) & F.coalesce(confidence < least, F.lit(False))


def is_reported(status: Column, sources: Column, confidence: Column, least: float = D.LEAST_CONFIDENCE) -> Column:
    """Open, in review or accepted, and not hidden for lack of confidence."""
    return F.coalesce(status.isin(*D.REPORTED), F.lit(False)) & ~is_unconfident(sources, confidence, least)


def is_protected(category: Column, severity: Column) -> Column:
    """A security finding of high severity or more."""
    return F.coalesce((category == "security") & (D.severity_rank(severity) >= 3), F.lit(False))


def is_formatting_only(sources: Column, rule_id: Column) -> Column:
    """A lint finding of a formatting family."""
    return F.array_contains(sources, "ruff") & F.coalesce(F.exists(F.array(*[F.lit(p) for p in D.FORMATTING]), lambda p: F.startswith(rule_id, p)), F.lit(False))


def needs_verification(sources: Column, status: Column, severity: Column, from_rank: int) -> Column:
    """An open finding of models alone, of at least a severity."""
    return is_model_only(sources) & (status == "open") & (D.severity_rank(severity) >= from_rank)


def grade(score: Column) -> Column:
    """A to E by the score's lower ends."""
    out = F.when(score >= D.GRADES[0][0], D.GRADES[0][1])
    for least, letter in D.GRADES[1:]:
        out = out.when(score >= least, letter)
    return out.otherwise("E")


def matches_query(text: str, *columns: Column) -> Column:
    """A case-insensitive substring of any column."""
    return F.exists(F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in columns]), lambda c: F.contains(c, F.lit(text.lower())))


def rule_or_source(rule_id: Column, sources: Column) -> Column:
    """The rule, or for an empty one the first source."""
    return F.coalesce(F.nullif(rule_id, F.lit("")), F.try_element_at(sources, F.lit(1)))


def fingerprint(rule: Column, path: Column, evidence: Column, title: Column) -> Column:
    """A digest that survives moved lines: rule, path and collapsed evidence (or title)."""
    body = F.coalesce(F.nullif(collapse(evidence), F.lit("")), collapse(title))
    return F.sha2(F.concat_ws("\u001f", rule, path, body), 256)


# -- text -------------------------------------------------------------------------------------------------------


def collapse(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def shorten(text: Column, most: int = 80) -> Column:
    """At most `most` characters, with an ellipsis if cut."""
    t = collapse(text)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def split_lines(text: Column) -> Column:
    """Lines by \\n, each without one trailing \\r; a last empty one is dropped; empty texts have none."""
    body = F.regexp_replace(F.regexp_replace(text, "\n\\z", ""), "\r(?=\n|\\z)", "")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def clean_evidence(text: Column, most: int = 5) -> Column:
    """Without line number prefixes, at most five lines, trimmed."""
    lines = F.transform(F.slice(split_lines(text), 1, most), lambda s: F.regexp_replace(s, r"^\s*\d+ \| ?", ""))
    return F.trim(F.array_join(lines, "\n"))


def dedent(text: Column) -> Column:
    """Without the indentation common to all lines that are not blank."""
    lines = F.split(text, "\n", -1)
    pads = F.transform(F.filter(lines, lambda s: F.trim(s) != ""), lambda s: F.length(s) - F.length(F.ltrim(s)))
    pad = F.coalesce(F.array_min(pads), F.lit(0))
    return F.array_join(F.transform(lines, lambda s: F.when(F.trim(s) == "", F.lit("")).otherwise(F.substring(s, pad + 1, F.length(s)))), "\n")


def range_text(start: Column, end: Column) -> Column:
    """`n` or `a-b`."""
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def compact_number(n: Column) -> Column:
    """From 1,000 in thousands with one decimal and a k."""
    return F.when(n >= 1000, F.concat(F.format_string("%.1f", n / 1000.0), F.lit("k"))).otherwise(n.cast("string"))


# -- paths ------------------------------------------------------------------------------------------------------


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folders(path: Column) -> Column:
    """The names of the folders above a path."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1))


def ancestors(path: Column) -> Column:
    """All folder prefixes from the top; none for a path without folders."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def skip_reason_for_path(path: Column) -> Column:
    """Why a file is skipped for its path, or null."""
    name = F.lower(base_name(path))
    return (
        F.when(F.exists(folders(path), lambda p: F.lower(p).isin(*D.EXCLUDED_DIRS)), "excluded_directory").when(name.isin(*D.LOCKFILES), "lockfile")
        .when(F.exists(F.array(*[F.lit(s) for s in D.GENERATED_SUFFIXES]), lambda s: F.endswith(name, s)), "generated")
    )


def skip_reason_for_content(size: Column, content: Column) -> Column:
    """too_large before binary (a NUL in the first bytes), or null."""
    return F.when(size > D.MAX_FILE_BYTES, "too_large").when(F.instr(F.substring(content, 1, D.SNIFF_BYTES), "\x00") > 0, "binary")


def path_rejection(name: Column, longest: int = 400) -> Column:
    """Why an archive's member name is not accepted, or null: traversal, invalid."""
    p = F.replace(name, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda s: ~s.isin("", "."))
    reserved = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"
    bad = lambda s: (F.length(s) > 255) | s.rlike(r'[<>:"|?*\x00-\x1f]') | s.rlike(r"[. ]$") | s.rlike(reserved)
    return (
        F.when(p.startswith("/") | p.rlike("^[A-Za-z]:") | F.array_contains(parts, ".."), "path_traversal")
        .when((F.size(parts) == 0) | (F.length(p) > longest) | F.exists(parts, bad), "invalid_path")
    )


def glob_pattern(pattern: str) -> str:
    """A shell pattern as a regular expression; `*` and `?` match separators as well, a directory takes all below it."""
    import fnmatch

    body = fnmatch.translate(pattern.strip("/"))
    return "^" + body.removesuffix(r"\z").removesuffix(r"\Z").replace("(?s:", "(?s:") + "(/.*)?$"


def is_test_path(path: Column) -> Column:
    """A test directory above, or a test's file name."""
    stem = F.lower(F.regexp_replace(base_name(path), r"\.[^.]+$", ""))
    in_dir = F.exists(folders(path), lambda p: F.lower(p).isin(*D.TEST_DIRS))
    return in_dir | stem.startswith("test_") | (stem == "conftest") | F.exists(F.array(*[F.lit(s) for s in D.TEST_SUFFIXES]), lambda s: F.endswith(stem, s))


def detect_language(path: Column, first_line: Column) -> Column:
    """By extension; a file without one by the interpreter of its first line (env, options, NAME=value and version suffixes allowed)."""
    ext = F.lower(F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1))
    words = F.filter(F.split(F.regexp_replace(first_line, r"^#!\s*", ""), SPACE), lambda w: w != "")
    program = base_name(F.try_element_at(words, F.lit(1)))
    rest = F.filter(F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 1)), lambda w: ~w.startswith("-") & ~F.contains(w, F.lit("=")))
    runs = F.regexp_replace(F.when(program == "env", base_name(F.try_element_at(rest, F.lit(1)))).otherwise(program), r"[\d.]+$", "")
    by_ext, by_run = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for language, (exts, interpreters) in D.LANGUAGES.items():
        by_ext = by_ext.when(ext.isin(*exts), language)
        if interpreters:
            by_run = by_run.when(runs.isin(*interpreters), language)
    return F.when(ext != "", by_ext).when(first_line.startswith("#!"), by_run)


# -- line ranges ------------------------------------------------------------------------------------------------


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column, slack: int = 0) -> Column:
    return (s1 <= e2 + slack) & (e1 >= s2 - slack)


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The common lines as a struct, null if there are none."""
    return F.when(overlaps(s1, e1, s2, e2), F.struct(F.greatest(s1, s2).alias("start"), F.least(e1, e2).alias("end")))


def difference(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The lines of the first range outside the second: no, one or two pieces."""
    whole = F.array(F.struct(s1.alias("start"), e1.alias("end")))
    cut = F.filter(F.array(F.struct(s1.alias("start"), F.least(e1, s2 - 1).alias("end")), F.struct(F.greatest(s1, e2 + 1).alias("start"), e1.alias("end"))), lambda r: r["start"] <= r["end"])
    return F.when(overlaps(s1, e1, s2, e2), cut).otherwise(whole)


def merge_ranges(ranges: Column) -> Column:
    """Sorted and merged where they overlap or touch; an array of structs (start, end)."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (r["start"] <= last["end"] + 1), grown).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(ranges), empty, add)


def clamp_ranges(ranges: Column, lines: Column) -> Column:
    """Cut to a file's lines, then merged; none for an empty file."""
    cut = F.transform(ranges, lambda r: F.struct(F.least(r["start"], lines).alias("start"), F.least(r["end"], lines).alias("end")))
    return F.when(lines > 0, merge_ranges(cut)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


# -- answers ----------------------------------------------------------------------------------------------------


def normal_word(value: Column) -> Column:
    """Trimmed, lower case, blanks and dashes as underscores; words for nothing are null."""
    w = F.translate(F.lower(F.trim(value)), " -", "__")
    return F.when(w.isin("", "none", "null", "n/a", "na"), F.lit(None)).otherwise(w)


def fraction(value: Column) -> Column:
    """Numbers and percentages as 0..1; only values above 1 and up to 100 are divided."""
    v = F.regexp_replace(F.trim(value.cast("string")), r"\s*%$", "").try_cast("double")
    return F.when((v > 1) & (v <= 100), v / 100).otherwise(v)


def cwe_id(value: Column) -> Column:
    """CWE-n without leading zeros, or null."""
    n = F.regexp_extract(value, r"(?i)CWE[-_ ]?(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("CWE-"), n.cast("bigint").cast("string")))


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer: thoughts removed, a code fence unwrapped, else from the first to the last brace; null if none parses."""
    plain = F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))
    fenced = F.regexp_extract(plain, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    first = F.coalesce(F.nullif(fenced, F.lit("")), plain)
    braces = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    good = lambda s: F.when(F.trim(s).startswith("{") & F.get_json_object(s, "$").isNotNull(), F.get_json_object(s, "$"))
    return F.coalesce(good(first), good(braces))


def seconds(value: Column) -> Column:
    """`34s` or `1.5s` in seconds, else null."""
    return F.nullif(F.regexp_extract(value, r"^(\d+(?:\.\d+)?)s$", 1), F.lit("")).try_cast("double")


def http_outcome(code: Column) -> Column:
    """The kind of failure of an HTTP status; null below 400."""
    return (
        F.when(code == 429, "rate_limited").when(code == 402, "quota_exhausted").when(code.isin(401, 403), "authentication").when(code == 404, "configuration")
        .when((code == 408) | (code >= 500), "unavailable").when(code >= 400, "request")
    )


def estimated_tokens(text: Column, budget: Column) -> Column:
    """A character count over 3.5, rounded up, and the output's budget."""
    return F.ceil(F.length(text) / 3.5) + budget


# -- display and request helpers --------------------------------------------------------------------------------


def display_name(filename: Column, most: int = 120) -> Column:
    """The last part of a name without control characters."""
    return F.substring(F.regexp_replace(F.regexp_extract(F.replace(filename, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1), r"\p{Cntrl}", ""), 1, most)


def milliseconds(ms: Column) -> Column:
    """Below a second in ms, from then on in seconds with one decimal."""
    tenths = F.floor((ms + 50) / 100)
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" s")))


def time_ago(at: Column, now: Column) -> Column:
    """now, minutes, hours, else the date."""
    s = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))
    minutes, hours = F.floor(s / 60).cast("string"), F.floor(s / 3600).cast("string")
    return F.when(s < 60, "just now").when(s < 3600, F.concat(minutes, F.lit(" min ago"))).when(s < 86400, F.concat(hours, F.lit(" h ago"))).otherwise(F.date_format(at, "yyyy-MM-dd"))


def is_loopback(url: Column) -> Column:
    """The host is localhost or a loopback address."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    return (host == "localhost") | host.rlike(r"^127(\.\d{1,3}){3}$") | (host == "[::1]")


def retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After value: a number or an HTTP date, not below 0; null for others."""
    at = F.try_to_timestamp(F.regexp_replace(value, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(F.trim(value).try_cast("double"), (F.unix_seconds(at) - F.unix_seconds(now.cast("timestamp"))).cast("double"))
    return F.when(wait.isNotNull(), F.greatest(F.lit(0.0), wait))


def next_quota_reset(now_utc: Column, zone: str = "America/Los_Angeles") -> Column:
    """The next midnight of a zone, in UTC."""
    local = F.from_utc_timestamp(now_utc.cast("timestamp"), zone)
    return F.to_utc_timestamp(F.date_add(F.to_date(local), 1).cast("timestamp"), zone)


def usage_count(value: Column) -> Column:
    """A count that is a whole number of 0 or more, else 0."""
    n = value.try_cast("bigint")
    return F.when(n >= 0, n).otherwise(F.lit(0).cast("bigint"))


def off_task(category: Column, severity: Column, task: str) -> Column:
    """Why an answer does not belong to a task, or null: style takes style and maintainability up to medium, review all but style."""
    if task == "style":
        return F.when(~category.isin("style", "maintainability"), "category").when(D.severity_rank(severity) > 2, "severity")
    return F.when(category == "style", "category")


def rate_limit(limit: Column, safety: float = 0.8) -> Column:
    """A share of the limit, but 1 at least."""
    return F.greatest(F.lit(1.0), limit * safety)


def ungrounded(lines: Column, first: Column, last: Column, shown_from: Column, shown_to: Column, evidence: Column, slack: int = 2) -> Column:
    """Why a reported range is not grounded in a file's `lines`, or null: past the end, not shown, no evidence, or a quoted line that does not occur nearby."""
    quoted = F.filter(F.transform(split_lines(clean_evidence(evidence)), collapse), lambda q: q != "")
    window = collapse(F.array_join(F.slice(lines, F.greatest(F.lit(1), first - slack), F.greatest(F.lit(0), last - first + 1 + 2 * slack)), " "))
    return (
        F.when(last > F.size(lines), "past_end").when((first < shown_from) | (last > shown_to), "not_shown").when(F.length(F.array_join(quoted, "")) < 3, "no_evidence")
        .when(~F.forall(quoted, lambda q: F.contains(window, q)), "not_found")
    )
