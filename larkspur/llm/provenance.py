"""Source files that nobody in the repository wrote by hand.

Three kinds of evidence, each a boolean column of `classify`:

* vendored: Merkle hashes are computed bottom-up, blocks of a file -> file -> directories. A file or directory whose
  hash occurs in several repositories is a shared subtree; a file most of whose blocks do is a changed copy, and a directory most
  of whose files are shared or changed copies is one as a whole (`evidence` has these columns apart from the others). Directory
  names that are reserved for other people's code and headers of outside projects count as well.
* generated: the leading comment says so, or the layout does (the same line with other numbers again and again).
* packed / bulk data: the text is mostly very long lines almost without blanks, or rows of literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.plans.durable import checkpoint

#: Directory names for code of outside projects (fixed values); `external` only below `contrib`.
VENDOR_DIRS = ("node_modules", "vendor", "_vendor", "third_party", "thirdparty", "third-party", "extern", "externals", "deps", "bower_components", "site-packages", "jspm_packages")
#: Name endings of tools that pack or generate.
PACKED_NAMES = r"(?i)(\.min|[.-]bundle|\.packed)\.[cm]?[jt]sx?$"
GENERATED_NAMES = r"(?i)(\.(gen|g|pb|pb\.gw|generated)\.\w+|_pb2(_grpc)?\.py|_stubs_gen\.\w+|_generated\.\w+|outerclass\.java)$"
_MADE = r"(?:generated|produced|emitted|created|made|built|written|compiled)"
#: How a leading comment says that its file was made by a program: of the file itself, by what it was made, or what becomes of edits. General forms, not sentences of any tool.
GENERATED_HEAD = "(?i)(" + "|".join([
    r"@generated\b", r"<auto-?generated\b", rf"\b(?:auto|automatically|machine)[- ]?{_MADE}\b", rf"^\W*(?:(?:this|the|all) )?(?:file|code|source|module|content)s? (?:(?:was|is|were|are|has been|have been) )?(?:\w+ly )?{_MADE} (?:by|from|with|using|at|on)\b(?! hand)",
    rf"^\W*{_MADE} (?:by|from|with|using) (?!hand\b|us\b|me\b)", r"^\W*(?:the )?output of\b", r"^\W*\S+ output\b[,;:.]", r"\b(?:do not|don't|never) (?:edit|modify|change|touch)\b", r"\bnot (?:to be|meant to be) (?:edited|modified)\b",
    r"\b(?:edits?|changes|modifications)\b.{0,40}\b(?:lost|overwritten|discarded|survive|replaced|reverted|undone)\b", r"\b(?:re-?generate|re-?run)\b.{0,40}\binstead\b", r"\b(?:change|edit) \S+ and (?:run|rerun|re-run)\b",
]) + ")"
#: What outside projects' files say in a leading comment: where they are from, or that their rights are with the authors of a project. General forms.
VENDORED_HEAD = "(?i)(" + "|".join([
    r"\bvendored (?:from|copy|in)\b", r"^\W*(?:origin|upstream|original source|source): .*\b(?:imported|copied|taken|release|version|licen[cs]e)\b", r"\b(?:copied|imported|taken|adapted|borrowed|forked) (?:\w+ )?from (?:the )?\S+ (?:project|release|repository|library|package|v?\d)",
    r"(?:\(c\)|\x{A9}|copyright) (?:\(c\) )?\d{4}(?:-\d{4})?,? (?:by )?the \S+ (?:contributors|authors|developers|project|team|foundation)", r"\bredistribution and use in source\b", r"\bpermission is hereby granted, free of charge", r"^\s*/\*! \S+ v?\d",
]) + ")"
PACKED_HEAD = r"(?i)(^\s*/\*! \S+ (?:\S+ )?bundle|^\W*(?:packed|minified|bundled)\b)"
#: The comment lines and blanks before a file's first other line.
HEAD = r"\A\x{FEFF}?(?:\s*(?://[^\n]*|#[^\n]*|/\*(?s:.*?)\*/|--[^\n]*|<!--(?s:.*?)-->)(?:\n|\z))+"
#: Characters from which equality means a copy. Smaller files and blocks have their place in the tree, but are alike by chance.
LEAST_SHARED = 400
LEAST_BLOCK = 80
#: Share of the characters of larger blocks from which a file is a changed copy.
MOST = 0.6
#: A directory is one of copies with so many of them and that share of its characters: what lies beside a few copies may well be hand-written.
DIR_COPIES, DIR_SHARE = 3, 0.8


def files(source: DataFrame) -> DataFrame:
    """(file_id, repository, file_path, text) of files with content; line ends are \\n, no byte-order mark."""
    text = F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "^\uFEFF", "")
    return source.filter("content is not null and file_id is not null").select("file_id", F.coalesce("repository", F.lit("")).alias("repository"), F.coalesce("file_path", F.lit("")).alias("file_path"), text.alias("text"))


def _directories(rows: DataFrame) -> DataFrame:
    """(repository, path, hash, size) of all directories, from the deepest level up; `rows` has the files in the same form.

    A directory's hash is the exclusive or of hashes of (name, hash) of its entries, so every entry is added
    where it is and no directory is collected. Versions of a file (the same path again) are separate entries.
    """
    depth = F.size(F.split("path", "/"))
    nodes = checkpoint(rows.withColumn("depth", depth))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    found, below = None, None
    for level in range(deepest, 1, -1):
        here = nodes.filter(F.col("depth") == level).select("repository", "path", "hash", "size")
        here = here if below is None else here.unionByName(below)
        parent, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
        below = here.groupBy("repository", parent.alias("path")).agg(F.bit_xor(F.xxhash64(name, "hash")).alias("hash"), F.sum("size").alias("size"))
        below = checkpoint(below)
        found = below if found is None else found.unionByName(below)
    return found


def _shared(rows: DataFrame) -> DataFrame:
    """(hash) that occur in more than one repository."""
    return rows.groupBy("hash").agg(F.min("repository").alias("a"), F.max("repository").alias("b")).filter("a < b").select("hash")


def shared_subtrees(source: DataFrame) -> DataFrame:
    """(file_id, shared_file, shared_dir, shared_blocks, mostly_shared_dir): which parts of the Merkle tree at and above a file occur in other repositories.

    Every file with content is in the tree. shared_blocks is the share of a file's characters in larger blocks that others have too; mostly_shared_dir says
    that the file lies in a directory that consists of shared files and changed copies (`DIR_COPIES`, `DIR_SHARE`).
    """
    text = files(source)
    # imports and comments open many files alike, so they are no blocks
    cut = F.filter(F.split("text", r"\n\s*\n"), lambda b: ~b.rlike(r"^\s*($|import |from |package |//|#|/\*|\*)"))
    blocks = F.transform(cut, lambda b: F.struct(F.xxhash64(F.trim(b)).alias("hash"), F.length(b).alias("size")))
    leaves = checkpoint(text.select("file_id", "repository", "file_path", F.xxhash64("text").alias("hash"), F.length("text").cast("long").alias("size"), blocks.alias("blocks")))
    tree = leaves.select("repository", F.col("file_path").alias("path"), "hash", "size").distinct()
    same = _shared(tree.filter(F.col("size") >= LEAST_SHARED)).withColumn("shared_file", F.lit(True))
    own = leaves.select("file_id", "repository", "file_path", "hash", "size").join(same, "hash", "left")
    parts = leaves.select("file_id", "repository", F.explode("blocks").alias("b")).select("file_id", "repository", "b.hash", "b.size")
    large = F.col("size") >= LEAST_BLOCK
    common = _shared(parts.filter(large).select("repository", "hash").distinct()).withColumn("common", F.lit(1))
    share = parts.filter(large).join(common, "hash", "left").groupBy("file_id").agg((F.sum(F.when(F.col("common") == 1, F.col("size")).otherwise(F.lit(0))) / F.sum("size")).alias("shared_blocks"))
    out = own.join(share, "file_id", "left").select(
        "file_id", "repository", "file_path", "size", F.coalesce("shared_file", F.lit(False)).alias("shared_file"),
        F.when(F.col("size") >= LEAST_SHARED, F.coalesce("shared_blocks", F.lit(0.0))).otherwise(F.lit(0.0)).alias("shared_blocks"),
    )
    parent = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    copies = F.col("shared_file") | (F.col("shared_blocks") >= MOST)
    mostly = out.filter(parent != "").groupBy("repository", parent.alias("dir")).agg(F.sum(F.when(copies, F.col("size")).otherwise(0)).alias("a"), F.sum("size").alias("b"), F.count_if(copies).alias("n"))
    mostly = mostly.filter((F.col("n") >= DIR_COPIES) & (F.col("a") >= DIR_SHARE * F.col("b"))).select("repository", "dir", F.lit(True).alias("mostly_shared_dir"))
    out = out.withColumn("dir", parent).join(mostly, ["repository", "dir"], "left").drop("dir")
    dirs = _directories(tree)
    if dirs is None:
        out = out.withColumn("shared_dir", F.lit(False))
    else:
        # the root (an empty path) would make whole copies of a repository its own vendored code
        large_dirs = dirs.filter((F.col("path") != "") & (F.col("size") >= LEAST_SHARED))
        marked = large_dirs.join(_shared(large_dirs.select("repository", "hash")), "hash").select("repository", F.col("path").alias("dir")).distinct()
        above = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.split("file_path", "/")) - 1)), lambda k: F.array_join(F.slice(F.split("file_path", "/"), F.lit(1), k), "/")), lambda d: d != F.col("file_path"))
        under = out.select("file_id", "repository", F.explode(above).alias("dir")).join(marked, ["repository", "dir"], "left_semi").select("file_id").distinct()
        out = out.join(under.withColumn("shared_dir", F.lit(True)), "file_id", "left")
    return out.groupBy("file_id").agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in ("shared_file", "shared_dir", "mostly_shared_dir")], F.max("shared_blocks").alias("shared_blocks"))


def layout(text: DataFrame) -> DataFrame:
    """Adds the head (leading comment), and the layout figures long_share, row_share and repeat_share (of characters or lines)."""
    shape = F.regexp_replace(F.regexp_replace("text", r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", "S"), r"\d+(?:\.\d+)?", "0")
    df = text.withColumns({
        "head": F.regexp_extract("text", HEAD, 0), "_lines": F.split(shape, r"\s*\n\s*"),
        "_long": F.regexp_extract_all(F.col("text"), F.lit(r"(?m)^[^\n]{300,}$"), F.lit(0)),
    })
    df = df.withColumns({
        "_filled": F.size(F.filter("_lines", lambda s: F.length(s) > 0)),
        # long lines almost without blanks; words in a row have one blank in six characters or so
        "_packed": F.aggregate("_long", F.lit(0), lambda n, s: n + F.when(F.length(F.regexp_replace(s, r"[^ ]", "")) * 10 < F.length(s), F.length(s)).otherwise(F.lit(0))),
        # rows of nothing but literals and their punctuation
        "_rows": F.size(F.filter("_lines", lambda s: s.rlike(r"^[\[{(]*(?:(?:[S0]|-0|0x\w+|null|None|true|false)\s*[:,;+\]})\[{(.]*\s*)+$") & s.rlike("[S0]"))),
        "_literal": F.filter("_lines", lambda s: (F.length(s) >= 8) & s.rlike("[0S]")),
    })
    n = F.nullif("_filled", F.lit(0))
    return df.withColumns({
        "long_share": F.col("_packed") / F.nullif(F.length("text"), F.lit(0)), "row_share": F.col("_rows") / n,
        "repeat_share": (F.size("_literal") - F.size(F.array_distinct("_literal"))) / n, "n_lines": F.col("_filled"),
    }).drop("_lines", "_long", "_filled", "_packed", "_rows", "_literal")


def _head_says(pattern: str) -> Column:
    return F.exists(F.split("head", "\n"), lambda s: s.rlike(pattern))


def evidence(source: DataFrame) -> DataFrame:
    """(file_id, tree, vendored_by_name, generated, packed, bulk_data): each kind of evidence by itself; one row per file_id with non-null content."""
    text = layout(files(source))
    parts = F.split(F.lower("file_path"), "/")
    in_dir = F.exists(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1)), lambda p: p.isin(*VENDOR_DIRS)) | F.col("file_path").rlike(r"(?i)(^|/)contrib/external/")
    judged = text.select(
        "file_id",
        (in_dir | _head_says(VENDORED_HEAD)).alias("vendored_by_name"),
        (_head_says(GENERATED_HEAD) | F.col("file_path").rlike(GENERATED_NAMES) | ((F.col("n_lines") >= 20) & (F.col("repeat_share") >= 0.4))).alias("generated"),
        ((F.col("long_share") >= 0.5) | _head_says(PACKED_HEAD) | (F.col("file_path").rlike(PACKED_NAMES))).alias("packed"),
        ((F.col("n_lines") >= 15) & (F.col("row_share") >= 0.85)).alias("bulk_data"),
    )
    judged = judged.groupBy("file_id").agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in judged.columns if c != "file_id"])
    tree = shared_subtrees(source).select("file_id", (F.col("shared_file") | F.col("shared_dir") | F.col("mostly_shared_dir") | (F.col("shared_blocks") >= MOST)).alias("tree"))
    return judged.join(tree, "file_id", "left").select("file_id", F.coalesce("tree", F.lit(False)).alias("tree"), "vendored_by_name", "generated", "packed", "bulk_data")


def classify(source: DataFrame) -> DataFrame:
    """(file_id, vendored, generated, packed, bulk_data, hand_written): one row per file_id with non-null content.

    Empty files are hand-written. Repeated rows of a file_id count once; a row without path or repository is judged by its text.
    """
    both = evidence(source).withColumn("vendored", F.col("vendored_by_name") | F.col("tree"))
    kinds = ["vendored", "generated", "packed", "bulk_data"]
    any_ = F.greatest(*[F.col(k) for k in kinds])
    return both.select("file_id", *kinds, (~any_).alias("hand_written"))


def not_hand_written(source: DataFrame) -> DataFrame:
    """(file_id) of the files that are vendored, generated, packed or bulk data."""
    return classify(source).filter("not hand_written").select("file_id")


def hand_written_findings(findings: DataFrame, source: DataFrame) -> DataFrame:
    """The findings whose file is not known to be other than hand-written (every version of it, by repository and path)."""
    other = source.select("file_id", "repository", "file_path").join(not_hand_written(source), "file_id", "left_semi")
    return findings.join(other.select("repository", "file_path").distinct(), ["repository", "file_path"], "left_anti")
