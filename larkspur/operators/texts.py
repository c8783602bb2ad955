"""Lines, windows, chunks and evidence; masking of known secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.plans.durable import checkpoint, small


def line_statistics(lines: DataFrame) -> DataFrame:
    """Per file: lines, blank ones, the longest and those over 120 characters."""
    return lines.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.trim("text") == "").alias("n_blank"), F.max(F.length("text")).alias("longest"), F.count_if(F.length("text") > 120).alias("n_long")
    )


def line_windows(files: DataFrame, size: int = 40) -> DataFrame:
    """(file_id, window, start_line, end_line): tumbling windows of `size` lines, the last one shorter."""
    n = F.size(C.split_lines(F.col("content")))
    rows = files.filter("content is not null").select("file_id", n.alias("n")).filter("n > 0")
    w = rows.select("file_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))).alias("window"))
    return w.select("file_id", "window", (F.col("window") * size + 1).alias("start_line"), F.least(F.col("n"), (F.col("window") + 1) * size).alias("end_line"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """(file_id, start_line, end_line): runs of lines that are not blank (gaps and islands)."""
    filled = lines.filter(F.trim("text") != "").select("file_id", "line_no")
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("file_id").orderBy("line_no"))
    return filled.withColumn("g", island).groupBy("file_id", "g").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")).drop("g")


def pack_segments(segments: DataFrame, target: int = 60) -> DataFrame:
    """(file_id, groups): consecutive segments packed greedily while the group's lines stay within the target; a file's segments are bounded by its lines."""
    rows = segments.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start_line").alias("start"), F.col("end_line").alias("end")))).alias("s"))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fits = (F.size(done) > 0) & (r["end"] - last["start"] + 1 <= target)
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), r["end"].alias("end"))))).otherwise(F.concat(done, F.array(r)))

    return rows.select("file_id", F.explode(F.aggregate("s", empty, add)).alias("g")).select("file_id", F.col("g.start").alias("start_line"), F.col("g.end").alias("end_line"))


def select_context(ranges: Column, body_start: Column, budget: int = 40) -> Column:
    """Ranges before the body, in order, while lines are left of the budget; the last one is cut; merged."""
    zero = F.struct(F.lit(budget).alias("left"), F.array().cast("array<struct<start:int,end:int>>").alias("taken"))

    def take(acc: Column, r: Column) -> Column:
        end = F.least(r["end"], body_start - 1, r["start"] + acc["left"] - 1).cast("int")
        use = (end >= r["start"]) & (acc["left"] > 0)
        piece = F.struct(r["start"].alias("start"), end.alias("end"))
        return F.when(use, F.struct((acc["left"] - (end - r["start"] + 1)).cast("int").alias("left"), F.concat(acc["taken"], F.array(piece)).alias("taken"))).otherwise(acc)

    return C.merge_ranges(F.aggregate(ranges, zero, take)["taken"])


def numbered(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Numbered rendering of the given lines per key, a gap line between lines that do not follow each other."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    rows = lines.withColumn("before", F.lag("line_no").over(w)).withColumn("width", F.length(F.max("line_no").over(Window.partitionBy(*keys)).cast("string")))
    line = F.concat(F.lpad(F.col("line_no").cast("string"), F.col("width"), F.lit(" ")), F.lit(" | "), F.col("text"))
    gap = F.when(F.col("line_no") > F.col("before") + 1, F.concat(F.repeat(F.lit(" "), F.col("width")), F.lit(" | ...\n"))).otherwise(F.lit(""))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.concat(gap, line).alias("t")))), lambda x: x["t"]), "\n").alias("numbered_code"))


def attach_evidence(findings: DataFrame, lines: DataFrame, most: int = 5) -> DataFrame:
    """(finding_id, evidence): where it is null, the finding's lines right-trimmed, five at most; nothing for blank ones."""
    need = findings.filter("evidence is null and start_line is not null").select("finding_id", "repository", "file_path", "start_line", F.least(F.coalesce("end_line", "start_line"), F.col("start_line") + most - 1).alias("last"))
    wanted = need.select("*", F.explode(F.sequence("start_line", F.greatest("start_line", "last"))).alias("line_no"))
    joined = wanted.join(lines.select("repository", "file_path", "line_no", "text"), ["repository", "file_path", "line_no"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.rtrim("text").alias("t")))), lambda x: x["t"]), "\n")
    return joined.groupBy("finding_id").agg(text.alias("evidence")).filter("trim(evidence) != ''")


def excerpts(findings: DataFrame, files: DataFrame, padding: int = 2) -> DataFrame:
    """(finding_id, first_line, last_line, n_chars) of a finding's lines with so many more on both sides, clamped to the file (repository, file_path, n_lines, lengths of its lines).

    A finding is one row and so is a file: the planner takes rows of single lines for no more than the findings they come from, and would broadcast
    them. Sizes of compressed files say little of the rows either, so the join is by sorting.
    """
    start = F.col("start_line").cast("bigint")
    last = F.greatest(start, F.coalesce(F.col("end_line").cast("bigint"), start)) + padding
    f = findings.filter("start_line is not null").select("finding_id", "repository", "file_path", F.greatest(F.lit(1), start - padding).alias("first_line"), last.alias("last_line"))
    joined = f.join(files.hint("merge"), ["repository", "file_path"]).withColumn("last_line", F.least("last_line", "n_lines")).filter("first_line <= last_line")
    first, last = F.col("first_line").cast("int"), F.col("last_line").cast("int")
    n_chars = F.aggregate(F.slice("lengths", first, last - first + 1), F.lit(0).cast("bigint"), lambda n, x: n + x)
    return joined.select("finding_id", first.alias("first_line"), last.alias("last_line"), n_chars.alias("n_chars"))


def common_folder(files: DataFrame, by: str = "repository") -> DataFrame:
    """The longest folder prefix that all paths of a group share, from its smallest and largest path."""
    ends = files.groupBy(by).agg(F.min("file_path").alias("a"), F.max("file_path").alias("b"))
    pa, pb = F.split("a", "/"), F.split("b", "/")
    n = F.least(F.size(pa), F.size(pb)) - 1
    same = F.when(n > 0, F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda k: F.array_join(F.slice(pa, F.lit(1), k), "/") == F.array_join(F.slice(pb, F.lit(1), k), "/"))).otherwise(F.array().cast("array<int>"))
    return ends.select(by, F.array_join(F.slice(pa, F.lit(1), F.coalesce(F.array_max(same), F.lit(0))), "/").alias("folder"))


#: Separators of words that may be secret values (a fixed pattern).
SEPARATORS = r"[\s'\"`,;()\[\]{}<>=:@/\\]+"


def candidate_values(text: Column) -> Column:
    """Distinct words and quoted strings of a line."""
    words = F.split(text, SEPARATORS)
    quoted = F.regexp_extract_all(text, F.lit(r"(['\"`])(.+?)\1"), F.lit(2))
    trimmed = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, "^['\"`,;()]+|['\"`,;()]+$", ""))
    return F.array_distinct(F.filter(F.concat(words, quoted, trimmed), lambda v: v != ""))


#: Evidence of findings whose text a detector withheld.
REDACTED = "[redacted: possible secret]"


def reported_lines(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, line_no): the lines of credential findings and of those with withheld evidence, in every version of their file that has the line."""
    own = findings.filter((F.col("issue_key") == "hardcoded-credential") | (F.col("evidence") == REDACTED)).filter("start_line >= 1")
    spans = own.select("repository", "file_path", "start_line", F.greatest("start_line", F.coalesce("end_line", "start_line")).alias("end_line")).distinct()
    held = files.filter("content is not null").join(spans.select("repository", "file_path").distinct(), ["repository", "file_path"], "left_semi")
    lengths = held.select("file_id", "repository", "file_path", F.size(C.split_lines(F.col("content"))).alias("n"))
    at = lengths.join(spans, ["repository", "file_path"]).filter("start_line <= n")
    return at.select("file_id", F.explode(F.sequence("start_line", F.least("end_line", "n"))).alias("line_no")).distinct()


def quoted_secrets(findings: DataFrame) -> DataFrame:
    """(v): the values that credential findings quote."""
    quoted = findings.filter("issue_key = 'hardcoded-credential' and evidence is not null")
    return quoted.select(F.explode(F.regexp_extract_all("evidence", F.lit('"([A-Za-z0-9+/=_.!*%#-]{12,})"'), F.lit(1))).alias("v"))


def sensitive_lines(lines: DataFrame, secret_lines: DataFrame, secret_hashes: DataFrame) -> DataFrame:
    """Lines that were reported, or of which a value's digest is known."""
    known = _known_values(lines.select("file_id", "line_no", "text"), secret_hashes).select("file_id", "line_no")
    return known.unionByName(secret_lines.select("file_id", "line_no")).distinct()


def _known_values(lines: DataFrame, secret_hashes: DataFrame) -> DataFrame:
    """Adds `v`, one row per value of a line whose digest is known. The digests are sent to all tasks if they are few by count, so that lines are not shuffled."""
    hashes = checkpoint(secret_hashes.select("sha1").distinct())
    values = lines.withColumn("v", F.explode(candidate_values(F.col("text")))).withColumn("sha1", F.sha1("v"))
    return values.join(small(hashes, hashes.count()), "sha1", "left_semi").drop("sha1")


def mask_values(lines: DataFrame, secret_hashes: DataFrame) -> DataFrame:
    """(file_id, line_no, masked): known values become numbered placeholders, numbered per file by first use, the longest first within a line."""
    values = checkpoint(_known_values(lines.select("file_id", "line_no", "text"), secret_hashes))
    first = values.groupBy("file_id", "v").agg(F.min("line_no").alias("at"))
    w = Window.partitionBy("file_id").orderBy("at", F.desc(F.length("v")), "v")
    number = first.withColumn("n", F.row_number().over(w)).select("file_id", "v", "n")
    per_line = values.select("file_id", "line_no", "text", "v").join(number, ["file_id", "v"])
    order = F.array_sort(F.collect_list(F.struct((-F.length("v")).alias("k"), "v", "n")))
    grouped = per_line.groupBy("file_id", "line_no", "text").agg(order.alias("vs"))
    masked = F.aggregate("vs", F.col("text"), lambda t, s: F.replace(t, s["v"], F.concat(F.lit("<REDACTED_SECRET_"), s["n"].cast("string"), F.lit(">"))))
    return grouped.select("file_id", "line_no", masked.alias("masked"))
