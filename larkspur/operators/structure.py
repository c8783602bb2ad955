"""Structure of files by their lines: headers, segments of top-level statements, and chunks built from them.

A line is taken by what it begins with, so everything is window functions over the lines of a file. A statement begins on a line at the
left edge that neither closes brackets nor continues the statement before; comment lines directly above belong to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import texts

#: Lines that are headers: imports and package clauses at the left edge.
HEADER = r"^(import\b|from\s+\S+\s+import\b|package\b|(const|let|var)\s+.*=\s*require\()"
COMMENT = r"^\s*(#|//|/\*|\*)"
#: Words that go on with the statement before them.
CONTINUES = r"^(else|elif|except|finally|catch|while\s*\(.*\);)\b"
AT_EDGE = r"^[^\s)\]}]"


def header_ranges(lines: DataFrame) -> DataFrame:
    """(file_id, start_line, end_line): header lines that follow each other, merged."""
    rows = lines.filter(F.col("text").rlike(HEADER)).select("file_id", "line_no")
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("file_id").orderBy("line_no"))
    return rows.withColumn("g", island).groupBy("file_id", "g").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")).drop("g")


def segments(lines: DataFrame, longest: int = 120) -> DataFrame:
    """(file_id, start_line, end_line): a partition of every file's lines into top-level statements with the comments above them, `longest` lines each at most.

    What stands before the first statement belongs to it; a longer statement is cut into windows.
    """
    text = F.col("text")
    comment = text.rlike(COMMENT)
    begins = text.rlike(AT_EDGE) & ~comment & ~text.rlike(CONTINUES)
    by_file = Window.partitionBy("file_id").orderBy("line_no")
    marked = lines.select("file_id", "line_no", begins.alias("begins"), comment.alias("comment"))
    # the comment lines directly above a line: those since the last line that is none
    last_other = F.max(F.when(~F.col("comment"), F.col("line_no"))).over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    starts = marked.withColumn("from", F.coalesce(last_other, F.lit(0)) + 1).filter("begins").select("file_id", F.col("from").alias("start_line"))
    sizes = lines.groupBy("file_id").agg(F.max("line_no").alias("n"))
    first = F.row_number().over(Window.partitionBy("file_id").orderBy("start_line")) == 1
    cut = starts.withColumn("start_line", F.when(first, F.lit(1)).otherwise(F.col("start_line")))
    whole = sizes.join(starts.select("file_id").distinct(), "file_id", "left_anti").select("file_id", F.lit(1).alias("start_line"))
    both = cut.unionByName(whole).join(sizes, "file_id")
    ended = both.withColumn("end_line", F.coalesce(F.lead("start_line").over(Window.partitionBy("file_id").orderBy("start_line")) - 1, "n"))
    pieces = F.explode(F.sequence(F.lit(0), F.floor((F.col("end_line") - F.col("start_line")) / longest).cast("int")))
    windows = ended.select("file_id", "start_line", "end_line", pieces.alias("k"))
    return windows.select("file_id", (F.col("start_line") + F.col("k") * longest).cast("int").alias("start_line"), F.least("end_line", F.col("start_line") + (F.col("k") + 1) * longest - 1).cast("int").alias("end_line"))


def build_chunks(files: DataFrame, lines: DataFrame, target: int = 60, longest: int = 120, budget: int = 40) -> DataFrame:
    """(file_id, chunk_index, start_line, end_line, context, partial_regions): chunks of packed segments; those with blank lines only are dropped and the index is dense.

    context has the header lines before the body within the budget; partial regions are clipped to the body.
    """
    groups = texts.pack_segments(segments(lines, longest), target)
    text = lines.filter(F.trim("text") != "").select("file_id", "line_no")
    # a body holds a line that is not blank if the first such line at or after its start lies in it: one sorted union instead of a range join
    marks = groups.select("file_id", F.col("start_line").alias("at"), F.col("end_line").alias("end"), F.lit(None).cast("int").alias("filled"))
    marks = marks.unionByName(text.select("file_id", F.col("line_no").alias("at"), F.lit(None).cast("int").alias("end"), F.col("line_no").cast("int").alias("filled")))
    ahead = Window.partitionBy("file_id").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    kept = marks.withColumn("next", F.min("filled").over(ahead)).filter(F.col("end").isNotNull() & (F.col("next") <= F.col("end")))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("at")) - 1
    bodies = kept.select("file_id", place.alias("chunk_index"), F.col("at").cast("int").alias("start_line"), F.col("end").alias("end_line"))
    pair = F.struct(F.col("start_line").cast("int").alias("start"), F.col("end_line").cast("int").alias("end"))
    heads = header_ranges(lines).groupBy("file_id").agg(F.array_sort(F.collect_list(pair)).alias("headers"))
    regions = files.select("file_id", F.transform("partial_regions", lambda r: F.struct(r["start_line"].alias("start"), r["end_line"].alias("end"))).alias("regions"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    rows = bodies.join(heads, "file_id", "left").join(regions, "file_id", "left")
    clipped = F.filter(
        F.transform(F.coalesce("regions", none), lambda r: F.struct(F.greatest(r["start"], F.col("start_line")).alias("start"), F.least(r["end"], F.col("end_line")).alias("end"))), lambda r: r["start"] <= r["end"]
    )
    before = F.filter(F.coalesce("headers", none), lambda h: h["end"] < F.col("start_line"))
    return rows.select("file_id", "chunk_index", "start_line", "end_line", texts.select_context(before, F.col("start_line"), budget).alias("context"), clipped.alias("partial_regions"))


def ranges_text(ranges: Column) -> Column:
    """Ranges as text: a-b, c-d."""
    return F.array_join(F.transform(ranges, lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")


def redact_lines(lines: DataFrame, sensitive: DataFrame, marker: str = "[line withheld: possible secret]") -> DataFrame:
    """The lines with those of `sensitive` (file_id, line_no) replaced by a marker."""
    hit = sensitive.select("file_id", "line_no").distinct().withColumn("_hit", F.lit(True))
    return lines.join(hit, ["file_id", "line_no"], "left").withColumn("text", F.when(F.col("_hit"), F.lit(marker)).otherwise(F.col("text"))).drop("_hit")


