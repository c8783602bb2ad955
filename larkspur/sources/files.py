"""Sources: directories, archives, labels, run records, settings and provider configuration."""

from __future__ import annotations

import io
import json
import tomllib
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from larkspur import domain as D
from larkspur.functions import columns as C


def scan_directory(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, size, reason, content): every file below a folder; reason is null for those that are taken, content only for them.

    Path checks come before content checks, so that skipped files' bytes are dropped in the scan.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.substring_index(F.col("path"), base, -1), "^/+", "")
    excluded = F.lit(False)
    for g in exclude:
        excluded = excluded | path.rlike(C.glob_pattern(g))
    reason = F.coalesce(F.when(excluded, "excluded"), C.skip_reason_for_path(path), C.skip_reason_for_content(F.col("length"), F.decode("content", "ISO-8859-1")))
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), reason.alias("reason"), "content")
    return rows.withColumn("content", F.when(F.col("reason").isNull(), F.decode("content", "UTF-8")))


def check_limits(files: DataFrame, max_files: int = D.MAX_FILES, max_bytes: int = D.MAX_TOTAL_BYTES) -> None:
    """Reject an input of more files or bytes than allowed (one row comes to the driver)."""
    n = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    if n["n"] > max_files or n["b"] > max_bytes:
        raise ValueError(f"{n['n']} files of {n['b']} bytes are more than {max_files} files or {max_bytes} bytes")


class ZipSource(DataSource):
    """``spark.read.format("zip_members").load(path)``: (archive, path, size, compressed, reason, content) of an archive's members.

    A member with a reason (traversal, special entry, duplicate, too large) carries no content; one archive is one partition.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, path string, size bigint, compressed bigint, reason string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options)


class _ZipReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths = options["path"].split(",")

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.value) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            total, packed = sum(i.file_size for i in infos), max(1, sum(i.compress_size for i in infos))
            if total > D.MAX_TOTAL_BYTES or (total > 1_000_000 and total / packed > D.MAX_RATIO):
                raise ValueError(f"{partition.value} expands to {total} bytes from {packed}")
            seen: set[str] = set()
            names = {i.filename.replace("\\", "/").casefold() for i in infos}
            for i in infos:
                name = i.filename.replace("\\", "/")
                folded = name.casefold()
                special = (i.external_attr >> 16) & 0o170000
                parents = {"/".join(folded.split("/")[:k]) for k in range(1, folded.count("/") + 1)}
                reason = (
                    "path_traversal" if name.startswith("/") or ".." in name.split("/") or name[1:2] == ":" else "special_entry" if special not in (0, 0o100000) or i.flag_bits & 1
                    else "duplicate" if folded in seen else "file_as_directory" if parents & names else "too_large" if i.file_size > D.MAX_FILE_BYTES else None
                )
                seen.add(folded)
                data = None
                if reason is None:
                    with z.open(i) as f:
                        data = f.read(i.file_size + 1)
                    if len(data) > i.file_size:
                        raise ValueError(f"{name} is longer than declared")
                    reason = "binary" if b"\x00" in data[: D.SNIFF_BYTES] else None
                yield partition.value, name, i.file_size, i.compress_size, reason, data if reason is None else None


def read_archives(spark: SparkSession, *paths: str) -> DataFrame:
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_members").load(",".join(paths))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The labels of a dataset file, one row each; duplicate ids are an error when the result is read."""
    label = "id string, file string, anchor string, lines int, category string, cwe string, severity string, detection string, description string"
    rows = spark.read.schema(f"dataset string, version int, labels array<struct<{', '.join(x.replace(' ', ':', 1) for x in label.split(', ')) }>>").option("multiLine", True).json(path)
    flat = rows.select(F.explode("labels").alias("l")).select("l.*").withColumn("lines", F.coalesce("lines", F.lit(1)))
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    checked = flat.withColumn("n", n)
    return checked.withColumn("id", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("label twice: "), F.col("id"))).cast("string")).otherwise(F.col("id"))).drop("n")


def locate_labels(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """Labels with start_line and end_line: the one line of their file that holds the anchor; n_hits tells those with none or several."""
    hits = labels.join(lines.select(F.col("file_path").alias("file"), "line_no", "text"), "file", "left").filter(F.col("text").isNull() | F.contains("text", "anchor"))
    found = hits.groupBy("id").agg(F.count("line_no").alias("n_hits"), F.min("line_no").alias("start_line"))
    rows = labels.join(found, "id", "left").na.fill(0, ["n_hits"])
    return rows.withColumn("start_line", F.when(F.col("n_hits") == 1, F.col("start_line"))).withColumn("end_line", F.col("start_line") + F.col("lines") - 1)


def latest_records(spark: SparkSession, path: str, key: str = "file") -> DataFrame:
    """The newest record per key of JSON lines files: the last line of the last file wins; blank and broken lines are skipped."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    rows = raw.filter(F.try_parse_json("value").isNotNull() & (F.trim("value") != "")).withColumn("k", F.get_json_object("value", f"$.{key}"))
    return rows.groupBy("k").agg(F.max_by("value", F.struct("f", "b", "n")).alias("record")).withColumnRenamed("k", key)


def pending(wanted: DataFrame, records: DataFrame, key: str = "file") -> DataFrame:
    """What is left to do: wanted keys without a complete record."""
    done = records.filter(F.get_json_object("record", "$.complete") == "true").select(key)
    return wanted.join(done, key, "left_anti")


def declared_settings(files: DataFrame) -> DataFrame:
    """Per repository, line length and Python version of its top-most pyproject.toml; broken ones give the defaults."""
    own = files.filter(C.base_name(F.col("file_path")) == "pyproject.toml")
    depth = F.struct(F.size(F.split("file_path", "/")), "file_path")
    top = own.groupBy("repository").agg(F.min_by("content", depth).alias("content"))

    @F.pandas_udf("line_length int, python int")
    def parse(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([settings(c) for c in contents], columns=["line_length", "python"]).astype("Int32")

    return top.select("repository", parse("content").alias("s")).select("repository", "s.*")


def settings(content: str | None) -> tuple[int, int]:
    """(line length, minor version of Python) of a settings file; 79 and 11 where nothing is declared."""
    import re

    try:
        tool = tomllib.loads(content or "").get("tool", {})
        data = tomllib.loads(content or "")
    except tomllib.TOMLDecodeError:
        return 79, 11
    ruff, black = tool.get("ruff"), tool.get("black")
    declared = [(ruff or {}).get("line-length"), (black or {}).get("line-length"), (tool.get("flake8") or {}).get("max-line-length")]
    length = next((v for v in declared if isinstance(v, int) and v > 0), 88 if ruff is not None or black is not None else 79)
    target = re.fullmatch(r"py3(\d+)", str((ruff or {}).get("target-version", "")))
    lower = [int(m) for m in re.findall(r">=?\s*3\.(\d+)", str(data.get("project", {}).get("requires-python", "")))]
    version = int(target[1]) if target else min(lower, default=11)
    return min(120, length), max(7, min(14, version))


def provider_config(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(providers, routes) of a JSON configuration; unknown providers in a route, doubles and tasks without a route are errors."""
    config = json.load(io.StringIO(text))
    providers, routing = config["providers"], config["routing"]
    for task, names in routing.items():
        unknown, double = set(names) - set(providers), len(names) != len(set(names))
        if unknown or double or not names:
            raise ValueError(f"route of {task}: unknown {sorted(unknown)}" if unknown else f"route of {task} is empty or names a provider twice")
    p = [(k, v.get("limits"), int(v.get("max_concurrency", 1)), float(v.get("timeout_seconds", 60))) for k, v in providers.items()]
    r = [(task, i, n) for task, names in routing.items() for i, n in enumerate(names)]
    return spark.createDataFrame(p, "provider string, limits string, max_concurrency int, timeout_seconds double"), spark.createDataFrame(r, "task string, pos int, provider string")
