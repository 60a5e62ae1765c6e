"""Reading trees of files, manifests and command lists as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions and their languages; markers of generated files.
LANGUAGES = {"rs": "rust", "c": "c", "h": "c-header", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp"}
GENERATED = ("@generated", "do not edit", "automatically generated", "autogenerated")


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ** any path, * and ? within one element."""
    out = re.sub(r"\\\*\\\*/|\\\*\\\*|\\\*|\\\?", lambda m: {r"\*\*/": "(?:.*/)?", r"\*\*": ".*", r"\*": "[^/]*", r"\?": "[^/]"}[m[0]], re.escape(glob))
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(map(glob_pattern, globs))) if globs else F.lit(False)


def tree(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), max_bytes: int = 2 << 20, scan_lines: int = 10) -> DataFrame:
    """One row a file below ``root`` with its language and, where it is dropped, the first reason that applies."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.col("path")
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    language = F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])
    # the content is read for files of a known language and a fit size only
    raw_text = F.when(F.col("length") <= max_bytes, F.col("content"))
    content = F.make_valid_utf8(raw_text.cast("string"))  # bytes that aren't UTF-8 become the replacement character
    head = F.lower(F.substring_index(content, "\n", scan_lines))
    generated = head.contains(GENERATED[0])
    for marker in GENERATED[1:]:
        generated = generated | head.contains(marker)
    reason = (
        F.when(language[ext].isNull(), "language")
        .when(matches_any(path, list(exclude)) | (~matches_any(path, list(include)) if include else F.lit(False)), "glob")
        .when(F.col("length") > max_bytes, "oversized")
        .when(F.contains(F.substring(raw_text, 1, 8192), F.lit(bytearray(b"\0"))), "binary")
        .when(generated, "generated")
    )
    return raw.select(F.xxhash64("path").alias("file_id"), "path", F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("directory"), language[ext].alias("language"), content.alias("content"), F.col("length").alias("size"), reason.alias("dropped"), F.sha2(raw_text, 256).alias("content_hash"))


def settle_headers(files: DataFrame) -> DataFrame:
    """Ambiguous headers take the language that most other files have (C on a tie): one verdict a run."""
    vote = files.where("dropped IS NULL").agg((F.count_if(F.col("language") == "cpp") > F.count_if(F.col("language") == "c")).alias("cpp_wins"))
    verdict = F.when(F.col("language") == "c-header", F.when(F.col("cpp_wins"), "cpp").otherwise("c")).otherwise(F.col("language"))
    return files.crossJoin(vote).withColumn("language", verdict).drop("cpp_wins")


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """Entries of command lists, one of each file and settings, with the digest of the settings."""
    raw = spark.read.schema("directory string, file string, command string, arguments array<string>").json(path, multiLine=True)
    words = F.coalesce("arguments", F.split("command", r"\s+"))
    settings = F.array_sort(F.filter(words, lambda w: w.rlike("^-(D|I|std|m|f)")))
    return raw.select("directory", "file", F.sha2(F.array_join(settings, "\n"), 256).alias("settings")).distinct()
