"""Which files of a tree are scanned: ignore files, manifests, and a count for every reason that drops one.

A path is taken apart into the directories above it, so that what a directory says (its ignore file, its manifest) reaches what lies
below it by a join on equal directories; no path is held against all patterns or all packages.  Of the patterns that match a path or a directory
the last one counts: a deeper directory's before an upper one's, ``.ignore`` before ``.gitignore``, a later line before an earlier one.  What lies in
an ignored directory is ignored whatever else says; of the packages around a file the deepest one owns it.

Ignore files and manifests are few beside files: their rows are broadcast where a count shows it, else joined by a shuffle.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import GENERATED, LANGUAGES

#: Rows of patterns or packages that may be broadcast (some hundred bytes each).
MOST_BROADCAST = 200_000
MAX_BYTES, BINARY_BYTES, HEAD_LINES = 2 << 20, 8192, 10
#: Files that state what is ignored, the stronger one last.
IGNORE_FILES = (".gitignore", ".ignore")


def pattern_of(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression over a path below the file's directory, negated, for directories only) of an ignore file's line; None if it says nothing.

    A pattern with a slash before its end holds from the file's directory on, any other one at any depth.  * and ? stay within an
    element, ** between slashes is any number of them.
    """
    line = line.rstrip("\r\n")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line[1:] if line[:2] in ("\\#", "\\!") else line
    only_dirs = line.endswith("/")
    line = line.rstrip("/") if only_dirs else line
    anchored = "/" in line
    line = line[1:] if line.startswith("/") else line
    if not line:
        return None
    out, i = [], 0
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif line[i:] == "**" and (i == 0 or line[i - 1] == "/"):
            out.append(".+")
            i += 2
        elif line[i] == "*":
            out.append("[^/]*")
            i += 1
        elif line[i] == "?":
            out.append("[^/]")
            i += 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            inside = line[i + 1 : end]
            out.append(f"(?!/)[{'^' + inside[1:] if inside[0] in '!^' else inside}]".replace("\\", "\\\\"))
            i = end + 1
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            out.append(re.escape(line[i]))
            i += 1
    return f"^{'' if anchored else '(?:[^/]+/)*'}{''.join(out)}$", negated, only_dirs


def ignore_patterns(files: DataFrame) -> DataFrame:
    """(directory, strength, line, regex, negated, only_dirs) of the ignore files among ``files`` (path, content)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                directory, _, name = path.rpartition("/")
                for k, line in enumerate((content or "").split("\n")):
                    if (p := pattern_of(line)) is not None:
                        rows.append((directory, IGNORE_FILES.index(name), k, *p))
            yield pd.DataFrame(rows, columns=["directory", "strength", "line", "regex", "negated", "only_dirs"])

    stated = files.where(F.col("path").rlike(r"(^|/)\.(git)?ignore$")).select("path", F.col("content").cast("string").alias("content"))
    return stated.mapInPandas(work, "directory string, strength int, line int, regex string, negated boolean, only_dirs boolean")


def few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


#: Directories above a path, from the root ("") down, as an array.
ABOVE = "transform(sequence(0, size(split({0}, '/')) - 1), i -> array_join(slice(split({0}, '/'), 1, i), '/'))"


def ignored(paths: DataFrame, patterns: DataFrame, hidden: bool = False) -> DataFrame:
    """(path, reason) of the paths that are left out: "ignored", or "hidden" for names that begin with a dot unless ``hidden`` or a pattern takes them back."""
    files = paths.select("path").distinct()
    # every directory is judged once, whatever it holds
    directories = files.selectExpr(f"explode({ABOVE.format('path')}) AS entry").where("entry <> ''").distinct()
    entries = files.selectExpr("path AS entry", "false AS is_dir").unionByName(directories.selectExpr("entry", "true AS is_dir"))
    asked = entries.selectExpr("entry", "is_dir", f"explode({ABOVE.format('entry')}) AS directory")
    below = F.when(F.col("directory") == "", F.col("entry")).otherwise(F.expr("substr(entry, length(directory) + 2)"))
    met = asked.join(few(patterns), "directory").where((~F.col("only_dirs") | F.col("is_dir")) & F.rlike(below, F.col("regex")))
    last = met.groupBy("entry", "is_dir").agg(F.max_by("negated", F.struct(F.length("directory"), "strength", "line")).alias("negated"))
    told = entries.join(last, ["entry", "is_dir"], "left")
    own = F.when(~F.col("negated"), "ignored").when(F.col("negated").isNull() & F.lit(not hidden) & F.col("entry").rlike(r"(^|/)\.[^/]*$"), "hidden")
    judged = told.select("entry", "is_dir", own.alias("reason")).where("reason IS NOT NULL")
    # the uppermost directory that is left out decides for all below it
    above = files.selectExpr("path", f"explode({ABOVE.format('path')}) AS entry").join(judged.where("is_dir").select("entry", "reason"), "entry").groupBy("path").agg(F.min_by("reason", F.length("entry")).alias("above"))
    alone = judged.where("NOT is_dir").select(F.col("entry").alias("path"), F.col("reason").alias("own"))
    return files.join(above, "path", "left").join(alone, "path", "left").select("path", F.coalesce("above", "own").alias("reason")).where("reason IS NOT NULL")


def manifests(files: DataFrame) -> DataFrame:
    """(root, package, lib_path, bin_paths) of the Cargo.toml files among ``files``; what isn't TOML or has no package gives none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    told = tomllib.loads(content or "")
                    name, root = told["package"]["name"], path.rpartition("/")[0]
                    at = lambda p, root=root: f"{root}/{p}" if root else p
                    bins = [at(b["path"]) for b in told.get("bin", []) if "path" in b]
                    lib = told.get("lib", {}).get("path")
                except (tomllib.TOMLDecodeError, KeyError, TypeError, AttributeError):
                    continue
                rows.append((root, name, at(lib) if lib else None, bins))
            yield pd.DataFrame(rows, columns=["root", "package", "lib_path", "bin_paths"])

    stated = files.where(F.col("path").rlike("(^|/)Cargo[.]toml$")).select("path", F.col("content").cast("string").alias("content"))
    return stated.mapInPandas(work, "root string, package string, lib_path string, bin_paths array<string>")


#: What a file is by its place in a package.
TARGET = """CASE WHEN package IS NULL THEN 'unknown' WHEN path = lib_path THEN 'library' WHEN array_contains(bin_paths, path) THEN 'binary' WHEN rest = 'build.rs' THEN 'build-script'
  WHEN rest = 'src/main.rs' OR rest LIKE 'src/bin/%' THEN 'binary' WHEN rest LIKE 'src/%' THEN 'library' WHEN rest LIKE 'tests/%' THEN 'test' WHEN rest LIKE 'benches/%' THEN 'bench' WHEN rest LIKE 'examples/%' THEN 'example' ELSE 'unknown' END"""


def owners(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, package, target) of all paths by the deepest package around each; null and "unknown" without one."""
    around = paths.select("path").distinct().selectExpr("path", f"explode({ABOVE.format('path')}) AS root").join(few(packages), "root")
    nearest = around.groupBy("path").agg(F.max_by(F.struct("root", "package", "lib_path", "bin_paths"), F.length("root")).alias("p")).select("path", "p.*")
    told = paths.select("path").distinct().join(nearest, "path", "left").selectExpr("*", "CASE WHEN root = '' THEN path ELSE substr(path, length(root) + 2) END AS rest")
    return told.selectExpr("path", "package", f"{TARGET} AS target")


def discover(files: DataFrame, languages: tuple[str, ...] = ("rust", "c", "cpp"), max_bytes: int = MAX_BYTES, hidden: bool = False) -> DataFrame:
    """Every file with its language, package, target and the first reason that drops it (null for those that stay).

    ``files``: path (below the root, without a leading slash), size, content (binary), link (boolean).  Reasons: hidden, ignored, metadata (ignore files, manifests,
    command lists, which are read for themselves), symlink, oversized, language (none that is known), unselected (known, not wanted), unreadable (null content), binary, generated.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    language = F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])[suffix]
    head = F.lower(F.substring_index(F.make_valid_utf8(F.col("content").cast("string")), "\n", HEAD_LINES))
    generated = F.lit(False)
    for marker in GENERATED:
        generated = generated | head.contains(marker)
    wanted = F.col("language").isin(*languages) | ((F.col("language") == "c-header") & F.lit("c" in languages or "cpp" in languages))
    left_out = ignored(files, ignore_patterns(files), hidden).withColumnRenamed("reason", "left_out")
    rows = files.withColumn("language", language).join(left_out, "path", "left").join(owners(files, manifests(files)), "path", "left")
    reason = (
        F.when(F.col("path").rlike(r"(^|/)(\.gitignore|\.ignore|Cargo[.]toml|compile_commands[.]json)$"), "metadata")
        .when(F.col("left_out").isNotNull(), F.col("left_out"))
        .when(F.coalesce("link", F.lit(False)), "symlink")
        .when(F.col("size") > max_bytes, "oversized")
        .when(F.col("language").isNull(), "language")
        .when(~wanted, "unselected")
        .when(F.col("content").isNull(), "unreadable")
        .when(F.contains(F.substring("content", 1, BINARY_BYTES), F.lit(bytearray(b"\0"))), "binary")
        .when(generated, "generated")
    )
    return rows.select("path", "language", "package", "target", reason.alias("dropped"))


def drop_counts(found: DataFrame) -> DataFrame:
    """(dropped, files) with "kept" for those that stay."""
    return found.groupBy(F.coalesce("dropped", F.lit("kept")).alias("dropped")).agg(F.count("*").alias("files"))
