"""Discovery over a tree whose files are the documents.

A document's path has its source, language and a bucket of its number; each source has an ignore file, each language under it a
manifest or an ignore file, chosen by hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import Duck
from ..operators.graph import cut
from ..registry import register
from ..sources import discovery
from .sql import composed, frame

#: Lines of an ignore file, and for the oracle what each means for the rest of a path (r) and whether it is a directory (dir).
LINES = [
    ("*.c", "r LIKE '%.c' AND r NOT LIKE '%.c/%'"),
    ("/en/", "r = 'en' AND dir"),
    ("!en/", "(r = 'en' OR r LIKE '%/en') AND dir"),
    ("de/b?", "r LIKE 'de/b_'"),
    ("**/f[0-4]*.h", "regexp_matches(r, '(^|/)f[0-4][^/]*[.]h$')"),
    ("b3/**", "r LIKE 'b3/_%'"),
    ("!*.rs", "r LIKE '%.rs'"),
    ("# b1", "false"),
    ("b1", "r = 'b1' OR r LIKE '%/b1'"),
    ("fr/**/f*7.*", "regexp_matches(r, '^fr/([^/]+/)*f[^/]*7[.][^/]*$')"),
]
SUFFIXES = ("rs", "c", "h", "cpp", "md", "rs", "cc")


def tree_files(d) -> str:
    """path, directory of its ignore file (the source or source/language), doc_id, size, content."""
    suffix = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SUFFIXES)) + " END"
    return f"SELECT doc_id, source, lang, source || '/' || lang || '/b' || CAST(doc_id % 5 AS STRING) || '/' || CASE WHEN doc_id % 11 = 0 THEN '.f' ELSE 'f' END || CAST(doc_id AS STRING) || '.' || {suffix} AS path, n_chars AS size, text AS content FROM documents"


def stated(d) -> str:
    """Lines of the ignore files: directory, line number, which of ``LINES``."""
    at = "SELECT source AS directory FROM documents GROUP BY source UNION ALL SELECT source || '/' || lang FROM documents GROUP BY source, lang"
    return f"SELECT directory, k AS line, {d.h60('directory || CAST(k AS STRING)')} % {len(LINES)} AS which FROM ({at}) a CROSS JOIN {d.series('0', '3', 'k')} s"


def packages(d) -> str:
    """Directories with a manifest: every source, and a third of the languages under it."""
    return f"SELECT directory FROM (SELECT source AS directory, 0 AS h FROM documents GROUP BY source UNION ALL SELECT source || '/' || lang, {d.h60('source || lang')} % 3 FROM documents GROUP BY source, lang) a WHERE h = 0"


def read_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree as files: documents, ignore files and manifests."""
    files = frame(spark, sf_dir, (tree_files,), "SELECT path, CAST(size AS BIGINT) AS size, CAST(content AS BINARY) AS content FROM tree_files")
    line = "CASE which " + " ".join(f"WHEN {k} THEN '{text}'" for k, (text, _) in enumerate(LINES)) + " END"
    ignores = frame(spark, sf_dir, (stated,), f"SELECT directory || '/.gitignore' AS path, 1L AS size, CAST(array_join(transform(array_sort(collect_list(struct(line, {line} AS t))), x -> x.t), '\\n') AS BINARY) AS content FROM stated GROUP BY directory")
    made = frame(spark, sf_dir, (packages,), "SELECT directory || '/Cargo.toml' AS path, 1L AS size, CAST('[package]\\nname = \"' || replace(directory, '/', '-') || '\"\\n' AS BINARY) AS content FROM packages")
    return cut(files.unionByName(ignores).unionByName(made).withColumn("link", F.lit(False)))


def verdicts(d) -> str:
    """For the oracle: each directory and file with what the last line that fits it says, then the uppermost one that is left out."""
    means = "CASE which " + " ".join(f"WHEN {k} THEN {rule}" for k, (_, rule) in enumerate(LINES)) + " END"
    back = "which IN (" + ", ".join(str(k) for k, (text, _) in enumerate(LINES) if text.startswith("!")) + ")"
    return f"""SELECT doc_id, path, size, content, source, lang, coalesce((list(state ORDER BY level) FILTER (WHERE state IS NOT NULL))[1], '') AS left_out FROM (
  SELECT e.doc_id, e.path, e.size, e.content, e.source, e.lang, e.level, CASE WHEN last_ IS NULL AND NOT dir AND regexp_matches(entry, '/[.][^/]*$') THEN 'hidden' WHEN NOT last_ THEN 'ignored' END AS state FROM (
    SELECT e.*, arg_max({back}, (length(directory), line)) FILTER (WHERE {means.replace('(r ', '(substr(entry, length(directory) + 2) ').replace(' r ', ' substr(entry, length(directory) + 2) ').replace('(r,', '(substr(entry, length(directory) + 2),')}) AS last_ FROM (
      SELECT *, source AS entry, true AS dir, 1 AS level FROM tree_files UNION ALL SELECT *, source || '/' || lang, true, 2 FROM tree_files UNION ALL SELECT *, source || '/' || lang || '/b' || (doc_id % 5), true, 3 FROM tree_files UNION ALL SELECT *, path, false, 4 FROM tree_files) e
    LEFT JOIN stated s ON (s.directory = e.source OR s.directory = e.source || '/' || e.lang) AND starts_with(entry, s.directory || '/') GROUP BY ALL) e) x GROUP BY ALL"""


REASON = """CASE WHEN left_out <> '' THEN left_out WHEN size > 2097152 THEN 'oversized' WHEN path LIKE '%.md' THEN 'language' WHEN content IS NULL THEN 'unreadable'
  WHEN regexp_matches(lower(array_to_string(string_split(content, chr(10))[1:10], chr(10))), '@generated|do not edit|automatically generated|autogenerated') THEN 'generated' ELSE 'kept' END"""
OWNER = "CASE WHEN EXISTS (SELECT 1 FROM packages p WHERE p.directory = source || '/' || lang) THEN source || '-' || lang ELSE source END"


def over_tree(text: str) -> str:
    return composed({r.__name__: r(Duck()) for r in (tree_files, stated, packages, verdicts)}, text)


@register("discover_tree", over_tree(f"SELECT path, {OWNER} AS package, {REASON} AS dropped FROM verdicts"))
def discover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's file with the package that owns it and why it is dropped, if it is."""
    found = discovery.discover(read_tree(spark, sf_dir))
    return found.where("dropped IS NULL OR dropped <> 'metadata'").select("path", "package", F.coalesce("dropped", F.lit("kept")).alias("dropped"))


@register("discovery_drops", over_tree(f"SELECT {REASON} AS dropped, count(*) AS files FROM verdicts GROUP BY 1"))
def discovery_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.drop_counts(discovery.discover(read_tree(spark, sf_dir)).where("dropped IS NULL OR dropped <> 'metadata'"))
