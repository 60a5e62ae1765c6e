"""Scans, classification, filters and partitioning of inputs."""

from __future__ import annotations

from ..sources.relations import commits, files, runs, units
from .sql import sql


@sql("scan_documents")
def scan_documents(d) -> str:
    # the first reason that applies is the one that is counted
    return """SELECT lang AS language, CASE WHEN text IS NULL THEN 'unreadable' WHEN instr(text, chr(0)) > 0 THEN 'binary' WHEN n_chars > 20000 THEN 'oversized'
  WHEN length(trim(text)) = 0 THEN 'empty' ELSE 'kept' END AS outcome, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY 1, 2"""


@sql("classify_language")
def classify_language(d) -> str:
    return f"""SELECT page_id, {d.extract("url", "[.]([a-z]+)(/|$)")} AS ext, CASE {d.extract("url", "[.]([a-z]+)(/|$)")} WHEN 'com' THEN 'commercial' WHEN 'org' THEN 'organisation'
  WHEN 'net' THEN 'network' ELSE 'other' END AS class, {d.matches("url", "^https")} AS secure FROM pages"""


@sql("header_majority_vote")
def header_majority_vote(d) -> str:
    # ambiguous files (from source 0) take the language that most of the others have; ties go to the lesser name
    return """SELECT d.doc_id, v.lang AS language, v.n AS votes FROM documents d CROSS JOIN (
  SELECT lang, n FROM (SELECT lang, n, row_number() OVER (ORDER BY n DESC, lang) AS r FROM (SELECT lang, count(*) AS n FROM documents WHERE source <> 'src0' GROUP BY lang) c) o WHERE r = 1
) v WHERE d.source = 'src0'"""


@sql("generated_filter")
def generated_filter(d) -> str:
    return f"""SELECT page_id, {d.matches(f"lower({d.head_lines('html', 10)})", "@generated|do not edit|<script")} AS generated, CAST(length(html) AS BIGINT) AS size FROM pages"""


def synthetic(d) -> str:
    """Generated sources: a file's statements follow from its seed by hashing; 5 % of the files have the seed of one of 128 shared ones."""
    pick = "CASE " + " ".join(f"WHEN {d.h60('seed || CAST(j AS STRING)')} % 5 = {k} THEN '{text}' || CAST({d.h60('seed || CAST(j AS STRING)')} % 97 AS STRING) || ';'" for k, text in enumerate(("let a = b + ", "call(a, b); c = ", "if (a > b) c = ", "while (b) b = ", "return "))) + " END"
    return f"""SELECT id, seed, {d.joined(d.sorted_list("lpad(CAST(j AS STRING), 3, '0') || ' ' || line"), " ")} AS content FROM (
  SELECT id, seed, j, {pick} AS line FROM (SELECT p_partkey AS id, CASE WHEN {d.h60("'pick' || CAST(p_partkey AS STRING)")} % 100 < 5 THEN 'shared' || CAST({d.h60("'slot' || CAST(p_partkey AS STRING)")} % 128 AS STRING) ELSE 'own' || CAST(p_partkey AS STRING) END AS seed FROM part) f
  CROSS JOIN {d.series("1", "24", "j")} q) s GROUP BY id, seed"""


@sql("synthetic_corpus", synthetic)
def synthetic_corpus(d) -> str:
    # every file with the size of its class: copies are those of one seed
    return "SELECT id, md5(content) AS content_hash, count(*) OVER (PARTITION BY md5(content)) AS copies FROM synthetic"


@sql("glob_filter")
def glob_filter(d) -> str:
    # include **/en/** and **/de/**, exclude **/*page=1*
    return f"""SELECT page_id, url FROM pages WHERE {d.matches("url", "^.*/(en|de)/.*$")} AND NOT {d.matches("url", "^.*/[^/]*page=1[^/]*$")}"""


@sql("longest_prefix_owner")
def longest_prefix_owner(d) -> str:
    return f"""SELECT page_id, owner, CAST(depth AS BIGINT) AS depth FROM (
  SELECT p.page_id, o.owner, length(o.owner) AS depth, row_number() OVER (PARTITION BY p.page_id ORDER BY length(o.owner) DESC, o.owner) AS r
  FROM (SELECT page_id, {d.extract("url", "^https?://([^?#]*)")} AS path, {d.extract("url", "^https?://([^/]*)")} AS host FROM pages) p
  JOIN (SELECT DISTINCT {d.extract("url", "^https?://([^/]*)")} AS host, {d.extract("url", "^https?://([^/]*)")} AS owner FROM pages
    UNION SELECT DISTINCT {d.extract("url", "^https?://([^/]*)")}, {d.extract("url", "^https?://([^/]*/[^/?#]+)/")} FROM pages) o
  ON p.host = o.host AND o.owner <> '' AND p.path LIKE o.owner || '%') x WHERE r = 1"""


@sql("partition_isolation")
def partition_isolation(d) -> str:
    # equal content counts as a copy only within a variant
    return "SELECT lang, count(*) AS classes, CAST(sum(n) AS BIGINT) AS files FROM (SELECT lang, md5(text) AS h, count(*) AS n FROM documents GROUP BY lang, md5(text) HAVING count(*) > 1) g GROUP BY lang"


@sql("units_from_lines", units)
def units_from_lines(d) -> str:
    return "SELECT file_id, count(*) AS n_units, min(line_no) AS first_line, max(line_no) AS last_line, CAST(sum(extent) AS BIGINT) AS extent FROM units GROUP BY file_id"


@sql("work_budget_filter")
def work_budget_filter(d) -> str:
    return "SELECT CASE WHEN n_chars <= 256 * 20 THEN 'within' ELSE 'over budget' END AS outcome, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1"


@sql("history_range", commits)
def history_range(d) -> str:
    return "SELECT id, committed_at, kind FROM (SELECT * FROM commits ORDER BY committed_at DESC, id DESC LIMIT 2000) c"


@sql("magic_detect")
def magic_detect(d) -> str:
    return """SELECT page_id, CASE WHEN lower(substr(html, 1, 9)) = '<!doctype' THEN 'html' WHEN substr(html, 1, 4) = '%PDF' THEN 'pdf' WHEN substr(html, 1, 1) = '{' THEN 'json' ELSE 'unknown' END AS format FROM pages"""


@sql("interval_join")
def interval_join(d) -> str:
    # addresses (keys) to the ranges that hold them, by way of bins of 64 so that the join is on a key
    return f"""SELECT a.o_orderkey AS address, r.lo, r.hi FROM (SELECT o_orderkey FROM orders) a
JOIN (SELECT lo, hi, CAST(floor(lo / 64) AS BIGINT) + k AS bin FROM (SELECT p_partkey * 37 AS lo, p_partkey * 37 + p_size AS hi FROM part) x CROSS JOIN {d.series("0", "1", "k")} s) r
ON CAST(floor(a.o_orderkey / 64) AS BIGINT) = r.bin AND a.o_orderkey >= r.lo AND a.o_orderkey < r.hi"""


@sql("json_props")
def json_props(d) -> str:
    return f"SELECT event_type, CAST({d.json('props', 'k')} AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2"


@sql("tree_identical")
def tree_identical(d) -> str:
    # two runs over the same tree: nothing on either side that the other hasn't
    return """SELECT lang, count(*) AS n_files, count_if(a IS NULL OR b IS NULL OR a <> b) AS differences, count_if(a IS NULL OR b IS NULL OR a <> b) = 0 AS reusable FROM (
  SELECT coalesce(x.lang, y.lang) AS lang, x.h AS a, y.h AS b FROM (SELECT doc_id, lang, md5(text) AS h FROM documents) x
  FULL OUTER JOIN (SELECT doc_id, lang, CASE WHEN doc_id % 97 = 0 THEN md5(text || '.') ELSE md5(text) END AS h FROM documents) y ON x.doc_id = y.doc_id) z GROUP BY lang"""


@sql("compile_commands")
def compile_commands(d) -> str:
    # entries with one key collapse, then fall into groups by their settings
    return f"""SELECT setting, count(*) AS entries, min(event_id) AS first_entry FROM (SELECT DISTINCT user_id, {d.json("props", "k")} AS setting, min(event_id) OVER (PARTITION BY user_id, {d.json("props", "k")}) AS event_id FROM events) e GROUP BY setting"""


@sql("completed_runs", runs)
def completed_runs(d) -> str:
    return "SELECT variant, count(*) AS n, count(DISTINCT root) AS roots FROM runs WHERE status = 'completed' GROUP BY variant"


@sql("run_groups_scan", runs)
def run_groups_scan(d) -> str:
    # groups of a root's completed runs with their finding and, where there is one, their suppression
    return """SELECT r.run_id, r.root, n.n_name AS group_name, CASE WHEN s.s_suppkey IS NULL THEN NULL ELSE 'yes' END AS suppressed FROM runs r
JOIN nation n ON n.n_nationkey = r.root % 25 LEFT JOIN supplier s ON s.s_suppkey = r.run_id WHERE r.status = 'completed'"""


@sql("files_by_content", files)
def files_by_content(d) -> str:
    return "SELECT content_hash, count(*) AS n, min(file_id) AS canonical, count(DISTINCT directory) AS directories FROM files GROUP BY content_hash"
