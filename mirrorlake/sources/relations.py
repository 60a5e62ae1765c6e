"""The driver's tables as the engine's relations: files, units, statements, tokens, commits, runs, symbols, calls.

Each function gives the text of one relation; later ones may name earlier ones.
"""

from __future__ import annotations

#: Tokens of a k-gram and hashes of a winnowing window on the tables' prose.
K, W = 5, 4
#: Lines of a file, at most, for which ids of units are distinct.
MOST_LINES = 1 << 24


def files(d) -> str:
    return "SELECT doc_id AS file_id, source AS directory, lang AS language, text AS content, md5(text) AS content_hash, n_chars AS size FROM documents WHERE text IS NOT NULL"


def units(d) -> str:
    """A unit is a line with something on it; its extent runs in characters of the file."""
    return f"""SELECT doc_id AS file_id, line_no, doc_id * {MOST_LINES} + line_no AS unit_id, line, CAST(length(line) AS BIGINT) AS extent
FROM {d.lines("documents", "doc_id", "text")} u WHERE length(trim(line)) > 0"""


def tokens(d) -> str:
    return f"""SELECT doc_id, pos, tok, CASE WHEN {d.matches("tok", "^[A-Za-z_]")} THEN 'ident' WHEN {d.matches("tok", "^[0-9]")} THEN 'number' ELSE 'punct' END AS kind
FROM {d.tokens("documents", "doc_id", "text")} t"""


def unit_tokens(d) -> str:
    return f"""SELECT file_id, line_no, unit_id, pos, tok, CASE WHEN {d.matches("tok", "^[A-Za-z_]")} THEN 'ident' WHEN {d.matches("tok", "^[0-9]")} THEN 'number' ELSE 'punct' END AS kind
FROM {d.tokens("units", "file_id, line_no, unit_id", "line")} t"""


def kgrams(d) -> str:
    lead = " || ' ' || ".join(["tok"] + [f"lead(tok, {i}) OVER (PARTITION BY doc_id ORDER BY pos)" for i in range(1, K)])
    return f"SELECT doc_id, pos, {d.h60('gram')} AS h FROM (SELECT doc_id, pos, {lead} AS gram FROM tokens) g WHERE gram IS NOT NULL"


def fingerprints(d) -> str:
    """The least hash of every window of W, the rightmost of equal ones; a file with fewer k-grams gives its least."""
    frame = f"(PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING)"
    return f"""SELECT DISTINCT doc_id, w.x AS h, -w.y AS pos FROM (
  SELECT doc_id, {d.least_pair("h", "-pos", frame)} AS w, count(*) OVER {frame} AS held, count(*) OVER (PARTITION BY doc_id) AS n FROM kgrams
) k WHERE held = {W} OR (n < {W} AND held = n)"""


def postings(d) -> str:
    return "SELECT h, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM fingerprints GROUP BY h"


def exact_members(d) -> str:
    """Files with equal content, in classes of two or more; rn is 1 for a class's least file and 2 for the others.

    Sizes and least ids are sums made before a shuffle, joined back to the files: a content that a third of all files share is a
    skewed side of a join, which is split at run time, not a window that one task sorts.
    """
    return """SELECT doc_id, lang, source, n_chars, gid, sz, CASE WHEN doc_id = least_id THEN 1 ELSE 2 END AS rn FROM (SELECT doc_id, lang, source, n_chars, md5(text) AS h FROM documents WHERE text IS NOT NULL) m
JOIN (SELECT md5(text) AS gid, count(*) AS sz, min(doc_id) AS least_id FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1) c ON m.h = c.gid"""


def unit_groups(d) -> str:
    """Units with equal text of some length, in classes of two or more; sizes and ranks as for files."""
    return """SELECT unit_id, file_id, line_no, line, extent, gid, sz, CASE WHEN unit_id = least_id THEN 1 ELSE 2 END AS rn FROM (SELECT *, md5(line) AS h FROM units WHERE extent >= 20) m
JOIN (SELECT md5(line) AS gid, count(*) AS sz, min(unit_id) AS least_id FROM units WHERE extent >= 20 GROUP BY md5(line) HAVING count(*) > 1) c ON m.h = c.gid"""


def commits(d) -> str:
    """Orders by date and key; they are numbered within a date, after all of the dates before (a row a date)."""
    return """SELECT o_orderkey AS id, o_orderdate AS committed_at, o_orderpriority AS subject, CAST(upto - n + row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS BIGINT) AS seq,
  CASE WHEN o_orderpriority LIKE '1-%' THEN 'fix' WHEN o_orderpriority LIKE '2-%' THEN 'feat' ELSE 'other' END AS kind FROM orders JOIN (
  SELECT o_orderdate AS day, count(*) AS n, sum(count(*)) OVER (ORDER BY o_orderdate) AS upto FROM orders GROUP BY o_orderdate) b ON o_orderdate = day"""


def commit_paths(d) -> str:
    return "SELECT DISTINCT l_orderkey AS id, l_suppkey AS path FROM lineitem"


def commit_sizes(d) -> str:
    return "SELECT id, count(*) AS n_paths FROM commit_paths GROUP BY id"


def seam_paths(d) -> str:
    """The ledger: a seam is a region, its members are the nations, a path belongs to its supplier's nation."""
    return "SELECT s.s_suppkey AS path, n.n_nationkey AS member, r.r_regionkey AS seam, r.r_name AS seam_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"


def runs(d) -> str:
    return "SELECT event_id AS run_id, user_id AS root, event_type AS variant, ts AS started_at, value AS priority, CASE WHEN value > 5 THEN 'completed' ELSE 'failed' END AS status, props FROM events"


def symbols(d) -> str:
    return "SELECT p_partkey AS symbol, p_brand AS owner, p_type AS class, CAST(p_size AS BIGINT) AS bytes, p_brand || '/' || p_type || '/' || p_size AS content, p_name AS name FROM part"


def calls(d) -> str:
    """An acyclic call graph with several parents and unreachable nodes; its root is 1."""
    return """SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS src, p_partkey AS dst FROM part WHERE p_partkey > 1 AND p_size % 5 <> 0
UNION SELECT CAST(floor(p_partkey / 3) AS BIGINT), p_partkey FROM part WHERE p_partkey >= 3 AND p_size % 7 = 0"""


def findings(d) -> str:
    """Labelled files as findings: the score that ranks them and the verdict on them."""
    return """SELECT l.doc_id AS finding, d.lang AS rule, CASE WHEN d.n_chars >= 2000 THEN 'high' WHEN d.n_chars >= 500 THEN 'medium' ELSE 'low' END AS band,
  CAST(d.n_chars AS DOUBLE) / (d.n_chars + 1000) AS score, l.quality AS hit, l.toxic AS withheld, d.n_chars AS size FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""
