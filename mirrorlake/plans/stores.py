"""Run-to-run comparison: diffs, churn, lineage, baselines, artifacts' deltas and JSON."""

from __future__ import annotations

from ..sources.relations import exact_members, runs, symbols, units
from .sql import sql


def before(d) -> str:
    """The tree of an earlier run: without every thirteenth file, every seventh length with other content (copies change together)."""
    return "SELECT doc_id AS path, lang, source, CASE WHEN length(text) % 7 = 0 THEN md5(coalesce(text, '') || '!') ELSE md5(text) END AS h FROM documents WHERE doc_id % 13 <> 0"


def after(d) -> str:
    """The tree of the later run: without every eleventh file."""
    return "SELECT doc_id AS path, lang, source, md5(text) AS h FROM documents WHERE doc_id % 11 <> 0"


@sql("tree_changes", before, after)
def tree_changes(d) -> str:
    return "SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS change FROM after a FULL OUTER JOIN before b ON a.path = b.path"


def before_groups(d) -> str:
    return "SELECT h AS gid, count(*) AS n, min(path) AS first_path FROM before GROUP BY h HAVING count(*) > 1"


def after_groups(d) -> str:
    return "SELECT h AS gid, count(*) AS n, min(path) AS first_path FROM after GROUP BY h HAVING count(*) > 1"


STORE = (before, after, before_groups, after_groups)


@sql("top_churn", *STORE)
def top_churn(d) -> str:
    return """WITH b AS (SELECT g.gid, t.gid IS NOT NULL AS top FROM before_groups g LEFT JOIN (SELECT gid FROM before_groups ORDER BY n DESC, gid LIMIT 20) t ON g.gid = t.gid),
a AS (SELECT g.gid, t.gid IS NOT NULL AS top FROM after_groups g LEFT JOIN (SELECT gid FROM after_groups ORDER BY n DESC, gid LIMIT 20) t ON g.gid = t.gid)
SELECT state, count(*) AS n FROM (SELECT CASE WHEN b.top AND a.top THEN 'still ranked' WHEN b.top AND a.gid IS NOT NULL THEN 'outranked' WHEN b.top THEN 'closed' WHEN a.top AND b.gid IS NOT NULL THEN 'promoted' WHEN a.top THEN 'entered' ELSE 'elsewhere' END AS state
FROM b FULL OUTER JOIN a ON b.gid = a.gid) x GROUP BY state"""


def adopted(d) -> str:
    """A new group adopts the earlier group with which it shares most paths, at least half of its own; ties to the lesser id."""
    return """SELECT new_gid, old_gid, shared FROM (SELECT x.h AS new_gid, y.h AS old_gid, count(*) AS shared, row_number() OVER (PARTITION BY x.h ORDER BY count(*) DESC, y.h) AS r FROM after x JOIN after_groups g ON x.h = g.gid
  JOIN before y ON x.path = y.path JOIN before_groups o ON y.h = o.gid WHERE x.h <> y.h GROUP BY x.h, y.h, g.n HAVING count(*) * 2 >= g.n) z WHERE r = 1"""


@sql("lineage_adoption", *STORE, adopted)
def lineage_adoption(d) -> str:
    return "SELECT new_gid, old_gid, shared FROM adopted"


@sql("group_identity", *STORE, adopted)
def group_identity(d) -> str:
    return "SELECT a.gid, CASE WHEN b.gid IS NOT NULL THEN 'retained' WHEN p.new_gid IS NOT NULL THEN 'adopted' ELSE 'new' END AS verdict FROM after_groups a LEFT JOIN before_groups b ON a.gid = b.gid LEFT JOIN adopted p ON a.gid = p.new_gid"


@sql("baseline_delta", *STORE)
def baseline_delta(d) -> str:
    return "SELECT coalesce(a.gid, b.gid) AS gid, CASE WHEN a.gid IS NULL THEN 'gone' WHEN b.gid IS NULL THEN 'appeared' WHEN a.n > b.n THEN 'expanded' ELSE 'continuing' END AS state FROM after_groups a FULL OUTER JOIN before_groups b ON a.gid = b.gid"


@sql("baseline_prune", *STORE)
def baseline_prune(d) -> str:
    return "SELECT gid, n FROM before_groups b WHERE EXISTS (SELECT 1 FROM after_groups a WHERE a.gid = b.gid)"


@sql("baseline_compat", before, after)
def baseline_compat(d) -> str:
    # the sets of versions (sources) are equal both ways
    return """SELECT lang, count_if(NOT in_after) AS only_before, count_if(NOT in_before) AS only_after, count_if(NOT (in_before AND in_after)) = 0 AS compatible FROM (
  SELECT lang, source, bool_or(side = 'b') AS in_before, bool_or(side = 'a') AS in_after FROM (SELECT lang, source, 'b' AS side FROM before UNION ALL SELECT lang, source, 'a' FROM after) u GROUP BY lang, source) s GROUP BY lang"""


@sql("symbol_deltas", symbols)
def symbol_deltas(d) -> str:
    return """SELECT owner, state, count(*) AS n, CAST(sum(delta) AS BIGINT) AS bytes FROM (SELECT coalesce(a.owner, b.owner) AS owner, CASE WHEN b.symbol IS NULL THEN 'added' WHEN a.symbol IS NULL THEN 'removed' WHEN a.bytes <> b.bytes THEN 'modified' ELSE 'unchanged' END AS state,
  coalesce(a.bytes, 0) - coalesce(b.bytes, 0) AS delta FROM (SELECT * FROM symbols WHERE symbol % 10 <> 0) a FULL OUTER JOIN (SELECT symbol, owner, CASE WHEN symbol % 9 = 0 THEN bytes + 3 ELSE bytes END AS bytes FROM symbols WHERE symbol % 8 <> 0) b ON a.symbol = b.symbol) x GROUP BY owner, state"""


@sql("ownership_delta", symbols)
def ownership_delta(d) -> str:
    return """SELECT coalesce(a.owner, b.owner) AS owner, CAST(sum(coalesce(a.bytes, 0) - coalesce(b.bytes, 0)) AS BIGINT) AS delta FROM (SELECT * FROM symbols WHERE symbol % 10 <> 0) a FULL OUTER JOIN (SELECT symbol, owner, bytes + 1 AS bytes FROM symbols WHERE symbol % 8 <> 0) b ON a.symbol = b.symbol GROUP BY 1"""


@sql("prefix_lookup", exact_members)
def prefix_lookup(d) -> str:
    # ids by their first hex digits in two tables; a prefix that names several is ambiguous
    return """SELECT prefix, count(*) AS n, min(kind) AS first_kind, count(*) > 1 AS ambiguous FROM (SELECT DISTINCT substr(gid, 1, 2) AS prefix, 'group' AS kind, gid AS id FROM exact_members UNION SELECT DISTINCT substr(md5(source), 1, 2), 'directory', md5(source) FROM exact_members) x GROUP BY prefix"""


@sql("groups_to_json", exact_members)
def groups_to_json(d) -> str:
    return f"SELECT gid, {d.to_json(('gid', 'gid'), ('members', 'n'), ('size', 'size'))} AS json FROM (SELECT gid, count(*) AS n, max(n_chars) AS size FROM exact_members GROUP BY gid) g"


@sql("sarif_results", exact_members)
def sarif_results(d) -> str:
    return f"SELECT doc_id, {d.to_json(('ruleId', chr(39) + 'exact-copy' + chr(39)), ('level', 'CASE WHEN n_chars > 1000 THEN ' + chr(39) + 'warning' + chr(39) + ' ELSE ' + chr(39) + 'note' + chr(39) + ' END'), ('uri', 'source'))} AS result FROM exact_members"


@sql("csv_records", symbols)
def csv_records(d) -> str:
    return "SELECT 'symbol' AS record_type, symbol AS id, owner || ';' || class || ';' || bytes AS fields FROM symbols UNION ALL SELECT 'total', 0, 'all;;' || CAST(sum(bytes) AS BIGINT) FROM symbols"


@sql("unit_occurrence_ordinal", units)
def unit_occurrence_ordinal(d) -> str:
    return "SELECT unit_id, CAST(row_number() OVER (PARTITION BY file_id, md5(line) ORDER BY line_no) AS BIGINT) AS ordinal FROM units"


@sql("snapshot_counts", runs)
def snapshot_counts(d) -> str:
    # a run is readable only once its last row, the commit mark, is there
    return "SELECT root, count(*) AS rows_, bool_or(variant = 'purchase') AS committed FROM runs GROUP BY root"
