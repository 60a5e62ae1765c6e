"""Commit history: co-change, seams, breaches, guards and stored generations."""

from __future__ import annotations

from ..sources.relations import commit_paths, commit_sizes, commits, runs, seam_paths
from .sql import sql

HISTORY = (commits, commit_paths, commit_sizes)


@sql("cochange_suggest", *HISTORY)
def cochange_suggest(d) -> str:
    return """WITH kept AS (SELECT p.id, p.path FROM commit_paths p JOIN commit_sizes s ON p.id = s.id WHERE s.n_paths <= 7), touched AS (SELECT path, count(*) AS n FROM kept GROUP BY path)
SELECT p.a, p.b, p.support, round(p.support * 1e0 / x.n, 6) AS confidence_a, round(p.support * 1e0 / y.n, 6) AS confidence_b, round(p.support * 1e0 / greatest(x.n, y.n), 6) AS coupling
FROM (SELECT l.path AS a, r.path AS b, count(*) AS support FROM kept l JOIN kept r ON l.id = r.id AND l.path < r.path GROUP BY l.path, r.path HAVING count(*) >= 3) p
JOIN touched x ON p.a = x.path JOIN touched y ON p.b = y.path WHERE p.support * 20 >= greatest(x.n, y.n)"""


@sql("history_summary", *HISTORY)
def history_summary(d) -> str:
    # percentiles by nearest rank
    return """SELECT k.kind, count(*) AS n, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY s.n_paths) AS BIGINT) AS median_size, CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY s.n_paths) AS BIGINT) AS p90_size
FROM commits k JOIN commit_sizes s ON k.id = s.id GROUP BY k.kind"""


@sql("commit_kind", commits)
def commit_kind(d) -> str:
    return "SELECT kind, count(*) AS n, min(id) AS first_id FROM commits GROUP BY kind"


@sql("commit_subject_parse")
def commit_subject_parse(d) -> str:
    # conventional subjects are built from the priority and status: word, scope, mark, colon
    return f"""SELECT kind, breaking, count(*) AS n FROM (SELECT {d.extract("subject", "^([a-z]+)([(][^:]*[)])?!?:")} AS kind, {d.matches("subject", "^[a-z]+([(][^:]*[)])?!:")} AS breaking FROM (
  SELECT CASE WHEN o_orderpriority LIKE '1-%' THEN 'fix' WHEN o_orderpriority LIKE '2-%' THEN 'feat' ELSE 'Misc' END || CASE WHEN o_orderstatus = 'F' THEN '(core)' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN '!' ELSE '' END || ': x' AS subject FROM orders) s) t GROUP BY kind, breaking"""


@sql("seam_membership", seam_paths)
def seam_membership(d) -> str:
    return "SELECT seam, member, count(*) AS paths, min(path) AS first_path FROM seam_paths GROUP BY seam, member"


def touches(d) -> str:
    """Members of seams that a commit touches."""
    return "SELECT DISTINCT c.id, c.seq, c.kind, s.seam, s.member FROM commits c JOIN commit_paths p ON c.id = p.id JOIN seam_paths s ON p.path = s.path"


def partial_touch(d) -> str:
    """Commits that touch some but not all members of a seam."""
    return """SELECT t.id, t.seq, t.seam, count(DISTINCT t.member) AS touched, max(m.n) AS members FROM touches t JOIN (SELECT seam, count(DISTINCT member) AS n FROM seam_paths GROUP BY seam) m ON t.seam = m.seam
GROUP BY t.id, t.seq, t.seam HAVING count(DISTINCT t.member) < max(m.n)"""


SEAM = (*HISTORY[:2], seam_paths, touches, partial_touch)


def breaches(d) -> str:
    """The first fix within the next 20 commits that touches a member left out; of several members the least."""
    # the 20 next commits lie in the commit's own bin of 20 and the next: two rows, each joined by seam and bin
    return """SELECT id, seam, seq, CAST(fix_seq AS BIGINT) AS fix_seq, member FROM (SELECT a.id, a.seam, a.seq, f.seq AS fix_seq, f.member, row_number() OVER (PARTITION BY a.id, a.seam ORDER BY f.seq, f.member) AS r
  FROM (SELECT id, seam, seq, CAST(floor(seq / 20) AS BIGINT) AS bin FROM partial_touch UNION ALL SELECT id, seam, seq, CAST(floor(seq / 20) AS BIGINT) + 1 FROM partial_touch) a
  JOIN (SELECT *, CAST(floor(seq / 20) AS BIGINT) AS bin FROM touches WHERE kind = 'fix') f ON a.seam = f.seam AND a.bin = f.bin AND f.seq BETWEEN a.seq + 1 AND a.seq + 20 WHERE NOT EXISTS (SELECT 1 FROM touches t WHERE t.id = a.id AND t.seam = a.seam AND t.member = f.member)) x WHERE r = 1"""


@sql("seam_breaches", *SEAM, breaches, written=(touches, partial_touch))
def seam_breaches(d) -> str:
    return "SELECT id, seam, fix_seq, member FROM breaches"


@sql("seam_metrics", *SEAM, breaches, written=(touches, partial_touch))
def seam_metrics(d) -> str:
    return "SELECT a.seam, count(*) AS changes, count(b.id) AS breaches, coalesce(CAST(max(b.seq) AS BIGINT), -1) AS last_breach FROM partial_touch a LEFT JOIN breaches b ON a.id = b.id AND a.seam = b.seam GROUP BY a.seam"


@sql("guard_asymmetric", *SEAM)
def guard_asymmetric(d) -> str:
    # all commits under the guard: denied where a seam is touched in part
    return "SELECT c.id, count(a.seam) AS asymmetric_seams, CASE WHEN count(a.seam) > 0 THEN 3 ELSE 0 END AS exit_status FROM commits c LEFT JOIN partial_touch a ON c.id = a.id GROUP BY c.id"


@sql("seam_findings", seam_paths)
def seam_findings(d) -> str:
    return "SELECT s.seam, count(DISTINCT l.l_orderkey) AS findings FROM lineitem l JOIN seam_paths s ON l.l_suppkey = s.path WHERE l.l_quantity > 45 GROUP BY s.seam"


@sql("preceding_run", runs)
def preceding_run(d) -> str:
    return "SELECT run_id, before_id FROM (SELECT run_id, lag(run_id) OVER (PARTITION BY root, variant ORDER BY started_at, run_id) AS before_id FROM runs WHERE status = 'completed') x WHERE before_id IS NOT NULL"


@sql("latest_run", runs)
def latest_run(d) -> str:
    return "SELECT root, run_id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY started_at DESC, run_id DESC) AS r FROM runs WHERE status = 'completed') x WHERE r = 1"


@sql("invocation_partitions", runs)
def invocation_partitions(d) -> str:
    # runs of a root within one hour are one invocation
    return "SELECT root, date_trunc('hour', started_at) AS hour, count(*) AS partitions, min(run_id) AS first_run FROM runs WHERE status = 'completed' GROUP BY root, date_trunc('hour', started_at)"


@sql("asof_seam_run", runs)
def asof_seam_run(d) -> str:
    # for each purchase the newest view of its user that isn't later: one window over both
    return """SELECT run_id, seen FROM (SELECT run_id, variant, max(CASE WHEN variant = 'view' THEN CAST(run_id AS BIGINT) END) OVER (PARTITION BY root ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM runs) x WHERE variant = 'purchase' AND seen IS NOT NULL"""


@sql("seam_generation_delta", runs)
def seam_generation_delta(d) -> str:
    # counters against the generation before, only where both have the same basis
    return """SELECT root, day, n, delta FROM (SELECT root, day, n, CASE WHEN basis = lag(basis) OVER (PARTITION BY root ORDER BY day) THEN n - lag(n) OVER (PARTITION BY root ORDER BY day) END AS delta FROM (
  SELECT root, date_trunc('day', started_at) AS day, count(*) AS n, min(variant) AS basis FROM runs GROUP BY root, date_trunc('day', started_at)) g) x WHERE delta IS NOT NULL"""


@sql("runs_with_group_count", runs)
def runs_with_group_count(d) -> str:
    return "SELECT n.n_nationkey AS run, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS groups FROM nation n"


@sql("finding_locations", runs)
def finding_locations(d) -> str:
    return f"SELECT run_id, coalesce(CAST({d.json('props', 'line')} AS BIGINT), 0) AS line, coalesce(CAST({d.json('props', 'k')} AS BIGINT), 0) AS col FROM runs"


@sql("coalesce_locations")
def coalesce_locations(d) -> str:
    return "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, c_name) AS location FROM customer"


@sql("family_lookup")
def family_lookup(d) -> str:
    return "SELECT p_partkey, p_name FROM part WHERE p_type = (SELECT min(p_type) FROM part)"
