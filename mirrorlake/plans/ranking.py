"""Orders, limits and top-k."""

from __future__ import annotations

from ..sources.relations import exact_members, findings
from .scalars import PRIORITY
from .sql import sql


@sql("report_order")
def report_order(d) -> str:
    # places within bins of the first keys, after all of the bins before (a row a bin)
    return f"""WITH p AS (SELECT gid, CASE WHEN risk < 0.3 THEN 1 ELSE 0 END AS low, round(priority, 9) AS worth, coalesce(CAST(floor(round(priority, 9) * 1000) AS BIGINT), -1000000) AS bin FROM ({PRIORITY}) q),
b AS (SELECT low, bin, sum(count(*)) OVER (ORDER BY low, bin DESC) - count(*) AS before FROM p GROUP BY low, bin)
SELECT p.gid, CAST(b.before + row_number() OVER (PARTITION BY p.low, p.bin ORDER BY p.worth DESC NULLS LAST, p.gid) AS BIGINT) AS place FROM p JOIN b ON p.low = b.low AND p.bin = b.bin"""


@sql("report_order_axes", exact_members)
def report_order_axes(d) -> str:
    # as above: bins by instances and the first digits of the id, and by size on a scale of logarithms
    return """WITH g AS (SELECT gid, n, dup, substr(gid, 1, 2) AS part, CAST(floor(log2(dup + 1) * 64) AS BIGINT) AS bin FROM (SELECT gid, count(*) AS n, sum(n_chars) - max(n_chars) AS dup FROM exact_members GROUP BY gid) x),
bn AS (SELECT n, part, sum(count(*)) OVER (ORDER BY n DESC, part) - count(*) AS before FROM g GROUP BY n, part), bd AS (SELECT bin, sum(count(*)) OVER (ORDER BY bin DESC) - count(*) AS before FROM g GROUP BY bin)
SELECT g.gid, CAST(bn.before + row_number() OVER (PARTITION BY g.n, g.part ORDER BY g.gid) AS BIGINT) AS by_instances, CAST(bd.before + row_number() OVER (PARTITION BY g.bin ORDER BY g.dup DESC, g.gid) AS BIGINT) AS by_duplicated
FROM g JOIN bn ON g.n = bn.n AND g.part = bn.part JOIN bd ON g.bin = bd.bin"""


@sql("top_groups", exact_members)
def top_groups(d) -> str:
    # ten groups, five occurrences of each
    # (a rank that is filtered alone is cut to five a group before its shuffle)
    return """SELECT gid, doc_id, CAST(r AS BIGINT) AS occurrence FROM (SELECT gid, doc_id, row_number() OVER (PARTITION BY gid ORDER BY doc_id) AS r FROM exact_members) m WHERE r <= 5 AND EXISTS (SELECT 1 FROM (SELECT gid FROM exact_members GROUP BY gid ORDER BY max(n_chars) DESC, gid LIMIT 10) t WHERE t.gid = m.gid)"""


@sql("top_priority")
def top_priority(d) -> str:
    return f"SELECT gid, round(priority, 6) AS priority FROM ({PRIORITY}) p ORDER BY round(priority, 9) DESC, gid LIMIT 20"


@sql("capped_topk", exact_members)
def capped_topk(d) -> str:
    # at most two of a group, then at most 1,000 in the order of visiting, which alone are numbered
    return """SELECT gid, doc_id, CAST(row_number() OVER (ORDER BY gid, doc_id) AS BIGINT) AS k FROM (
  SELECT gid, doc_id FROM (SELECT gid, doc_id, row_number() OVER (PARTITION BY gid ORDER BY doc_id) AS r FROM exact_members) m WHERE r <= 2 ORDER BY gid, doc_id LIMIT 1000) x"""


@sql("min_identifier_view", exact_members)
def min_identifier_view(d) -> str:
    # the total is over all groups, also those out of view: one row, not a window over all
    return "SELECT gid, n, (SELECT count(*) FROM exact_members) AS total FROM (SELECT gid, count(*) AS n, min(n_chars) AS least FROM exact_members GROUP BY gid) g WHERE least >= 500"


@sql("retention_topn")
def retention_topn(d) -> str:
    return "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) x WHERE r <= 3"


@sql("precision_at_k", findings)
def precision_at_k(d) -> str:
    # ties in score: the pessimistic order puts misses first
    return """WITH r AS (SELECT hit, row_number() OVER (ORDER BY score DESC, finding) AS r FROM (SELECT * FROM findings ORDER BY score DESC, finding LIMIT 100) x),
w AS (SELECT hit, row_number() OVER (ORDER BY score DESC, hit, finding) AS r FROM (SELECT * FROM findings ORDER BY score DESC, hit, finding LIMIT 100) x)
SELECT r.k, r.p AS p_at_k, w.p AS pessimistic FROM (SELECT k, round(avg(CASE WHEN r <= k THEN CAST(hit AS DOUBLE) END), 6) AS p FROM r CROSS JOIN (SELECT 10 AS k UNION ALL SELECT 50 UNION ALL SELECT 100) ks GROUP BY k) r
JOIN (SELECT k, round(avg(CASE WHEN r <= k THEN CAST(hit AS DOUBLE) END), 6) AS p FROM w CROSS JOIN (SELECT 10 AS k UNION ALL SELECT 50 UNION ALL SELECT 100) ks GROUP BY k) w ON r.k = w.k"""


@sql("mean_average_precision", findings)
def mean_average_precision(d) -> str:
    return """SELECT rule, round(sum(CASE WHEN hit = 1 THEN hits * 1e0 / r ELSE 0e0 END) / max(total), 6) AS average_precision FROM (
  SELECT rule, hit, sum(hit) OVER (PARTITION BY rule ORDER BY score DESC, finding ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits, row_number() OVER (PARTITION BY rule ORDER BY score DESC, finding) AS r, sum(hit) OVER (PARTITION BY rule) AS total FROM findings) x GROUP BY rule"""
