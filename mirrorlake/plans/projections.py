"""Normalisation, segmentation, predicates and suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import spans
from ..registry import register
from ..sources.relations import exact_members, runs, tokens, unit_groups, unit_tokens, units
from .sql import run, sql, told


@sql("tokenize_documents", tokens)
def tokenize_documents(d) -> str:
    return "SELECT doc_id, kind, count(*) AS n, count(DISTINCT tok) AS n_distinct FROM tokens GROUP BY doc_id, kind"


@sql("alpha_rename", units, unit_tokens)
def alpha_rename(d) -> str:
    # identifiers become the ordinal of their first occurrence in the unit; those with a capital keep their name
    return """SELECT unit_id, max(ord) AS highest, CAST(sum(ord) AS BIGINT) AS total, count(*) AS renamed FROM (
  SELECT unit_id, pos, dense_rank() OVER (PARTITION BY unit_id ORDER BY first_pos) - 1 AS ord FROM (
    SELECT unit_id, pos, min(pos) OVER (PARTITION BY unit_id, tok) AS first_pos FROM unit_tokens WHERE kind = 'ident' AND lower(tok) = tok) a) b GROUP BY unit_id"""


@sql("literal_norm_modes", tokens)
def literal_norm_modes(d) -> str:
    return """SELECT kind, count(DISTINCT tok) AS preserve, count(DISTINCT CASE WHEN kind = 'number' THEN 'N' || length(tok) ELSE tok END) AS category,
  count(DISTINCT CASE WHEN kind = 'number' THEN 'LIT' ELSE tok END) AS full_norm FROM tokens GROUP BY kind"""


@sql("resolved_override")
def resolved_override(d) -> str:
    # a label is a verdict that replaces the guess from size, either way
    return """SELECT d.doc_id, coalesce(l.quality = 1, d.n_chars > 500) AS is_type, l.quality IS NOT NULL AND (l.quality = 1) <> (d.n_chars > 500) AS overridden
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


@sql("segment_ids", units)
def segment_ids(d) -> str:
    # long lines are segments of their own; the others are numbered by the gap they lie in
    return """SELECT unit_id, CASE WHEN extent >= 200 THEN 'own-' || line_no ELSE 'gap-' || CAST(sum(CASE WHEN extent >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS BIGINT) END AS segment FROM units"""


@sql("innermost_unit")
def innermost_unit(d) -> str:
    # a span of at most 64 lies in two bins of 64; the join is on the bin
    return f"""SELECT point, owner FROM (SELECT a.p_partkey AS point, b.id AS owner, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.n, b.id) AS r
  FROM part a JOIN (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS n, CAST(floor(p_partkey / 64) AS BIGINT) + k AS bin FROM part CROSS JOIN {d.series("0", "1", "k")} s) b
  ON CAST(floor(a.p_partkey / 64) AS BIGINT) = b.bin AND a.p_partkey >= b.id AND a.p_partkey < b.id + b.n) x WHERE r = 1"""


@sql("bracket_depth")
def bracket_depth(d) -> str:
    # tags open and close; the depth is the running sum, never below zero
    return f"""SELECT page_id, max(depth) AS deepest, count(*) AS tags, count_if(step = -1) AS closings FROM (
  SELECT page_id, pos, step, greatest(CAST(sum(step) OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT), 0) AS depth FROM (
    SELECT page_id, pos, CASE WHEN tok = '<' THEN 1 ELSE -1 END AS step FROM {d.tokens("pages", "page_id", "html")} t WHERE tok IN ('<', '>')) s) x GROUP BY page_id"""


@sql("statement_runs", units)
def statement_runs(d) -> str:
    # runs of 1 to 4 lines of a file, as long as they stay within it
    return f"""SELECT file_id, run_length, count(*) AS n_runs FROM (SELECT u.file_id, s.run_length, row_number() OVER (PARTITION BY u.file_id, s.run_length ORDER BY u.line_no) AS k, count(*) OVER (PARTITION BY u.file_id, s.run_length) AS n
  FROM units u CROSS JOIN {d.series("1", "4", "run_length")} s) x WHERE k + run_length - 1 <= n GROUP BY file_id, run_length"""


@sql("statement_heads", units, unit_tokens)
def statement_heads(d) -> str:
    return """SELECT unit_id, max(CASE WHEN pos = 0 THEN kind END) AS head0, max(CASE WHEN pos = 1 THEN kind END) AS head1, max(CASE WHEN pos = 2 THEN kind END) AS head2, max(CASE WHEN pos = 3 THEN kind END) AS head3
FROM unit_tokens WHERE pos < 4 GROUP BY unit_id"""


@sql("min_tokens_gate", units, unit_tokens)
def min_tokens_gate(d) -> str:
    return "SELECT n_tokens >= 20 AS kept, count(*) AS n, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM (SELECT unit_id, count(*) AS n_tokens FROM unit_tokens GROUP BY unit_id) u GROUP BY 1"


PAIRS = "SELECT a.gid, a.doc_id AS a, b.doc_id AS b, a.n_chars AS na, b.n_chars AS nb, a.source AS sa, b.source AS sb FROM exact_members a JOIN exact_members b ON a.gid = b.gid AND a.rn = 1 AND b.rn > 1"
#: Vectors of one label beside their label's first: candidate pairs whose number grows with the rows.
NEIGHBOURS = """SELECT a.vec_id AS a, b.vec_id AS b, a.embedding AS x, b.embedding AS y, a.label FROM embeddings a
JOIN (SELECT vec_id, embedding, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) b ON a.label = b.label AND b.r = 1 AND a.vec_id <> b.vec_id"""


@sql("length_ratio_gate", units)
def length_ratio_gate(d) -> str:
    return "SELECT greatest(a, b) <= 3 * least(a, b) AS near, count(*) AS n FROM (SELECT extent AS a, lead(extent) OVER (PARTITION BY file_id ORDER BY line_no) AS b FROM units) p WHERE b IS NOT NULL GROUP BY 1"


@sql("shape_divergence", units, unit_tokens)
def shape_divergence(d) -> str:
    # shapes are counts of token kinds; neighbouring units are compared
    return """SELECT unit_id, round((abs(i - i2) + abs(n - n2) + abs(p - p2)) / (i + n + p + i2 + n2 + p2), 6) AS divergence, 2 * (abs(i - i2) + abs(n - n2) + abs(p - p2)) <= (i + n + p + i2 + n2 + p2) AS kept FROM (
  SELECT *, lead(i) OVER (PARTITION BY file_id ORDER BY unit_id) AS i2, lead(n) OVER (PARTITION BY file_id ORDER BY unit_id) AS n2, lead(p) OVER (PARTITION BY file_id ORDER BY unit_id) AS p2 FROM (
    SELECT file_id, unit_id, count_if(kind = 'ident') AS i, count_if(kind = 'number') AS n, count_if(kind = 'punct') AS p FROM unit_tokens GROUP BY file_id, unit_id) c) x WHERE i2 IS NOT NULL"""


@sql("shape_histogram", units, unit_tokens)
def shape_histogram(d) -> str:
    # the characteristic vector of a unit: counts of token shapes, the deepest nesting of round brackets by running sum, the size
    shapes = {"names": "kind = 'ident'", "numbers": "kind = 'number'", "stops": "tok IN ('.', '!', '?')", "commas": "tok IN (',', ';', ':')", "opens": "tok IN ('(', '[', '{')", "closes": "tok IN (')', ']', '}')", "quotes": "tok IN ('\"', '`')", "symbols": "tok IN ('#', '*', '$', '%', '&', '|', '<', '>')", "signs": "tok IN ('+', '-', '=', '/')"}
    return f"""SELECT unit_id, {", ".join(f"count(CASE WHEN {rule} THEN 1 END) AS {name}" for name, rule in shapes.items())}, CAST(max(depth) AS BIGINT) AS depth, count(*) AS nodes FROM (
  SELECT *, greatest(0, sum(CASE WHEN tok = '(' THEN 1 WHEN tok = ')' THEN -1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY pos)) AS depth FROM unit_tokens) t GROUP BY unit_id"""


SPANS = "SELECT p_partkey AS id, p_brand AS file, p_partkey % 100 AS s, p_partkey % 100 + p_size AS e FROM part"


@sql("not_nested_pairs")
def not_nested_pairs(d) -> str:
    return f"""SELECT a.id AS a, b.id AS b FROM ({SPANS}) a JOIN ({SPANS}) b ON a.file = b.file AND a.id < b.id AND a.s = b.s - 1
WHERE NOT (a.s <= b.s AND b.e <= a.e) AND NOT (b.s <= a.s AND a.e <= b.e)"""


def _self_overlap_text(_) -> str:
    return f"SELECT a.id AS a, b.id AS b, NOT (a.s < b.e AND b.s < a.e) AS apart FROM ({SPANS}) a JOIN ({SPANS}) b ON a.file = b.file AND b.id > a.id"


@register("no_self_overlap", told(_self_overlap_text))
def no_self_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.all_pairs(run(spark, sf_dir, SPANS))


@sql("no_adjoining")
def no_adjoining(d) -> str:
    return f"SELECT a.id AS a, b.id AS b FROM ({SPANS}) a JOIN ({SPANS}) b ON a.file = b.file AND a.id <> b.id AND a.e = b.s WHERE a.id < b.id"


@sql("test_code_flag", exact_members)
def test_code_flag(d) -> str:
    # a marker wins over the path; a group is test code only if all its members are
    return """SELECT gid, bool_and(CASE WHEN n_chars < 200 THEN true WHEN source LIKE '%1' THEN true ELSE false END) AS is_test, min(CASE WHEN n_chars < 200 THEN 'marker' WHEN source LIKE '%1' THEN 'path' ELSE 'none' END) AS basis FROM exact_members GROUP BY gid"""


@sql("boilerplate_classify", units, unit_tokens)
def boilerplate_classify(d) -> str:
    return """SELECT class, count(*) AS n FROM (SELECT unit_id, CASE WHEN i = 0 AND p > 0 THEN 'punctuation' WHEN i = 1 AND n = 0 THEN 'single' WHEN n > i THEN 'table' WHEN p > i THEN 'marked-up'
  WHEN i <= 4 AND caps = i THEN 'heading' WHEN i <= 4 THEN 'short' ELSE 'prose' END AS class FROM (
  SELECT unit_id, count_if(kind = 'ident') AS i, count_if(kind = 'number') AS n, count_if(kind = 'punct') AS p, count_if(kind = 'ident' AND upper(tok) = tok) AS caps FROM unit_tokens GROUP BY unit_id) c) x GROUP BY class"""


@sql("body_counters", units, unit_tokens)
def body_counters(d) -> str:
    return """SELECT file_id, count_if(kind = 'ident') AS idents, count_if(kind = 'number') AS numbers, count_if(kind = 'punct') AS puncts, count_if(tok = '.') AS statements, count_if(tok = ',') AS lists,
  count_if(tok = '=') AS assignments, count_if(tok IN ('(', ')')) AS calls, count(DISTINCT unit_id) AS units FROM unit_tokens GROUP BY file_id"""


@sql("materiality_flags", exact_members)
def materiality_flags(d) -> str:
    return "SELECT gid, bool_and(n_chars > 300) AS all_loop, bool_or(lang IN ('de', 'fr')) AS any_alloc, min(n_chars) AS least_calls FROM exact_members GROUP BY gid"


@sql("inline_marker", units)
def inline_marker(d) -> str:
    # a marker line (here: one with an address) suppresses the next unit below it in its file
    return """SELECT marker, suppressed FROM (SELECT line, unit_id AS marker, lead(unit_id) OVER (PARTITION BY file_id ORDER BY line_no) AS suppressed FROM units) u WHERE line LIKE '%@%' AND suppressed IS NOT NULL"""


@sql("suppress_precedence")
def suppress_precedence(d) -> str:
    return """SELECT doc_id, coalesce(CASE WHEN source LIKE 'src1%' THEN 'path' END, CASE WHEN text LIKE '%icensed under%' THEN 'vendored' END, CASE WHEN lang = 'es' THEN 'symbol' END, CASE WHEN n_chars < 100 THEN 'inline' END) AS rule FROM documents"""


@sql("suppress_all_members", exact_members)
def suppress_all_members(d) -> str:
    return """SELECT gid, bool_and(rule IS NOT NULL) AS suppressed, max(CASE WHEN rn = 1 THEN rule END) AS canonical_rule FROM (
  SELECT gid, rn, CASE WHEN source LIKE 'src1%' THEN 'path' WHEN lang = 'es' THEN 'symbol' END AS rule FROM exact_members) m GROUP BY gid"""


@sql("prefix_rule_join", exact_members)
def prefix_rule_join(d) -> str:
    return """SELECT gid, rule FROM (SELECT g.gid, r.rule, row_number() OVER (PARTITION BY g.gid ORDER BY r.ord) AS k FROM (SELECT DISTINCT gid FROM exact_members) g
  JOIN (SELECT prefix, ord, 'rule-' || prefix AS rule FROM (SELECT DISTINCT substr(md5(text), 1, 8) AS prefix, min(doc_id) AS ord FROM documents WHERE n_chars % 3 = 0 GROUP BY 1) p) r ON substr(g.gid, 1, 8) = r.prefix) x WHERE k = 1"""


@sql("unused_rules")
def unused_rules(d) -> str:
    return "SELECT n_nationkey AS rule, n_name AS name FROM nation n WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000)"


@sql("rank_down", exact_members)
def rank_down(d) -> str:
    return """SELECT gid, bool_or(p.disposition = 'rank-down') AS ranked_down, bool_and(p.disposition = 'hide') AS hidden FROM exact_members m
JOIN (SELECT 'en' AS lang, 'report' AS disposition UNION ALL SELECT 'de', 'rank-down' UNION ALL SELECT 'fr', 'rank-down' UNION ALL SELECT 'es', 'hide') p ON m.lang = p.lang GROUP BY gid"""


@sql("coexisting_arms", runs)
def coexisting_arms(d) -> str:
    # three-valued conditions: bit 1 can be false, bit 2 can be true; a conjunction of two by their bits
    return """SELECT variant, a, b, CASE WHEN a = 2 AND b = 2 THEN 2 WHEN a = 1 OR b = 1 THEN 1 ELSE 3 END AS both, count(*) AS n FROM (
  SELECT variant, CASE WHEN priority < 5 THEN 1 WHEN priority < 10 THEN 2 ELSE 3 END AS a, CASE WHEN root % 3 = 0 THEN 1 WHEN root % 3 = 1 THEN 2 ELSE 3 END AS b FROM runs) x GROUP BY variant, a, b"""
