"""Scalar functions of rows and pairs."""

from __future__ import annotations

from ..sources.relations import units
from .projections import NEIGHBOURS
from .sql import sql


@sql("cosine_embeddings")
def cosine_embeddings(d) -> str:
    return f"""SELECT a, b, round(CASE WHEN xx = 0 OR yy = 0 THEN 0 ELSE xy / sqrt(xx * yy) END, 5) AS cosine FROM (SELECT a, b, {d.dot("x", "y")} AS xy, {d.dot("x", "x")} AS xx, {d.dot("y", "y")} AS yy FROM ({NEIGHBOURS}) p) q"""


@sql("l1_embeddings")
def l1_embeddings(d) -> str:
    return f"SELECT a, b, round({d.l1('x', 'y')}, 4) AS distance FROM ({NEIGHBOURS}) p"


#: v / (v + half), 0 where either isn't positive.
def saturating(v: str, half: str) -> str:
    return f"CASE WHEN {v} <= 0 OR {half} <= 0 THEN 0e0 ELSE {v} * 1e0 / ({v} + {half}) END"


PRIORITY = f"""SELECT gid, confidence, risk, difficulty, confidence * (0.5e0 + 0.5e0 * (2 * risk + (1 - difficulty)) / 3) AS priority FROM (
  SELECT gid, {saturating("least_chars", "40")} AS confidence, 0.5e0 * {saturating("(instances - 1)", "2")} + 0.35e0 * {saturating("most_chars", "120")} + 0.15e0 * {saturating("(directories - 1)", "1")} AS risk,
    0.4e0 * {saturating("most_chars", "200")} + 0.25e0 * CASE WHEN most_chars < 500 THEN 1 ELSE 0 END + 0.2e0 * 0 + 0.15e0 * CASE WHEN languages > 1 THEN 1 ELSE 0 END AS difficulty FROM (
    SELECT md5(text) AS gid, count(*) AS instances, min(n_chars) AS least_chars, max(n_chars) AS most_chars, count(DISTINCT source) AS directories, count(DISTINCT lang) AS languages FROM documents GROUP BY md5(text) HAVING count(*) > 1) g) f"""


@sql("priority_rank")
def priority_rank(d) -> str:
    return f"SELECT gid, round(confidence, 6) AS confidence, round(risk, 6) AS risk, round(difficulty, 6) AS difficulty, round(priority, 6) AS priority FROM ({PRIORITY}) p"


#: Pairs of neighbouring documents with measures of several dimensions; one that can't be measured is null.
def measured(d) -> str:
    return """SELECT a, b, lexical, structural, cfg, api, CAST(NULL AS DOUBLE) AS type_evidence FROM (
  SELECT doc_id AS a, b, least(n, n2) * 1e0 / greatest(n, n2) AS structural, CASE WHEN lang = lang2 THEN 1e0 ELSE 0.5e0 END AS lexical, CASE WHEN least(n, n2) < 50 THEN NULL ELSE 1e0 - abs(n - n2) * 1e0 / (n + n2) END AS cfg,
    CASE WHEN source = source2 THEN 1e0 WHEN lang <> lang2 THEN NULL ELSE 0.8e0 END AS api FROM (
    SELECT doc_id, lang, source, n_chars AS n, lead(doc_id) OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS b, lead(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS n2,
      lead(lang) OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS lang2, source AS source2 FROM documents WHERE n_chars > 0) x WHERE b IS NOT NULL) y"""


def composite(names: list[tuple[str, str]]) -> str:
    top = " + ".join(f"coalesce({w} * {n}, 0e0)" for n, w in names)
    low = " + ".join(f"CASE WHEN {n} IS NULL THEN 0e0 ELSE {w} END" for n, w in names)
    return f"({top}) / ({low})"


# The weights of the dimensions.
WEIGHTS = [("lexical", "0.20e0"), ("structural", "0.45e0"), ("cfg", "0.20e0"), ("type_evidence", "0.15e0"), ("api", "0.15e0")]


@sql("composite_score", measured)
def composite_score(d) -> str:
    return f"SELECT a, b, round({composite(WEIGHTS)}, 6) AS composite FROM measured"


@sql("classify_pairs", measured)
def classify_pairs(d) -> str:
    return f"""SELECT class, confidence, count(*) AS n FROM (SELECT CASE WHEN structural = 1 AND lexical = 1 AND api = 1 THEN 'type-1' WHEN lexical >= 0.9 THEN 'type-2' WHEN c >= 0.7 THEN 'type-3' ELSE 'none' END AS class,
  CASE WHEN c >= 0.85 AND type_evidence IS NOT NULL THEN 'high' WHEN c >= 0.75 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, {composite(WEIGHTS)} AS c FROM measured) m) x GROUP BY class, confidence"""


@sql("text_agreement", units)
def text_agreement(d) -> str:
    # neighbouring lines word by word: equal positions over the longer length
    return f"""SELECT unit_id, round({d.equal_places("x", "y")} * 1e0 / greatest({d.size("x")}, {d.size("y")}), 6) AS agreement FROM (
  SELECT unit_id, {d.pieces("line", " ")} AS x, {d.pieces("nxt", " ")} AS y FROM (SELECT unit_id, line, lead(line) OVER (PARTITION BY file_id ORDER BY line_no) AS nxt FROM units) n WHERE nxt IS NOT NULL) p"""


@sql("set_jaccard", units)
def set_jaccard(d) -> str:
    return f"""SELECT unit_id, round(CASE WHEN {d.either("x", "y")} = 0 THEN NULL ELSE {d.common("x", "y")} * 1e0 / {d.either("x", "y")} END, 6) AS jaccard FROM (
  SELECT unit_id, {d.pieces("line", " ")} AS x, {d.pieces("nxt", " ")} AS y FROM (SELECT unit_id, line, lead(line) OVER (PARTITION BY file_id ORDER BY line_no) AS nxt FROM units) n WHERE nxt IS NOT NULL) p"""


@sql("api_jaccard")
def api_jaccard(d) -> str:
    return f"""WITH s AS (SELECT l_orderkey AS id, {d.sorted_set("l_suppkey")} AS targets FROM lineitem GROUP BY l_orderkey)
SELECT a.id, round({d.common("a.targets", "b.targets")} * 1e0 / {d.either("a.targets", "b.targets")}, 6) AS jaccard FROM s a JOIN s b ON b.id = a.id + 1"""


@sql("path_functions")
def path_functions(d) -> str:
    return f"SELECT page_id, {d.extract('url', '^(.*)/[^/]*$')} AS directory, {d.extract('url', '^https?://([^/]+)')} AS host, {d.extract('url', '^https?://([^/]+/[^/?#]+)')} AS leading_two FROM pages"


@sql("width_family")
def width_family(d) -> str:
    # one substitution of a width for another must explain the change
    widths = "(SELECT 'red' AS w UNION ALL SELECT 'blue' UNION ALL SELECT 'small' UNION ALL SELECT 'large' UNION ALL SELECT 'ring')"
    return f"""SELECT a, b, min(f || '>' || t) AS substitution FROM (SELECT p.p_partkey AS a, q.p_partkey AS b, p.p_name AS x, q.p_name AS y FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1) n
CROSS JOIN (SELECT l.w AS f, r.w AS t FROM {widths} l JOIN {widths} r ON l.w <> r.w) s WHERE replace(x, f, t) = y GROUP BY a, b"""


@sql("owner_key")
def owner_key(d) -> str:
    return f"SELECT p_partkey, {d.extract('p_name', '^([a-z]+)')} AS owner, {d.extract('p_brand', '#([0-9]+)')} AS version FROM part"


@sql("range_overlap")
def range_overlap(d) -> str:
    return """SELECT a, b, round(greatest(0, least(ea, eb) - greatest(sa, sb) + 1) * 1e0 / (greatest(ea, eb) - least(sa, sb) + 1), 6) AS line_jaccard, CAST(greatest(0, least(ea, eb) - greatest(sa, sb)) AS BIGINT) AS bytes FROM (
  SELECT p.p_partkey AS a, q.p_partkey AS b, p.p_partkey % 40 AS sa, p.p_partkey % 40 + p.p_size AS ea, q.p_partkey % 40 AS sb, q.p_partkey % 40 + q.p_size AS eb FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1) x"""


@sql("safe_ratio")
def safe_ratio(d) -> str:
    return "SELECT event_type, round(coalesce(count_if(value > 10) * 1e0 / nullif(count_if(value > 5), 0), 0e0), 6) AS ratio, count(*) AS n FROM events GROUP BY event_type"


@sql("allocation_names")
def allocation_names(d) -> str:
    return "SELECT p_type, count_if(p_name IN ('small ring', 'red widget', 'large bolt', 'blue gear')) AS allocating, count(*) AS n FROM part GROUP BY p_type"


@sql("demangle_names")
def demangle_names(d) -> str:
    # _Z<length><name> to the name: the nested form's last element
    return f"SELECT s_suppkey, {d.extract('mangled', '^_ZN?[0-9]*([A-Za-z#]+)')} AS name, {d.extract('mangled', '([0-9]+)E$')} AS serial FROM (SELECT s_suppkey, '_ZN8' || s_name || 'E' AS mangled FROM supplier) m"
