"""Candidate pairs by equality of keys, runs over alignments, containment and siblings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import Duck, Spark
from ..operators import runs, winnow
from ..operators.graph import cut
from ..registry import register
from ..sources.code import code_files, code_lines, code_tokens
from ..sources.relations import K, W, exact_members, fingerprints, kgrams, postings, tokens, unit_groups, unit_tokens, units
from .fingerprinting import CAP, LIST_CAP, LSH, close_pairs
from .sql import composed, frame, sql, told


def seed_pairs(d) -> str:
    """Files that share a fingerprint whose list isn't over the cap."""
    return f"""SELECT a.doc_id AS a, b.doc_id AS b, count(DISTINCT a.h) AS shared FROM (SELECT DISTINCT f.doc_id, f.h FROM fingerprints f JOIN postings p ON f.h = p.h AND p.n BETWEEN 2 AND {CAP}) a
JOIN (SELECT DISTINCT f.doc_id, f.h FROM fingerprints f JOIN postings p ON f.h = p.h AND p.n BETWEEN 2 AND {CAP}) b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id"""


SEEDS = (tokens, kgrams, fingerprints, postings, seed_pairs)


@sql("kgram_seed_pairs", *SEEDS, written=(fingerprints,))
def kgram_seed_pairs(d) -> str:
    return "SELECT a, b, shared FROM seed_pairs"


@sql("kgram_document_pairs", *SEEDS, written=(fingerprints,))
def kgram_document_pairs(d) -> str:
    return """SELECT p.a, p.b, p.shared, round(p.shared * 1e0 / least(x.n, y.n), 6) AS score FROM seed_pairs p
JOIN (SELECT doc_id, count(DISTINCT h) AS n FROM fingerprints GROUP BY doc_id) x ON p.a = x.doc_id JOIN (SELECT doc_id, count(DISTINCT h) AS n FROM fingerprints GROUP BY doc_id) y ON p.b = y.doc_id
WHERE p.shared * 10 >= 3 * least(x.n, y.n)"""


def fragments(d) -> str:
    """Units with their identifiers renamed by first occurrence; equal forms are copies up to names."""
    return f"""SELECT unit_id, file_id, n, md5({d.joined("forms", " ")}) AS digest, raw FROM (
  SELECT unit_id, file_id, count(*) AS n, {d.sorted_list("lpad(CAST(pos AS STRING), 6, '0') || form")} AS forms, min(raw) AS raw FROM (
    SELECT t.unit_id, t.file_id, t.pos, CASE WHEN kind = 'ident' THEN 'v' || (dense_rank() OVER (PARTITION BY t.unit_id, kind ORDER BY first_pos) - 1) ELSE tok END AS form, md5(u.line) AS raw FROM (
      SELECT *, min(pos) OVER (PARTITION BY unit_id, tok) AS first_pos FROM unit_tokens) t JOIN units u ON t.unit_id = u.unit_id) x GROUP BY unit_id, file_id) y WHERE n >= 8"""


FRAGMENTS = (units, unit_tokens, fragments)


@sql("renamed_fragment_pairs", *FRAGMENTS, written=(fragments,))
def renamed_fragment_pairs(d) -> str:
    return f"""SELECT a.unit_id AS a, b.unit_id AS b, a.raw = b.raw AS exact FROM fragments a JOIN (SELECT digest FROM fragments GROUP BY digest HAVING count(*) BETWEEN 2 AND {CAP}) k ON a.digest = k.digest
JOIN fragments b ON a.digest = b.digest AND a.unit_id < b.unit_id"""


@sql("renamed_groups", *FRAGMENTS)
def renamed_groups(d) -> str:
    return "SELECT digest, count(*) AS members, count(DISTINCT file_id) AS files, CASE WHEN count(DISTINCT raw) > 1 THEN 'type-2' ELSE 'type-1' END AS class, max(n) AS tokens FROM fragments GROUP BY digest HAVING count(*) > 1"


def windows(d) -> str:
    """Windows of three units of a file."""
    return """SELECT file_id, line_no, k, md5(h0 || h1 || h2) AS h FROM (SELECT file_id, line_no, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS k, md5(line) AS h0,
  lead(md5(line), 1) OVER (PARTITION BY file_id ORDER BY line_no) AS h1, lead(md5(line), 2) OVER (PARTITION BY file_id ORDER BY line_no) AS h2 FROM units) w WHERE h2 IS NOT NULL"""


def window_pairs(d) -> str:
    return """SELECT a.file_id AS a, b.file_id AS b, a.k AS pa, b.k AS pb, b.k - a.k AS shift FROM windows a JOIN (SELECT h FROM windows GROUP BY h HAVING count(*) BETWEEN 2 AND 256) c ON a.h = c.h
JOIN windows b ON a.h = b.h AND (a.file_id < b.file_id OR (a.file_id = b.file_id AND a.k < b.k))"""


WINDOWS = (units, windows, window_pairs)


@sql("window_seed_pairs", *WINDOWS)
def window_seed_pairs(d) -> str:
    return "SELECT a, b, count(*) AS windows, count(DISTINCT shift) AS shifts FROM window_pairs GROUP BY a, b"


def islands(d) -> str:
    """Maximal runs of windows on one diagonal: windows that touch merge."""
    return """SELECT a, b, shift, min(pa) AS start_a, max(pa) + 2 AS end_a, min(pb) AS start_b, max(pb) + 2 AS end_b, count(*) AS windows FROM (
  SELECT *, sum(brk) OVER (PARTITION BY a, b, shift ORDER BY pa) AS island FROM (
    SELECT *, CASE WHEN pa <= max(pa + 3) OVER (PARTITION BY a, b, shift ORDER BY pa ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk FROM window_pairs) x) y GROUP BY a, b, shift, island"""


@sql("fold_window_matches", *WINDOWS, islands)
def fold_window_matches(d) -> str:
    return "SELECT a, b, CAST(shift AS BIGINT) AS shift, CAST(start_a AS BIGINT) AS start_a, CAST(end_a AS BIGINT) AS end_a, windows FROM islands"


#: Tokens of a gram and grams of a winnowing window; places that a gram may have.
GRAM, WINDOW, PLACES = 20, 4, 64


def segments(d) -> str:
    """Tokens of derived programs with the number of the function that they lie in; function names alone begin with f and a digit."""
    return f"SELECT file_id, pos, tok, CAST(sum(CASE WHEN {d.matches('tok', '^f[0-9]+$')} THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos) AS BIGINT) AS seg FROM code_tokens"


def code_seeds(d) -> str:
    """Places of two files (or of one, apart) with an equal gram, which is the least of its window and which few places hold."""
    gram = " || ' ' || ".join(["tok"] + [f"lead(tok, {i}) OVER (PARTITION BY file_id, seg ORDER BY pos)" for i in range(1, GRAM)])
    over = f"(PARTITION BY file_id, seg ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)"
    prints = f"""SELECT DISTINCT file_id, w.x AS h, -w.y AS pos FROM (SELECT file_id, {d.least_pair("h", "-pos", over)} AS w, count(*) OVER {over} AS held, count(*) OVER (PARTITION BY file_id, seg) AS n FROM (
  SELECT file_id, seg, pos, {d.h60("gram")} AS h FROM (SELECT file_id, seg, pos, {gram} AS gram FROM segments) g WHERE gram IS NOT NULL) k) w WHERE held = {WINDOW} OR (n < {WINDOW} AND held = n)"""
    return f"""SELECT a.file_id AS a, b.file_id AS b, a.pos AS pa, b.pos AS pb FROM ({prints}) a JOIN (SELECT h FROM ({prints}) p GROUP BY h HAVING count(*) BETWEEN 2 AND {PLACES}) c ON a.h = c.h
JOIN ({prints}) b ON a.h = b.h AND (a.file_id < b.file_id OR (a.file_id = b.file_id AND a.pos + {GRAM} <= b.pos))"""


PROGRAMS = (code_lines, code_files, code_tokens, segments)


@register(
    "maximal_equal_runs",
    composed(
        {r.__name__: r(Duck()) for r in (*PROGRAMS, code_seeds)},
        # token by token: all equal tokens on the diagonals of seeds, islands of neighbours in one pair of segments, those that hold a seed
        """WITH equal AS (SELECT a, b, shift, x.pos AS pa, x.seg AS sa, y.seg AS sb FROM (SELECT DISTINCT a, b, pb - pa AS shift FROM code_seeds) s JOIN segments x ON x.file_id = a JOIN segments y ON y.file_id = b AND y.pos = x.pos + shift AND y.tok = x.tok),
islands AS (SELECT a, b, shift, min(pa) AS first_a, max(pa) AS last_a FROM (SELECT *, pa - row_number() OVER (PARTITION BY a, b, shift, sa, sb ORDER BY pa) AS island FROM equal) e GROUP BY a, b, shift, sa, sb, island)
SELECT DISTINCT i.a, i.b, first_a AS start_a, first_a + i.shift AS start_b, last_a - first_a + 1 AS length FROM islands i JOIN code_seeds s ON s.a = i.a AND s.b = i.b AND s.pb - s.pa = i.shift AND s.pa BETWEEN first_a AND last_a""",
    ),
)
def maximal_equal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of equal tokens, grown as far as both sides agree within their functions."""
    toks = cut(frame(spark, sf_dir, PROGRAMS, "SELECT * FROM segments"))
    toks.createOrReplaceTempView(view := f"mirrorlake_segments_{uuid.uuid4().hex[:8]}")
    found = cut(spark.sql(composed({"segments": f"SELECT * FROM {view}"}, code_seeds(Spark()))))
    spark.catalog.dropTempView(view)
    return runs.extend(runs.segmented(toks), found, GRAM)


COVERED = """SELECT * FROM islands i WHERE NOT EXISTS (SELECT 1 FROM islands o WHERE o.a = i.a AND o.b = i.b AND o.start_a <= i.start_a AND o.end_a >= i.end_a AND o.start_b <= i.start_b AND o.end_b >= i.end_b
  AND (o.end_a - o.start_a > i.end_a - i.start_a OR (o.end_a - o.start_a = i.end_a - i.start_a AND (o.shift < i.shift OR (o.shift = i.shift AND o.start_a < i.start_a)))))"""


ISLANDS = (*WINDOWS, islands)


def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that lie in no other one of their pair of files, by a sweep over each pair."""
    return runs.uncovered(frame(spark, sf_dir, ISLANDS, "SELECT a, b, CAST(shift AS BIGINT) AS shift, CAST(start_a AS BIGINT) AS start_a, CAST(end_a AS BIGINT) AS end_a, CAST(start_b AS BIGINT) AS start_b, CAST(end_b AS BIGINT) AS end_b FROM islands"))


def all_pairs(text: str) -> str:
    """An oracle that holds every run against every other one of its pair of files."""
    return composed({r.__name__: r(Duck()) for r in ISLANDS}, text)


@register("drop_contained_rects", all_pairs(f"SELECT a, b, CAST(shift AS BIGINT) AS shift, CAST(start_a AS BIGINT) AS start_a, CAST(end_a AS BIGINT) AS end_a FROM ({COVERED}) x"))
def drop_contained_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uncovered(spark, sf_dir).select("a", "b", "shift", "start_a", "end_a")


@register("fold_restated", all_pairs(f"SELECT a, b, count(*) AS kept, CAST(max(end_a - start_a) AS BIGINT) AS widest FROM ({COVERED}) x GROUP BY a, b"))
def fold_restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the runs of a pair of files the widest of those that cover one another stays."""
    return uncovered(spark, sf_dir).groupBy("a", "b").agg(F.count("*").alias("kept"), F.max(F.col("end_a") - F.col("start_a")).alias("widest"))


def _lift(pairs: str = "SELECT a, b FROM lsh_pairs WHERE estimate >= 0.3 UNION SELECT a, b FROM seed_pairs UNION SELECT a, b FROM window_pairs WHERE a < b") -> str:
    # distinct pairs of three sources; each counted once, by the first gate that drops it
    return f"""SELECT reason, count(*) AS pairs FROM (SELECT p.a, p.b, CASE WHEN x.source = y.source THEN 'nested' WHEN x.lang <> y.lang THEN 'alternatives' WHEN greatest(x.n_chars, y.n_chars) > 3 * least(x.n_chars, y.n_chars) THEN 'divergent' ELSE 'kept' END AS reason
FROM ({pairs}) p JOIN documents x ON p.a = x.doc_id JOIN documents y ON p.b = y.doc_id) r GROUP BY reason"""


@register("lift_pairs", told(lambda _: _lift(), *LSH, *SEEDS[1:], units, windows, window_pairs))
def lift_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of each source are made within the lists of its keys."""
    prints = winnow.fingerprints(frame(spark, sf_dir, (), "SELECT doc_id, text FROM documents"), K, W)
    lines = frame(spark, sf_dir, (units, windows), "SELECT file_id AS id, h FROM windows")
    pairs = winnow.sharing(prints.selectExpr("doc_id AS id", "h"), CAP).unionAll(winnow.sharing(lines, LIST_CAP))
    found = cut(close_pairs(spark, sf_dir, 0.3).select("a", "b").unionAll(pairs).distinct())
    return frame(spark, sf_dir, (), _lift("SELECT a, b FROM pairs_found"), given={"pairs_found": found})


@sql("subsumed_groups", exact_members, units, unit_groups)
def subsumed_groups(d) -> str:
    # groups of equal units all of whose members lie in files of one group of equal files
    return """SELECT u.gid AS inner_gid, m.gid AS outer_gid, count(DISTINCT u.unit_id) AS members FROM unit_groups u JOIN exact_members m ON u.file_id = m.doc_id GROUP BY u.gid, m.gid, u.sz HAVING count(DISTINCT u.unit_id) = u.sz"""


@sql("drop_subsumed_runs", exact_members, units, unit_groups)
def drop_subsumed_runs(d) -> str:
    return """SELECT gid, sz AS members FROM (SELECT DISTINCT gid, sz FROM unit_groups) g WHERE NOT EXISTS (SELECT 1 FROM (
  SELECT u.gid FROM unit_groups u JOIN exact_members m ON u.file_id = m.doc_id GROUP BY u.gid, m.gid, u.sz HAVING count(DISTINCT u.unit_id) = u.sz) s WHERE s.gid = g.gid)"""


@sql("contained_groups", units, unit_groups)
def contained_groups(d) -> str:
    # every member's file belongs to one wider group, one to one
    return """SELECT i.gid AS inner_gid, o.gid AS outer_gid FROM unit_groups i JOIN unit_groups o ON i.file_id = o.file_id AND o.gid <> i.gid AND o.extent > i.extent
GROUP BY i.gid, o.gid, i.sz, o.sz HAVING count(DISTINCT i.file_id) = i.sz AND count(DISTINCT i.unit_id) = i.sz AND count(*) = i.sz AND o.sz = i.sz"""


@sql("narrower_cut", units, unit_groups)
def narrower_cut(d) -> str:
    # for each group the widest other that shares a file with every occurrence; ties to the lesser id
    return """SELECT inner_gid, outer_gid FROM (SELECT i.gid AS inner_gid, o.gid AS outer_gid, row_number() OVER (PARTITION BY i.gid ORDER BY max(o.extent) DESC, o.gid) AS r
  FROM unit_groups i JOIN unit_groups o ON i.file_id = o.file_id AND o.gid <> i.gid AND o.extent > i.extent GROUP BY i.gid, o.gid, i.sz HAVING count(DISTINCT i.unit_id) = i.sz) x WHERE r = 1"""


@sql("reportable_regions", exact_members, units, unit_groups)
def reportable_regions(d) -> str:
    # a region folds into an exact group of its hosts, or if it covers more than half of one
    return """SELECT u.gid, CASE WHEN count(DISTINCT m.gid) = 1 AND count(m.doc_id) = count(*) THEN 'folded: hosts are copies' WHEN max(u.extent * 2 - d.n_chars) > 0 THEN 'folded: most of a host' ELSE 'reported' END AS outcome
FROM unit_groups u JOIN documents d ON u.file_id = d.doc_id LEFT JOIN exact_members m ON u.file_id = m.doc_id GROUP BY u.gid"""


def grouped(d) -> str:
    return "SELECT DISTINCT doc_id FROM exact_members"


#: Files with a bin of their size; two sizes within a ratio of 1.7 lie in one bin or in neighbouring ones.
SIZED = "SELECT doc_id, source, lang, n_chars, CAST(floor(ln(n_chars) / 0.53) AS BIGINT) AS bin FROM documents WHERE n_chars > 0"


def near_sizes(d) -> str:
    """The first file of every group three times, with the bins of the sizes near its own."""
    return f"SELECT gid, source, lang, n_chars, CAST(floor(ln(n_chars) / 0.53) AS BIGINT) + k AS near_bin FROM exact_members CROSS JOIN {d.series('-1', '1', 'k')} s WHERE rn = 1 AND n_chars > 0"


@sql("siblings_similarity", exact_members, grouped)
def siblings_similarity(d) -> str:
    # ungrouped files of a directory that holds a group member, near in size to the group's first; at most 8 a group
    return f"""SELECT gid, doc_id, score FROM (SELECT m.gid, d.doc_id, round(least(d.n_chars, m.n_chars) * 1e0 / greatest(d.n_chars, m.n_chars), 6) AS score,
  row_number() OVER (PARTITION BY m.gid ORDER BY least(d.n_chars, m.n_chars) * 1e0 / greatest(d.n_chars, m.n_chars) DESC, d.doc_id) AS r FROM ({near_sizes(d)}) m
  JOIN ({SIZED}) d ON m.source = d.source AND m.lang = d.lang AND m.near_bin = d.bin WHERE NOT EXISTS (SELECT 1 FROM grouped g WHERE g.doc_id = d.doc_id)
  AND least(d.n_chars, m.n_chars) * 10 >= 6 * greatest(d.n_chars, m.n_chars)) x WHERE r <= 8"""


SIGNATURE = "(SELECT *, count(*) OVER (PARTITION BY sig) AS sharing FROM (SELECT doc_id, source, lang || '/' || CAST(floor(n_chars / 10) AS BIGINT) AS sig FROM documents) a)"


@sql("siblings_signature", exact_members, grouped)
def siblings_signature(d) -> str:
    return f"""SELECT m.gid, s.doc_id, min(s.sharing) AS sharing FROM exact_members m JOIN {SIGNATURE} o ON m.doc_id = o.doc_id JOIN {SIGNATURE} s ON o.sig = s.sig AND o.source = s.source
WHERE s.sharing <= 8 AND NOT EXISTS (SELECT 1 FROM grouped g WHERE g.doc_id = s.doc_id) GROUP BY m.gid, s.doc_id"""


@sql("siblings_merged", exact_members, grouped)
def siblings_merged(d) -> str:
    return f"""SELECT coalesce(a.gid, b.gid) AS gid, coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NOT NULL THEN 'signature' ELSE 'similarity' END AS basis FROM (
  SELECT m.gid, d.doc_id FROM ({near_sizes(d)}) m JOIN ({SIZED}) d ON m.source = d.source AND m.lang = d.lang AND m.near_bin = d.bin WHERE NOT EXISTS (SELECT 1 FROM grouped g WHERE g.doc_id = d.doc_id) AND least(d.n_chars, m.n_chars) * 10 >= 8 * greatest(d.n_chars, m.n_chars)) a
FULL OUTER JOIN (SELECT DISTINCT m.gid, s.doc_id FROM exact_members m JOIN {SIGNATURE} o ON m.doc_id = o.doc_id JOIN {SIGNATURE} s ON o.sig = s.sig AND o.source = s.source
  WHERE s.sharing <= 8 AND NOT EXISTS (SELECT 1 FROM grouped g WHERE g.doc_id = s.doc_id)) b ON a.gid = b.gid AND a.doc_id = b.doc_id"""


@sql("ungrouped_units", exact_members)
def ungrouped_units(d) -> str:
    return "SELECT lang, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM exact_members m WHERE m.doc_id = d.doc_id) GROUP BY lang"


def _split_text(_) -> str:
    # near pairs whose ends share no group, folded by their contents
    return """SELECT least(x.h, y.h) AS h1, greatest(x.h, y.h) AS h2, count(*) AS pairs, round(min(p.estimate), 6) AS weakest FROM lsh_pairs p JOIN (SELECT doc_id, md5(text) AS h FROM documents) x ON p.a = x.doc_id
JOIN (SELECT doc_id, md5(text) AS h FROM documents) y ON p.b = y.doc_id LEFT JOIN exact_members g1 ON p.a = g1.doc_id LEFT JOIN exact_members g2 ON p.b = g2.doc_id
WHERE p.estimate >= 0.5 AND (g1.gid IS NULL OR g2.gid IS NULL OR g1.gid <> g2.gid) GROUP BY least(x.h, y.h), greatest(x.h, y.h)"""


@register("split_pairs", told(_split_text, exact_members, *LSH))
def split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, (exact_members,), _split_text(None), given={"lsh_pairs": close_pairs(spark, sf_dir, 0.5)})


@sql("cross_corpus_pairs")
def cross_corpus_pairs(d) -> str:
    return f"""SELECT l.doc_id, b.item_id, count(*) AS shared_lines FROM {d.lines("documents", "doc_id", "text")} l JOIN {d.lines("benchmark", "item_id", "text")} b ON md5(l.line) = md5(b.line) WHERE length(b.line) > 20 GROUP BY l.doc_id, b.item_id"""


@sql("cross_variant_groups")
def cross_variant_groups(d) -> str:
    return "SELECT lang, md5(text) AS h, count(*) AS n, count(DISTINCT source) AS variants FROM documents WHERE text IS NOT NULL GROUP BY lang, md5(text) HAVING count(DISTINCT source) >= 2"


@sql("unambiguous_match")
def unambiguous_match(d) -> str:
    return "SELECT part, supplier_key FROM (SELECT p_partkey AS part, s_suppkey AS supplier_key, count(*) OVER (PARTITION BY p_partkey) AS n FROM part JOIN supplier ON p_partkey % 97 = s_suppkey % 89 AND p_size = s_nationkey) x WHERE n = 1"


@sql("relocations_in_symbol")
def relocations_in_symbol(d) -> str:
    # a range of up to 50 lies in its start's bin of 64 and the next
    return f"""SELECT symbol, {d.joined(d.sorted_set("lpad(CAST(offset_at AS STRING), 8, '0')"))} AS offsets FROM (SELECT p_partkey AS symbol, o_orderkey AS offset_at FROM (SELECT p_partkey, p_size, CAST(floor(p_partkey * 37 / 64) AS BIGINT) + k AS bin FROM part CROSS JOIN {d.series("0", "1", "k")} s) p JOIN orders ON CAST(floor(o_orderkey / 64) AS BIGINT) = bin
  AND o_orderkey >= p_partkey * 37 AND o_orderkey < p_partkey * 37 + p_size) x GROUP BY symbol"""
