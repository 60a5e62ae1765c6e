"""Exact groups, their facts, noise, folds and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import growth, minhash
from ..operators.budget import admitted
from ..operators.graph import cut
from ..registry import register
from ..sources.code import CODE_TOKEN, WORDS, code_files, code_lines
from ..sources.relations import exact_members, tokens, unit_groups, units
from .fingerprinting import BANDS, LIST_CAP, LSH, SEEDS, signed
from .sql import frame, run, sql, told


@sql("exact_groups", exact_members)
def exact_groups(d) -> str:
    return "SELECT gid, count(*) AS members, count(DISTINCT source) AS directories, min(doc_id) AS canonical, max(n_chars) AS size FROM exact_members GROUP BY gid"


@sql("group_facts", exact_members)
def group_facts(d) -> str:
    return "SELECT gid, count(*) AS instances, min(n_chars) AS least, max(n_chars) AS most, count(DISTINCT doc_id) AS files, count(DISTINCT source) AS directories, count(DISTINCT lang) AS languages FROM exact_members GROUP BY gid"


@sql("duplicated_tokens", exact_members)
def duplicated_tokens(d) -> str:
    return "SELECT gid, CAST(sum(n_chars) - max(CASE WHEN rn = 1 THEN n_chars END) AS BIGINT) AS duplicated FROM exact_members GROUP BY gid"


@sql("dominant_category", exact_members)
def dominant_category(d) -> str:
    return "SELECT gid, source AS category FROM (SELECT gid, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY gid) AS total, row_number() OVER (PARTITION BY gid ORDER BY count(*) DESC, source DESC) AS r FROM exact_members GROUP BY gid, source) c WHERE r = 1 AND n * 5 >= total * 4"


@sql("language_counts")
def language_counts(d) -> str:
    return "SELECT lang AS language, count(*) AS files FROM documents GROUP BY lang"


def _funnel(candidates: str = "lsh_pairs") -> str:
    return f"""SELECT 1 AS stage, 'signed' AS name, count(DISTINCT doc_id) AS passed FROM minhashes UNION ALL SELECT 2, 'candidates', count(*) FROM {candidates}
UNION ALL SELECT 3, 'gate', count(*) FROM lsh_pairs WHERE estimate >= 0.3 UNION ALL SELECT 4, 'strong', count(*) FROM lsh_pairs WHERE estimate >= 0.7"""


@register("funnel_counts", told(lambda _: _funnel(), *LSH))
def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates are counted; signatures are compared for those that can pass the gate."""
    files = signed(spark, sf_dir)
    pairs = minhash.candidates(files, BANDS, LIST_CAP, SEEDS, 0.3, every=True)
    return frame(spark, sf_dir, (), _funnel("candidates"), given={"minhashes": files, "candidates": pairs, "lsh_pairs": cut(minhash.estimates(pairs, files, SEEDS, 0.3))})


@sql("truncation_share", units, unit_groups)
def truncation_share(d) -> str:
    return "SELECT count_if(sz > 3) AS skipped, count(*) AS examined, round(count_if(sz > 3) * 1e0 / count(*), 6) AS share FROM unit_groups"


@sql("identifier_jaccard", exact_members, units)
def identifier_jaccard(d) -> str:
    # the weakest likeness of a directory's files to its first, over sets of lines
    return f"""WITH s AS (SELECT d.source, d.doc_id, {d.sorted_set("u.line")} AS names FROM documents d JOIN units u ON d.doc_id = u.file_id GROUP BY d.source, d.doc_id),
c AS (SELECT source, names FROM (SELECT source, names, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM s) x WHERE r = 1)
SELECT s.source, round(max(CASE WHEN {d.either("s.names", "c.names")} = 0 THEN NULL ELSE {d.common("s.names", "c.names")} * 1e0 / {d.either("s.names", "c.names")} END), 6) AS strongest, count(*) AS members FROM s JOIN c ON s.source = c.source GROUP BY s.source"""


@sql("multiset_agreement", tokens)
def multiset_agreement(d) -> str:
    # of each file with the next: what their token counts share over what either has
    return """SELECT a AS doc_id, round(CAST(sum(least(na, nb)) AS DOUBLE) / sum(greatest(na, nb)), 6) AS agreement FROM (
  SELECT coalesce(x.a, y.a) AS a, coalesce(x.n, 0) AS na, coalesce(y.n, 0) AS nb FROM (SELECT doc_id AS a, tok, count(*) AS n FROM tokens GROUP BY doc_id, tok) x
  FULL OUTER JOIN (SELECT doc_id - 1 AS a, tok, count(*) AS n FROM tokens GROUP BY doc_id, tok) y ON x.a = y.a AND x.tok = y.tok) z WHERE a >= 0 GROUP BY a"""


@sql("collapse_exact")
def collapse_exact(d) -> str:
    return "SELECT l_orderkey, count(*) AS records, count(DISTINCT l_returnflag || l_linestatus) = 1 AS collapses FROM lineitem GROUP BY l_orderkey"


@sql("fold_by_content", units, unit_groups)
def fold_by_content(d) -> str:
    return f"SELECT gid, {d.size(d.sorted_set('file_id'))} AS files, {d.joined(d.sorted_set("lpad(CAST(file_id AS STRING), 8, '0')"))} AS sites FROM unit_groups GROUP BY gid"


@sql("admissible_members")
def admissible_members(d) -> str:
    # greedy: in order of start, a member is kept if it begins at or after the end of the last kept; a fold over one file's members
    kept = d.fold(d.sorted_pairs("p_partkey % 1000", "p_partkey % 1000 + p_size"), "0", "0", "x.a >= acc.b", "acc.a + 1", "x.b")
    return f"SELECT file, f.a AS kept, f.b AS upto FROM (SELECT p_brand AS file, {kept} AS f FROM part GROUP BY p_brand) k"


@sql("confirm_regions", units, unit_groups)
def confirm_regions(d) -> str:
    return "SELECT lower(line) AS form, count(*) AS occurrences, CASE WHEN count(DISTINCT line) = 1 THEN 'type-1' ELSE 'type-2' END AS class FROM units WHERE extent >= 20 GROUP BY lower(line) HAVING count(*) > 1"


def code_text(d) -> str:
    """Lines of derived programs with their tokens."""
    return f"SELECT file_id, line_no AS k, regexp_extract_all(line, '{CODE_TOKEN.replace(chr(92), chr(92) * 2)}', 0) AS toks FROM {d.lines('code_files', 'file_id', 'content')} l"


@register("grow_runs")
def grow_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed runs of lines of derived programs that continue each other at all of their places, confirmed as a whole."""
    lines = cut(frame(spark, sf_dir, (code_lines, code_files, code_text), "SELECT * FROM code_text"))
    words = tuple(WORDS.split())
    return growth.grow(lines, cut(growth.windows(lines, words=words)), words=words)


@sql("medoid_sample")
def medoid_sample(d) -> str:
    # of a label's vectors 8 evenly spaced ones
    return """SELECT DISTINCT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings) e
CROSS JOIN (SELECT r_regionkey AS k FROM region UNION ALL SELECT r_regionkey + 5 FROM region) s WHERE k < 8 AND i = CAST(floor(k * (n - 1) / 7) AS BIGINT)"""


COMPONENTS = "SELECT md5(text) AS gid, count(*) AS n, min(doc_id) AS root FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) >= 2"
UNITS_OF_WORK = 60


@register(
    "component_budget",
    f"""WITH RECURSIVE c AS ({COMPONENTS}), o AS (SELECT *, row_number() OVER (ORDER BY root) AS k FROM c),
f(k, gid, n, taken, used) AS (SELECT CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), false, CAST(0 AS BIGINT) UNION ALL SELECT o.k, o.gid, o.n, f.used + o.n <= {UNITS_OF_WORK}, CASE WHEN f.used + o.n <= {UNITS_OF_WORK} THEN f.used + o.n ELSE f.used END FROM f JOIN o ON o.k = f.k + 1)
SELECT gid, n, taken FROM f WHERE k > 0""",
)
def component_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components in the order of their roots are taken while they fit; one that doesn't is skipped, and later ones may still fit."""
    found = cut(run(spark, sf_dir, COMPONENTS))
    taken = admitted(found.select(F.col("root").alias("place"), F.col("n").alias("size")), UNITS_OF_WORK)
    return found.join(F.broadcast(taken), found.root == taken.place, "left").select("gid", "n", F.col("place").isNotNull().alias("taken"))
