"""K-grams, winnowing, posting lists, signatures and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import minhash
from ..operators.graph import cut
from ..registry import register
from ..sources.relations import MOST_LINES, K, exact_members, fingerprints, kgrams, postings, tokens, unit_groups, unit_tokens, units
from .sql import frame, sql, told

CAP, BUDGET = 64, 1_000_000


@sql("kgram_hashes", tokens, kgrams)
def kgram_hashes(d) -> str:
    return "SELECT doc_id, count(*) AS n, count(DISTINCT h) AS n_distinct, min(h) AS least, max(h) AS most FROM kgrams GROUP BY doc_id"


@sql("winnow_fingerprints", tokens, kgrams, fingerprints)
def winnow_fingerprints(d) -> str:
    return "SELECT doc_id, pos, h FROM fingerprints"


@sql("posting_stats", tokens, kgrams, fingerprints, postings)
def posting_stats(d) -> str:
    return f"""SELECT count(*) AS hashes, count_if(n > {CAP}) AS dropped_hashes, CAST(sum(CASE WHEN n > {CAP} THEN n ELSE 0 END) AS BIGINT) AS dropped_postings, CAST(sum(n) AS BIGINT) AS postings, max(n) AS longest FROM postings"""


@sql("pairs_available", tokens, kgrams, fingerprints, postings)
def pairs_available(d) -> str:
    return f"SELECT n AS list_length, count(*) AS lists, CAST(sum(CAST(floor(n * (n - 1) / 2) AS BIGINT)) AS BIGINT) AS pairs FROM postings WHERE n BETWEEN 2 AND {CAP} GROUP BY n"


@sql("rarest_first_budget", tokens, kgrams, fingerprints, postings)
def rarest_first_budget(d) -> str:
    # lists by length and key: admitted while their pairs, added up, fit the budget
    # lists of one length cost the same, so how many of them still fit follows from what the shorter ones cost (a row a length)
    return f"""SELECT n AS list_length, admitted, lists - admitted AS cut FROM (SELECT n, lists, CAST(least(lists, greatest(0, floor(({BUDGET} - (upto - lists * pairs)) * 1e0 / pairs))) AS BIGINT) AS admitted FROM (
  SELECT n, lists, pairs, CAST(sum(lists * pairs) OVER (ORDER BY n) AS BIGINT) AS upto FROM (SELECT n, count(*) AS lists, CAST(floor(n * (n - 1) / 2) AS BIGINT) AS pairs FROM postings WHERE n BETWEEN 2 AND {CAP} GROUP BY n) l) c) x"""


@sql("token_hash", tokens)
def token_hash(d) -> str:
    return f"SELECT doc_id, min({d.h60('tok')}) AS least, max({d.h60('tok')}) AS most, count(DISTINCT {d.h60('tok')}) AS n FROM tokens GROUP BY doc_id"


@sql("unit_fingerprint", units)
def unit_fingerprint(d) -> str:
    # length prefixes and a domain tag keep different field splits apart
    return f"SELECT unit_id, substr({d.sha(chr(39) + 'unit:' + chr(39) + ' || length(line) || ' + chr(39) + ':' + chr(39) + ' || line')}, 1, 32) AS fingerprint FROM units"


@sql("statement_windows", units)
def statement_windows(d) -> str:
    def window(n: int) -> str:
        text = " || '|' || ".join(["md5(line)"] + [f"lead(md5(line), {i}) OVER (PARTITION BY file_id ORDER BY line_no)" for i in range(1, n)])
        return f"SELECT file_id, line_no, {n} AS width, {text} AS body FROM units"

    return f"SELECT width, count(*) AS n, count(DISTINCT md5(body)) AS n_distinct FROM ({window(4)} UNION ALL {window(8)} UNION ALL {window(16)}) w WHERE body IS NOT NULL GROUP BY width"


@sql("occurrence_ranks", units, unit_groups)
def occurrence_ranks(d) -> str:
    # numbered within bins of 1,000 files, after the sizes of the bins before; a class has a row a bin
    bins = f"SELECT *, CAST(floor(unit_id / {1000 * MOST_LINES}) AS BIGINT) AS bin FROM unit_groups"
    return f"""SELECT unit_id, b.gid, CAST(ahead + row_number() OVER (PARTITION BY b.gid, b.bin ORDER BY unit_id) - 1 AS BIGINT) AS occurrence FROM ({bins}) b
JOIN (SELECT gid, bin, sum(n) OVER (PARTITION BY gid ORDER BY bin) - n AS ahead FROM (SELECT gid, bin, count(*) AS n FROM ({bins}) x GROUP BY gid, bin) y) s ON b.gid = s.gid AND b.bin = s.bin"""


@sql("content_entropy", tokens)
def content_entropy(d) -> str:
    return """SELECT doc_id, round(-sum(n * 1e0 / total * log2(n * 1e0 / total)), 4) AS entropy FROM (
  SELECT doc_id, tok, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM tokens GROUP BY doc_id, tok) c GROUP BY doc_id"""


@sql("noise_flags", tokens)
def noise_flags(d) -> str:
    return """SELECT doc_id, CASE WHEN top > 16 AND top * 3 > total THEN 'high-frequency' WHEN total > 1 AND entropy / log2(CAST(total AS DOUBLE)) < 0.6 THEN 'low-entropy' ELSE 'none' END AS flag FROM (
  SELECT doc_id, max(n) AS top, max(total) AS total, -sum(n * 1e0 / total * log2(n * 1e0 / total)) AS entropy FROM (
    SELECT doc_id, tok, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM tokens GROUP BY doc_id, tok) c GROUP BY doc_id) x"""


def shingles(d) -> str:
    """Word pairs of a file as integers."""
    return f"SELECT DISTINCT doc_id, {d.h60('gram')} % 2147483647 AS x FROM (SELECT doc_id, tok || ' ' || lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS gram FROM tokens WHERE kind = 'ident') g WHERE gram IS NOT NULL"


#: Seeds of the permutations x -> (a x + b) mod (2**31 - 1), made by rule.
SEEDS, BANDS = 128, 64
#: Files that a band, or units that a skeleton, may be held by.
LIST_CAP = 256


def minhashes(d) -> str:
    """The least value of each permutation, side by side in one aggregate."""
    values = [f"min(({(s * 1103515245 + 12345) % 2147483647} * (x % 65536) + {(s * 69069 + 1) % 2147483647} + x) % 2147483647)" for s in range(1, SEEDS + 1)]
    return f"SELECT doc_id, {d.array(values)} AS sig FROM shingles GROUP BY doc_id"


@sql("minhash_signatures", tokens, shingles, minhashes)
def minhash_signatures(d) -> str:
    return f"SELECT doc_id, seed, v FROM {d.unnested('minhashes', 'doc_id', 'sig', 'seed', 'v')} u"


def bands(d) -> str:
    """Two values a band: the first with the next."""
    pairs = d.array([f"{d.part('sig', 2 * k + 1)} || '-' || {d.part('sig', 2 * k + 2)}" for k in range(BANDS)])
    return f"SELECT doc_id, band, v FROM {d.unnested('minhashes', 'doc_id', pairs, 'band', 'v')} u"


def band_sizes(d) -> str:
    return "SELECT band, v, count(*) AS held FROM bands GROUP BY band, v"


def lsh_pairs(d) -> str:
    """Distinct pairs that share a band whose list isn't over the cap, with the share of equal values."""
    return f"""SELECT p.a, p.b, {d.equal_places("x.sig", "y.sig")} * 1e0 / {SEEDS} AS estimate FROM (
  SELECT DISTINCT l.doc_id AS a, r.doc_id AS b FROM bands l JOIN band_sizes z ON l.band = z.band AND l.v = z.v AND z.held BETWEEN 2 AND {LIST_CAP}
  JOIN bands r ON l.band = r.band AND l.v = r.v AND l.doc_id < r.doc_id) p JOIN minhashes x ON x.doc_id = p.a JOIN minhashes y ON y.doc_id = p.b"""


LSH = (tokens, shingles, minhashes, bands, band_sizes, lsh_pairs)


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``minhashes``, made where the texts are read."""
    return minhash.signatures(frame(spark, sf_dir, (), "SELECT doc_id, text FROM documents"), SEEDS)


def close_pairs(spark: SparkSession, sf_dir: str, floor: float) -> DataFrame:
    """``lsh_pairs`` with an estimate of at least ``floor``, written: the others are dropped within their lists, before they are moved."""
    files = signed(spark, sf_dir)
    return cut(minhash.estimates(minhash.candidates(files, BANDS, LIST_CAP, SEEDS, floor), files, SEEDS, floor))


def _lsh_pairs_text(_) -> str:
    return "SELECT a, b, round(estimate, 6) AS estimate FROM lsh_pairs WHERE estimate >= 0.3"


@register("minhash_lsh_pairs", told(_lsh_pairs_text, *LSH))
def minhash_lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, (), _lsh_pairs_text(None), given={"lsh_pairs": close_pairs(spark, sf_dir, 0.3)})


@sql("estimated_jaccard", *LSH, written=(minhashes,))
def estimated_jaccard(d) -> str:
    return "SELECT round(estimate, 6) AS estimate, count(*) AS pairs FROM lsh_pairs GROUP BY 1"


@sql("near_miss_band", *LSH, written=(minhashes,))
def near_miss_band(d) -> str:
    return "SELECT a, b, round(estimate, 6) AS estimate FROM lsh_pairs WHERE estimate >= 0.2 AND estimate < 0.3 ORDER BY a, b LIMIT 1000"


@sql("signed_cap", units)
def signed_cap(d) -> str:
    return "SELECT unit_id, extent FROM units WHERE extent >= 40 ORDER BY extent DESC, unit_id LIMIT 100000"


@sql("group_fingerprint", exact_members)
def group_fingerprint(d) -> str:
    return f"SELECT gid, {d.sha(d.joined('members'))} AS fingerprint FROM (SELECT gid, {d.sorted_set('CAST(doc_id AS STRING)')} AS members FROM exact_members GROUP BY gid) g"


@sql("hex_render", exact_members)
def hex_render(d) -> str:
    return f"SELECT doc_id, {d.hexed('source')} AS hexed FROM exact_members"


@sql("settings_digest")
def settings_digest(d) -> str:
    return f"SELECT s_suppkey, {d.sha(chr(39) + 'balance=' + chr(39) + ' || ' + d.six('s_acctbal') + ' || chr(10) || ' + chr(39) + 'nation=' + chr(39) + ' || s_nationkey')} AS digest FROM supplier"


@sql("kgram_window_width", tokens, kgrams)
def kgram_window_width(d) -> str:
    return f"SELECT CAST({K} AS BIGINT) AS k, count(*) AS n FROM kgrams"


@sql("unit_token_hashes", units, unit_tokens)
def unit_token_hashes(d) -> str:
    return f"SELECT file_id, count(DISTINCT {d.h60('tok')}) AS n FROM unit_tokens GROUP BY file_id"
