"""Operation sequences, rules as data, windows, edges and confidences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import Duck
from ..operators import semantic
from ..operators.graph import cut
from ..registry import register
from .sql import composed, frame, sql


def ops(d) -> str:
    """Operations of a unit in order: a user's events of a day."""
    return "SELECT user_id * 100 + CAST(substr(CAST(ts AS STRING), 9, 2) AS BIGINT) AS unit, user_id, event_type AS op, value, row_number() OVER (PARTITION BY user_id, substr(CAST(ts AS STRING), 9, 2) ORDER BY ts, event_id) AS k FROM events"


def sequences(d) -> str:
    return f"SELECT unit, max(user_id) AS user_id, count(*) AS n, {d.joined(d.sorted_list("lpad(CAST(k AS STRING), 4, '0') || op"))} AS keyed FROM ops GROUP BY unit"


@sql("op_sequence_pairs", ops, sequences)
def op_sequence_pairs(d) -> str:
    return "SELECT a.unit AS a, b.unit AS b FROM sequences a JOIN (SELECT keyed FROM sequences WHERE n >= 2 GROUP BY keyed HAVING count(*) BETWEEN 2 AND 64) k ON a.keyed = k.keyed JOIN sequences b ON a.keyed = b.keyed AND a.unit < b.unit"


API = "(SELECT 'click' AS name, 'read' AS op_kind UNION ALL SELECT 'view', 'read' UNION ALL SELECT 'purchase', 'write' UNION ALL SELECT 'signup', 'acquire' UNION ALL SELECT 'logout', 'release')"


@sql("api_correspondence")
def api_correspondence(d) -> str:
    return f"SELECT event_type, coalesce(m.op_kind, 'none') AS op_kind, count(*) AS n FROM events e LEFT JOIN {API} m ON e.event_type = m.name GROUP BY event_type, coalesce(m.op_kind, 'none')"


@sql("api_normalize", ops)
def api_normalize(d) -> str:
    return f"SELECT unit, count(m.op_kind) AS registered, count(*) - count(m.op_kind) AS excluded, round(count(m.op_kind) * 1e0 / count(*), 6) AS coverage FROM ops o LEFT JOIN {API} m ON o.op = m.name GROUP BY unit"


def operations(d) -> str:
    """Operations with what is known of them: kinds by the event, tags by the event's property (unknown ones are null), language and variant by the user."""
    kinds = ["source", "filter", "map", "reduce", "collect", "map", "propagate_error", "validate", "acquire_resource", "release_resource", "io", "map"]
    pick = lambda words, by: f"CASE {by} " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(words) if w) + " END"
    apis = ["rust::ToString::to_string", "rust::str::parse", "std::to_string", "std::stoull"]
    return f"""SELECT unit, k, CASE WHEN user_id % 2 = 0 THEN 'rust' ELSE 'cpp' END AS language, CASE WHEN user_id % 3 = 0 THEN 'debug' ELSE 'release' END AS variant, {pick(kinds, "h % 12")} AS kind,
  {pick(["text", "number", "", "text"], "CAST(floor(h / 12) AS BIGINT) % 4")} AS type_tag, {pick(["result", "option", ""], "CAST(floor(h / 48) AS BIGINT) % 3")} AS fallible,
  {pick(["result_adapter", "option_adapter", ""], "CAST(floor(h / 144) AS BIGINT) % 3")} AS direct, {pick(["file", "lock"], "CAST(floor(h / 432) AS BIGINT) % 2")} AS resource,
  CASE WHEN h % 12 IN (2, 5, 11) THEN {pick(apis, "CASE WHEN h % 12 = 2 THEN 0 WHEN h % 12 = 5 THEN 1 ELSE 2 + CAST(floor(h / 864) AS BIGINT) % 2 END")} END AS api
FROM (SELECT unit, user_id, CAST(k AS BIGINT) AS k, {d.h60("op || CAST(CAST(floor(value) AS BIGINT) AS STRING)")} AS h FROM ops) o"""


FIRST = "kind = 'map' AND api = '{}' AND next_kind = 'map' AND next_api = '{}'"
#: The rules again for the oracle, by what stands beside an operation.
BESIDE = [
    ("rust-serialization-round-trip-v1", FIRST.format("rust::ToString::to_string", "rust::str::parse"), 1),
    ("cpp-serialization-round-trip-v1", FIRST.format("std::to_string", "std::stoull"), 1),
    ("result-direct-propagation-v1", "kind = 'propagate_error' AND fallible = 'result' AND direct = 'result_adapter'", 0),
    ("option-direct-propagation-v1", "kind = 'propagate_error' AND fallible = 'option' AND direct = 'option_adapter'", 0),
    ("optional-validation-v1", "kind = 'validate' AND fallible = 'option'", 0),
    ("result-validation-v1", "kind = 'validate' AND fallible = 'result'", 0),
    ("resource-lifecycle-v1", "kind = 'acquire_resource' AND next_kind = 'release_resource' AND next_resource = resource", 1),
]


@register(
    "semantic_rules",
    composed(
        {"ops": ops(Duck()), "operations": operations(Duck())},
        f"""WITH beside AS (SELECT *, row_number() OVER w - 1 AS place, lead(kind) OVER w AS next_kind, lead(api) OVER w AS next_api, lead(resource) OVER w AS next_resource FROM operations WINDOW w AS (PARTITION BY unit ORDER BY k)),
runs AS (SELECT a.unit, a.place AS first, min(b.place) - 1 AS last FROM (SELECT *, lag(kind) OVER (PARTITION BY unit ORDER BY k) AS last_kind FROM beside) a JOIN (SELECT unit, place, kind FROM beside UNION ALL SELECT unit, max(place) + 1, 'end' FROM beside GROUP BY unit) b
  ON a.unit = b.unit AND b.place > a.place AND b.kind NOT IN ('source', 'filter', 'map', 'reduce', 'collect') WHERE a.kind IN ('source', 'filter', 'map', 'reduce', 'collect') AND coalesce(a.last_kind, '') NOT IN ('source', 'filter', 'map', 'reduce', 'collect') GROUP BY a.unit, a.place)
SELECT unit, 'sequence-pipeline-v1' AS rule, first, last FROM runs r WHERE last > first AND EXISTS (SELECT 1 FROM beside b WHERE b.unit = r.unit AND b.place BETWEEN first AND last AND b.kind <> 'map') """
        + " ".join(f"UNION ALL SELECT unit, '{name}', place, place + {more} FROM beside WHERE {when}" for name, when, more in BESIDE),
    ),
)
def semantic_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the operations of a unit match a rule; a place may match several."""
    return semantic.spans(frame(spark, sf_dir, (ops, operations), "SELECT * FROM operations"))


@register("semantic_groups")
def semantic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of compatible spans under each rule."""
    found = cut(frame(spark, sf_dir, (ops, operations), "SELECT * FROM operations"))
    made, _ = semantic.groups(cut(semantic.classes(found, semantic.spans(found))))
    return made.drop("group_id")


@sql("semantic_windows", ops)
def semantic_windows(d) -> str:
    # maximal runs of permitted kinds
    return """SELECT unit, CAST(min(k) AS BIGINT) AS first_k, count(*) AS run_length FROM (SELECT unit, k, k - row_number() OVER (PARTITION BY unit ORDER BY k) AS island FROM ops WHERE op IN ('view', 'click')) x GROUP BY unit, island HAVING count(*) >= 2"""


CONFIDENCE = "least(1e0, 0.9e0 * coverage * CASE WHEN first_op IS NULL OR last_op IS NULL THEN 1e0 WHEN first_op = last_op THEN 1.05e0 ELSE 0.85e0 END)"


def unit_facts(d) -> str:
    return f"""SELECT unit, max(user_id) AS user_id, count(m.op_kind) * 1e0 / count(*) AS coverage, max(CASE WHEN k = 1 THEN op END) AS first_op, max(CASE WHEN k = n THEN op END) AS last_op FROM (SELECT *, count(*) OVER (PARTITION BY unit) AS n FROM ops) o LEFT JOIN {API} m ON o.op = m.name GROUP BY unit"""


@sql("semantic_confidence", ops, unit_facts)
def semantic_confidence(d) -> str:
    return f"SELECT unit, round({CONFIDENCE}, 6) AS confidence FROM unit_facts"


@sql("semantic_group_confidence", ops, unit_facts)
def semantic_group_confidence(d) -> str:
    return f"SELECT user_id, round(min({CONFIDENCE}), 6) AS confidence, round(min(coverage), 6) AS coverage FROM unit_facts GROUP BY user_id"


@sql("window_edge_shape", ops)
def window_edge_shape(d) -> str:
    # edges with both ends inside a window of five, by kind
    return """SELECT w, count_if(op = 'view' AND nxt = 'click') AS view_click, count_if(op = 'click' AND nxt = 'view') AS click_view, count_if(op = nxt) AS same, count(*) AS edges FROM (
  SELECT unit || '-' || CAST(floor((k - 1) / 5) AS BIGINT) AS w, op, lead(op) OVER (PARTITION BY unit, CAST(floor((k - 1) / 5) AS BIGINT) ORDER BY k) AS nxt FROM ops) x WHERE nxt IS NOT NULL GROUP BY w"""


@sql("edge_validation")
def edge_validation(d) -> str:
    return """SELECT 'out of range' AS fault, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey) UNION ALL
SELECT 'duplicate', count(*) FROM (SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1) x UNION ALL SELECT 'dangling order', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)"""


@sql("operation_edges", ops)
def operation_edges(d) -> str:
    return "SELECT op, nxt, count(*) AS n FROM (SELECT op, lead(op) OVER (PARTITION BY unit ORDER BY k) AS nxt FROM ops) x WHERE nxt IS NOT NULL GROUP BY op, nxt"
