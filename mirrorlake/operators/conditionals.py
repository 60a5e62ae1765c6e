"""Which arms of preprocessor conditionals a row lies in, whether two rows can be in one build, and what predicates can evaluate to.

Arms are a stack that opens and closes along a file's rows.  It is held as what each level says last: depths are sums that never
fall below zero, a conditional is the stretch between an opening and its mate on one level, and a row's path has the latest arm of
every level that is open there.  All of it is windows by file; no row is walked.

Predicates are evaluated by one fold over their tokens, with a stack of (operator, possible values): bit 1 for "can be false", bit 2 for
"can be true".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE = "PARTITION BY file_id ORDER BY pos"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def arm_paths(rows: DataFrame) -> DataFrame:
    """(file_id, pos, path) of the rows that are no directives.

    ``rows``: file_id, pos, directive ("if", "elif", "else", "endif" or null), condition ("true", "false" or "unknown"; null counts as the last), fault (whether
    the parser stumbled there).  A path is the conditionals around, outermost first: conditional (pos of its first directive), arm (from 0), believed,
    reachable.  A conditional that isn't closed, or that encloses a fault, isn't believed, and its arms are all taken for the first.  An arm isn't reachable
    if its condition is false or an arm before it was surely taken.  Directives with nothing open mean nothing.
    """
    t = rows.select("file_id", "pos", "directive", "condition", "fault").repartition("file_id")
    t = t.selectExpr("*", "CASE directive WHEN 'if' THEN 1 WHEN 'endif' THEN -1 ELSE 0 END AS step", f"sum(CASE WHEN fault THEN 1 ELSE 0 END) OVER ({FILE}) AS faults")
    t = t.selectExpr("*", f"sum(step) OVER ({FILE}) AS run").selectExpr("*", f"run - least(0, min(run) OVER ({FILE})) AS depth")
    t = t.selectExpr("*", f"CASE WHEN step = -1 THEN coalesce(lag(depth) OVER ({FILE}), 0) ELSE depth END AS level")
    # on a level an opening is followed by its arms and its end
    level = "PARTITION BY file_id, level ORDER BY pos"
    told = t.selectExpr("*", f"last_value(CASE WHEN step = 1 THEN pos END) IGNORE NULLS OVER ({level}) AS conditional")
    one = "PARTITION BY file_id, level, conditional"
    told = told.selectExpr(
        "*",
        f"CAST(sum(CASE WHEN directive IS NULL THEN 0 ELSE 1 END) OVER ({one} ORDER BY pos) - 1 AS INT) AS arm",
        f"coalesce(max(CASE WHEN step = -1 THEN 1 ELSE 0 END) OVER ({one}), 0) = 1 AND max(CASE WHEN step = -1 THEN faults END) OVER ({one}) = max(CASE WHEN step = 1 THEN faults END) OVER ({one}) AS believed",
        f"coalesce(max(CASE WHEN condition = 'true' THEN 1 ELSE 0 END) OVER ({one} ORDER BY pos {BEFORE}), 0) = 0 AND coalesce(condition, '') <> 'false' AS reached",
    ).selectExpr("*", f"first_value(CASE WHEN step = 1 THEN reached END) IGNORE NULLS OVER ({one} ORDER BY pos) AS first_reached")
    # a directive says what its level is from there on, every other row asks all levels that are open; level 0 stands for none
    said = "struct(conditional, CASE WHEN believed THEN arm ELSE 0 END AS arm, believed, CASE WHEN believed THEN reached ELSE first_reached END AS reachable)"
    both = told.selectExpr("file_id", "pos", "directive IS NULL AS asks", f"CASE WHEN directive IS NOT NULL THEN {said} END AS said", "explode(CASE WHEN directive IS NULL AND depth > 0 THEN sequence(1L, depth) WHEN directive IS NULL THEN array(0L) WHEN step >= 0 AND level > 0 THEN array(CAST(level AS BIGINT)) END) AS level")
    seen = both.selectExpr("*", f"last_value(said) IGNORE NULLS OVER ({level} {BEFORE}) AS held").where("asks")
    # an open level always has an arm before the row; level 0 stands for none
    return seen.groupBy("file_id", "pos").agg(F.expr("transform(array_sort(collect_list(CASE WHEN level > 0 THEN struct(level, held) END)), x -> x.held)").alias("path"))


def excludes(a: str, b: str) -> str:
    """Whether two paths first differ in the arm of one conditional that is believed."""
    return f"coalesce(get(filter(zip_with({a}, {b}, (x, y) -> CASE WHEN x <> y THEN x.believed AND y.believed AND x.conditional = y.conditional END), z -> z IS NOT NULL), 0), false)"


def unreachable(path: str) -> str:
    return f"exists({path}, x -> NOT x.reachable)"


def coexist(a: str, b: str) -> str:
    """Whether one build can hold both: neither in an arm that none takes, and no shared conditional between them."""
    return f"NOT {unreachable(a)} AND NOT {unreachable(b)} AND NOT {excludes(a, b)}"


#: Tokens of a predicate: a word, a quoted text, or one character.
PREDICATE_TOKEN = r'[A-Za-z_][A-Za-z0-9_]*|"[^"]*"|\S'
FALSE, TRUE, BOTH = 1, 2, 3


def predicate_values(predicate: str, test_enabled: bool) -> str:
    """What a predicate over all, any, not, test and other words can evaluate to: FALSE, TRUE, BOTH as bits; null for null.

    ``test`` has the given value, any other word and any unknown function can be either.  An empty argument can be either too.  A bracket that
    isn't closed leaves the whole undecided.
    """
    test = TRUE if test_enabled else FALSE
    top = "element_at(s.stack, -1)"
    value = f"coalesce(s.v, {BOTH})"
    joined = f"CASE {top}.op WHEN 'all' THEN ({top}.v & {value} & 2) | (({top}.v | {value}) & 1) WHEN 'any' THEN (({top}.v | {value}) & 2) | ({top}.v & {value} & 1) WHEN 'not' THEN {value} ELSE {BOTH} END"
    rest = "slice(s.stack, 1, size(s.stack) - 1)"
    state = "array<struct<op:string,v:int>>"
    make = lambda stack, v, word: f"named_struct('stack', {stack}, 'v', CAST({v} AS INT), 'word', {word})"
    # a word sets the value of the argument until a bracket opens it up or it ends; what follows a closed bracket changes nothing
    word = f"CASE WHEN s.word = ')' THEN s WHEN t RLIKE '^[A-Za-z_]' THEN {make('s.stack', f'CASE WHEN t = {chr(39)}test{chr(39)} THEN {test} ELSE {BOTH} END', 't')} ELSE s END"
    opened = f"concat(s.stack, array(named_struct('op', s.word, 'v', CASE s.word WHEN 'all' THEN {TRUE} WHEN 'any' THEN {FALSE} ELSE {BOTH} END)))"
    swapped = f"CASE WHEN {top}.op = 'not' THEN shiftleft(({joined}) & 1, 1) | shiftright(({joined}) & 2, 1) ELSE {joined} END"
    step = f"""CASE WHEN t = '(' THEN {make(opened, 'NULL', "''")} WHEN t = ')' AND size(s.stack) > 0 THEN {make(rest, swapped, "')'")}
      WHEN t = ',' AND size(s.stack) > 0 THEN {make(f"concat({rest}, array(named_struct('op', {top}.op, 'v', CAST({joined} AS INT))))", 'NULL', "''")} ELSE {word} END"""
    pattern = PREDICATE_TOKEN.replace("\\", "\\\\")
    start = make(f"CAST(array() AS {state})", "NULL", "''")
    return f"""CASE WHEN {predicate} IS NOT NULL THEN aggregate(regexp_extract_all({predicate}, '{pattern}', 0), {start}, (s, t) -> {step}, s -> CASE WHEN size(s.stack) > 0 THEN {BOTH} ELSE coalesce(s.v, {BOTH}) END) END"""
