"""Expressions that Spark and the oracle engine spell differently, so that a query has one text for both."""

from __future__ import annotations

TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]"


class Spark:
    name = "spark"

    def h60(self, x: str) -> str:
        """The first 60 bits of md5 as an integer: a key on which both engines agree."""
        return f"CAST(conv(substr(md5({x}), 1, 15), 16, 10) AS BIGINT)"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def sorted_set(self, x: str) -> str:
        return f"array_sort(collect_set({x}))"

    def sorted_list(self, x: str) -> str:
        return f"array_sort(collect_list({x}))"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def joined(self, a: str, sep: str = ",") -> str:
        return f"array_join({a}, '{sep}')"

    def lines(self, table: str, key: str, text: str) -> str:
        return f"(SELECT {key}, CAST(line_no AS BIGINT) AS line_no, line FROM {table} LATERAL VIEW posexplode(split({text}, '\\n')) x AS line_no, line)"

    def joined_by(self, x: str, order: str, sep: str) -> str:
        """Values of a group end to end, in the order of another column."""
        return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {x} AS x))), e -> e.x), {sep})"

    def tokens(self, table: str, keys: str, text: str, pattern: str = TOKEN) -> str:
        pattern = pattern.replace("\\", "\\\\")
        return f"(SELECT {keys}, CAST(pos AS BIGINT) AS pos, tok FROM {table} LATERAL VIEW posexplode(regexp_extract_all({text}, '{pattern}', 0)) x AS pos, tok)"

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(items)})"

    def unnested(self, table: str, keys: str, array: str, place: str, value: str) -> str:
        """Elements of an array with their places from 1 on."""
        return f"(SELECT {keys}, CAST({place} + 1 AS BIGINT) AS {place}, {value} FROM {table} LATERAL VIEW posexplode({array}) x AS {place}, {value})"

    def sorted_pairs(self, a: str, b: str) -> str:
        """All pairs of a group as sorted structs of a and b."""
        return f"array_sort(collect_list(struct(CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b)))"

    def fold(self, pairs: str, a: str, b: str, when: str, then_a: str, then_b: str) -> str:
        """A fold over pairs x in their order: what is held (acc, a pair too) changes where ``when`` holds."""
        return f"aggregate({pairs}, struct(CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b), (acc, x) -> CASE WHEN {when} THEN struct({then_a} AS a, {then_b} AS b) ELSE acc END)"

    def least_pair(self, x: str, y: str, over: str) -> str:
        """The least pair of a window as a struct of x and y."""
        return f"min(struct({x} AS x, {y} AS y)) OVER {over}"

    def head_lines(self, x: str, n: int) -> str:
        return f"substring_index({x}, '\\n', {n})"

    def series(self, lo: str, hi: str, name: str) -> str:
        return f"(SELECT CAST({name} AS BIGINT) AS {name} FROM (SELECT explode(sequence({lo}, {hi})) AS {name}))"

    def pieces(self, text: str, sep: str) -> str:
        return f"split({text}, '{sep}')"

    def part(self, a: str, k: int) -> str:
        return f"get({a}, {k - 1})"

    def matches(self, x: str, pattern: str) -> str:
        p = pattern.replace("\\", "\\\\")
        return f"({x} RLIKE '{p}')"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        p = pattern.replace("\\", "\\\\")
        return f"regexp_extract({x}, '{p}', {group})"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def epoch(self, x: str) -> str:
        return f"unix_micros({x})"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, v) -> s + v)"

    def l1(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> abs(CAST(x AS DOUBLE) - CAST(y AS DOUBLE))), CAST(0 AS DOUBLE), (s, v) -> s + v)"

    def common(self, a: str, b: str) -> str:
        return f"CAST(size(array_intersect({a}, {b})) AS BIGINT)"

    def either(self, a: str, b: str) -> str:
        return f"CAST(size(array_union({a}, {b})) AS BIGINT)"

    def equal_places(self, a: str, b: str) -> str:
        return f"CAST(size(filter(zip_with({a}, {b}, (x, y) -> x = y), e -> coalesce(e, false))) AS BIGINT)"

    def hexed(self, x: str) -> str:
        return f"lower(hex(encode({x}, 'UTF-8')))"

    def six(self, x: str) -> str:
        return f"format_string('%.6f', CAST({x} AS DOUBLE))"

    def to_json(self, *pairs: tuple[str, str]) -> str:
        return "to_json(struct(" + ", ".join(f"{v} AS {k}" for k, v in pairs) + "))"


class Duck:
    name = "duck"

    def h60(self, x: str) -> str:
        return f"CAST(('0x' || substr(md5({x}), 1, 15)) AS BIGINT)"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def sorted_set(self, x: str) -> str:
        return f"list_sort(list(DISTINCT {x}) FILTER (WHERE {x} IS NOT NULL))"

    def sorted_list(self, x: str) -> str:
        return f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))"

    def size(self, a: str) -> str:
        return f"CAST(len({a}) AS BIGINT)"

    def joined(self, a: str, sep: str = ",") -> str:
        return f"array_to_string({a}, '{sep}')"

    def lines(self, table: str, key: str, text: str) -> str:
        return f"(SELECT {key}, CAST(line_no - 1 AS BIGINT) AS line_no, parts[line_no] AS line FROM (SELECT {key}, parts, unnest(range(1, len(parts) + 1)) AS line_no FROM (SELECT {key}, string_split({text}, chr(10)) AS parts FROM {table})))"

    def joined_by(self, x: str, order: str, sep: str) -> str:
        return f"string_agg({x}, {sep} ORDER BY {order})"

    def tokens(self, table: str, keys: str, text: str, pattern: str = TOKEN) -> str:
        return f"(SELECT {keys}, CAST(pos - 1 AS BIGINT) AS pos, parts[pos] AS tok FROM (SELECT {keys}, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT {keys}, regexp_extract_all({text}, '{pattern}') AS parts FROM {table})))"

    def array(self, items: list[str]) -> str:
        return f"[{', '.join(items)}]"

    def unnested(self, table: str, keys: str, array: str, place: str, value: str) -> str:
        return f"(SELECT {keys}, CAST({place} AS BIGINT) AS {place}, held[{place}] AS {value} FROM (SELECT {keys}, held, unnest(range(1, len(held) + 1)) AS {place} FROM (SELECT {keys}, {array} AS held FROM {table})))"

    def sorted_pairs(self, a: str, b: str) -> str:
        return f"list_sort(list({{'a': CAST({a} AS BIGINT), 'b': CAST({b} AS BIGINT)}}))"

    def fold(self, pairs: str, a: str, b: str, when: str, then_a: str, then_b: str) -> str:
        first = f"{{'a': CAST({a} AS BIGINT), 'b': CAST({b} AS BIGINT)}}"
        return f"list_reduce([{first}] || {pairs}, lambda acc, x: CASE WHEN {when} THEN {{'a': {then_a}, 'b': {then_b}}} ELSE acc END)"

    def least_pair(self, x: str, y: str, over: str) -> str:
        return f"min(struct_pack(x := {x}, y := {y})) OVER {over}"

    def head_lines(self, x: str, n: int) -> str:
        return f"array_to_string(string_split({x}, chr(10))[1:{n}], chr(10))"

    def series(self, lo: str, hi: str, name: str) -> str:
        return f"(SELECT CAST({name} AS BIGINT) AS {name} FROM (SELECT unnest(range({lo}, {hi} + 1)) AS {name}))"

    def pieces(self, text: str, sep: str) -> str:
        return f"string_split({text}, '{sep}')"

    def part(self, a: str, k: int) -> str:
        return f"({a})[{k}]"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def epoch(self, x: str) -> str:
        return f"epoch_us({x})"

    def dot(self, a: str, b: str) -> str:
        return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS DOUBLE)"

    def l1(self, a: str, b: str) -> str:
        return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS DOUBLE)"

    def common(self, a: str, b: str) -> str:
        return f"CAST(len(list_intersect({a}, {b})) AS BIGINT)"

    def either(self, a: str, b: str) -> str:
        return f"CAST(len(list_distinct(list_concat({a}, {b}))) AS BIGINT)"

    def equal_places(self, a: str, b: str) -> str:
        return f"CAST(len(list_filter(list_zip({a}, {b}), lambda p: coalesce(p[1] = p[2], false))) AS BIGINT)"

    def hexed(self, x: str) -> str:
        return f"lower(hex(encode({x})))"

    def six(self, x: str) -> str:
        return f"printf('%.6f', CAST({x} AS DOUBLE))"

    def to_json(self, *pairs: tuple[str, str]) -> str:
        return "CAST(to_json({" + ", ".join(f"'{k}': {v}" for k, v in pairs) + "}) AS VARCHAR)"
