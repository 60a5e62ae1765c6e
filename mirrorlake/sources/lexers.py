"""Error-tolerant lexers of Rust, C and C++ and the detection of units, as vectorised functions over a column of sources."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

TOKEN_FIELDS = "array<struct<kind:string,text:string,pos:int,line:int>>"

# The languages' keywords.
KEYWORDS = {
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while",
}
KEYWORDS["cpp"] = KEYWORDS["c"] + " bool catch class constexpr delete explicit export false friend mutable namespace new noexcept nullptr operator override private protected public template this throw true try typename using virtual"
_SETS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}

_RUST_LITERALS = r"""r(?P<hashes>#*)"[\s\S]*?"(?P=hashes)|b?"(?:\\.|[^"\\])*"?|b?'(?:\\(?:u\{[0-9a-fA-F]*\}|x[0-9a-fA-F]{2}|.)|[^'\\\n])'"""
_C_LITERALS = r"""(?:u8|[LuU])?R"(?P<tag>[^()\\\s]{0,16})\([\s\S]*?\)(?P=tag)"|(?:u8|[LuU])?"(?:\\[\s\S]|[^"\\\n])*"?|[LuU]?'(?:\\.|[^'\\\n])+'"""
_NUMBER = r"0[xX][0-9a-fA-F_']+\w*|0[bB][01_']+\w*|\d[\d_']*(?:\.\d[\d_']*)?(?:[eE][+-]?\d+)?\w*"
_PUNCT = r"::|->|=>|\.\.=?|<<=?|>>=?|&&|\|\||[-+*/%^&|=!<>]=|\+\+|--|##|[^\sA-Za-z0-9_]"


def _pattern(literals: str, lifetimes: bool, directives: bool) -> re.Pattern[str]:
    parts = [
        r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))",
        r"(?P<directive>(?m:^)[ \t]*#(?:\\\n|[^\n])*)" if directives else None,
        f"(?P<literal>{literals})",
        r"(?P<lifetime>'[A-Za-z_]\w*)" if lifetimes else None,
        f"(?P<number>{_NUMBER})",
        r"(?P<ident>[^\W\d]\w*)",
        f"(?P<punct>{_PUNCT})",
    ]
    return re.compile("|".join(p for p in parts if p))


_PATTERNS = {"rust": _pattern(_RUST_LITERALS, True, False), "c": _pattern(_C_LITERALS, False, True)}
_PATTERNS["cpp"] = _PATTERNS["c"]
_TRIGRAPHS = {"??=": "#", "??/": "\\", "??'": "^", "??(": "[", "??)": "]", "??!": "|", "??<": "{", "??>": "}", "??-": "~"}


def lex(source: str, language: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, offset, line) of the tokens; comments and white space are gone, what fits nothing is a one-character punct."""
    if language != "rust" and "??" in source:
        source = re.sub(r"\?\?[=/'()!<>-]", lambda m: _TRIGRAPHS[m[0]], source)
    out, line, at = [], 1, 0
    for m in _PATTERNS[language].finditer(source):
        line += source.count("\n", at, m.start())
        at = m.start()
        kind = m.lastgroup if m.lastgroup in ("comment", "directive", "literal", "lifetime", "number", "ident", "punct") else next(k for k in ("comment", "directive", "literal", "lifetime", "number", "ident", "punct") if m.groupdict().get(k) is not None)
        if kind == "comment":
            continue
        text = m[0]
        if kind == "ident" and text in _SETS[language]:
            kind = "keyword"
        out.append((kind, text.strip() if kind == "directive" else text, m.start(), line))
    return out


def units(tokens: list[tuple[str, str, int, int]], language: str) -> list[tuple[str, str, int, int, int, int]]:
    """(kind, name, first token, past the last, first line, last line) of functions, blocks of implementation and records, nested ones too."""
    close: dict[int, int] = {}
    stack: list[int] = []
    for i, (_, text, _, _) in enumerate(tokens):
        if text == "{":
            stack.append(i)
        elif text == "}" and stack:
            close[stack.pop()] = i
    out = []
    bodies: list[int] = []  # ends of the function bodies around, the innermost last
    for i, (kind, text, _, line) in enumerate(tokens):
        while bodies and i >= bodies[-1]:
            bodies.pop()
        if text == "{" and i in close and _is_body(tokens, i):
            bodies.append(close[i])
        if kind != "keyword" and not (language != "rust" and text == "("):
            continue
        found = None
        if language == "rust" and text in ("fn", "impl", "struct", "enum", "trait"):
            name = next((t[1] for t in tokens[i + 1 : i + 12] if t[0] == "ident"), "")
            found = ("function" if text == "fn" else "impl" if text == "impl" else "record", name, i)
        elif language != "rust" and text in ("struct", "class", "union", "enum"):
            found = ("record", tokens[i + 1][1] if i + 1 < len(tokens) and tokens[i + 1][0] == "ident" else "", i)
        elif text == "(" and i and tokens[i - 1][0] == "ident" and not bodies:
            found = ("function", tokens[i - 1][1], i - 1)
        if found:
            depth = 0
            for j in range(i, len(tokens)):
                t = tokens[j][1]
                depth += (t in "([") - (t in ")]") if len(t) == 1 else 0
                if t == ";" and depth <= 0:
                    break
                if t == "{" and depth <= 0:
                    if j in close:
                        out.append((found[0], found[1], found[2], close[j] + 1, tokens[found[2]][3], tokens[close[j]][3]))
                    break
    return out


def _is_body(tokens: list[tuple[str, str, int, int]], brace: int) -> bool:
    return brace > 0 and tokens[brace - 1][1] in (")", "const", "noexcept", "override")


def tokens_of(files: DataFrame) -> DataFrame:
    """``files``: file_id, language, content.  Adds the column tokens; rows of other languages get an empty list."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[{"kind": k, "text": t, "pos": p, "line": n} for k, t, p, n in lex(c or "", g)] if g in _PATTERNS else [] for c, g in zip(batch["content"], batch["language"], strict=True)]
            yield pd.DataFrame({"file_id": batch["file_id"], "language": batch["language"], "tokens": rows})

    return files.select("file_id", "language", "content").mapInPandas(work, f"file_id long, language string, tokens {TOKEN_FIELDS}")


def units_of(files: DataFrame) -> DataFrame:
    """``files``: file_id, language, content.  One row for every unit."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, *u) for f, c, g in zip(batch["file_id"], batch["content"], batch["language"], strict=True) if g in _PATTERNS for u in units(lex(c or "", g), g)]
            yield pd.DataFrame(rows, columns=["file_id", "kind", "name", "first_token", "end_token", "first_line", "last_line"])

    return files.select("file_id", "language", "content").mapInPandas(work, "file_id long, kind string, name string, first_token int, end_token int, first_line int, last_line int")
