"""Ignore files and manifests against a walk from the root, directory by directory."""

import random
import re

import pytest

from mirrorlake.sources import discovery

RNG = random.Random(21)


def fits(pattern, elements):
    """A pattern's elements against a path's, by recursion; ** stands for any number."""
    if not pattern:
        return not elements
    if pattern[0] == "**":
        if len(pattern) == 1:
            return len(elements) > 0
        return any(fits(pattern[1:], elements[k:]) for k in range(len(elements) + 1))
    return bool(elements) and one(pattern[0], elements[0]) and fits(pattern[1:], elements[1:])


def one(p, s):
    if not p:
        return not s
    if p[0] == "*":
        return any(one(p[1:], s[k:]) for k in range(len(s) + 1))
    if p[0] == "?":
        return bool(s) and one(p[1:], s[1:])
    if p[0] == "[" and "]" in p[2:]:
        end = p.index("]", 2)
        inside, no = (p[2:end], True) if p[1] == "!" else (p[1:end], False)
        ranges = [(m[0][0], m[0][-1]) for m in re.finditer(r".-.|.", inside)]
        return bool(s) and any(a <= s[0] <= b for a, b in ranges) != no and one(p[end + 1 :], s[1:])
    if p[0] == "\\" and len(p) > 1:
        p = p[1:]
    return bool(s) and p[0] == s[0] and one(p[1:], s[1:])


def verdict(lines, rest, is_dir):
    """True for ignored, False for taken back, None for nothing said; the last line counts."""
    for line in reversed(lines):
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line[1:] if line[:1] == "!" or line[:2] in ("\\#", "\\!") else line
        if line.endswith("/") and not is_dir:
            continue
        line = line.rstrip("/")
        if not line.strip("/"):
            continue
        anchored, pattern = "/" in line, [e for e in line.split("/") if e]
        elements = rest.split("/")
        if fits(pattern, elements) if anchored else one(pattern[0], elements[-1]):
            return not back
    return None


def walk(paths, ignores):
    out = {}
    for path in paths:
        parts = path.split("/")
        for n in range(1, len(parts) + 1):
            entry, said = "/".join(parts[:n]), None
            for k in range(n):
                directory = "/".join(parts[:k])
                for name in (".gitignore", ".ignore"):
                    found = verdict(ignores.get((directory, name), []), entry[len(directory) + 1 if directory else 0 :], n < len(parts))
                    said = said if found is None else found
            if said or (said is None and parts[n - 1].startswith(".")):
                out[path] = "ignored" if said else "hidden"
                break
    return out


LINES = ["*.rs", "!a.rs", "a/", "/b", "b/c", "**/c/d.rs", "a/**", "!b/", "c*/", "[a-c].rs", "[!a-b]", "?.c", "#a", "\\#a", "\\!b", "a/*/d.rs", "**", "!**/d.rs", "d.rs  ", "", "/", "a/**/d.rs", "!.e", ".e/"]
NAMES = ["a", "b", "c", "d", ".e"]
FILES = ["a.rs", "b.rs", "d.rs", "x.c", "#a", "!b", ".h.rs"]


def test_patterns_equal_a_walk(spark):
    for _ in range(3):
        paths = sorted({"/".join([RNG.choice(NAMES) for _ in range(RNG.randint(0, 4))] + [RNG.choice(FILES)]) for _ in range(400)})
        ignores = {}
        for _ in range(RNG.randint(4, 9)):
            at = "/".join(RNG.choice(paths).split("/")[:-1][: RNG.randint(0, 2)])
            ignores[at, RNG.choice([".gitignore", ".ignore"])] = RNG.choices(LINES, k=RNG.randint(1, 4))
        files = [(f"{d}/{n}" if d else n, "\n".join(lines)) for (d, n), lines in ignores.items()]
        stated = discovery.ignore_patterns(spark.createDataFrame(files, "path string, content string"))
        got = {r.path: r.reason for r in discovery.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), stated).collect()}
        assert got == walk(paths, ignores)


@pytest.fixture(scope="module")
def tree(spark):
    big = b"fn f() {}\n" * 300_000
    rows = [
        ("Cargo.toml", b"[workspace]\nmembers = ['in']\n"), ("src/lib.rs", b"fn a() {}"), ("in/Cargo.toml", b"[package]\nname = 'inner'\n[lib]\npath = 'code/l.rs'\n[[bin]]\nname = 't'\npath = 'tools/t.rs'\n"),
        ("in/src/main.rs", b"fn main() {}"), ("in/src/x.rs", b"x"), ("in/tests/t.rs", b"t"), ("in/build.rs", b"b"), ("in/code/l.rs", b"l"), ("in/tools/t.rs", b"t"), ("in/deep/Cargo.toml", b"[package]\nname = 'deep'"), ("in/deep/src/bin/z.rs", b"z"),
        ("in/bad/Cargo.toml", b"not toml ["), ("in/bad/src/y.rs", b"y"), ("gen/p.rs", b"// @generated\n"), ("gen/q.rs", b"\n" * 12 + b"// @generated\n"), ("bin/n.c", b"a\0b"), ("bin/far.c", b"a" * 9000 + b"\0"), ("big.rs", big), ("notes.md", b"# n"),
        ("none.c", None), ("link.rs", b"l"), (".gitignore", b"out/\n"), ("out/k.rs", b"k"), (".h/k.rs", b"k"), ("odd\xff.h".encode("latin1").decode("latin1"), b"\xff\xfe"),
    ]
    return spark.createDataFrame([(p, len(c or b""), bytearray(c) if c is not None else None, p == "link.rs", "clash") for p, c in rows], "path string, size long, content binary, link boolean, language string")


def test_reasons_and_packages(tree):
    got = {r.path: r for r in discovery.discover(tree, languages=("rust", "cpp")).collect()}
    dropped = {p: r.dropped for p, r in got.items() if r.dropped}
    assert dropped == {"Cargo.toml": "metadata", "in/Cargo.toml": "metadata", "in/deep/Cargo.toml": "metadata", "in/bad/Cargo.toml": "metadata", ".gitignore": "metadata", "gen/p.rs": "generated", "bin/n.c": "unselected", "bin/far.c": "unselected", "none.c": "unselected", "big.rs": "oversized", "notes.md": "language", "link.rs": "symlink", "out/k.rs": "ignored", ".h/k.rs": "hidden"}
    owner = {p: (r.package, r.target) for p, r in got.items()}
    assert owner["src/lib.rs"] == (None, "unknown") and owner["in/src/main.rs"] == ("inner", "binary") and owner["in/src/x.rs"] == ("inner", "library") and owner["in/tests/t.rs"] == ("inner", "test")
    assert owner["in/build.rs"] == ("inner", "build-script") and owner["in/code/l.rs"] == ("inner", "library") and owner["in/tools/t.rs"] == ("inner", "binary") and owner["in/deep/src/bin/z.rs"] == ("deep", "binary") and owner["in/bad/src/y.rs"] == ("inner", "unknown")
    every = {r.path: r.dropped for r in discovery.discover(tree, hidden=True).collect()}
    assert every["bin/n.c"] == "binary" and every["bin/far.c"] is None and every["none.c"] == "unreadable" and every[".h/k.rs"] is None
    counts = {r.dropped: r.files for r in discovery.drop_counts(discovery.discover(tree)).collect()}
    assert sum(counts.values()) == tree.count() and counts["metadata"] == 5 and counts["binary"] == 1


def test_without_broadcast_and_without_files(spark, tree, monkeypatch):
    want = sorted(map(repr, discovery.discover(tree).collect()))
    monkeypatch.setattr(discovery, "MOST_BROADCAST", -1)
    assert sorted(map(repr, discovery.discover(tree).collect())) == want
    assert discovery.discover(tree.limit(0)).collect() == []
