"""Nested ignore files against a plain walk."""

import random
import re

import pytest

from sparkloom.operators import ignore


def match_segments(pattern, path):
    if not pattern:
        return not path
    if pattern[0] == "**":
        return any(match_segments(pattern[1:], path[k:]) for k in range(len(path) + 1))
    return bool(path) and glob(pattern[0], path[0]) and match_segments(pattern[1:], path[1:])


def glob(p, s):
    if not p:
        return not s
    if p[0] == "*":
        return any(glob(p[1:], s[k:]) for k in range(len(s) + 1))
    if not s:
        return False
    if p[0] == "?":
        return glob(p[1:], s[1:])
    if p[0] == "[":
        end = p.index("]", 2)
        inner, no = (p[2:end], True) if p[1] == "^" else (p[1:end], False)
        hit = bool(re.match(f"[{re.escape(inner).replace(chr(92) + '-', '-')}]", s[0]))
        return hit != no and glob(p[end + 1 :], s[1:])
    if p[0] == "\\":
        return p[1] == s[0] and glob(p[2:], s[1:])
    return p[0] == s[0] and glob(p[1:], s[1:])


def plain(files, path, is_dir):
    """Folder by folder from the top; the deepest file's last matching line counts."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        node, folder = "/".join(parts[:n]), is_dir or n < len(parts)
        verdict = folder and parts[n - 1] == ".git"
        state = False
        for k in range(n):
            scope = "/".join(parts[:k])
            rest = parts[k:n]
            for line in files.get(scope, "").split("\n"):
                line = line.rstrip("\r")
                line = line[:-2] + " " if line.endswith("\\ ") else line.rstrip(" ")
                if not line or line[0] == "#":
                    continue
                negated = line[0] == "!"
                line = line[1:] if negated else line
                line = line[1:] if line[:2] in ("\\#", "\\!") else line
                only = line.endswith("/")
                line = line[:-1] if only else line
                anchored = line.startswith("/")
                line = line[1:] if anchored else line
                if not line or only and not folder:
                    continue
                bare = "/" not in line and not anchored
                if any(glob(line, s) for s in rest) if bare else match_segments(line.split("/"), rest):
                    state = not negated
        if state or verdict:
            return True
        assert node
    return False


def test_against_a_walk(spark):
    rng = random.Random(11)
    names = ["a", "b", "c.py", "d.txt", "x1", ".git", "#h", "!b", "sp "]
    paths = {("/".join(rng.choice(names) for _ in range(rng.randint(1, 5))), rng.random() < 0.2) for _ in range(250)}
    paths = sorted({p: d for p, d in paths}.items())
    patterns = ["a", "*.py", "/b", "b/", "a/**", "**/x1", "a/**/b", "!a", "!*.py", "?1", "[ab]", "[^ab]", "# a", "\\#h", "\\!b", "", "  ", "sp\\ ", "x1  ", "/", "a//b", "**", "/**", "!/a/b/", "c.p[x-z]", "*", "!*/", "**/", "a/*/c.py", "d\\.txt", "**/**/b", "a/**/**"]
    for _ in range(4):
        files = {s: "\n".join(rng.choice(patterns) + rng.choice(["", "", "\r"]) for _ in range(rng.randint(0, 5))) for s in ["", "a", "b", "a/b", "a/a", "x1/a"]}
        got = ignore.ignored(spark.createDataFrame(paths, "path string, is_dir boolean"), spark.createDataFrame(list(files.items()), "scope string, text string")).collect()
        assert len(got) == len(paths)
        for r in got:
            assert r["ignored"] == plain(files, r["path"], dict(paths)[r["path"]]), (r, files)


def test_bad_patterns_and_nothing(spark):
    paths = spark.createDataFrame([("a", False)], "path string, is_dir boolean")
    with pytest.raises(Exception, match="line 2"):
        ignore.ignored(paths, spark.createDataFrame([("", "x\n[a")], "scope string, text string")).collect()
    none = spark.createDataFrame([], "scope string, text string")
    assert [r["ignored"] for r in ignore.ignored(paths, none).collect()] == [False]
    assert ignore.ignored(paths.limit(0), none).count() == 0
