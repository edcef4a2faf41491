"""The tree source over a temporary folder."""

import os

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import tree


@pytest.fixture
def root(tmp_path):
    for path in ("a/b/c/d.txt", "a/b/e.py", "a/f", "g/h", "é/ö.txt", "top"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
    (tmp_path / "empty").mkdir()
    os.symlink("a", tmp_path / "loop")
    os.symlink("../..", tmp_path / "a/b/up")
    os.symlink("nowhere", tmp_path / "g/broken")
    os.mkfifo(tmp_path / "g/pipe")
    return tmp_path


def plain(root):
    out = {}
    for folder, folders, names in os.walk(root):
        for n in folders + names:
            path = os.path.join(folder, n)
            s = os.lstat(path)
            kind = "link" if os.path.islink(path) else "folder" if os.path.isdir(path) else "file" if os.path.isfile(path) else "other"
            out[os.path.relpath(path, root)] = (kind, s.st_size if kind == "file" else None, os.readlink(path) if kind == "link" else None, s.st_mode & 0o7777, int(s.st_mtime))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_all_entries(spark, root, partitions):
    rows = tree.walk(spark, str(root), partitions=partitions).collect()
    got = {r["path"]: (r["kind"], r["size"], r["target"], r["mode"], int(r["modified"].timestamp())) for r in rows}
    assert got == plain(root) and len(rows) == len(got)
    assert all(r["depth"] == r["path"].count("/") + 1 and r["parent"] == os.path.dirname(r["path"]) and r["name"] == os.path.basename(r["path"]) and r["error"] is None for r in rows)


def test_bounds_and_filters(spark, root):
    want = plain(root)
    depth = lambda p: p.count("/") + 1
    walk = tree.walk(spark, f"file://{root}")
    assert {r["path"] for r in walk.where("depth <= 2 and kind = 'file'").collect()} == {p for p, v in want.items() if depth(p) <= 2 and v[0] == "file"}
    assert {r["path"] for r in walk.where("depth = 3").collect()} == {p for p in want if depth(p) == 3}
    assert {r["path"] for r in walk.where("depth > 2").select("path").collect()} == {p for p in want if depth(p) > 2}
    assert {r["path"] for r in tree.walk(spark, str(root), maxDepth=1).collect()} == {p for p in want if depth(p) == 1}
    assert {r["path"] for r in tree.walk(spark, str(root), kind="link", maxDepth=2).collect()} == {p for p, v in want.items() if depth(p) <= 2 and v[0] == "link"}
    assert len(tree.TreeReader({"path": str(root), "maxdepth": "1"}).partitions()) == 1
    order = [r["path"] for r in tree.in_walk_order(walk).orderBy("place").collect()]
    assert order == sorted(want, key=lambda p: p.split("/"))
    gone = tree.walk(spark, str(root / "none")).collect()
    assert len(gone) == 1 and gone[0]["error"]
    assert tree.walk(spark, str(root / "empty")).agg(F.count(F.lit(1))).first()[0] == 0
