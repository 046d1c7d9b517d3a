"""Listing a tree by Spark finds what the walk in one process finds."""

import os
import re

import pytest

from tidemark.engine import scan
from tidemark.functions import text
from tidemark.plans.model import scratch_folder
from tidemark.sources.discovery import Selection, discover_files, graph_tables, readable
from tidemark.sources.tree import list_tree, local_path, read_tree, write_tree

NAMES = ("a.ts", "b.d.ts", "c.min.js", "d.txt", "src/e.tsx", "src/x/y/z/f.cjs", "src/dist/g.ts", "node_modules/m/h.js", "src/node_modules/i.js", ".cache/j.js", "vendor/k.js", "it's [odd] é/l.mjs", "gone/.hidden.ts", "src/upper.TS")


def tree(tmp_path):
    for name in NAMES:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty").mkdir()
    (tmp_path / "folder.ts").mkdir()
    os.symlink(tmp_path / "a.ts", tmp_path / "link.ts")
    os.symlink(tmp_path / "src", tmp_path / "linked")
    os.symlink(tmp_path, tmp_path / "src" / "loop")
    with open(os.fsencode(tmp_path) + b"/bad\xff.ts", "w"):
        pass
    return str(tmp_path)


def both(spark, root, include=None, exclude=None):
    paths, said = discover_files(root, include, exclude)
    paths, unread = readable(paths)
    base = root if os.path.isdir(root) else os.path.dirname(root)
    near = sorted(os.path.relpath(p, base) for p in paths), sorted((d["file"], d["message"]) for d in said + unread)
    files, errors = list_tree(spark, root, Selection.of(include, exclude))
    far = sorted(r[0] for r in files.collect()), sorted((os.path.join(base, r["file"]) if r["file"] else base, r["message"]) for r in errors.collect())
    assert near == far
    return near


def test_same_as_walk(spark, tmp_path):
    files, said = both(spark, tree(tmp_path))
    assert files == [".ts".join(("a", "")), "gone/.hidden.ts", "it's [odd] é/l.mjs", "src/e.tsx", "src/x/y/z/f.cjs"]
    assert [m for _, m in said] == ["its name isn't UTF-8"]


@pytest.mark.parametrize("include, exclude", [(["src/**"], None), (None, ["src"]), (["**/*.ts"], ["gone"]), (["none/**"], None)])
def test_patterns(spark, tmp_path, include, exclude):
    both(spark, tree(tmp_path), include, exclude)


def test_roots(spark, tmp_path):
    (tmp_path / "one.txt").write_text("x")
    (tmp_path / "void").mkdir()
    assert both(spark, str(tmp_path / "one.txt")) == (["one.txt"], [])
    assert both(spark, str(tmp_path / "void")) == ([], [])
    assert both(spark, str(tmp_path / "nowhere"))[1][0][1].startswith("no such file or folder")
    assert scan(str(tmp_path / "void"), spark, distributed=True)["stats"]["files_scanned"] == 0
    assert [d["level"] for d in scan(str(tmp_path / "nowhere"), spark, distributed=True)["diagnostics"]] == ["error"]


def test_excluded_folders_are_not_entered(tmp_path, monkeypatch):
    root, entered, real = tree(tmp_path), [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda folder: entered.append(os.path.relpath(folder, root)) or real(folder))
    discover_files(root)
    assert not {"node_modules", "node_modules/m", ".cache", "vendor", "linked", "src/loop"} & set(entered) and "src/x/y/z" in entered


def test_a_wide_folder_leaves_in_batches(spark, tmp_path):
    for k in range(10_050):
        (tmp_path / f"f{k}.ts").touch()
    files, _ = list_tree(spark, str(tmp_path))
    assert files.count() == files.distinct().count() == 10_050


def test_gone_after_listing(spark, tmp_path):
    (tmp_path / "here.ts").write_bytes(b"const x = 1;\n\xff")
    files = spark.createDataFrame([("here.ts",), ("gone.ts",)], "relative_path string")
    rows = {r["relative_path"]: r for r in read_tree(files, str(tmp_path)).collect()}
    assert bytes(rows["here.ts"]["content"]) == b"const x = 1;\n\xff" and rows["here.ts"]["unread"] is None
    assert rows["gone.ts"]["content"] is None and rows["gone.ts"]["unread"].startswith("can't read")
    graph, _, diagnostics = graph_tables(read_tree(files, str(tmp_path)))
    assert sorted(r["file"] for r in diagnostics.where("level = 'error'").collect()) == ["gone.ts", "here.ts"]
    assert {r[0] for r in graph.functions.select("file").distinct().collect()} == {"here.ts"}


def test_writing_again_changes_nothing(spark):
    root = local_path(scratch_folder(spark, "tree"))
    files = spark.createDataFrame([("a/b.ts", "é"), ("c.ts", ""), ("d.ts", None)], "relative_path string, text string")
    for _ in range(2):
        assert {r[0]: r[1] for r in write_tree(files, root).collect()} == {"a/b.ts": 2, "c.ts": 0, "d.ts": 0}
        assert sorted(os.listdir(root)) == ["a", "c.ts", "d.ts"] and os.listdir(f"{root}/a") == ["b.ts"]


def test_addresses():
    assert local_path("file:///tmp/x") == local_path("file:/tmp/x") == local_path("/tmp/x") == "/tmp/x"
    with pytest.raises(ValueError):
        local_path("hdfs://host/x")


def test_writing_is_many_tasks(spark, tmp_path):
    """Files that come in one partition are written by several tasks."""
    files = spark.createDataFrame([(f"d{k % 3}/p{k}.ts", f"{k}") for k in range(200)], "relative_path string, text string").coalesce(1)
    written = write_tree(files, str(tmp_path / "tree"))
    assert sum(n > 0 for n in written.rdd.glom().map(len).collect()) > 1 and written.count() == 200
    assert sorted(p.read_text() for p in (tmp_path / "tree").rglob("*.ts")) == sorted(f"{k}" for k in range(200))


def test_patterns_are_read_once(monkeypatch):
    """However many paths are held against them; and what they match is what each of them matches by itself."""
    patterns = ("node_modules", "dist/", "**/*.min.js", "src/?.ts", "**/x/**", "a.b", "it's [odd]", "once-only")
    paths = [f"{a}{b}" for a in ("", "src/", "src/x/", "node_modules/", "dist/", "a.b/", "it's [odd]/", "a+b/") for b in ("", "a.ts", "ab.ts", "q.min.js", "a.b", "node_modules", "axb", "it's [odd]", "dist", "é.ts", "a\nb.min.js")]
    alone = lambda path, p: re.match(text.glob_regex(p), path) or (not re.search(r"[*?]", p) and path.startswith(p.rstrip("/") + "/"))
    assert [text.path_matches(path, [p]) for path in paths for p in patterns] == [bool(alone(path, p)) for path in paths for p in patterns]
    expected, made, plain = [any(alone(path, p) for p in patterns) for path in paths], [], text.glob_regex
    monkeypatch.setattr(text, "glob_regex", lambda p: made.append(p) or plain(p))
    assert [text.path_matches(path, patterns) for path in paths] == expected
    assert len(made) == len(patterns) and not text.path_matches("a.ts", ())
