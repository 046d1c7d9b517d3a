"""Both kernels give one answer for a project."""

from tidemark.cli import main
from tidemark.engine import scan

FILES = {
    "a.ts": b"app.get('/a', (req: Request, res) => {\n  const v = req.query.id; db.query('select ' + v);\n  res.send(escapeHtml(req.body.name));\n});\n",
    "it's/b.ts": b"import { exec } from 'child_process';\nfunction wrap(x: string) { return 'cat ' + x; }\nexport function h(req: Request) { exec(wrap(req.params.f)); }\n",
    "clean.ts": b"export const x = 1;\n",
    "broken.ts": b"const y = '\xff\xfe';\n",
}


def key(result):
    return [(f["id"], f["rule_id"], tuple(f["kinds"]), f["source_id"], tuple((s["node_id"], s["role"]) for s in f["proof"])) for f in result["findings"]]


def project(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    return str(tmp_path)


def test_one_answer(spark, tmp_path):
    root = project(tmp_path)
    near, far = scan(root), scan(root, spark, distributed=True)
    assert key(near) == key(far) and len(key(near)) >= 2
    for r in (near, far):
        assert [d["file"].endswith("broken.ts") for d in r["diagnostics"] if d["level"] == "error"] == [True]
    assert [f["file"] for f in near["findings"]] == [f["file"] for f in far["findings"]]


def test_flag(spark, tmp_path, capsys):
    assert main(["scan", project(tmp_path), "--distributed", "-q", "-f", "json"]) == 2
    assert '"findings"' in capsys.readouterr().out


SINK = "app.get('/a', (req, res) => {\n  const v = req.query.id;\n  db.query('select ' + v);\n});\n"
FORMS = {
    "lf.ts": SINK.encode(),
    "crlf.ts": SINK.replace("\n", "\r\n").encode(),
    "cr.ts": SINK.replace("\n", "\r").encode(),
    "mixed.ts": ("// one\r// two\r\n" + SINK + "// three").encode(),
    "separators.ts": ("const x = 1; const y = 2; \n" + SINK).encode(),
    "bom.ts": b"\xef\xbb\xbf" + SINK.encode(),
    "bad.ts": b"// \xff\xfe\n" + SINK.encode(),
    "deep.ts": ("f(" * 4000 + ")" * 4000 + ";\n" + SINK).encode(),
    "empty.ts": b"",
    "wide.ts": ("const s = '𝒳é'; " + SINK).encode(),
}


def test_bytes_of_all_kinds(spark, tmp_path):
    """Line ends, byte-order marks, bad bytes and deep nesting mean the same however a project is scanned."""
    for name, data in FORMS.items():
        (tmp_path / name).write_bytes(data)
    near, far = scan(str(tmp_path)), scan(str(tmp_path), spark, distributed=True)
    place = lambda r: [(f["relative_path"], f["rule_id"], f["range"]["start"], f["range"]["end"]) for f in r["findings"]]
    said = lambda r: sorted((d["level"], d["message"], d["file"]) for d in r["diagnostics"])
    assert place(near) == place(far) and said(near) == said(far)
    lines = {f["relative_path"]: f["range"]["start"]["line"] for f in near["findings"]}
    assert lines == {"lf.ts": 3, "crlf.ts": 3, "cr.ts": 3, "mixed.ts": 5, "separators.ts": 6, "bom.ts": 3, "bad.ts": 4, "wide.ts": 3}
    assert {f["range"]["start"]["column"] for f in near["findings"]} == {3}
    assert {d[2].rsplit("/", 1)[1] for d in said(near) if d[0] == "error"} == {"bad.ts", "deep.ts"}


def test_unreadable(tmp_path):
    from tidemark.sources.discovery import readable

    (tmp_path / "a.ts").write_text("x")
    good, said = readable([str(tmp_path / "a.ts"), str(tmp_path / "gone.ts"), str(tmp_path)])
    assert [g[-4:] for g in good] == ["a.ts"] and [d["level"] for d in said] == ["error", "error"]
