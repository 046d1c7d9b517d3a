import pytest

from tidemark.engine import scan, scan_source, should_fail
from tidemark.frontend.builder import build_file
from tidemark.frontend.expressions import member_chain, parse_expression
from tidemark.frontend.parser import parse
from tidemark.source_queries import FORMS, UNKNOWN


def flows(source: str, src: str, dst: str) -> bool:
    """Whether edges lead from a node labelled src to one labelled dst."""
    t = build_file(source, "a.ts")
    label = {n["id"]: n["label"] for n in t["nodes"]}
    seen, todo = set(), [i for i, x in label.items() if x == src]
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            todo += [e["dst"] for e in t["edges"] if e["src"] == at]
    return any(label[i] == dst for i in seen)


@pytest.mark.parametrize(
    ("source", "src", "dst"),
    [
        ("function f(a) { const x = a; sink(x); }", "a", "sink"),
        ("function f(a) { let x; x = a; sink(x); }", "a", "sink"),
        ("function f(a) { let x = ''; x += a; sink(x); }", "a", "sink"),
        ("function f(a) { sink('q' + a); }", "a", "sink"),
        ("function f(a) { sink(`q ${a} r`); }", "a", "sink"),
        ("function f(a) { sink([1, a]); sink({ k: a }); }", "a", "sink"),
        ("function f(a) { const o = {}; o.k = a; sink(o.k); }", "a", "sink"),
        ("function f(a) { const { x, y: [z = 1] } = a; sink(z); }", "a", "sink"),
        ("function f(a) { sink(...a); }", "a", "sink"),
        ("function h(x) { return x; } function f(a) { sink(h(a)); }", "a", "sink"),
        ("const h = (x) => x + 1; function f(a) { sink(h(a)); }", "a", "sink"),
        ("class C { m(x) { return x; } f(a) { sink(this.m(a)); } }", "a", "sink"),
        ("function f(a) { if (a) { const x = a; sink(x); } }", "a", "sink"),
        ("function f(a) { for (const x of a) { sink(x); } }", "a", "sink"),
        ("function f(a) { try { sink(a as string); } catch (e) {} }", "a", "sink"),
        ("async function f(a) { sink(await a!.b?.[c]); }", "a", "sink"),
        ("function f(a) { sink(a ? 1 : 2); }", "a", "sink"),
        ("function f({ a }) { sink(a); }", "a", "sink"),
        ("function f(x = g(), a: Array<Map<string, number>> = []) { sink(a); }", "a", "sink"),
    ],
)
def test_forms(source, src, dst):
    assert flows(source, src, dst)


def test_no_flow():
    assert not flows("function f(a) { const x = 'k'; sink(x); }", "a", "sink")
    assert not flows("function f(a) { sink(typeof a); }", "a", "sink")


def test_names_positions_and_unicode():
    t = build_file("const f = () => 1;\nlet 😀 = 1; app.get('/', function () {});\nclass A { m() {} }\nfunction f2() {} function f2() {}", "d/a.ts")
    assert [f["id"] for f in t["functions"]] == ["d/a.ts::f", "d/a.ts::app.get~arg1", "d/a.ts::A.m", "d/a.ts::f2", "d/a.ts::f2~2", "d/a.ts::<module>"]
    call = next(n for n in t["nodes"] if n["label"] == "app.get")
    assert call["range"]["start"] == {"line": 2, "column": 13}  # the emoji is two UTF-16 units


def test_broken_and_strange_sources():
    for source in ("", "((((", "function (", "`${", "const x = <T>y;", "a < b > c", "x = /[/]/g.test(y) / 2", "<div a={b}>{c}</div>", "export type { A } from 'b'; import x from 'y';", "\x00", "enum E { A = 1 } declare const q: number;", "label: for (;;) { break label; }"):
        build_file(source, "a.ts")
    statements, problems = parse("type A = { b: string } | (x: number) => void;\nconst y: A[] = f<string>(1) as A;")
    assert not problems and len(statements) == 1


@pytest.mark.parametrize(
    ("text", "segments", "call", "args"),
    [
        ("a.b", ["a", "b"], False, []), ("a?.b!.c", ["a", "b", "c"], False, []), ("o['k']", ["o", "k"], False, []), ("o[d]", ["o", "*"], False, []), ("(a.b).c", ["a", "b", "c"], False, []),
        ("require('m/sub').x(1, 'b')", ["m", "x"], True, ["1", "'b'"]), ("await f(g(1, 2), [3]);", ["f"], True, ["g(1, 2)", "[3]"]), ("f('a' + lon…", ["f"], True, ["'a' + lon"]), ("x as string", ["x"], False, []), ("a + b", None, False, []),
    ],
)
def test_expressions(text, segments, call, args):
    e = parse_expression(text)
    assert (e.segments, e.is_call, e.args) == (segments, call, args)


def test_member_chain():
    assert member_chain("this.a.b") == ["this", "a", "b"]
    assert member_chain("f(x).y") is None


def test_scan(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    bad = "const { exec: run } = require('child_process');\napp.get('/', (req, res) => {\n  run('ping ' + req.query.host);\n});\n"
    (tmp_path / "src" / "a.ts").write_text(bad)
    (tmp_path / "node_modules" / "b.js").write_text(bad)
    (tmp_path / "src" / "t.d.ts").write_text("declare const x: number;")
    (tmp_path / "src" / "c.js").write_text("app.get('/', (req, res) => { db.query('select ?', [req.query.id]); });\n")
    r = scan(str(tmp_path))
    assert r["stats"]["files_scanned"] == 2 and not any(d["level"] == "error" for d in r["diagnostics"])
    # The alias hides the call's name; what it stands for is found.
    assert [(f["rule_id"], f["relative_path"], f["range"]["start"]["line"]) for f in r["findings"]] == [("command-child-process-exec", "src/a.ts", 3)]
    assert [s["role"] for s in r["findings"][0]["proof"]][:1] == ["source"] and should_fail(r, "error") and not should_fail(r, "none")
    assert scan(str(tmp_path)) | {"stats": 0, "config": 0} == r | {"stats": 0, "config": 0}
    assert scan(str(tmp_path / "nothing"))["diagnostics"][0]["level"] == "error"


def test_sanitisers():
    assert not scan_source("app.get('/', (req, res) => { res.send(escapeHtml(req.query.x)); });")["findings"]
    assert [f["kinds"] for f in scan_source("app.get('/', (req, res) => { exec(escapeHtml(req.query.x)); });")["findings"]] == [["command"]]


@pytest.mark.parametrize(("name", "code", "passes"), FORMS)
def test_registered_forms(name, code, passes):
    result = scan_source("app.get('/x', (req, res) => {\n" + code + "\n});\n")
    assert [f["rule_id"] for f in result["findings"]] == ["command-exec"] * passes
    assert bool(result["diagnostics"]) == (name in UNKNOWN)
