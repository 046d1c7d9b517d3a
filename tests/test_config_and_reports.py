import json

import pytest

from tidemark import accuracy, cli
from tidemark.engine import scan_source
from tidemark.functions.text import glob_regex, path_matches
from tidemark.reporters import chosen_steps, create_reporter, render_json, render_markdown, render_pretty, render_sarif, summary_line, validate_sarif
from tidemark.rules.catalogue import TAGS, builtin_rules
from tidemark.sources.config import ConfigError, merge_rules, parse_config, resolve_config

BAD = "app.get('/', (req, res) => {\n  db.query('a' + req.query.id);\n  res.send(`<b>${req.body.n}</b>`);\n});\n"


def test_catalogue():
    rules = builtin_rules()
    assert {k: len(v) for k, v in rules.items()} == {"sources": 47, "sanitizers": 34, "sinks": 147, "propagators": 64}
    for kind in ("sources", "sanitizers", "sinks"):
        assert len({r["id"] for r in rules[kind]}) == len(rules[kind]) and all(set(r["kinds"]) <= set(TAGS) for r in rules[kind])
    assert [sum(r["severity"] == s for r in rules["sinks"]) for s in ("error", "warning", "note")] == [101, 44, 2]


def test_config():
    c = parse_config("""
version: 1
analysis: {maxCallDepth: 7, dedupe: false}
ignorePaths: ["**/gen/**"]
output:
  failOn: warning
rules:
  sources:
    - id: my-source
      kinds: [sql]
      member: my.input
  sinks:
    - {id: sql-query, kinds: [sql], call: query, severity: note, message: "yes", taintedArgs: [1]}
""")
    assert (c.max_call_depth, c.dedupe, c.ignore_paths, c.fail_on, c.format) == (7, False, ["**/gen/**"], "warning", "pretty")
    assert c.rules["sources"][-1]["id"] == "my-source" and c.rules["sinks"][0]["severity"] == "note" and any("sql-query" in w for w in c.warnings)
    assert not scan_source("const x = my.input; db.run(x);", config=c)["findings"]


@pytest.mark.parametrize(
    ("text", "path"),
    [
        ("version: 2", "version"), ("rules: []", "rules"), ("rules: {sinks: [{id: x, kinds: [sql], call: q, message: m, severity: bad}]}", "rules.sinks[0].severity"), ("rules: {sources: [{id: x, kinds: [sql]}]}", "rules.sources[0]"),
        ("analysis: {maxIterations: 0}", "analysis.maxIterations"), ("a: 1\na: 2", "a"), ("a:\n\tb: 1", "tabs"), ("rules: {sources: [{id: x, kinds: [sql], member: 'a b'}]}", "rules.sources[0].member"),
    ],
)
def test_config_errors(text, path):
    with pytest.raises(ConfigError, match="^" + path.replace("[", r"\[")):
        parse_config(text)


def test_resolution(tmp_path):
    assert resolve_config(str(tmp_path)).origin == "built-in"
    (tmp_path / ".tidemark.yml").write_text("analysis: {maxCallDepth: 9}\nstrange: on")
    c = resolve_config(str(tmp_path), overrides={"format": "json"})
    assert c.max_call_depth == 9 and c.format == "json" and c.warnings == ["strange: unknown key"]
    with pytest.raises(ConfigError):
        resolve_config(str(tmp_path), str(tmp_path / "no.yml"))
    assert merge_rules([{"id": "a", "v": 1}, {"id": "b", "v": 1}], [{"id": "a", "v": 2}])[0] == [{"id": "a", "v": 2}, {"id": "b", "v": 1}]


def test_globs():
    assert path_matches("a/b/c.ts", ["a/**/*.ts"]) and path_matches("a/c.ts", ["a/**/*.ts"]) and path_matches("a/b", ["a"]) and not path_matches("ab/c", ["a"]) and not path_matches("a/b/c.ts", ["a/*.ts"])
    assert glob_regex("a.b?") == r"^a\.b[^/]$"


def test_reports():
    r = scan_source(BAD)
    assert summary_line(r["findings"]) == "2 findings (1 error, 1 warning) in 1 file"
    body = json.loads(render_json(r))
    assert list(body) == ["tool", "root", "findings", "stats", "diagnostics"] and "elapsedMs" not in body["stats"] and list(body["findings"][0])[:3] == ["id", "ruleId", "severity"]
    assert render_json(scan_source(BAD)) == render_json(r)
    log = json.loads(render_sarif(r))
    assert not validate_sarif(json.dumps(log)) and [x["ruleIndex"] for x in log["runs"][0]["results"]] == [0, 1]
    log["runs"][0]["results"][0]["ruleIndex"] = 5
    assert validate_sarif(json.dumps(log)) and validate_sarif("no")
    assert "1 more not shown" in render_markdown(r, 1) and "sql-query" in render_pretty(r) and "\x1b[" in render_pretty(r, colour=True)
    assert "no findings" in render_pretty(scan_source(""))
    with pytest.raises(ValueError, match="unknown format"):
        create_reporter("xml")


def test_chosen_steps():
    p = [{"n": i} for i in range(5)]
    assert chosen_steps(p, 5) == p and chosen_steps(p, 3) == [p[0], p[1], 2, p[4]] and chosen_steps(p, 1) == [p[4]] and chosen_steps(p, 0) == []


def test_scoring():
    f = lambda line, kind: {"relative_path": "a.ts", "range": {"start": {"line": line}}, "kinds": [kind]}
    report = accuracy.score([{"file": "a.ts", "line": 5, "family": "sql"}, {"file": "a.ts", "line": 6, "family": "sql"}], [{"file": "a.ts", "line": 20, "family": "sql"}], [f(7, "sql"), f(21, "html")])
    assert report["overall"] == {"tp": 1, "fp": 1, "fn": 1, "precision": 0.5, "recall": 0.5, "f1": 0.5} and report["clean_hits"] == 1 and not accuracy.passes(report)
    assert accuracy.embed(accuracy.embed("# t\n", "one"), "two").count("accuracy:start") == 1


def test_cli(tmp_path, capsys):
    file = tmp_path / "a.ts"
    file.write_text(BAD)
    assert cli.main(["scan", str(tmp_path), "-q", "-f", "json"]) == 1
    assert len(json.loads(capsys.readouterr().out)["findings"]) == 2
    assert cli.main(["scan", str(tmp_path), "-q", "--fail-on", "none", "-o", str(tmp_path / "out.txt")]) == 0
    assert cli.main(["scan", str(tmp_path / "no"), "-q"]) == 2 and cli.main(["bogus"]) == 2
    capsys.readouterr()
    assert cli.main(["explain", f"{file}:2"]) == 0 and "sql-query" in capsys.readouterr().out
    assert cli.main(["rules", "--json"]) == 0 and len(json.loads(capsys.readouterr().out)["sinks"]) == 147
