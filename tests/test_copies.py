"""Files of one text are analysed once; what is found in each is what is found in it alone."""

from types import SimpleNamespace

from tidemark import engine
from tidemark.sources.config import Config

TAKEN = "app.get('/a', (req, res) => {\n  const v = req.query.id;\n  db.query('select ' + v);\n});\n"
CLEAN = "export const x = 1;\n"
FILES = [("a.ts", TAKEN), ("src/b.ts", TAKEN), ("c.ts", CLEAN), ("d.ts", None), ("e.ts", ""), ("f.ts", CLEAN), ("it's/é.ts", TAKEN), ("g.ts", "const y = 1;\n" + TAKEN)]


def rows(df):
    """Findings of files, without the numbers that only order them."""
    return sorted((tuple(sorted((k, str(v)) for k, v in r.asDict(True).items() if k not in ("level", "seq"))) for r in df.collect()))


def test_same_as_one_by_one(spark, monkeypatch):
    """The same rows, and the front-end is given each text once, no text being an empty one."""
    files = spark.createDataFrame(FILES, "relative_path string, text string")
    given, plain = [], engine.analyse_files

    def watched(spark, texts, config, proofs=True):
        given.append(texts.count())
        return plain(spark, texts, config, proofs)

    alone = rows(plain(spark, files, Config())[0].findings)
    monkeypatch.setattr(engine, "analyse_files", watched)
    assert rows(engine.file_findings(spark, files, Config())) == alone and len({r for r in alone}) == 4
    assert given == [4]


def test_bytes(spark):
    files = spark.createDataFrame([(p, None if t is None else t.encode()) for p, t in FILES], "relative_path string, content binary")
    found = {(r["relative_path"], r["id"]) for r in engine.file_findings(spark, files, Config(), proofs=False).collect()}
    assert found == {(p, f"sql-query:{p}:{line}:3") for p, line in (("a.ts", 3), ("src/b.ts", 3), ("it's/é.ts", 3), ("g.ts", 4))}


def test_rules_that_name_paths(spark, monkeypatch):
    """With a rule that names a function of one file, each file is analysed under its own path."""
    config = Config()
    config.rules["sources"][0]["within_functions"] = ["a.ts::app.get~arg1"]
    monkeypatch.setattr(engine, "analyse_files", lambda spark, files, config, proofs: (SimpleNamespace(findings=files), None))
    files = spark.createDataFrame(FILES, "relative_path string, text string")
    assert sorted(map(tuple, engine.file_findings(spark, files, config).collect()), key=lambda r: r[0]) == sorted(FILES)
