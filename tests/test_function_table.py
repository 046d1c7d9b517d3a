"""The functions of files without the other tables, and what the parser puts back."""

import pytest

from tidemark.frontend.expressions import member_chain
from tidemark.frontend.parser import Parser
from tidemark.sources import discovery


def test_same_functions(spark, monkeypatch):
    """As the whole graph has them, callees included; no other table's rows leave the parser, and a task holds few files' rows."""
    monkeypatch.setattr(discovery, "FILES", 7)
    files = spark.createDataFrame([(f"p{k}.ts", None if k == 3 else f"function f{k}(a, {{ b }}) {{ return g(a); }}\nfunction g(x) {{ return x; }}\nclass C {{ m() {{ f{k}(1); }} }}") for k in range(40)], "relative_path string, text string")
    whole, few = discovery.graph_tables(files)[0].functions, discovery.function_table(files)
    assert few.schema == whole.schema
    rows = sorted(map(repr, few.collect()))
    assert rows == sorted(map(repr, whole.collect())) and len(rows) == 39 * 4 + 1
    assert discovery._parsed(files, ("functions",)).columns == ["kind", "functions"]


@pytest.mark.parametrize("source", ["a < b >> (c)", "f(a < b >> c, d)", "(a: B<C<D>>) + 1", "x < y<z>> 1"])
def test_failed_attempts_leave_no_trace(source):
    """Signs that an attempt took apart are whole again after it, and no attempt copies the tokens."""
    parser = Parser(source)
    before, own = list(parser.tokens), parser.tokens
    assert parser.attempt(lambda: [parser.type_arguments() if parser.sees("<") else parser.next() for _ in before] and None) is None
    assert parser.tokens is own and parser.tokens == before and parser.at == 0


@pytest.mark.parametrize(("text", "chain"), [("a.b.$c_1", ["a", "b", "$c_1"]), ("a.b\n", ["a", "b"]), ("a .b", ["a", "b"]), ("a.1", None), ("a.", None), ("é.b", ["é", "b"]), ("require", ["require"]), ("a.b()", None)])
def test_plain_chains(text, chain):
    assert member_chain(text) == chain
