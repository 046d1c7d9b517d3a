import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.secret_scan import BASE, MORE, RULES, automaton, redact, secret_digest, text_spans

PLAIN = [
    (re.compile("(?:" + "|".join(["[pP][aA][sS][sS][wW][oO][rR][dD]", "[pP][aA][sS][sS][wW][dD]", "[sS][eE][cC][rR][eE][tT]", "[tT][oO][kK][eE][nN]", "[aA][pP][iI]_?[kK][eE][yY]"]) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[1]) >= 8),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]
PIECES = ["token", "secret", "password", "Passwd", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "deadbeef", "0123456789abcdef" * 2, "AKIA", "ABCDEFGHIJKLMNOP", "é😀", "pass", "tok", "-----BEGIN PRIVATE KEY-----", "ghp_" + "a1" * 20, "\n"]


def brute(text):
    return sorted(((m.start(), m.end(), k) for k, (p, ok) in enumerate(PLAIN) for m in p.finditer(text) if ok(m)), key=lambda x: (x[0], x[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans(text):
    assert [s for s in text_spans(text.encode()) if s[2] < len(BASE)] == brute(text)


def test_more_rules_and_size():
    kinds = [RULES[k].kind for _, _, k in text_spans(b"-----BEGIN RSA PRIVATE KEY----- ghp_" + b"Z" * 36 + b" xoxb-1234567890")]
    assert kinds == [r.kind for r in MORE]
    assert automaton().n_states < automaton().n_built < 5000
    assert text_spans(b"") == [] and text_spans(b"a" * 1_000_000)[0][:2] == (0, 1_000_000)


def test_digest_and_redaction(spark):
    texts = [(1, "é token=abcdefgh12 x", 5), (2, None, 6), (3, "", 7), (4, "nothing", 8), (4, "nothing", 8)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, n_chars long")
    rows = {r["doc_id"]: r for r in secret_digest(docs).collect()}
    assert (rows[1]["n_assign"], rows[1]["spans"], rows[2]["spans"]) == (1, "assign:2:18", "")
    assert rows[1]["base_sha256"] == hashlib.sha256(b"assign:2:18").hexdigest() and rows[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    out = {r["doc_id"]: r for r in redact(docs).collect()}
    assert out[1]["text"] == "é <assign> x" and out[1]["n_chars"] == 12 and out[2]["text"] is None and out[4]["text"] == "nothing"
    assert secret_digest(docs.limit(0)).count() == 0
