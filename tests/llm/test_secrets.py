import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm import secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
KEY = "AKIA" + "ABCDEFGHIJKLMNOP"
PARTS = ["token=", "Secret : '", "api_KEY=\"", "apikey:", "passwd", "password ", "= ", "abcdef", "ab1", "0123456789abcdef", "AKIA", "ABCDEFGHIJ0123456", " ", "\n", "é", "toKen=abcdefgh ", "ghp_" + "a" * 36, "xoxb-1234567890", "-----BEGIN RSA PRIVATE KEY-----"]


def brute(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def base(text, scanner=secrets.Scanner(secrets.RULES)):
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in scanner.scan(["", text, "x"])[1] if s["kind"] in ("assign", "access", "hex")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans_equal_brute_force(text):
    assert base(text) == brute(text)


def test_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") is True
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == frozenset({frozenset({b"aki", b"kia"})})
    assert frozenset({b"tok", b"oke", b"ken"}) in secrets.trigram_query(secrets.BASE_RULES[0].pattern, re.I)
    assert secrets.trigram_query("(abc|d*)") is True


def test_index_over_pieces(monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 7)
    assert base("xx token=abcdefgh yy " + KEY) == brute("xx token=abcdefgh yy " + KEY)


def test_rows(spark):
    rows = [(1, "token=abcdef " + KEY, "c"), (2, None, "c"), (3, "", None), (3, "", None), (4, "é ghp_" + "a" * 36 + " " + "0af" * 9, "x"), (None, "secret: longvalue", "x")]
    found = secrets.digest(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string"))).collect()
    assert len(found) == 6
    for (i, t, _), r in zip(sorted(rows, key=lambda r: (r[0] or 0)), sorted(found, key=lambda r: r.doc_id or 0)):
        want = brute(t or "")
        assert (r.doc_id, r.base_sha256) == (i, hashlib.sha256(",".join(want).encode()).hexdigest())
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r.spans.split(",")) | {""}
    assert "code_host:2:42" in [r for r in found if r.doc_id == 4][0].spans
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []
