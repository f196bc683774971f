import hashlib
import random
import re
import time

import pytest

from kredenz.llm.queries import op13_secret_scans
from kredenz.llm.secrets import secrets, spans_of
from tests.llm.fixtures import documents, given

#: Text, and the literals that must be found beside the base patterns.
CASES = [
    ('password = "hunter2x!"', ["hunter2x!"]),
    ("db_pass: str = 'S3cr3tPw!' ", ["S3cr3tPw!"]),
    ('K = "zx81-QQ-77ab"\nclient = connect(user, password=K)', ["zx81-QQ-77ab"]),
    ('K = "zx81-QQ-77ab"\nK2 = K\nK = "plain text"\nsecret = K2', ["zx81-QQ-77ab"]),
    ('K = "zx81-QQ-77ab"\nK = load()\npassword = K', []),
    ('a = b_token = "abc123DEF456"', ["abc123DEF456"]),
    ('b_token = a = "abc123DEF456"', ["abc123DEF456"]),
    ('{"apiKey": "AbC123xyz789", "tokenCount": "Ab12Cd34Ef56"}', ["AbC123xyz789"]),
    ("PASSWORD=hunter2abc\nexport ACCESS_KEY=abcd1234efgh", ["hunter2abc", "abcd1234efgh"]),
    ("password: hunter2abc9", ["hunter2abc9"]),
    ("the token: hello world and password: is required", []),
    ("<password>Tr0ub4dor&3</password>", ["Tr0ub4dor&3"]),
    ('<add key="DbPassword" value="Xy77-kk-12"/>', ["Xy77-kk-12"]),
    ('{"name": "DB_PASSWORD", "value": "Xy77-kk-12"}', ["Xy77-kk-12"]),
    ('cfg["secret"] = "k9k9-22-zz1"', ["k9k9-22-zz1"]),
    ('x = "part1A9" + "part2B8"\nself.secret = x', ["part1A9", "part2B8"]),
    ('self.k = "part1A9zz"\ndef f(): passwd = self.k', ["part1A9zz"]),
    ('password = os.environ.get("DB_PASSWORD")', []),
    ('password = getpass() or "fallback99X"', ["fallback99X"]),
    ('p = {\\"password\\": \\"abc123xyz9\\"}', ["abc123xyz9"]),
    ('password = (\n  "abcd12"\n  "efgh34"\n)', ["abcd12", "efgh34"]),
    ('conn = "Server=x;Password=abc123XYZ;Uid=1"', ["abc123XYZ"]),
    ('password = "changeme"; secret = "${SECRET}"; api_key = "xxxxxxxxxxxx"', []),
    ('token_url = "https://host.example/oauth/token"; secret_name = "Ab12Cd34Ef"', []),
    ('if password == "abc12345": pass', []),
    ('keyword = "Ab12Cd34Ef56"; monkey = "Ab12Cd34Ef56"', []),
    ('secret = """Ab12Cd34Ef56"""', ["Ab12Cd34Ef56"]),
    ('naïve\U0001f600 = 1; pwd := `Ab12Cd34Ef56`', ["Ab12Cd34Ef56"]),
]


@pytest.mark.parametrize("text, want", CASES)
def test_literals(text, want):
    assert [text[s.start : s.end] for s in spans_of(text) if s.kind == "literal"] == want


def plain_base(text):
    """The contract's patterns, in plain words."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def compare(rows, got):
    assert len(rows) == len(got)
    want = {}
    for i, text in rows:
        base = plain_base(text or "")
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        want.setdefault(i, []).append((*[sum(k == j for _, k, _ in base) for j in range(3)], hashlib.sha256(said.encode()).hexdigest(), set(said.split(",")) - {""}))
    for r in got:
        assert any(
            (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == w[:4] and w[4] <= set(r.spans.split(",")) for w in want[r.doc_id]
        )
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts) and len(starts) == r.n_assign + r.n_access + r.n_hex + r.n_literal


def test_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in given(spark, folder, "documents").collect()]
    got = op13_secret_scans(spark, folder).collect()
    compare(rows, got)
    assert sum(r.n_hex for r in got) > 10


def test_base_patterns_of_random_texts(spark, tmp_path):
    dice = random.Random(5)
    parts = ["password", "PassWd", "ſecret", "toKen", "Key", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "AKIA", "AKIAAB12", "0123456789abcdef", "deadbeef", "Z", "\U0001f600", "\n", "abcdefghijkl", "é"]
    rows = [(k, "".join(dice.choices(parts, k=dice.randint(0, 40))), "AKIA", None, None, None, None) for k in range(400)]
    rows += [(500, None, None, None, None, None, None), (None, "token=abcdefghijklmnop", None, None, None, None, None), (7, "token=abcdefghijklmnop", None, None, None, None, None)]
    documents(spark, rows).selectExpr("*", "node AS spans").write.parquet(f"{tmp_path}/documents.parquet")
    compare([r[:2] for r in rows], op13_secret_scans(spark, str(tmp_path)).collect())


def test_awkward_documents_and_clashing_names(spark):
    frame = documents(spark).withColumnRenamed("node", "_text").withColumnRenamed("score", "spans")
    got = secrets(frame, keep=("doc_id", "_text")).collect()
    assert len(got) == frame.count() and all(r.spans is not None for r in got)
    assert secrets(frame.limit(0)).collect() == []


@pytest.mark.parametrize("unit", ["a=", "a.", 'a="', "a='\\", "a=(", 'a="""', "a: b[c, ", '"', 'a="x"+', "password=password+'x1234567'\n", "a=\\\"b ", "token=     ", "<a>", "AKIA", "ab"])
def test_time_grows_with_the_text(unit):
    def seconds(n):
        text = (unit * (n // len(unit) + 1))[:n]
        began = time.process_time()
        spans_of(text)
        return time.process_time() - began

    assert seconds(200_000) < 4 * max(0.05, seconds(100_000))
