import random
import re

import numpy as np
import pyarrow as pa

from quern.llm import secret_scan as S
from quern.llm.automaton import Automaton

BASE = [
    ("assign", re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def brute(text):
    found = []
    for k, (kind, p, g, least) in enumerate(BASE):
        found += [(m.start(), k, kind, m.end()) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


def sample(seed, n):
    r = random.Random(seed)
    parts = ["password", "PassWd", "secret", "token", "Api_Key", "apikey", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIAABCDEFGHIJKLMN", "deadbeef", "0123456789abcdef", "é", "𝒳", "\n", "x", "abc.d", "A1", "==", "-", "K", "ſ"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_base_spans_equal_brute_force(spark):
    rows = [*sample(1, 700), "", None, "token=" + "a" * 30000, "0" * 40000, "token=a.token:abcdefgh", "AKIA" * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in S.BASE] for r in S.scan_secrets(df).collect()}
    for i, t in enumerate(rows):
        assert out[i] == brute(t), t
    text = dict(enumerate(rows))
    for r in S.scan_secrets(df).collect():
        assert all(text[r["doc_id"]][s["start"] : s["end"]] == s["secret"] for s in r["spans"])


def test_lockstep_and_single_scan_agree():
    texts = sample(2, 90)
    column = pa.array(texts)
    many = S.find_spans(column)
    for i in range(len(texts)):
        assert S.find_spans(column.slice(i, 1)).get(0) == many.get(i)


def test_added_rules_and_redaction(spark):
    key = "ghp_" + "aB3" * 12
    rows = [(1, f"x {key} y", "k"), (2, "-----BEGIN RSA PRIVATE KEY----- z", "k"), (3, "nothing", "k"), (4, None, "k"), (5, "token = 'abcdefgh12' and AKIAABCDEFGHIJKL", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in S.scan_secrets(df).collect()}
    assert out == {1: ["github"], 2: ["pem"], 3: [], 4: [], 5: ["assign", "access"]}
    masked = {r["doc_id"]: r["text"] for r in S.redact(df).collect()}
    assert masked == {1: "x [SECRET] y", 2: "[SECRET] z", 3: "nothing", 4: None, 5: "[SECRET]' and [SECRET]"}
    assert S.scan_secrets(df.limit(0)).count() == 0 and S.redact(df.limit(0)).columns == df.columns


def test_automaton_is_minimal_and_right():
    a = Automaton(["ab+c", "b{2,3}", "(?:x|y)?z"])
    assert len(a.rules) <= a.states_before
    raw = np.frombuffer(b"abbbc xz", np.uint8)
    hits = list(a.scan(raw, np.array([0]), np.array([8])))
    # The third b ends bb as the second did: one report.
    assert [(p, m) for _, p, m in hits] == [(2, 2), (4, 1), (7, 4)]
    back = Automaton(["ab+c"], anywhere=False, backward=True)
    assert back.reach(b"xaabbbc", 6, -1, -1) == 2 and back.reach(b"xaabbbc", 5, -1, -1) is None


def test_all_rules_equal_their_expressions():
    """Random strings that begin like secrets, against the rules as plain expressions."""
    r = random.Random(7)
    parts = ["ghp_", "gho_", "xoxb-", "AIza", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "AKIA", "token=", "secret: '", "abcdefgh", "ABCD1234", "0123456789abcdef", "-", "_", " ", "=", "\n"]
    exact = [(r[2], re.compile(r[3] or r[2])) for r in S.RULES]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 25)))
        want = sorted((m.start(), k, m.end()) for k, (whole, counted) in enumerate(exact) for m in re.finditer(whole, text) if counted.fullmatch(m[0]))
        assert S.find_spans(pa.array([text])).get(0, []) == want, text


def test_a_run_is_one_hit():
    text = "deadbeef" * 250_000
    automaton = Automaton([rule[1] for rule in S.RULES])
    raw = np.frombuffer(text.encode(), np.uint8)
    assert list(automaton.scan(raw, np.array([0]), np.array([len(raw)]))) == [(0, 31, 1 << S.KINDS.index("hex"))]
    assert S.find_spans(pa.array([text])) == {0: [(0, S.KINDS.index("hex"), len(text))]}


def test_many_hits_without_a_match():
    text = "ghp_abcdefgh-" * 20_000 + "ghp_" + "z" * 36 + " xoxb-abcd " * 20_000
    spans = S.find_spans(pa.array([text]))
    at = len("ghp_abcdefgh-") * 20_000
    assert spans == {0: [(at, S.KINDS.index("github"), at + 40)]}
