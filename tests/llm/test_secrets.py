import hashlib
import random
import re

import duckdb

from probity.llm import secrets
from probity.llm.automata import compile_rules

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")


def brute(text: str) -> list:
    data = (text or "").encode()
    at = lambda i: len(data[:i].decode())
    out = [(at(m.start()), 0, at(m.end())) for m in ASSIGN.finditer(data) if len(m[2]) >= 12]
    out += [(at(m.start()), 1, at(m.end())) for m in ACCESS.finditer(data) if len(m[0]) >= 18]
    out += [(at(m.start()), 2, at(m.end())) for m in HEX.finditer(data) if len(m[0]) >= 16]
    return sorted(out)


def test_scanner_against_regular_expressions():
    rng, scanner = random.Random(5), secrets.Scanner()
    parts = ["password", "PASSWD", "token", "api_key", "apikey", "Secret", "=", ":", " ", '"', "'", "abcdef0123456789", "AKIA", "AKIAABCDEFGHIJKLMN", "é", "zz", "0f", "==", "x.y/z+w-q_", "\n", "ghp_", "eyJ"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        mine = [(s, secrets.BASE.index(k), e) for s, e, k in secrets.spans_of(scanner, text.encode()) if k in secrets.BASE]
        assert mine == brute(text), text


def test_other_rules():
    scanner = secrets.Scanner()
    text = "é ghp_" + "Z1" * 18 + " xoxb-1234567890-abc sk_live_" + "z" * 20 + " -----BEGIN RSA PRIVATE KEY----- Bearer   " + "Q" * 20 + " eyJhbGc.eyJzdWI.c2ln-_x"
    kinds = {k: text[s:e] for s, e, k in secrets.spans_of(scanner, text.encode())}
    assert set(kinds) == {"hosting", "chat", "payment", "private_key", "bearer", "web_token"}
    assert kinds["hosting"].startswith("ghp_") and kinds["private_key"].endswith("KEY-----")


def test_compiled_rules_are_minimal_and_right():
    rows, masks = compile_rules([("a[bc]+d", False), ("x{2,3}", True), ("(?:q|rs)?t", False)])
    rules = [re.compile(rb"a[bc]+d$"), re.compile(rb"[xX]{2,3}$"), re.compile(rb"(?:q|rs)?t$")]
    rng = random.Random(1)
    for _ in range(500):
        data = bytes(rng.choices(b"abcdxXqrst", k=rng.randint(1, 12)))
        at = 0
        for b in data:
            at = rows[at][b]
        assert [bool(masks[at] >> k & 1) for k in range(3)] == [bool(r.search(data)) for r in rules]
    assert len(rows) <= 12


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "x" * 200_000 + " token=abcdefghijkl", "k"), (3, "é password: 'aaaaaaaaaaaaa'", "k"), (None, "deadbeefdeadbeef", "k")], "doc_id long, text string, found string")
    rows = secrets.scan(docs).collect()
    assert len(rows) == 5
    by = sorted((r["doc_id"] or 0, [tuple(x) for x in r["found"]]) for r in rows)
    assert by[0] == (0, [("hex", 0, 16)]) and by[1] == (1, []) and by[2] == (2, [])
    assert (3, [("assign", 2, 26)]) in by and (3, [("assign", 200_001, 200_019)]) in by
    assert secrets.scan(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    mine = {r["doc_id"]: r for r in secrets.query(spark, sf).collect()}
    assert len(mine) == len(texts)
    for doc_id, text in texts:
        want = brute(text)
        r = mine[doc_id]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
        joined = ",".join(f"{secrets.BASE[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()


def test_no_regular_expressions_and_linear_time():
    import time

    assert not hasattr(secrets, "re")
    scanner = secrets.Scanner()
    assert len(scanner.present.masks) < 5000

    def took(data: bytes) -> float:
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            secrets.spans_of(scanner, data)
            best = min(best, time.perf_counter() - began)
        return best

    for part in (b"eyJa", b"token:", b"token=a ", b"AKIA", b"deadbeef", b"-----BEGIN ", b"bearer  ", b"eyJa.eyJb"):
        small, large = took(part * 2_000), took(part * 16_000)
        assert large < 16 * small + 0.05, (part, small, large)


def test_overlapping_starts_and_dropped_matches():
    rng, scanner = random.Random(11), secrets.Scanner()
    rules = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "web_token": re.compile(rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), "bearer": re.compile(rb"bearer\x20+([A-Za-z0-9._~+/=-]+)", re.I), "private_key": re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----")}
    keep = {r.kind: r.keep for r in secrets.RULES}
    parts = ["eyJ", "eyJa", ".", "token", "=", ":", "Bearer ", "bearer", " ", "AKIA", "ABCDEFGHIJ0123", "0123456789ab", "cdef", "-----", "BEGIN ", "PRIVATE KEY", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "é", "-_"]
    for _ in range(3000):
        data = "".join(rng.choices(parts, k=rng.randint(1, 25))).encode()
        mine = [(s, e, scanner.rules[k].kind) for s, e, k in scanner.scan(data)]
        for kind, rule in rules.items():
            want = [(m.start(), m.end(), kind) for m in rule.finditer(data) if len(m[m.lastindex if kind in ("bearer", "assign") else 0]) >= keep[kind]]
            assert [x for x in mine if x[2] == kind] == want, (kind, data)
