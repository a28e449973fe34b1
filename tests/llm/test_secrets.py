from __future__ import annotations

import hashlib
import random
import re
import zlib

from quirelake.llm import secrets as s

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def plain(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, b, k) for a, _, k, b in sorted(found)]


def checked(prefix, body):
    crc, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits = s._DIGITS[d] + digits
    return prefix + body + digits


def test_scan_equals_plain_expressions():
    rng = random.Random(3)
    parts = ["token", "=", ": ", '"', "abc123", "AKIA", "AKIA" + "Z9" * 9, "0af" * 9, "Secret", "PASSWD", "api_key", "apikey", " ", "é", "İ",
             "ſecret=abcdefgh", "toKen=abcdefgh", "\n", "passwordpasswd=aaaaaaa", "x" * 7]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert [f for f in s.scan(text) if f[2] in s.BASE] == plain(text), text


def test_checksum_adds_spans():
    good = checked("ghp_", "xZ" * 15)
    text = f"x {good} y {good[:-1]}{'0' if good[-1] != '0' else '1'} {checked('npm_', 'Z' * 30)}"
    assert [(text[a:b], k) for a, b, k in s.scan(text)] == [(good, "github"), (checked("npm_", "Z" * 30), "npm")]


def test_report_and_redaction(spark, docs):
    texts = ["token = 'abcdefgh' and " + "0" * 24, None, "", "clean", "token: abc", "Token = " + "a" * 30]
    rows = {r.doc_id: r for r in s.report(docs(*texts)).collect()}
    assert (rows[0].n_assign, rows[0].n_access, rows[0].n_hex, rows[0].spans) == (1, 0, 1, "assign:0:17,hex:23:47")
    assert rows[0].base_sha256 == hashlib.sha256(rows[0].spans.encode()).hexdigest()
    assert rows[1].spans == rows[2].spans == rows[4].spans == "" and rows[1].n_hex == 0
    clean = s.redact_secrets(docs(*texts, extra="spans"))
    assert [r.text for r in clean.orderBy("doc_id").collect()] == ["[SECRET]' and [SECRET]", None, "", "clean", "token: abc", "[SECRET]"]
    assert clean.columns[-1] == "spans" and s.report(docs("a").limit(0)).count() == 0


def test_very_long_text():
    text = "a b token=abcdef " * 100_000
    assert len(s.scan(text)) == 100_000
