"""PII and secret scans against plain patterns."""

import base64
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from slabwise.llm import pii, secret_scan


def luhn(x):
    total = 0
    for i, c in enumerate(reversed(x)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(texts)], "doc_id long, text string, base string, start int")


TRICKY = [None, "", "a@b.c_x@y.zz", "a@b..c a@b.c..foo@bar.com .@x.y", "a@b.c.d.e-f@g.h@i.j", "é" * 50 + "mail ü@x.de x@ü.de q@w.de.", "1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3.256 999.1.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111112", "+1 (555) 123-4567 ++49 30 1234567 +1-2 +123456789012345678", "\x01.\x02@\x03.com 4\x031111 a\x01b@c.de", "5" * 5000, "a@" + "b." * 20_000 + "c", "x" * 200_000, "1 " * 50_000, "+" * 10_000 + "1 2"]


def test_base_kinds_equal_plain_patterns(spark):
    r = random.Random(3)
    alphabet = "ab1 2.3-@+_%()9\x01\x03é"
    texts = TRICKY + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 120))) for _ in range(300)]
    texts += ["".join(r.choice(["a@b.c", "1.2.3.4", "4111111111111111", "+49 30 1234567", " ", ".", "-", "é", "7"]) for _ in range(20)) for _ in range(150)]
    got = {x.doc_id: x for x in pii.digest(pii.find_pii(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = plain_pii(t or "")
        x = got[i]
        assert x.base_sha256 == hashlib.sha256(said(want).encode()).hexdigest(), (t or "")[:200]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == kind for k, *_ in want) for kind in pii.BASE]
        assert not want or set(said(want).split(",")) <= set(x.spans.split(","))


def test_revealing_terms_are_marked_everywhere(spark):
    r = random.Random(1)
    filler = lambda: " ".join(r.choice("alpha beta gamma delta epsilon zeta theta".split()) for _ in range(12))
    texts = [f"{filler()} Zork writes from z@home.org {filler()}" for _ in range(4)]
    texts += [f"{filler()} mail other{i}@x.org {filler()}" for i in range(60)] + ["again Zork alone, zorks no", filler(), None]
    found = pii.find_pii(docs_of(spark, texts))
    got = {x.doc_id: x.spans for x in pii.digest(found).collect()}
    assert got[64] == "term:6:10" and got[65] == "" == got[66]
    assert all("term" in got[i] for i in range(4)) and not any("term" in got[i] for i in range(4, 64))
    clean = {x.doc_id: x.clean for x in docs_of(spark, texts).join(found, "doc_id").select("doc_id", pii.sanitised(F.col("text"), F.col("spans")).alias("clean")).collect()}
    assert clean[64] == "again [TERM] alone, zorks no" and "z@home.org" not in clean[0] and "[EMAIL]" in clean[0]


def test_terms_beside_an_entity_mentioned_twice_are_marked(spark):
    r = random.Random(5)
    filler = lambda: " ".join(r.choice("alpha beta gamma delta epsilon zeta theta".split()) for _ in range(40))
    texts = [f"{filler()} Quill at q@home.org {filler()}" for _ in range(2)] + [filler() for _ in range(300)]
    texts += [f"{filler()} m{i}@x.org {filler()}" for i in range(60)] + ["only Quill here"]
    got = {x.doc_id: x.spans for x in pii.digest(pii.find_pii(docs_of(spark, texts))).collect()}
    assert got[362] == "term:5:10" and all("term" in got[i] for i in (0, 1)) and not any("term" in got[i] for i in range(2, 362))


def test_pii_of_repeated_null_and_no_rows(spark):
    rows = [(None, "a@b.cd"), (None, None), (1, "x@y.zz"), (1, "x@y.zz"), (1, "none")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(x.doc_id), x.spans) for x in pii.digest(pii.find_pii(d)).collect())
    assert got == sorted([("None", "email:0:6"), ("None", ""), ("1", "email:0:6"), ("1", "email:0:6"), ("1", "")])
    assert pii.find_pii(d.limit(0)).count() == 0


def test_pii_runs_no_python(spark, monkeypatch):
    plans = []
    written = pii.written
    monkeypatch.setattr(pii, "written", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or written(df, name))
    pii.digest(pii.find_pii(docs_of(spark, ["a@b.cd"]))).collect()
    assert len(plans) >= 6 and not any(re.search("Python|Arrow|Pandas", p) for p in plans)


def test_places_of_many_matches_in_one_text(spark):
    t = " ".join(f"ü u{i}@ex{i % 97}.com at 10.0.{i % 250}.7" for i in range(3000))
    x = pii.digest(pii.find_pii(docs_of(spark, [t]))).first()
    assert x.base_sha256 == hashlib.sha256(said(plain_pii(t)).encode()).hexdigest() and x.n_email == x.n_ip == 3000


def plain_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


P, Q = 2**521 - 1, 2**607 - 1
D = pow(65537, -1, (P - 1) * (Q - 1))
RSA = der(0x30, *map(number, (0, P * Q, 65537, D, P, Q, D % (P - 1), D % (Q - 1), pow(Q, -1, P))))
RSA_PUBLIC = der(0x30, number(P * Q), number(65537))
DSA = der(0x30, *map(number, (0, Q, 2**160 + 7, 3, pow(3, 12345, Q), 12345)))
ENCRYPTED = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30)), der(4, bytes(range(64))))
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2b\x65\x70")), der(4, der(4, bytes(range(32)))))
JWT = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256", "typ": "JWT"}).encode(), b'{"sub":"me"}', b"signature-bytes"))
SSH = b"openssh-key-v1\0" + b"\0\0\0\4none" + b"\0\0\0\4none" + b"\0\0\0\0" + b"\0\0\0\1" + bytes(60)


def test_patterns_equal_plain_ones(spark):
    r = random.Random(7)
    parts = ["password", "Token", "API_KEY", "apikey", "ſecret", "toKen", " ", ":", "=", '"', "abcdef12", "deadbeef" * 4, "AKIA", "ABCDEFGH1234", "é", ".", "-", "x"]
    texts = [None, "", "secret" + " " * 1000 + "=abcdefgh", "f" * 100_000, "secret=" * 5000] + ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(400)]
    got = {x.doc_id: x for x in secret_scan.digest(secret_scan.scan_secrets(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = plain_secrets(t or "")
        assert got[i].base_sha256 == hashlib.sha256(said(want).encode()).hexdigest(), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == kind for k, *_ in want) for kind in secret_scan.BASE]


def wrapped(data, end="\n", width=64):
    b = base64.b64encode(data).decode()
    return end.join(b[i : i + width] for i in range(0, len(b), width))


@pytest.mark.parametrize("kind,text", [("der", base64.b64encode(x).decode()) for x in (RSA_PUBLIC, DSA, ENCRYPTED)] + [("der", base64.urlsafe_b64encode(RSA).decode().rstrip("=")), ("der", wrapped(RSA)), ("der", wrapped(RSA, "\\n", 76)), ("der", wrapped(PKCS8, "\r\n  ", 40)), ("openssh", wrapped(SSH, "\n", 70)), ("jwt", JWT), ("der", base64.b64encode(RSA).decode()), ("der", base64.b64encode(PKCS8).decode()), ("der", PKCS8.hex() + "00" * 0 if len(PKCS8) >= 32 else ""), ("openssh", base64.b64encode(SSH).decode())])
def test_structures_are_confirmed(kind, text):
    found = secret_scan.find_secrets(f"é see {text} end".encode())
    assert (kind, 6, 6 + len(text)) in found
    broken = text[:-12] + ("A" * 12 if kind == "jwt" else "")
    if kind == "der":
        assert all(k != kind for k, *_ in secret_scan.find_secrets(f"see {broken[:-8]} end".encode()))


def test_lookalikes_are_not_reported():
    signature = der(0x30, number(2**250 + 12345), number(2**251 + 7))  # two numbers, but no key
    for t in (base64.b64encode(signature).decode(), signature.hex(), wrapped(bytes(range(200))), base64.b64encode(der(0x30, number(0), *(number(i + 2**500) for i in range(8)))).decode(), "eyJhbGciOiJub25l.x.y", "eyJub3Q.abc.def", base64.b64encode(bytes(range(90))).decode(), "30" * 40, "M" * 80):
        assert not [k for k, *_ in secret_scan.find_secrets(t.encode()) if k not in secret_scan.BASE], t


def test_pem_blocks():
    body = base64.b64encode(RSA).decode()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(body[i : i + 64] for i in range(0, len(body), 64)) + "\n-----END RSA PRIVATE KEY-----"
    assert ("pem", 2, 2 + len(pem)) in secret_scan.find_secrets(f"a {pem}".encode())
    escaped = pem.replace("\n", "\\n")
    assert ("pem", 3, 3 + len(escaped)) in secret_scan.find_secrets(f'k="{escaped}"'.encode())
    locked = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011\n\n" + wrapped(bytes(range(64))) + "\n-----END RSA PRIVATE KEY-----"
    assert ("pem", 0, len(locked)) in secret_scan.find_secrets(locked.encode())
    assert "pem" not in {k for k, *_ in secret_scan.find_secrets(("-----BEGIN A-----" * 20_000 + "-----END B-----").encode())}
    assert not [k for k, *_ in secret_scan.find_secrets(pem.replace("RSA", "X").replace(body[4:20], "A" * 16).encode()) if k == "pem"]


def test_secrets_of_repeated_and_null_ids(spark):
    d = spark.createDataFrame([(None, "password=abcdefgh"), (None, None), (1, "x"), (1, "x"), (1, f"é {JWT}")], "doc_id long, text string")
    got = sorted((str(x.doc_id), x.spans) for x in secret_scan.digest(secret_scan.scan_secrets(d)).collect())
    assert got == sorted([("None", "assign:0:17"), ("None", ""), ("1", ""), ("1", ""), ("1", f"jwt:2:{2 + len(JWT)}")])


def test_secrets_of_no_rows(spark):
    assert secret_scan.digest(secret_scan.scan_secrets(docs_of(spark, ["x"]).limit(0))).count() == 0
