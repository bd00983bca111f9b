import hashlib
import re
import time

import duckdb

from duelframe.llm import license_scan, secret_scan
from duelframe.llm.common import settle

from ..conftest import SF


def plain_spans(text):
    """The base kinds by the plainest reading of their definitions."""
    out = []
    name = "|".join(["password", "passwd", "secret", "token", "api_?key"])
    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)
    for m in re.finditer("(" + either + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m.group()) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)), [sum(k == n for _, k, _ in out) for n in range(3)]


CASES = [None, "", "password: short", "PASSWORD = 'abcdefgh1'", "Api_Key:abc=defgh", "ſecret=abcdefghij", "toKen=abcdefghi", "é😀 token='0123456789'",
         "AKIA" + "A" * 12, "AKIA" + "A" * 11, "f" * 32, "g" + "0" * 31, "token: secret=abcdefgh1234", "secret" * 2000, "[0-9a-f]" * 50, "a" * 100_000 + " token=" + "b" * 50_000]


def test_base_spans(spark):
    texts = CASES + [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    docs = settle(spark).createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        joined, counts = plain_spans(text or "")
        r = found[k]
        assert [r.n_assign, r.n_access, r.n_hex] == counts
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("literal")] == [s for s in joined.split(",") if s]
    assert list(found[0].asDict()) == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal", "best_score"]
    assert sum(found[k].n_hex for k in found) >= 3 and secret_scan.scan(docs.limit(0)).count() == 0


def literal_texts(text):
    return [text[a:b] for a, b in sorted(secret_scan.literals(text))]


def test_literals_of_sensitive_names():
    assert literal_texts('db_password := "tr0ub4dor&3x!"') == ["tr0ub4dor&3x!"]
    assert literal_texts('{"clientSecret": "q8Zr71LmX0pA"}') == ["q8Zr71LmX0pA"]
    assert literal_texts("auth-token => 'k2Jd93mQz7'") == ["k2Jd93mQz7"]
    assert literal_texts("title = 'k2Jd93mQz7'\nnote: q8Zr71LmX0pA") == []
    assert literal_texts("password = changeme\nsecret='xxxxxxxxxxxx'\napi_key: aaaaaaaaaaaa") == []


def test_short_literals_and_long_names():
    assert literal_texts('db_pass = "k2Jd93mQ"') == literal_texts("pwd: k2Jd93mQ") == literal_texts("hmac_key: k2Jd93mQ") == ["k2Jd93mQ"]
    assert literal_texts("salt = k2Jdk79J") == ["k2Jdk79J"] and literal_texts("salt = aaaaaaab") == []
    assert literal_texts("a." * 200 + "secret = q8Zr71LmX0pA") == ["q8Zr71LmX0pA"]


def test_constants_are_propagated():
    text = 'seed = "q8Zr71LmX0pA"\nother = seed\nsettings.password = other\n'
    assert literal_texts(text) == ["q8Zr71LmX0pA"]
    assert literal_texts('a = "q8Zr7"\nb = "1LmX0"\nsecret = a + b') == ["q8Zr7", "1LmX0"]
    assert literal_texts('secret = seed\nseed = "q8Zr71LmX0pA"') == []
    assert secret_scan.sensitivity("DB_PASSWORD") == secret_scan.sensitivity("dbPassword") == 1.0 and secret_scan.sensitivity("monkey") == 0.0


Q = "q8Zr71LmX0pA"
SYNTAX = [
    'config["password"] = "%s"', "os.environ['SECRET_KEY'] = '%s'", 'secret = b"%s"', 'auth_token=f"%s"', 'const password: string = "%s"', 'secret = ("%s")',
    "password = `%s`", 'private_key = """%s"""', "secret = '''%s'''", "signing_key: |\n  %s\nother: 1", "<password>%s</password>", '<dbx><api_key a="b"> %s </api_key>',
    'let apiKey: Option<str> = "%s"', "token: str='%s'", "secret = [\n  '%s',\n]", "passwords = {}\npassword =\t'%s'",
]


def test_syntax():
    for line in SYNTAX:
        assert literal_texts(line % Q) == [Q], line
        assert literal_texts("x = 1\n" + line % "title" + "\n") == [], line
    assert literal_texts('password = ["q8Zr71LmX0pA", "k2Jd93mQz7", "short"]') == ["q8Zr71LmX0pA", "k2Jd93mQz7"]
    assert literal_texts('secret = "q8Zr7" "1LmX0pA"') == ["q8Zr7", "1LmX0pA"]
    assert literal_texts('password = "q8Z\\"r71LmX0pA"') == ['q8Z\\"r71LmX0pA']
    assert literal_texts('secret = get_secret_value("path/to/the/vault")') == []
    assert literal_texts("signing_key: |\n  q8Zr71LmX0pA\n  k2Jd93mQz7\nother: 1") == ["q8Zr71LmX0pA\n  k2Jd93mQz7"]
    assert literal_texts("keys = ['q8Zr71LmX0pA', 'k2Jd93mQz7']\nsecret = keys") == ["q8Zr71LmX0pA", "k2Jd93mQz7"]


def test_sums_have_no_cap():
    parts = [f"p{k}x" for k in range(300)]
    assert literal_texts("secret = " + " + ".join(f'"{x}"' for x in parts)) == parts
    chain = 'a0 = "q8Zr71"\n' + "".join(f'a{k} = a{k - 1} + "{x}"\n' for k, x in enumerate(parts, 1)) + f"secret = a{len(parts)}"
    assert literal_texts(chain) == ["q8Zr71", *parts]
    # Doubling names a value of astronomic length and costs what is written.
    assert literal_texts('a0 = "q8Zr71"\n' + "".join(f"a{k} = a{k - 1} + a{k - 1}\n" for k in range(1, 200)) + "secret = a199") == ["q8Zr71"]


def test_the_best_name_counts():
    found = secret_scan.literals('x = "q8Zr71LmX0pA"\nsalt = x\npassword = x\n')
    assert list(found.values()) == list(secret_scan.literals('password = "q8Zr71LmX0pA"').values())


def test_unclosed_and_long():
    for text in ('secret = "' + "a" * 200_000, "secret = (" * 20_000, "a: b " * 50_000, "<a>" * 20_000, "secret = '''" + "x'" * 50_000,
                 "password: |\n" + " x\n" * 50_000, 'k = "\\' * 50_000, "a = [" * 3_000, "a:b" * 50_000):
        began = time.time()
        secret_scan.literals(text)
        assert time.time() - began < 5, text[:20]


def licenses(spark, rows, **settings):
    docs = settle(spark).createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, license string, at int")
    return sorted(((r.doc_id, r.license, round(r.containment, 6), r.first_word) for r in license_scan.scan(docs, **settings).collect()), key=str)


def test_licenses(spark):
    gpl = license_scan.TEMPLATES["GPL-3.0"]
    rows = [(1, "So. RELEASED under the\nMIT license!"), (2, None), (3, ""), (4, "under the MIT License"), (5, "x " * 20_000 + license_scan.TEMPLATES["Apache-2.0"]),
            (6, "a b " + gpl[5:]), (7, gpl.replace("General", "Special")), (None, gpl), (1, "Released under the MIT License. Released under the MIT License.")]
    assert licenses(spark, rows) == sorted([(1, "MIT", 1.0, 0), (5, "Apache-2.0", 1.0, 20_000), (6, "GPL-3.0", 0.875, 1), (None, "GPL-3.0", 1.0, 0)], key=str)
    assert licenses(spark, []) == [] and licenses(spark, rows, templates={}) == [] and licenses(spark, rows, templates={"short": "a b"}) == []


def test_long_template(spark):
    body = " ".join(f"word{k}" for k in range(60))
    edited = " ".join("other" if k == 30 else f"word{k}" for k in range(60))
    assert licenses(spark, [(1, "x " + body), (2, edited), (3, " ".join(body.split()[:40]))], templates={"own": body}) == [(1, "own", 1.0, 1), (2, "own", round(51 / 56, 6), 0)]


def test_bands_guarantee_collisions():
    for shingles in (1, 3, 8, 56, 400):
        n = license_scan.bands(shingles, 0.8, 1e-4)
        x = -(-8 * shingles // 10)
        assert (1 - x / (2 * shingles - x)) ** n <= 1e-4
