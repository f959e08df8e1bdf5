"""Cases that were lost in earlier versions of the operators."""

import datetime
import hashlib
import re
import string

from glossa.llm import licenses, pii


def test_values_followed_by_other_tokens(spark):
    ibans = ["BE68 5390 0754 7034", "AT611904300234573201", "DE89 3704 0044 0532 0130 00", "PL61 1090 1014 0000 0712 1981 2874", "ES91 2100 0418 4502 0005 1332", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    texts = [f"to {v} {after}" for v in ibans for after in ("EUR", "2024", "A", "12", "", "and")]
    long = ["password=" + "aB3" * 60, "sk-" + "xY9" * 30, "token: " + "q1" * 2000]
    rows = spark.createDataFrame(list(enumerate([*texts, *[f"x {v} y" for v in long]])), "doc_id long, text string")
    got = [r for r in pii.pseudonymised(rows).orderBy("doc_id").collect()]
    for i, text in enumerate(texts):
        value, out = ibans[i // 6], got[i].text
        assert got[i].n_iban == 1 and value not in out and len(out) == len(text) and out[3 + len(value) :] == text[3 + len(value) :]
        plain = out[3 : 3 + len(value)].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    for r, v in zip(got[len(texts) :], long, strict=True):
        assert r.n_secret == 1 and v not in r.text and len(r.text) == len(v) + 4


def _noise(key, kind, *parts):
    return hashlib.sha256("\x1f".join([key, kind, *map(str, parts), key]).encode()).hexdigest()


def _plain_permuted(x, key, kind):
    """The Feistel rounds over a string's letters and digits, written apart from the operator."""
    alphabets = [string.digits, string.ascii_lowercase, string.ascii_uppercase]
    symbols = [c for c in x if c in "".join(alphabets)]
    left, right = symbols[: len(symbols) // 2], symbols[len(symbols) // 2 :]
    for r in range(1, 9):
        moved = []
        for i, c in enumerate(left):
            k = int(_noise(key, kind, r, "".join(right) + f"\x1e{i // 16}")[i % 16 * 4 :][:4], 16)
            a = next(a for a in alphabets if c in a)
            moved.append(a[(a.index(c) + k) % len(a)])
        left, right = right, moved
    done = iter([*left, *right])
    return "".join(next(done) if c in "".join(alphabets) else c for c in x)


def _plain_number(n, a, b, key, kind):
    hi, lo = divmod(n, b)
    for r in range(1, 9):
        if r % 2 == 0:
            hi = (hi + int(_noise(key, kind, r, lo)[:14], 16)) % a
        else:
            lo = (lo + int(_noise(key, kind, r, hi)[:14], 16)) % b
    return hi * b + lo


def _plain_pseudonym(x, kind, key):
    if kind == "date":
        first = datetime.date(1800, 1, 1)
        days = [first + datetime.timedelta(d) for d in range(146097)]
        if "/" in x and int(x[3:5]) > 12:
            late = [d for d in days if d.day > 12]
            at = late.index(datetime.date(int(x[6:]), int(x[:2]), int(x[3:5])))
            return late[_plain_number(at, 9, 9833, key, "late-date")].strftime("%m/%d/%Y")
        form = "%Y-%m-%d" if "-" in x else "%d.%m.%Y" if "." in x else "%d/%m/%Y"
        return days[_plain_number((datetime.datetime.strptime(x, form).date() - first).days, 27, 5411, key, "date")].strftime(form)
    if kind == "ssn":
        areas = [a for a in range(1, 900) if a != 666]
        a, g, s = map(int, x.split("-"))
        n = _plain_number((areas.index(a) * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, key, "ssn")
        return f"{areas[n // (99 * 9999)]:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"
    if kind == "ip":
        sets = [{1: range(10), 2: range(10, 100), 3: range(100, 256)}[len(o)] for o in x.split(".")]
        r = [s.index(int(o)) for s, o in zip(sets, x.split("."), strict=True)]
        b = len(sets[2]) * len(sets[3])
        n = _plain_number((r[0] * len(sets[1]) + r[1]) * b + r[2] * len(sets[3]) + r[3], len(sets[0]) * len(sets[1]), b, key, "ip")
        hi, lo = divmod(n, b)
        return ".".join(str(s[i]) for s, i in zip(sets, [*divmod(hi, len(sets[1])), *divmod(lo, len(sets[3]))], strict=True))
    if kind == "card":
        plain = [c for c in x if c.isdigit()]
        body = _plain_permuted("".join(plain[:-1]), key, "card")
        total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        done = iter(body + str(-total % 10))
        return "".join(next(done) if c.isdigit() else c for c in x)
    if kind == "email":
        name, at = x.rsplit("@", 1)
        domain, top = at.rsplit(".", 1)
        return f"{_plain_permuted(name, key, 'name')}@{_plain_permuted(domain, key, 'domain')}.{top}"
    if kind == "phone":
        head = re.match(r"(?:\+[0-9]{1,3}(?:[ .-]|(?=\())?)?", x)[0]
        return head + _plain_permuted(x[len(head) :], key, "phone")
    raise ValueError(kind)


def test_pseudonyms_by_plain_code(spark):
    values = [
        ("29/02/2024", "date"), ("02/29/2024", "date"), ("12/13/1999", "date"), ("13/12/1999", "date"), ("2199-12-31", "date"), ("01.01.1800", "date"), ("123-45-6789", "ssn"), ("899-99-9999", "ssn"), ("667-01-0001", "ssn"),
        ("10.1.1.1", "ip"), ("255.255.255.255", "ip"), ("0.0.0.0", "ip"), ("192.168.10.7", "ip"), ("4337166598464399", "card"), ("4337-1665-9846-4399", "card"), ("a@b.co", "email"), ("Bob.42+" + "x" * 50 + "@mail-8.example.org", "email"), ("+1 (988) 555-2485", "phone"), ("988-555-2485", "phone"),
    ]
    rows = spark.createDataFrame([(i, f"see {v} and") for i, (v, _) in enumerate(values)], "doc_id long, text string")
    for r in pii.pseudonymised(rows, "k1").collect():
        v, kind = values[r.doc_id]
        assert r.text == f"see {_plain_pseudonym(v, kind, 'k1')} and" and r[f"n_{kind}"] == 1, (v, r.text)


def test_different_values_get_different_pseudonyms(spark):
    every = [f"{a:02d}/{b:02d}/{y}" for y in (1999, 2024) for a in range(1, 32) for b in range(1, 32)]
    every += [f"{a}.{b}.1.{c}" for a in (1, 10, 100, 255) for b in range(0, 256, 17) for c in range(256)]
    every += ["010.1.1.1", "010.001.1.1", "1.01.1.1"] + [f"{a:03d}-{g:02d}-0001" for a in range(1, 900, 7) for g in (1, 99)]
    out = pii.pseudonymised(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")).collect()
    assert len({r.text for r in out}) == len(set(every)) and all(len(r.text) == len(every[r.doc_id]) for r in out)
    assert [r.text for r in out if r.doc_id in (every.index("010.1.1.1"), every.index("31/31/1999"))] == ["31/31/1999", "010.1.1.1"]


def test_pii_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x 1.2.3.4", "a", "b", 5, "c")], "doc_id long, text string, found string, made string, n_pii int, `a.b` string")
    got = pii.pseudonymised(df)
    assert got.columns[:5] == ["doc_id", "text", "found", "made", "a.b"] and got.first()[2:5] == ("a", "b", "c") and got.first()["n_pii"] == 1
    long = spark.createDataFrame([(1, "mail a@b.co " * 40000), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_email for r in pii.pseudonymised(long).collect()} == {1: 40000, 2: 0}


def test_values_beyond_earlier_bounds_are_found(spark):
    long_domain, long_name = "me@" + ".".join("abcdefghijkl") + ".com", "n" * 90 + "@site.org"
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVPmB92K27uhbUJU1p1r"
    texts = [long_domain, long_name, "password      =       hunter2hunter2", "glpat-" + "aB3_" * 6, f"bearer {jwt}"]
    out = [r.text for r in pii.pseudonymised(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").orderBy("doc_id")).orderBy("doc_id").collect()]
    assert all(a != b and len(a) == len(b) for a, b in zip(texts, out, strict=True))
    assert out[0].endswith(".com") and out[1].endswith("@" + out[1].rpartition("@")[2]) and out[2].startswith("password      =       ") and out[3].startswith("glpat-") and "eyJ" in out[4]


def test_late_ids_of_an_expression_are_found(spark):
    ids = " OR ".join(["MIT", "Apache-2.0", "GPL-2.0-only", "LGPL-2.1-only", "MPL-2.0", "EPL-2.0", "BSD-3-Clause", "ISC", "AGPL-3.0-only", "BSD-2-Clause"] * 4 + ["Zlib"])
    row = licenses.scanned(spark.createDataFrame([(1, f"SPDX-License-Identifier: {ids} end")], "doc_id long, text string")).first()
    assert "zlib" in row.labels.split(",")
