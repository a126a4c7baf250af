import hashlib
import re

import pytest

from rupaka.llm import op6_pii as pii
from tests.llm.common import same

E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
I = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
C = re.compile(r"[0-9]([\x20-]?[0-9])+")
P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def plain(text):
    text = text or ""
    ok = {
        "email": (E, lambda s: True),
        "ip": (I, lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (C, lambda s: 16 <= sum(c.isdigit() for c in s) <= 19 and luhn(s)),
        "phone": (P, lambda s: 8 <= sum(c.isdigit() for c in s) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (r, f) in ok.items() for m in r.finditer(text) if f(m[0])]


TEXTS = [
    None,
    "",
    "no data here",
    "a@b.c%d@e.f x@y x@y.z..q@w.e a.b@c-d.co.",
    "😀 é me@x.org 10.0.0.1 1.2.3.4.5.6.7.8 256.1.1.1 0255.001.0.9",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4713332104704538 4713 332104704538 99",
    "call +1 (499) 555-6503 or +49 30 1234567 or +1 2 or +123456789012345678",
    "0000000000000000 " + "1" * 30000 + " " + "1 " * 20000,
    "@" * 3000 + "a" * 60000,
    "a@b" + ".c" * 20000,
    "+1" + "(" * 30000,
    "IBAN DE89 3704 0044 0532 0130 00 ok, GB82WEST12345698765432, DE89 3704 0044 0532 0130 01",
    "phone 212 555 0187; the number 212 555 0187 as such; fax (212) 555-0187",
    "mail a@b.cc " * 1500,
]


def test_spans_match_a_plain_scan(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = pii.find_pii(df)
    for r in found.collect():
        base = [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE]
        assert base == plain(TEXTS[r.doc_id]), TEXTS[r.doc_id] and TEXTS[r.doc_id][:80]
    by = {r.doc_id: r.spans for r in found.collect()}
    assert [TEXTS[11][s.start : s.end] for s in by[11] if s.kind == "iban"] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert [s.start for s in by[12] if s.kind == "local_phone"][0] == 6


def test_driver_table(spark, sf):
    from rupaka.llm.common import table

    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in pii.op6_personal_data(spark, sf).collect():
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in pii.BASE)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_against_sql(spark, folder):
    d = f"/root/testdata/{folder}"
    same(pii.op6_personal_data(spark, d), pii.SQL, d)


def test_redaction_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x", "mail me@x.org or 10.0.0.1!", "q"), (1, "y", "mail me@x.org or 10.0.0.1!", "q"), (2, None, None, None)], "doc_id long, spans string, text string, base string")
    out = pii.find_pii(df).select("doc_id", pii.redacted(pii.F.col("text"), pii.F.col("spans")).alias("t")).collect()
    assert sorted(r.t for r in out) == ["", "mail [EMAIL] or [IP]!", "mail [EMAIL] or [IP]!"]
    assert pii.find_pii(df.limit(0)).count() == 0


def test_ibans_whatever_follows(spark):
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947"
    after = ["", " BIC COBADEFFXXX", " 00 EUR 500", " I paid", " EUR", ", ok", f" {gb} X", f" {no} {de} 12"]
    texts = [f"KONTO {n}{a}" for n in (de, de.replace(" ", ""), gb, no) for a in after]
    texts += [f"AT12 {de}", f"ZZ12 {de} 00", "A" + de, de + "A", de[:-1] + "1", "DE89 " * 400 + de]
    out = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in out:
        t, found = texts[r.doc_id], [(s.start, s.end) for s in r.spans if s.kind == "iban"]
        want = {(m.start(), m.end()) for n in (de, de.replace(" ", ""), gb, no) for m in re.finditer(rf"(?<![A-Za-z0-9]){n}(?![A-Za-z0-9])", t)}
        assert found == sorted(want), t


def test_context_reaches_past_neighbours_of_the_kind(spark):
    n = "212 555 01%02d"
    texts = ["phone 212 555 0187, 212 555 0188", "212 555 0187, 212 555 0188 fax", "phone " + ", ".join(n % k for k in range(6)), "phone" + " " * 40 + "212 555 0187", "phone" + " " * 36 + "212 555 0187"]
    for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        t = texts[r.doc_id]
        near = lambda m: t[max(0, m.start() - pii.NEAR) : m.start()] + " " + t[m.end() : m.end() + pii.NEAR]
        want = [(m.start(), m.end()) for m in re.finditer(r"\d{3} \d{3} \d{4}", t) if re.search("phone|call|tel|fax|mobile", near(m))]
        assert [(s.start, s.end) for s in r.spans] == want, t
