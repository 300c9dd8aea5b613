import hashlib
import re

from tapeline.llm import pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda d=d: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "plain words", "x@y@z.com a@b.c_d@e.f a@b. q@-.-", "é😀 mail: jo.e@mail.example.com, x", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3", "card 4111 1111-1111 1111 and 4111111111111112 5500005555555559",
    "+1 (213) 555-2625 it +12 34 +123456789 +1234567890123456", "pay 4111  1111 1111 1111", "IBAN DE89 3704 0044 0532 0130 00 ok, GB82WEST12345698765432, DE00370400440532013000", "ssn 123-45-6789 but 123-45-6789 order 000-12-3456", "call (213) 555-2625 now",
    "9" * 5000 + " " + "7.7.7.7 " * 900 + "a" * 20000 + "@b" + ".c" * 5000 + " " + "1 " * 8000, "a@b.co\n1.1.1.1\n", "4111111111111111" * 2,
]


def test_base_spans_equal_brute_force(spark):
    rows = [(i, t, "keep") for i, t in enumerate(TEXTS)] + [(1, "", "again"), (None, "a@b.co", "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    got = {(r.doc_id, r.n_email): r for r in pii.digest(pii.find_pii(docs)).collect()}
    assert len(pii.digest(pii.find_pii(docs)).collect()) == len(rows)
    for i, t, _ in rows:
        want = brute(t)
        r = got[(i, sum(k == "email" for k, *_ in want))]
        assert [r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in want) for x in ("ip", "card", "phone")], i
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), i
        assert r.spans.split(",")[: len(want)] == [f"{k}:{s}:{e}" for k, s, e in want] or not want


def test_added_kinds_need_checksum_or_context(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    kinds = {r.doc_id: [s.value for s in r.pii if s.kind not in pii.BASE_KINDS] for r in pii.find_pii(docs).collect()}
    assert kinds[9] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert kinds[10] == ["123-45-6789"] and kinds[11] == ["(213) 555-2625"] and kinds[7] == []
    red = {r.doc_id: r.text for r in pii.redact(pii.find_pii(docs)).collect()}
    assert red[4] == "é😀 mail: [email], x" and red[0] is None
    twice = spark.createDataFrame([(1, "1.1.1.1 21.1.1.1 end 1.1.1.1"), (2, "none")], "doc_id long, text string")
    assert sorted(r.text for r in pii.redact(pii.find_pii(twice)).collect()) == ["[ip] [ip] end [ip]", "none"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(pii.find_pii(docs)).collect() == []
