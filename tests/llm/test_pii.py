import hashlib
import random
import re

from paysleuth.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn_ok(d):
    odd, even = d[-1::-2], d[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def plain(text):
    def digits(m):
        return re.sub(r"\D", "", m[0])

    out = [("email", m.start(), m.end()) for m in re.finditer(EMAIL, text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [
        ("card", m.start(), m.end())
        for m in re.finditer(CARD, text)
        if 13 <= len(digits(m)) <= 19 and luhn_ok(digits(m))
    ]
    out += [("phone", m.start(), m.end()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m)) <= 15]
    return out


def base(text):
    return [(s["kind"], s["start"], s["end"]) for s in pii.find_spans(text) if s["kind"] in pii.BASE_KINDS]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(7)
    pieces = ["a@b.c", "x.y@", "@", "@d-e.org", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8", "+1 (262) 555-3752", "+", "é",
              "4111 1111 1111 1111", "4111-1111-1111-1112", "0", "7 ", "-", ".", " ", "a", "%", "Z9", "+49 30 1234567",
              "378282246310005", "00012.0.0.1", "\n", "(", ")", "DE89 3704 0044 0532 0130 00", "078-05-1120"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert base(text) == plain(text), text


def test_added_kinds_need_a_checksum_or_context():
    kinds = lambda t: [s["kind"] for s in pii.find_spans(t) if s["kind"] in pii.ADDED_KINDS]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 ok") == ["iban"]
    assert kinds("IBAN DE89 3704 0044 0532 0130 01 ok") == []
    assert kinds("her ssn: 078-05-1120") == ["ssn"] and kinds("part 078-05-1120") == []
    assert kinds("call 212-555-0188 now") == ["national_phone"] and kinds("no 212-555-0188") == []


def test_long_texts_take_linear_time():
    for text in ("a" * 2_000_000 + "@", "7" * 2_000_000, "+1" + "(" * 1_000_000, "a@" * 300_000, "1." * 500_000):
        pii.find_spans(text)


def test_digest(spark):
    rows = [(1, "write a@b.org or +49 30 1234567", "x"), (2, None, "y"), (2, None, "y"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.pii_digest(docs).collect()}
    assert pii.pii_digest(docs).count() == 4
    assert got[1]["spans"] == "email:6:13,phone:17:31" and got[1]["n_email"] == 1 and got[1]["n_card"] == 0
    assert got[1]["base_sha256"] == hashlib.sha256(b"email:6:13,phone:17:31").hexdigest()
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.pii_digest(docs.limit(0)).count() == 0
