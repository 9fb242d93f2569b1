import hashlib
import random
import re

from tests.llm.data import DOCS, awkward, frame
from tracewell.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for k, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    spans = [(m.start(), k, m.end()) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text or "") if valid(kind, m[0])]
    named = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]
    return (*(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(",".join(named).encode()).hexdigest(), named)


def noisy():
    rng = random.Random(9)
    bits = ["4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "00000000001.002.3.4", "99999999999999999999.1.1.1", "+49 (30) 1234-567", "+1", "+123456789", "+1234567890123456", "a@b.c_d@e.f", "x.y@z.example", "@", "a@b", "a@b.", "é@ü.de", "a.b@c.d.e-", "😀", " ", "\n", "word", "-", ".", "12", "7" * 11, "7" * 12, "7" * 25, "0" * 16, "contact jane (at) site (dot) org", "call 555-123-4567", "(555) 123 4567"]
    return awkward() + bits + ["".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(1, 40))) for _ in range(150)] + ["1 " * 20_000, "+" + "9" * 3000, "a" * 50_000 + "@"]


def test_base_spans_match_plain_patterns(spark):
    texts = noisy()
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(frame(spark, texts).repartition(4))).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        *n, sha, named = brute(text)
        r = got[i]
        assert [r[f"n_{k}"] for k in PLAIN] == n and r["base_sha256"] == sha, (text, r)
        assert set(named) <= set(filter(None, r["spans"].split(",")))


def test_reliabilities_and_classifier():
    counts = {"phone 1 1 1": 400, "phone 1 1 0": 300, "phone 0 1 1": 40, "phone -1 0 -1": 500, "phone -1 0 0": 300, "phone 0 0 0": 50}
    p = pii.expectation_maximisation(counts)
    assert p["phone 1 1 0"] > 0.95 > 0.5 > 0.05 > p["phone -1 0 0"]
    q = pii.train_classifier({"phone short some": (0.95, 300), "phone short few": (0.9, 40), "phone long few": (0.03, 500)})
    assert q["phone short some"] > q["phone short few"] > 0.5 > q["phone long few"]
    assert pii.expectation_maximisation({}) == {} and pii.train_classifier({}) == {}


def planted(seed=4, n=400):
    """(texts, (text, start, end) of personal spans that no base pattern takes, of look-alikes that aren't personal)."""
    rng = random.Random(seed)
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    digits = lambda k: "".join(rng.choice("23456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghimnorstuv") for _ in range(rng.randint(2, 9)))
    true = [
        lambda: (rng.choice(["password=", "login password: ", "the token = \""]), hexa(rng.choice([18, 24, 40]))), lambda: ("", "AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16))),
        lambda: (rng.choice(["call ", "phone: ", ""]), f"({digits(3)}) {digits(3)}-{digits(4)}"), lambda: (rng.choice(["contact ", "mail ", ""]), f"{word()} (at) {word()} (dot) {rng.choice(['com', 'org', 'de'])}"),
    ]
    false = [
        lambda: ("file ", f"{word()}-{word()}-{word()}-{word()}{rng.randint(1, 99)}"), lambda: ("version ", f"{word()}{word()}{word()}{rng.randint(1, 999)}"),
        lambda: (rng.choice(["order ", "invoice ", ""]), f"1{rng.randint(10, 99)} {rng.randint(100, 999)} 0000"),
    ]
    texts, good, bad = [], set(), set()
    for i in range(n):
        text = ""
        for _ in range(rng.randint(1, 4)):
            text += " ".join(word() for _ in range(rng.randint(1, 12))) + " "
            own, makers = (good, true) if rng.random() < 0.6 else (bad, false)
            lead, value = rng.choice(makers)()
            text += lead
            own.add((i, len(text), len(text) + len(value)))
            text += value + rng.choice([" ", ", ", "\n"])
        texts.append(text + word())
    return texts, good, bad


def test_added_spans_gain_over_the_base(spark):
    texts, good, bad = planted()
    rows = pii.find_pii(frame(spark, texts).repartition(3)).collect()
    base = {(r["doc_id"], x["start"], x["end"]) for r in rows for x in r["base"]}
    added = {(r["doc_id"], x["start"], x["end"]) for r in rows for x in r["spans"]} - base
    assert not base & good
    right = len(added & good)
    assert right / len(good) > 0.85 and right / len(added) > 0.95, (right, len(good), len(added))
    assert len(added & bad) < 0.05 * len(bad)


def test_very_many_matches_and_very_long_ones(spark):
    texts = ["a [at] b" + " [dot] c" * 20_000, "x@y.io " * 100_000, "+49 30 1234567, " * 20_000, "k9" * 200_000, "1.2.3.4 " * 30_000, "(555) 234-4567 " * 20_000, "4111 1111 1111 1111, " * 5_000]
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(frame(spark, texts).repartition(4))).collect()}
    assert [got[1]["n_email"], got[2]["n_phone"], got[4]["n_ip"], got[6]["n_card"]] == [100_000, 20_000, 30_000, 5_000]
    for i in (1, 2, 4, 6):
        *_, sha, _ = brute(texts[i])
        assert got[i]["base_sha256"] == sha


def test_empty_and_repeats(spark):
    assert pii.find_pii(spark.createDataFrame([], DOCS)).collect() == []
    got = pii.digest(pii.find_pii(frame(spark, ["a@b.co", "a@b.co", None], [1, 1, None]))).collect()
    assert sorted(r["n_email"] for r in got) == [0, 1, 1]


def test_main_path_has_no_python(spark):
    plan = pii.digest(pii.find_pii(frame(spark, ["a@b.co"])))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
