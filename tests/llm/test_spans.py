"""Secrets and personal data against plain regular expressions in Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dialgauge.llm import pii, secrets

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"


def luhn(number):
    total = 0
    for k, d in enumerate(reversed(re.sub(r"\D", "", number))):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits(v):
    return len(re.sub(r"[^0-9]", "", v))


PII = [
    ("email", EMAIL, lambda m: True),
    ("ip", IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", CARD, lambda m: 12 <= digits(m[0]) <= 19 and luhn(m[0])),
    ("phone", PHONE, lambda m: 9 <= digits(m[0]) <= 15),
]
SECRETS = [
    ("assign", ASSIGN, lambda m: len(m[2]) >= 8),
    ("access", ACCESS, lambda m: len(m[0]) >= 16),
    ("hex", HEX, lambda m: len(m[0]) >= 32),
]


def base(text, kinds):
    out = []
    for rank, (kind, pattern, valid) in enumerate(kinds):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if valid(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def check(rows, texts, kinds):
    for row in rows:
        want = base(texts[row["doc_id"]], kinds)
        assert row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (texts[row["doc_id"]][:300], want, row)
        for kind, *_ in kinds:
            assert row[f"n_{kind}"] == len(re.findall(rf"\b{kind}:", want))
        assert set(filter(None, want.split(","))) <= set(row["spans"].split(","))


def noise(seed, alphabet, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


PII_PARTS = ["1", "2", "255", "256", "0", "4539 1488 0343 6467", "12", "-", " ", ".", "..", "@", "a", "b_c", "+", "+1 (", ")", "é", "_", "\n", "😀"]
SECRET_PARTS = ["token", "api_key", "APIKEY", "secret", "ſecret", "=", ":", '"', "'", " ", "abcdefgh", "a1", "AKIA", "AKIAABCDEFGHIJKL", "Z9", "deadbeef" * 4, "f", "\n", "é", "😀", "."]


def test_pii_noise(make_docs):
    texts = noise(1, PII_PARTS, 1500) + ["a@b.c_d@e.f", "x@y..z", "a@b.c.", "1.2.3.4.5.6.7.8", "12--34567890123452"]
    check(pii.digests(pii.find_pii(make_docs(texts))).collect(), texts, PII)


def test_secret_noise(make_docs):
    texts = noise(2, SECRET_PARTS, 1500) + ["token=secret:abcdefgh1", "token==abcdefgh"]
    check(secrets.digests(secrets.find_secrets(make_docs(texts))).collect(), texts, SECRETS)


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check(pii.digests(pii.find_pii(docs)).collect(), texts, PII)
    check(secrets.digests(secrets.find_secrets(docs)).collect(), texts, SECRETS)


def test_awkward(awkward, no_docs):
    for found in (pii.digests(pii.find_pii(awkward)), secrets.digests(secrets.find_secrets(awkward))):
        rows = found.collect()
        assert len(rows) == 9 and {r["spans"] for r in rows} == {""}
        assert {r["base_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_pii(no_docs).count() == 0 and secrets.find_secrets(no_docs).count() == 0


def test_long_runs_do_not_crash(make_docs):
    texts = ["1 2" * 40_000, "a@b" + ".c" * 40_000, "9" * 10_000, "token=" + "ab" * 40_000, "x" * 10_000 + "@"]
    check(pii.digests(pii.find_pii(make_docs(texts))).collect(), texts, PII)
    check(secrets.digests(secrets.find_secrets(make_docs(texts))).collect(), texts, SECRETS)


def test_own_kinds(make_docs):
    texts = ["pay to IBAN DE89 3704 0044 0532 0130 00 now", "IBAN DE88 3704 0044 0532 0130 00", "my ssn 219-09-9999", "part 219-09-9999"]
    rows = {r["doc_id"]: r["spans"] for r in pii.digests(pii.find_pii(make_docs(texts))).collect()}
    assert rows[0] == "iban:12:39" and rows[1] == "" and rows[2] == "ssn:7:18" and rows[3] == ""


def test_context_moves_the_score(make_docs):
    texts = ["call me: +1 (275) 555-5927", "see +1 (275) 555-5927", "serial +1 (275) 555-5927"]
    found = pii.find_pii(make_docs(texts)).select("doc_id", F.col("spans")[0]["score"].alias("score"))
    score = {r["doc_id"]: r["score"] for r in found.collect()}
    assert score[0] > score[1] > score[2]


@pytest.fixture(scope="module")
def random_tokens():
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    return ["".join(rng.choice(alphabet) for _ in range(64)) for _ in range(40)]


def test_battery_finds_random_tokens_only(make_docs, random_tokens):
    usual = ["internationalization", "counterrevolutionary", "incomprehensibilities", "electroencephalograph"]
    texts = [f"value {t} end" for t in random_tokens]
    texts += [f"plain {w} text" for w in usual * 10] + ["a/path/that/goes/through/many/folders/of/text", "x" * 64, "no" * 32]
    rows = {r["doc_id"]: r["spans"] for r in secrets.digests(secrets.find_secrets(make_docs(texts))).collect()}
    found = [k for k in range(40) if rows[k] == "random:6:70"]
    assert len(found) >= 36
    assert all(not rows[k] for k in range(40, len(texts)))


def test_redaction(make_docs):
    docs = make_docs(['é token = "abcdefghij" x', None, "clean", "deadbeef" * 5])
    rows = {r["doc_id"]: r for r in secrets.redacted(docs).collect()}
    assert rows[0]["text"] == 'é [SECRET]" x' and rows[1]["text"] is None
    assert rows[2]["text"] == "clean" and rows[3]["text"] == "[SECRET]"
    assert secrets.redacted(docs).columns == docs.columns




ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
SIZES = {"hex": 16, "HEX": 16, "base32": 32, "base64": 64}
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
ORDINARY = r"[A-Za-z]?[a-z]+|[A-Z]+"
FOLDERS = "usr local share python site packages config static module-2 version_12 build v1 main getElement ById 2023".split()


def encoding_of(token):
    for name, pattern in (("hex", "[0-9a-f]+"), ("HEX", "[0-9A-F]+"), ("base32", "[A-Z2-7]+")):
        if re.fullmatch(pattern, token):
            return name
    return "base64"


def looks_random(token):
    name = encoding_of(token)
    size, codes = SIZES[name], [ALPHABETS[name].index(c) for c in token]
    n = len(codes)
    chi = size / n * sum(c * c for c in Counter(codes).values()) - n
    high = [c >= size / 2 for c in codes]
    up, changes = sum(high), sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * up * (n - up) / n
    runs = (changes - mean) / math.sqrt(max(mean * (mean - 1) / (n - 1), 0.25))
    off = [c - sum(codes) / n for c in codes]
    own = sum(x * x for x in off)
    serial = (sum(a * b for a, b in zip(off, off[1:])) / own if own else 1.0) * math.sqrt(n)
    return max(abs((chi - size + 1) / math.sqrt(2 * (size - 1))), abs(runs), abs(serial)) <= secrets.BOUND


def letter_shares(texts):
    counts = {chr(97 + k): 10 * p for k, p in enumerate(secrets.ENGLISH)}
    for text in texts:
        for token in re.findall(TOKEN, text or ""):
            equal = sum(c * (c - 1) for c in Counter(token.lower()).values())
            if re.fullmatch(ORDINARY, token) and equal <= 0.25 * len(token) * (len(token) - 1):
                for c in token.lower():
                    counts[c] += 1
    whole = sum(counts.values())
    return {c: k / whole for c, k in counts.items()}


def evidence(token, shares):
    """Least -ln(ordinary / flat) over the three kinds of ordinary text, in nats."""
    name = encoding_of(token)
    alphabet, size = ALPHABETS[name], SIZES[name]

    def ordinary(upper):
        def weight(c):
            if not c.isalpha():
                return 0.005
            return shares[c.lower()] * 0.95 * (1.0 if name != "base64" else 0.9 if c.isupper() == upper else 0.1)

        whole = sum(map(weight, alphabet))
        return sum(math.log(whole / size / weight(c)) for c in token)

    numbers = sum(math.log(10 / size) if c.isdigit() else 100.0 for c in token)
    return min(ordinary(False), ordinary(True), numbers)


def harmless(seed, n):
    rng = random.Random(seed)
    return ["/".join(rng.choice(FOLDERS) for _ in range(rng.randint(5, 8))) for _ in range(n)]


def test_battery_against_brute_force(spark, make_docs, small):
    rng = random.Random(11)
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts += [" ".join(harmless(k, 20)) for k in range(100)]
    texts += ["order 20231011121345000001 of 98765432101234567890123", "MAX_BUFFER_SIZE_LIMIT_OF_BYTES internationalization"]
    for name, n in [(name, n) for name in ALPHABETS for n in (20, 22, 24, 28) for _ in range(3)]:
        texts.append("see " + "".join(rng.choice(ALPHABETS[name]) for _ in range(n)) + " there")
    shares = letter_shares(texts)
    steps = {}
    for token in {t for text in texts for t in re.findall(TOKEN, text or "") if not re.fullmatch(ORDINARY, t)}:
        steps[token] = min(2000, max(0, math.floor(10 * evidence(token, shares)))) if looks_random(token) else 0
    tested = [t for text in texts for t in re.findall(TOKEN, text or "") if t in steps]
    least = {}
    for name in ALPHABETS:
        own = [steps[t] for t in tested if encoding_of(t) == name]
        passing = [s for s in set(own) if math.exp(-s / 10) <= 0.01 * sum(o >= s for o in own) / len(own)]
        least[name] = min(passing, default=10**6)
    edge = {t for t in steps if abs(10 * evidence(t, shares) - round(10 * evidence(t, shares))) < 0.2}
    want = {t for t in steps if steps[t] >= least[encoding_of(t)]}
    found = secrets.find_secrets(make_docs(texts))
    values = found.select(F.explode(F.filter("spans", lambda s: s["kind"] == "random")).alias("s")).select("s.value").collect()
    got = {r["value"] for r in values}
    assert (got ^ want) <= edge and len(want - edge) > 20
    assert not got & {t for k in range(100) for t in harmless(k, 20)}


def test_single_secrets_among_a_million_harmless_tokens(spark, no_docs):
    """Single keys against the rule's first rank with 1,000,000 tokens read as base 64 and ten harmless ones of each other
    encoding: 0.9 are found from 24 characters on; in base 64 itself 0.5 of 24 characters and 0.9 of 40."""
    rng = random.Random(3)
    weights = secrets.evidence_weights(secrets.letters(no_docs)).select("weights").first()[0]
    rows = [(name, n, "".join(rng.choice(ALPHABETS[name]) for _ in range(n))) for name in ALPHABETS for n in (24, 40) for _ in range(200)]
    keys = spark.createDataFrame(rows, "name string, n int, token string")
    given = F.lit([[[int(w) for w in kind] for kind in own] for own in weights])
    judged = keys.withColumn("v", secrets._verdict(F.col("token"), given)).collect()
    for name in ALPHABETS:
        bar = math.exp(-math.log(10)) * 0.01 if name != "base64" else 1e-8
        for n in (24, 40):
            own = [r["v"]["step"] for r in judged if r["name"] == name and r["n"] == n]
            share = sum(math.exp(-s / 10) <= bar for s in own) / len(own)
            assert share >= (0.5 if (name, n) == ("base64", 24) else 0.9), (name, n, share)
