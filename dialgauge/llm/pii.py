"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score. SQL functions only.

Defined cases: a null or empty text has no spans; repeated rows give repeated results; an empty table gives no
rows; columns other than the id and the text are not looked at. The patterns hold no group that can repeat
without bound, so very long runs of digits or labels do not exhaust the stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import NONE, count, digest, matches

# The four base kinds in their order, then the method's own.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

# The local part starts where its run starts or where the match before it ended; the domain ends before "..",
# or before a dot that no label follows. Same matches as [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]+\.[A-Za-z0-9-])"
    r"[A-Za-z0-9.-]+?(?=\.\.|\.?(?![A-Za-z0-9.-]))"
)
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PART = "^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
# A whole run of digits with at most one blank or hyphen between two of them, 12 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

# Score of a confirmed span without context, and the words that raise or lower it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
NEARBY = {
    "email": "e-?mail|contact|write to",
    "ip": "ip|address|host|login",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id",
}
DOUBTFUL = "version|order|invoice|serial|isbn|ticket"
CONTEXT, RAISE, LOWER = 40, 0.2, 0.2


def luhn(number: Column) -> Column:
    """Whether the digits of ``number`` pass: every second from the right doubled, sum divisible by ten."""
    digits = F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), "")
    values = F.transform(
        digits,
        lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
        ),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the account number passes: first four characters last, letters as 10 to 35, rest 1 modulo 97."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97)
        .when(c.between("A", "Z"), (a * 100 + F.ascii(c) - 55) % 97)
        .otherwise(a),
    )
    return rest == 1


def n_digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda part: part.rlike(IP_PART)),
    "card": luhn,
    "phone": lambda v: n_digits(v).between(9, 15),
    "iban": mod97,
    "ssn": lambda v: ~v.rlike("^(000|666|9)|-00-|-0000$"),
}
PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}
# A plain test that every match passes, cheaper than the pattern.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}


def _confirmed(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, PATTERN[kind], kind, KINDS.index(kind)), lambda s: VALID[kind](s["value"]))
    return F.when(F.contains(text, F.lit(NEEDED[kind])), found).otherwise(F.array().cast(NONE)) if kind in NEEDED else found


def _scored(text: Column, kind: str):
    return lambda span: _with_score(text, span, kind)


def _with_score(text: Column, span: Column, kind: str) -> Column:
    left = F.greatest(span["start"] - CONTEXT, F.lit(0))
    near = F.lower(
        F.concat(
            F.substring(text, left + 1, span["start"] - left), F.lit(" "), F.substring(text, span["end"] + 1, F.lit(CONTEXT))
        )
    )
    raised = F.when(near.rlike(rf"\b({NEARBY[kind]})\b"), RAISE).otherwise(0.0)
    lowered = F.when(near.rlike(rf"\b({DOUBTFUL})\b"), LOWER).otherwise(0.0)
    return F.struct(
        *[span[f] for f in ("start", "end", "rank", "kind", "value")],
        F.least(F.lit(1.0), F.lit(PRIOR[kind]) + raised - lowered).alias("score"),
    )


def find_pii(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """(id, spans): confirmed spans of every row, each with start, end, rank, kind, value and score.

    Positions count code points from 0, the end is exclusive. The four base kinds stay whatever their score is;
    the method's own (account numbers, social security numbers) stay from ``least`` on.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), body.alias("body"))
    rows = rows.select("*", *[_confirmed(F.col("body"), k).alias(f"found_{k}") for k in KINDS])
    scored = []
    for kind in KINDS:
        spans = F.transform(F.col(f"found_{kind}"), _scored(F.col("body"), kind))
        scored.append(spans if KINDS.index(kind) < 4 else F.filter(spans, lambda s: s["score"] >= least))
    return rows.select(id_col, F.concat(*scored).alias("spans"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of :func:`find_pii`'s spans, one row per input row."""
    base = F.filter("spans", lambda s: s["rank"] < 4)
    texts = found.select(
        id_col, "spans", digest(base).alias("base"), digest(F.col("spans")).alias("all_spans")
    )
    return texts.select(
        id_col,
        *[count(F.col("spans"), k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(F.col("base"), 256).alias("base_sha256"),
        F.col("all_spans").alias("spans"),
    )
