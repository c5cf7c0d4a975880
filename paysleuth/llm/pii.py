"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Four base kinds (email, ip, card, phone) follow fixed patterns and always stay. The method adds account numbers (IBAN,
mod-97), social security numbers and national telephone numbers, which stay only with a sufficient score.
All patterns are linear in the text: possessive repeats, and for e-mail a walk from each ``@``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "national_phone")
KINDS = BASE_KINDS + ADDED_KINDS
SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")

# Words beside a span that speak for it.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social", "security"),
    "national_phone": ("phone", "tel", "call", "mobile", "fax"),
}
# What a pattern is worth alone, and what a passed checksum and a context word add.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.3, "phone": 0.6, "iban": 0.2, "ssn": 0.3, "national_phone": 0.2}
CHECKED, NEARBY = 0.5, 0.3
LEAST_SCORE = 0.5
REACH = 40  # code points on either side in which context words count


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _LOCAL_END.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def _proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, confirmed by a checksum) in the order of kinds."""
    for start, end in _emails(text):
        yield "email", start, end, False
    if not re.search("[0-9]", text):
        return
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            yield "ip", m.start(), m.end(), False
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if len(m[0]) <= 40 else ""  # 19 digits and 18 separators at most
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end(), True
    phones = []
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                phones.append((m.start(), m.end()))
                yield "phone", m.start(), m.end(), False
    for m in _IBAN.finditer(text):
        yield "iban", m.start(), m.end(), mod97(m[0].replace(" ", ""))
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end(), False
    for m in _NATIONAL.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in phones):
            yield "national_phone", m.start(), m.end(), False


def find_spans(text: str | None) -> list[dict]:
    """All spans of a text, by kind as in KINDS, then start; ends are exclusive, positions count code points."""
    spans = []
    for kind, start, end, confirmed in _proposals(text or ""):
        if kind == "iban" and not confirmed:
            continue
        around = (text[max(0, start - REACH) : start] + " " + text[end : end + REACH]).lower()
        near = any(w in around for w in CONTEXT[kind])
        score = min(1.0, PRIOR[kind] + CHECKED * confirmed + NEARBY * near)
        if kind in BASE_KINDS or score >= LEAST_SCORE:
            spans.append({"kind": kind, "start": start, "end": end, "score": round(score, 2)})
    return spans


@F.pandas_udf(SPANS)
def spans_of(text: pd.Series) -> pd.Series:
    return text.map(find_spans)


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with an array of spans (kind, start, end, score); a null text counts as empty.

    Rows are handled one by one: repeated rows, null ids and other columns change nothing.
    """
    return docs.withColumn(out, spans_of(F.coalesce(F.col(text_col), F.lit(""))))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, their digest, and all spans.

    A null or empty text has none. Null ids and repeated rows are rows like any other; spans of one kind never overlap, so
    there are no ties. Other columns play no part; an empty table gives an empty result.
    """
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text", "_spans")
    found = found.select("doc_id", "_spans")
    spans = F.col("_spans")
    counts = [F.size(_of_kinds(spans, k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = _of_kinds(spans, *BASE_KINDS)
    return found.select(
        "doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans")
    )
