"""Personal data in texts: anchors found by one Aho-Corasick pass, spans grown from them by local parsers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
#: What is taken out of texts. A web address alone doesn't name a person and stays; e-mail addresses in it go.
REDACTED = (*BASE_KINDS, "account")

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORD_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL_REST = re.compile(r"[^\s<>\"'`]+")
#: What stands between a cue and its value: an account or secret is only taken where something says that a value follows.
ACCOUNT_REST = re.compile(r"[\"']?[\x20\t]{0,4}(?:(?:number|no\.?|nr\.?)[\x20\t]{0,4}[=:#]?|[=:#]{1,2}>?)[\x20\t]{0,4}[\"']?([A-Za-z0-9][A-Za-z0-9_-]*)", re.I | re.A)
#: An IBAN holds its own checksum, so a cue is enough; it has 15 to 34 characters, perhaps in groups.
IBAN_REST = re.compile(r"[\"']?[\x20\t]{0,4}(?:number|no\.?|nr\.?)?[\x20\t]{0,4}[=:#]?[\x20\t]{0,4}[\"']?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})", re.I | re.A)
#: Cues after which an account number or a secret identifier stands.
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "passport", "ssn", "token", "api_key", "apikey", "secret", "password")
MIN_ACCOUNT = 6


@cache
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for x in "0123456789":
        found.add_word(x, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for cue in CUES:
        for x in {cue, cue.title(), cue.capitalize(), cue.upper()}:
            found.add_word(x, ("cue", len(x)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        d = ord(x) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


#: Letters as the two digits that an IBAN's checksum takes them for.
LETTERS = {ord(x): str(int(x, 36)) for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def iban(text: str) -> bool:
    text = text.replace(" ", "").upper()
    return 15 <= len(text) <= 34 and text[:2].isalpha() and text[2:4].isdigit() and int((text[4:] + text[:4]).translate(LETTERS)) % 97 == 1


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def account(text: str, at: int, cue: str) -> tuple[int, int] | None:
    """The identifier after a cue that ends at ``at``."""
    if cue.lower() == "iban":
        m = IBAN_REST.match(text, at)
        value = m[1] if m and m.start(1) > at else ""
        for n in range(len(value), 14, -1):  # words in capitals may follow
            if (n == len(value) or value[n] == " ") and iban(value[:n]):
                return m.start(1), m.start(1) + n
        return None
    m = ACCOUNT_REST.match(text, at)
    value = m[1].rstrip("-_") if m else ""
    return (m.start(1), m.start(1) + len(value)) if len(value) >= MIN_ACCOUNT and any(x.isdigit() for x in value) else None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans as (kind, start, end) in code points, ordered by start, then kind as in ``KINDS``.

    The automaton reports at-signs, plus signs, digits, scheme separators and identifier cues in order. From each anchor
    a parser expands to the boundaries of its kind and validates; an anchor inside the last candidate of its kind is
    skipped, so candidates don't overlap and come leftmost first. Kinds may overlap each other.
    """
    spans: list[tuple[str, int, int]] = []
    if not text:
        return spans
    email_end = ip_end = card_end = url_end = account_end = 0
    for last, (kind, size) in anchors().iter(text):
        at = last + 1 - size
        if kind == "digit":
            if at >= card_end and (m := CARD_RUN.match(text, at)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", at, card_end))
            if at >= ip_end:
                if m := DOTTED.match(text, at):
                    ip_end = m.end()
                    if all(map(octet, m[0].split("."))):
                        spans.append(("ip", at, ip_end))
                else:  # a later digit of this run or chain can't begin a match either
                    ip_end = DIGITS_AND_DOTS.match(text, at).end()
        elif kind == "at":
            if m := DOMAIN.match(text, last + 1):
                start = at
                while start > email_end and text[start - 1] in LOCAL_CHARS:
                    start -= 1
                if start < at:
                    email_end = m.end()
                    spans.append(("email", start, email_end))
        elif kind == "plus":
            if m := PHONE.match(text, at):
                if 9 <= sum(x.isdigit() for x in m[0]) <= 15:
                    spans.append(("phone", at, m.end()))
        elif kind == "scheme":
            start = at
            while start > url_end and at - start < 16 and (text[start - 1] in WORD_CHARS or text[start - 1] in "+.-"):
                start -= 1
            if at >= url_end and start < at and (m := URL_REST.match(text, last + 1)):
                url_end = last + 1 + len(m[0].rstrip(".,;:!?)]}"))
                if url_end > last + 1:
                    spans.append(("url", start, url_end))
        elif at >= account_end and not (at and text[at - 1] in WORD_CHARS) and (found := account(text, last + 1, text[at : last + 1])):
            account_end = found[1]
            spans.append(("account", *found))
    spans.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return spans


#: Where a run of digits parted by single dots ends.
DIGITS_AND_DOTS = re.compile(r"[0-9]+(?:\.[0-9]+)*")


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span of a kind in ``REDACTED``, or run of overlapping ones, replaced by the first's kind in brackets."""
    spans = [x for x in spans if x[0] in REDACTED]
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = [find_spans(x) for x in batch.column("text").to_pylist()]
        base = [[x for x in spans if x[0] in BASE_KINDS] for spans in every]
        yield pa.RecordBatch.from_pydict(
            {"key": batch.column("key")}
            | {f"n_{kind}": pa.array([sum(x[0] == kind for x in spans) for spans in base], pa.int64()) for kind in BASE_KINDS}
            | {"base_sha256": pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string()), "spans": pa.array(map(joined, every), pa.string())}
            | {"n_account": pa.array([sum(x[0] == "account" for x in spans) for spans in every], pa.int64()), "n_personal": pa.array([sum(x[0] in REDACTED for x in spans) for spans in every], pa.int64())}
        )


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with its counts by base kind, a digest of the base spans, all spans, and the numbers of accounts and
    of all spans that ``redact`` takes out.

    Null and empty texts have no spans; repeated rows are reported each; further columns are ignored. No shuffle.
    """
    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    key_type = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(_found, f"key {key_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_account long, n_personal long")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, with personal data in the text replaced by its kind; null texts stay null."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: redacted(x, find_spans(x)), na_action="ignore")

    return docs.withColumn(text_col, clean(F.col(text_col)))
