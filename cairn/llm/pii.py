"""Personal data: anchor expansion (operator 3).

One Aho-Corasick pass over the whole text finds anchors: at-signs, plus-signs, digits, URL schemes and
identifier cues, whatever their case. At each anchor a deterministic local parser expands to the
boundaries of an email address, IP address, card number, phone number, URL or account value and validates it. Each kind's spans
are leftmost and non-overlapping; a match that fails its check is dropped and its text is not tried again.

Offsets are code points, end exclusive. Kinds in order: email, ip, card, phone (the base kinds), then
url and account, which the cues add. Time is linear in the text apart from the cues' reach. An account value goes to its real end whatever its length;
IBANs in groups are checked (mod 97), and a value after IBAN that fails the check still counts as an account.

Cases: a null text is empty and an empty text has no spans; very long texts are scanned whole; repeated
rows get equal results; other columns are untouched (a column named like the result is replaced).
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
CUES = ("account", "acct", "iban", "ssn", "passport", "user id", "customer id", "token", "api_key", "apikey", "api key", "secret", "password", "passwd")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"'`]+")
LABEL = r"(?:\s?(?i:no|number|nr|id)\b\.?)?"
#: After a cue and a sign, the value up to its real end: no length cap, and the signs of base64 and of JWT.
ACCOUNT = re.compile(LABEL + r"\s{0,2}[:=#]\s{0,2}[\"']?([A-Za-z0-9_+/.~=-]+)")
#: Numbers in groups after a cue, with or without a sign: digits, six at least, and single spaces or hyphens between.
GROUPED = re.compile(LABEL + r"\s{0,2}[:=#]?\s{0,2}[\"']?([0-9]+(?:[\x20-][0-9]+)*)(?![A-Za-z0-9_+/=~])")
IBAN = re.compile(LABEL + r"\s{0,2}[:=#]?\s{0,2}[\"']?([A-Za-z]{2}[0-9]{2}(?:[\x20-]?[A-Za-z0-9]){11,30})")
LEAST = 6

RESULT = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    for kind, words in (("url", SCHEMES), ("account", CUES)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


#: A-Z to a-z, for the rare texts that lower() would make longer.
LOWER = {i: i + 32 for i in range(65, 91)}


def lowered(text: str) -> str:
    """The text in lower case, each character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(LOWER)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def iban_end(text: str, start: int, end: int) -> int | None:
    """Where the longest valid IBAN (mod 97) that begins at start and stops at a group's or word's end, or None."""
    for stop in range(end, start + 14, -1):
        if stop < len(text) and text[stop].isalnum() and text[stop - 1].isalnum():
            continue
        raw = re.sub("[ -]", "", text[start:stop]).upper()
        if 15 <= len(raw) <= 34 and text[stop - 1].isalnum() and int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1:
            return stop
    return None


def account(text: str, at: int) -> tuple[int, int] | None:
    """The span of the value after a cue that ends at `at`: a checked IBAN, else a number in groups, else one word with a digit."""
    if (m := IBAN.match(text, at)) and (end := iban_end(text, *m.span(1))):
        return m.start(1), end
    if (m := GROUPED.match(text, at)) and m.end() > at and m.start(1) > at and sum("0" <= c <= "9" for c in m[1]) >= LEAST:
        return m.span(1)
    if m := ACCOUNT.match(text, at):
        value = m[1].rstrip(".") if m[1].endswith(".") else m[1]
        if len(value) >= LEAST and any("0" <= c <= "9" for c in value):
            return m.start(1), m.start(1) + len(value)
    return None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end), by kind as listed, then start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = phone_end = ip_end = ip_tried = card_end = url_end = account_end = 0
    for last, (kind, size) in automaton().iter(lowered(text)):
        at = last + 1 - size
        if kind == "digit":
            if at >= card_end and (m := CARD.match(text, at)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
            if at >= ip_end and at >= ip_tried:
                if m := IP.match(text, at):
                    ip_end = m.end()
                    if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split(".")):
                        found["ip"].append(m.span())
                else:  # no other start in this run of digits can match
                    ip_tried = DIGITS.match(text, at).end()
        elif kind == "email":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found["email"].append((start, email_end))
        elif kind == "phone":
            if at >= phone_end and (m := PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif kind == "url":
            if at >= url_end and not (at and text[at - 1].isalnum()) and (m := URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)]}"))
                url_end = m.end()
                if end > last + 1:
                    found["url"].append((at, end))
        elif last + 1 > account_end and (span := account(text, last + 1)):
            account_end = span[1]
            found["account"].append(span)
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    if not spans:
        return text
    out, at, rank = [], 0, {k: i for i, k in enumerate(KINDS)}
    runs: list[list] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], rank[x[0]])):
        if runs and s < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], e)
        else:
            runs.append([k, s, e])
    for k, s, e in runs:
        out += (text[at:s], f"[{k.upper()}]")
        at = e
    return "".join([*out, text[at:]])


@F.arrow_udf(RESULT)
def pii_spans(text: pa.Array) -> pa.Array:
    rows = []
    for t in text.to_pylist():
        spans = find(t)
        count = dict.fromkeys(KINDS, 0)
        for k, _, _ in spans:
            count[k] += 1
        base = joined([x for x in spans if x[0] in BASE])
        rows.append((*count.values(), hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
    columns = list(zip(*rows)) if rows else [[] for _ in RESULT]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64() if i < len(KINDS) else pa.string()) for i, c in enumerate(columns)], RESULT.names)


@F.arrow_udf(T.StringType())
def pii_masked(text: pa.Array) -> pa.Array:
    return pa.array([masked(t, find(t)) for t in text.to_pylist()], pa.string())


def pii(docs: DataFrame, out: str = "pii") -> DataFrame:
    """docs with one struct column: counts by kind, the digest of the base spans, all spans."""
    return docs.withColumn(out, pii_spans(F.col("text").cast("string")))


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.col(f"pii.n_{k}").alias(f"n_{k}") for k in BASE], "pii.base_sha256", "pii.spans", "pii.n_url", "pii.n_account", sum((F.col(f"pii.n_{k}") for k in KINDS), F.lit(0)).alias("n_spans"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data masked; n_chars, if there, is that of the new text."""
    out = docs.withColumn("text", pii_masked(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
