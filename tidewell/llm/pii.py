"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, schemes and identifier cues; local parsers expand each anchor to both sides and
validate what they get. Digit groups, which have no anchor of their own, are scanned for addresses, cards and phones.

Base kinds, leftmost and without overlaps within a kind; what fails its test is dropped and not tried again:

========  ==================================================================  =================================
email     ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
ip        four numbers joined by points                                       each at most 255
card      digits, single spaces or hyphens between them                       13 to 19 digits, Luhn
phone     ``+``, a digit, digits and ``space ( ) . -``, a digit               9 to 15 digits
========  ==================================================================  =================================

Kinds that anchors add: ``mailbox``, an address with letters outside ASCII; ``login``, a URL authority that carries
user information or a numeric host; ``account``, an IBAN (remainder 1 modulo 97), a social security number or a
number of 6 to 18 digits after a cue such as "account no.".
"""

from __future__ import annotations

import re
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import common

KINDS = ("email", "ip", "card", "phone", "mailbox", "login", "account")
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "smb://", "redis://", "postgres://", "mysql://", "mongodb://")
CUES = {"iban": "iban", "account": "number", "acct": "number", "passport": "number", "konto": "number", "cuenta": "number", "compte": "number", "ssn": "ssn", "social security": "ssn"}

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
WIDE_DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,24}(?![\w-])")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
AUTHORITY = re.compile(r"(?:([^\s/?#@<>\"']{1,256})@)?([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)(?::[0-9]{1,5})?(?![\w@])")
AFTER_CUE = re.compile(r"(?:\s{0,3}(?:no|nr|number|num|id)\b)?[\s.:#=-]{0,4}", re.I)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
NUMBER = re.compile(r"[A-Z]{0,2}[0-9](?:[ -]?[0-9]){5,17}(?![0-9A-Za-z])")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_ok(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


class Finder:
    """Spans of personal data in one text, as (kind, start, end) in code points, end exclusive."""

    def __init__(self):
        self.anchors = ahocorasick.Automaton()
        self.anchors.add_word("@", ("at", 1))
        for scheme in SCHEMES:
            self.anchors.add_word(scheme, ("scheme", len(scheme)))
        for cue, kind in CUES.items():
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                self.anchors.add_word(form, (kind, len(form)))
        self.anchors.make_automaton()

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        at: list[int] = []
        for last, (kind, size) in self.anchors.iter(text):
            if kind == "at":
                at.append(last)
            elif kind == "scheme":
                self.login(text, last + 1, size, found["login"])
            elif not (last >= size and text[last - size].isalnum()):
                self.account(text, last + 1, kind, found["account"])
        self.emails(text, at, found)
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
                found["ip"].append(m.span())
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    found["phone"].append(m.span())
        return [(kind, a, b) for kind in KINDS for a, b in sorted(set(found[kind]))]

    def emails(self, text: str, at: list[int], found: dict) -> None:
        """Expand each at-sign; the left side ends at the last match, as it would for a scan from left to right."""
        done = wide_done = 0
        for i in at:
            if i < done:
                continue
            right = DOMAIN.match(text, i + 1)
            left = i
            while left > done and (c := text[left - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
                left -= 1
            if right and left < i:
                found["email"].append((left, right.end()))
                done = right.end()
            elif (wide := WIDE_DOMAIN.match(text, i + 1)) and wide.end() - i <= 256:
                while left > max(wide_done, i - 65) and ((c := text[left - 1]).isalnum() or c in "._%+-"):
                    left -= 1
                if 0 < i - left <= 64 and text[left].isalnum() and text[i - 1].isalnum():
                    found["mailbox"].append((left, wide.end()))
                    wide_done = wide.end()

    @staticmethod
    def login(text: str, start: int, size: int, out: list) -> None:
        m = AUTHORITY.match(text, start)
        if m and (m[1] or (ip := IP.fullmatch(m[2])) and all(len(p) <= 3 and int(p) <= 255 for p in ip.groups())):
            out.append((start - size, m.end()))

    @staticmethod
    def account(text: str, start: int, kind: str, out: list) -> None:
        start = AFTER_CUE.match(text, start).end()
        if kind == "ssn":
            m = SSN.match(text, start)
        elif kind == "number" and (m := NUMBER.match(text, start)):
            pass
        elif m := IBAN.match(text, start):
            end = m.end()
            while end > start and not iban_ok(text[start:end]):  # a word may follow: give up characters from the right
                end -= 1
            m = None
            if end > start:
                out.append((start, end))
        if m:
            out.append(m.span())


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find(df: DataFrame, text_col: str = "text", into: str = "pii_spans") -> DataFrame:
    """Add ``into``, the spans of personal data by kind, then start.

    Null and empty texts have none. Texts are searched whole, in time linear in their length. Repeated rows get equal
    spans; equal spans of one kind count once. ``into`` replaces a column of that name.
    """
    df = df.drop(into)
    at = df.columns.index(text_col)

    def make():
        finder = Finder()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in finder(t or "")] for t in batch.column(at).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, into])

        return run

    return common.arrow_map(df, make, T.StructType([*df.schema.fields, T.StructField(into, SPANS)]))


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    """Spans of one kind. The lambda has one parameter: a second one would be the place in the array."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op3_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = find(common.read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda s: s["kind"].isin("email", "ip", "card", "phone"))
    return found.select(
        "doc_id",
        *[count_of(spans, k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
