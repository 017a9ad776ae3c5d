"""Personal data: patterns propose spans, checksums confirm, context scores.

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches of one
pattern per kind, kept when their check holds (parts at most 255, 12 to 19 digits
passing Luhn, 9 to 15 digits); a failing match is dropped and not tried again.
Added kinds: iban (mod 97 must be 1), and spans whose score depends on words close
by: ssn (ddd-dd-dddd), tel (a number without +, 9 to 15 digits), secret (a long hex
or base64 value after a word such as token). A base match has score 1; an added
one starts from its kind's prior, gains CONTEXT if such a word stands within REACH
characters before it, and stays at MINIMUM or more and if it overlaps no base span.

Offsets are code points, end exclusive. A null text counts as empty: no spans.
Texts are scanned whole, in time proportional to their length whatever they hold:
emails are sought from each `@` outwards, addresses among whole chains of digits and
dots, and the other patterns consume a run or look at a bounded stretch of it.
Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "tel", "secret")
CONTEXT, MINIMUM, REACH = 0.5, 0.75, 40

# Base kinds, in the forms that the searches below need.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
TEL = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,5}\)?(?:[\x20.-]?[0-9]{2,5}){2,4}(?![0-9-])")
SECRET = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
DIGIT = re.compile(r"[0-9]")
HINTS = {
    "iban": re.compile(r"(?i)iban|account|konto|compte|cuenta"),
    "ssn": re.compile(r"(?i)ssn|social security|tax id"),
    "tel": re.compile(r"(?i)\b(phone|tel|call|mobile|fax|cell)"),
    "secret": re.compile(r"(?i)token|secret|password|passwd|api.?key|bearer"),
}
PRIOR = {"iban": 0.8, "ssn": 0.4, "tel": 0.3, "secret": 0.3}


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = int(x) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Spans of leftmost matches: the local part runs up to an @, a domain with a dot follows."""
    end, at = 0, text.find("@")
    while at >= 0:
        before = text[end:at]
        begin = end + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
        end = m.end() if m else at + 1
        at = text.find("@", end)


def addresses(text: str):
    """Spans of four numbers with dots between: the first four of each chain of digits and dots, the next four, and so on."""
    for chain in NUMBERS.finditer(text):
        if chain[0].count(".") >= 3:
            parts, at = chain[0].split("."), chain.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(int(p.lstrip("0")[:4] or "0") <= 255 for p in four):
                    yield at, end
                at = end + 1


def base_spans(text: str) -> list[tuple[int, int, str, float]]:
    found = [(a, b, "email", 1.0) for a, b in emails(text)]
    if DIGIT.search(text):
        found += [(a, b, "ip", 1.0) for a, b in addresses(text)]
        found += [(m.start(), m.end(), "card", 1.0) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [(m.start(), m.end(), "phone", 1.0) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def added_spans(text: str, base: list) -> list[tuple[int, int, str, float]]:
    if not DIGIT.search(text):
        return []
    found, base = [], sorted(base)
    starts, ends = [x[0] for x in base], list(itertools.accumulate((x[1] for x in base), max))
    for kind, pattern, ok in (
        ("iban", IBAN, lambda s: mod97(s)),
        ("ssn", SSN, lambda s: s[:3] not in ("000", "666") and s[4:6] != "00" and s[7:] != "0000"),
        ("tel", TEL, lambda s: 9 <= len(_digits(s)) <= 15),
        ("secret", SECRET, lambda s: DIGIT.search(s) and re.search("[A-Za-z]", s)),
    ):
        for m in pattern.finditer(text):
            if ok(m[0]):
                score = PRIOR[kind] + CONTEXT * bool(HINTS[kind].search(text, max(0, m.start() - REACH), m.start()))
                before = bisect.bisect_left(starts, m.end())  # base spans that begin before this one ends
                if score >= MINIMUM and not (before and ends[before - 1] > m.start()):
                    found.append((m.start(), m.end(), kind, min(1.0, score)))
    return found


def spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start, then kind as listed."""
    base = base_spans(text)
    return sorted(base + added_spans(text, base), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str) -> str:
    """Each span becomes [kind]; overlapping spans become one."""
    out, at = [], 0
    for a, b, kind, _ in spans(text):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _text(found) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in found)


def find_pii(docs: DataFrame) -> DataFrame:
    """Per document: counts by base kind, digest of the base spans, all spans, lowest score."""

    def run(batches):
        for b in T.slices(batches):
            rows = []
            for t in T.strings(b["text"]).to_pylist():
                found = spans(t)
                base = [x for x in found if x[2] in BASE]
                rows.append([sum(x[2] == k for x in base) for k in BASE] + [hashlib.sha256(_text(base).encode()).hexdigest(), _text(found), min((x[3] for x in found), default=None)])
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(list(c), t) for c, t in zip(cols, kinds))], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "lowest_score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, lowest_score double")


def redact_pii(docs: DataFrame, col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in col replaced; null stays null."""

    def run(batches):
        for b in T.slices(batches):
            k = b.schema.get_field_index(col)
            yield b.set_column(k, b.schema.field(k), pa.array([t and redact(t) for t in b[col].to_pylist()], b.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)
