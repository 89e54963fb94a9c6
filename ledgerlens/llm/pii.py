"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors: at-signs, plus signs, digits, address schemes and
identifier cues. At each anchor a local parser expands to the longest run that a kind could span
and validates inside it, so text without anchors costs one automaton pass.

Base kinds, leftmost and non-overlapping for each kind: ``email``, ``ip`` (four parts of at most
255), ``card`` (12 to 19 digits that pass Luhn), ``phone`` (plus sign, 9 to 15 digits). A run of the
characters a kind consists of cannot be left by a match, so matching inside runs equals matching
the whole text. Added kinds: ``url`` with user information, ``account`` (IBAN with valid check
digits), ``secret`` (value after a password, token or key cue; access key ids).

Offsets are code points, end exclusive. Null and empty texts have no spans; a null id is kept; repeated
rows give equal results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import map_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
_ORDER = {kind: k for k, kind in enumerate(KINDS)}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a later start in the same run of digits fares no better than its first, so only that is tried
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#@\"'<>]+@[^\s\"'<>]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?:password|passwd|token|secret|api_?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']{8,})", re.I)
_KEY_ID = re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")

# Runs that a match of the kind cannot leave, from an anchor to the right.
_EMAIL_RIGHT = re.compile(r"[A-Za-z0-9._%+@-]*")
_NUMBER_RUN = re.compile(r"[0-9. -]*[0-9]")
_PHONE_RUN = re.compile(r"\+[ ().0-9+-]*")
_CUE_SPAN = 120

_CUES = ("password", "passwd", "token", "secret", "apikey", "api_key")


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for anchor, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"), ("akia", "key"), ("iban", "iban"), *[(d, "digit") for d in "0123456789"]]:
        out.add_word(anchor, (kind, len(anchor)))
    for cue in _CUES:
        out.add_word(cue, ("cue", len(cue)))
    out.make_automaton()
    return out


_AUTOMATON = _automaton()


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _iban(text: str) -> bool:
    packed = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _left(text: str, at: int, allowed: frozenset[str], stop: int) -> int:
    while at > stop and text[at - 1] in allowed:
        at -= 1
    return at


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")


_LOWER = {c: c + 32 for c in range(65, 91)}


def _lowered(text: str) -> str:
    """ASCII letters in lower case, at their places."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def _emails(text: str, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Addresses of a run of local characters and at-signs: each sign is tried once, with all that stands before it."""
    while (at := text.find("@", start, stop)) >= 0:
        if at > start and (m := _DOMAIN.match(text, at + 1, stop)):
            yield start, m.end()
            start = m.end()
        else:
            start = at + 1


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by kind as listed."""
    out: list[tuple[int, int, str]] = []
    if not text:
        return out
    mail = number = phone = url = iban = secret = 0  # where the next run of each kind may begin
    for last, (kind, size) in _AUTOMATON.iter(_lowered(text)):
        at = last - size + 1
        if kind == "digit":
            if at < number:
                continue
            run = _NUMBER_RUN.match(text, at)
            number = run.end()
            if number - at >= 7:
                for m in _IP.finditer(text, at, number):
                    if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                        out.append((m.start(), m.end(), "ip"))
            if number - at >= 12:
                for m in _CARD.finditer(text, at, number):
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((m.start(), m.end(), "card"))
        elif kind == "at":
            if at < mail:
                continue
            start = _left(text, at, _LOCAL, mail)
            mail = _EMAIL_RIGHT.match(text, at).end()
            out.extend((a, b, "email") for a, b in _emails(text, start, mail))
        elif kind == "plus":
            if at < phone:
                continue
            phone = _PHONE_RUN.match(text, at).end()
            for m in _PHONE.finditer(text, at, phone):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
        elif kind == "scheme":
            start = _left(text, at, _SCHEME, url)
            if m := _URL.match(text, start):
                out.append((m.start(), m.end(), "url"))
                url = m.end()
        elif kind == "key":
            if m := _KEY_ID.match(text, at):
                out.append((m.start(), m.end(), "secret"))
        elif kind == "cue":
            if at >= secret and (m := _SECRET.match(text, at)):  # a cue inside a secret is a part of it
                out.append((m.start(1), m.end(1), "secret"))
                secret = m.end()
        elif at >= iban:
            if (m := _IBAN.search(text, last + 1, last + _CUE_SPAN)) and _iban(m[0]):
                out.append((m.start(), m.end(), "account"))
                iban = m.end()
    return sorted(set(out), key=lambda s: (s[0], _ORDER[s[2]], s[1]))


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    found = spans(text)
    if not found:
        return text
    out, at = [], 0
    for start, end, kind in found:
        if start >= at:
            out += [text[at:start], "<", kind, ">"]
        at = max(at, end)
    return "".join(out) + text[at:]


def show(found: list[tuple[int, int, str]]) -> str:
    """Spans as kind:start:end, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of ``docs``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[list[int]] = [[] for _ in BASE]
        digests, shown = [], []
        for text in batch.column(1).to_pylist():
            found = spans(text)
            base = [s for s in found if s[2] in BASE]
            for column, kind in zip(counts, BASE):
                column.append(sum(s[2] == kind for s in base))
            digests.append(hashlib.sha256(show(base).encode()).hexdigest())
            shown.append(show(found))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(shown)],
            ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(columns, run, "doc_id long, " + "".join(f"n_{k} long, " for k in BASE) + "base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all other columns as they are."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([redact(t) for t in batch.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], names)

    return map_batches(docs, run, docs.schema)
