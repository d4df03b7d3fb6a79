"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, schemes and
the words that announce an identifier.  At each anchor a local parser expands to the left and
right until the boundary of the address or number, and checks what it found.  The text between
anchors is never looked at again.

Kinds of the base: ``email``, ``ip``, ``card``, ``phone``.  Kinds that anchors add: ``url`` (an
address with a scheme), ``iban`` (checked by its remainder) and ``account`` (a token, key,
password or account number behind a word that announces it).  An added span never overlaps a
base span or an earlier added one.  Positions are code points; ends are exclusive.

Defined cases: a null text is treated as an empty one and stays null when it is masked; texts
of any length are read whole, in time proportional to their length; rows are independent, so
repeated rows and an empty table need no rule; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame

from .common import fresh, per_row

KINDS = ("email", "ip", "card", "phone", "url", "iban", "account")
BASE = KINDS[:4]

# local boundaries
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_VALUE = re.compile(r"[\"']?\s{0,2}[:=#]\s{0,2}[\"']?([A-Za-z0-9_\-./+]{8,512})(?![A-Za-z0-9_\-./+])")

SCHEMES = ("http://", "https://", "ftp://")
CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "api-key", "access_key", "account",
        "account no", "account number", "ssn", "passport", "iban")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_holds(number: str) -> bool:
    """Remainder check of an account number in the international form, blanks removed."""
    if not 15 <= len(number) <= 34:
        return False
    turned = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _quad_holds(quad: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in quad.split("."))


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for s in SCHEMES:
        for form in (s, s.upper(), s.capitalize()):
            found.add_word(form, ("scheme", len(form)))
    for s in CUES:
        for form in (s, s.upper(), s.capitalize(), s.title()):
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of one text, by start and then by kind."""
    base: list[tuple[str, int, int]] = []
    cues: list[tuple[str, int, int]] = []
    mail_end = quad_next = number_next = 0  # nothing before these can start a further match
    for last, (what, length) in anchors.iter(text):
        if what == "digit":
            if last >= quad_next:
                if m := _QUAD.match(text, last):
                    quad_next = m.end()
                    if _quad_holds(m[0]):
                        base.append(("ip", last, m.end()))
                else:
                    quad_next = _DIGITS.match(text, last).end()
            if last >= number_next:
                if m := _NUMBER.match(text, last):
                    number_next = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        base.append(("card", last, m.end()))
        elif what == "at":
            start = last
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                mail_end = m.end()
                base.append(("email", start, mail_end))
        elif what == "plus":
            if m := _PHONE.match(text, last):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    base.append(("phone", last, m.end()))
        else:
            cues.append((what, last + 1 - length, last + 1))
    if cues:
        base += _announced(text, cues, base)
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(base, key=lambda s: (s[1], rank[s[0]], s[2]))


def _announced(text: str, cues: list[tuple[str, int, int]],
               base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    taken = bytearray(len(text) + 1)
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    added = []
    for what, a, b in cues:
        if a and (text[a - 1].isalnum() or text[a - 1] == "_"):
            continue
        span = None
        if what == "scheme":
            if m := _URL.match(text, b):
                end = a + len(text[a:m.end()].rstrip(".,;:!?)]"))
                span = ("url", a, end) if end > b else None
        else:
            behind = b
            while behind < min(len(text), b + 3) and text[behind] in " :=#":
                behind += 1
            if (m := _IBAN.match(text, behind)) and iban_holds(m[0].replace(" ", "")):
                span = ("iban", m.start(), m.end())
            elif (m := _VALUE.match(text, b)) and sum(c.isdigit() for c in m[1]) >= 4:
                span = ("account", m.start(1), m.end(1))
        if span and not any(taken[span[1]:span[2]]):
            taken[span[1]:span[2]] = b"\1" * (span[2] - span[1])
            added.append(span)
    return added


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in angle brackets; where spans overlap, the
    run they form together is replaced by the kind that starts first."""
    if not spans:
        return text
    out, upto = [], 0
    for kind, a, b in spans:
        if a >= upto:
            out += [text[upto:a], f"<{kind}>"]
        upto = max(upto, b)
    return "".join(out) + text[upto:]


def with_spans(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """Append ``name``: the spans of each text as ``array<struct<kind,start,stop>>``."""
    return _per_text(docs, text, fresh(docs, name), "array<struct<kind:string,start:int,stop:int>>", lambda t, s: s)


def mask_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, with personal data masked in ``text``."""
    name = fresh(docs, "_masked")
    done = _per_text(docs, text, name, "string", masked)
    return done.select(*[done[name].alias(c) if c == text else done[f"`{c}`"] for c in docs.columns])


def summary(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append counts by kind, the digest of the base spans and all spans as one string."""
    def make():
        anchors = automaton()

        def one(t):
            spans = find_spans(t or "", anchors)
            base = [s for s in spans if s[0] in BASE]
            counts = [sum(s[0] == k for s in base) for k in BASE]
            return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

        return lambda texts: [one(t) for t in texts]

    return per_row(docs, make, [text], "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
                                       "spans string")


def _per_text(docs: DataFrame, text: str, name: str, kind: str, result: Callable) -> DataFrame:
    def make():
        anchors = automaton()
        return lambda texts: [(result(t, find_spans(t or "", anchors)),) for t in texts]

    return per_row(docs, make, [text], f"{name} {kind}")
