"""Personal data by anchor expansion.

One Aho-Corasick automaton (Aho and Corasick, 1975) runs over the whole text and stops at anchors: at-signs, schemes, digits and plus
signs, and words that announce an identifier. From each anchor a parser looks left and right for the boundaries of an email, address,
number or account, and checks what it found: octets, numbers of digits, check digits.

Every part of a text is expanded from at most a few anchors, as a parser starts after what its kind has consumed, so the work is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import release, text_blocks

#: Kinds in the order of their spans; the first four have base rules.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
#: Anchors. Each is also found capitalised and in capitals, but for those of ``KEYS``.
AT_SIGNS = ("(at)", "[at]", "{at}", "＠")
SCHEMES = ("mailto:", "tel:", "sip:", "sips:", "xmpp:", "http://", "https://", "ftp://", "sftp://", "ssh://", "ldap://", "postgres://", "postgresql://", "mysql://", "mongodb://", "redis://", "amqp://", "smb://")
CUES = (
    "password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "access-key", "private_key", "auth",
    "iban", "account", "acct", "konto", "cuenta", "compte", "ssn", "social security", "passport", "license", "licence", "tax id", "customer id", "user id", "patient id", "member id",
)

#: Beginnings of keys that public services issue, and what follows them. They are written in this case alone.
KEYS = {
    "AKIA": r"[A-Z0-9]{16}", "ASIA": r"[A-Z0-9]{16}", "ghp_": r"[A-Za-z0-9]{36}", "github_pat_": r"[A-Za-z0-9_]{22,82}", "xoxb-": r"[0-9A-Za-z-]{20,80}", "xoxp-": r"[0-9A-Za-z-]{20,80}",
    "sk_live_": r"[0-9A-Za-z]{16,99}", "AIza": r"[0-9A-Za-z_-]{35}",
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_WIDE_DOMAIN = re.compile(r"[\w-]++(?:\.[\w-]+)++")
_SPELT_DOMAIN = re.compile(r"\s?([\w-]++(?:(?:\.|\s?[(\[{](?:dot|DOT|Dot)[)\]}]\s?)[\w-]+)+)")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]+)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Telephone numbers within a longer run of digits: of the North American plan, and of others by groups.
_NORTH_AMERICA = re.compile(r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")
_GROUPED = re.compile(r"\+[2-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])")
_GROUP = re.compile(r"[0-9]+")
_AUTHORITY = re.compile(r"[^\s/?#<>\"']{1,512}")
_NUMBER = re.compile(r"\+?[0-9(][ ().0-9-]{5,24}[0-9](?![0-9])")
#: What may stand between a cue and its value, and the values.
_AFTER_CUE = re.compile(r"(?: ?(?:number|no|nr|num|code|key|id)\b\.?)?[ \t]{0,4}(?:[:=#]|is\b)[ \t]{0,4}[\"']?", re.IGNORECASE)
_VALUE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9+/_.=-]|(?<=[0-9])[ ](?=[0-9])){4,127}")
_KEYS = {x: re.compile(rest + r"(?![A-Za-z0-9])") for x, rest in KEYS.items()}
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")


@cache
def anchors() -> ahocorasick.Automaton:
    """Automaton over all anchors; an anchor's value is its part and length."""
    found = ahocorasick.Automaton()
    for part, some in (("@", ("@",)), ("at", AT_SIGNS), ("0", "0123456789"), ("+", ("+",)), ("scheme", SCHEMES), ("cue", CUES)):
        for x in some:
            for form in (x, x.capitalize(), x.upper()):
                found.add_word(form, (part, len(form)))
    for x in KEYS:
        found.add_word(x, ("key", len(x)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def octet(part: str) -> bool:
    rest = part.lstrip("0")
    return len(rest) <= 3 and int(rest or "0") <= 255


def iban(value: str) -> bool:
    """Check digits by ISO 7064, modulo 97."""
    x = value.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


class Finder:
    """Spans of one text: those of the base rules, and those that the parsers add."""

    def __init__(self, text: str):
        self.text = text
        self.base: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
        self.more: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        self.after = dict.fromkeys(("email", "wide", "ip", "card", "phone", "address", "account"), 0)
        parts = {"@": self._at, "at": self._spelt, "0": self._digit, "+": self._plus, "scheme": self._scheme, "cue": self._cue, "key": self._key}
        for end, (part, length) in anchors().iter(text):
            parts[part](end + 1 - length, end + 1)

    def _left(self, at: int, least: int, own) -> int:
        while at > least and own(self.text[at - 1]):
            at -= 1
        return at

    def _at(self, at: int, end: int) -> None:
        start = self._left(at, self.after["email"], _LOCAL.__contains__)
        m = _DOMAIN.match(self.text, end) if start < at else None
        if m:
            self.base["email"].append((start, m.end()))
            self.after["email"] = m.end()
        # the same with letters of any language, where a base rule ends too early
        first = self._left(at, self.after["wide"], lambda c: c in _LOCAL or c.isalnum())
        n = _WIDE_DOMAIN.match(self.text, end) if first < at else None
        self.after["wide"] = n.end() if n else end
        if n and not n[0].isascii() | n[0].rpartition(".")[2].isdigit() or n and m and first < start:
            self.more["email"].append((first, n.end()))

    def _spelt(self, at: int, end: int) -> None:
        """An at-sign in words or full width."""
        spaced = at - 1 if at and self.text[at - 1] == " " else at
        start = self._left(spaced, self.after["wide"], lambda c: c in _LOCAL or c.isalnum())
        m = _SPELT_DOMAIN.match(self.text, end) if start < spaced else None
        if m and m[1][-1].isalpha():
            self.more["email"].append((start, m.end()))
            self.after["wide"] = m.end()

    def _digit(self, at: int, end: int) -> None:
        if at >= self.after["card"]:
            m = _CHAIN.match(self.text, at)
            self.after["card"] = m.end() if m else end
            if m:
                self._chain(at, m[0])
        if at >= self.after["ip"]:
            m = _DOTTED.match(self.text, at)
            self.after["ip"], runs = m.end(), m[0].split(".")
            for k in range(0, len(runs) - 3, 4):
                four = runs[k : k + 4]
                length = sum(map(len, four)) + 3
                if all(map(octet, four)):
                    self.base["ip"].append((at, at + length))
                at += length + 1

    def _chain(self, at: int, chain: str) -> None:
        """Digits with single blanks or hyphens between: a card, or a card among other numbers."""
        digits = chain.replace(" ", "").replace("-", "") if len(chain) < 40 else chain
        if 16 <= len(digits) <= 19 and luhn(digits):
            self.base["card"].append((at, at + len(chain)))
            return
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(chain)]
        k = 0
        while k < len(groups):
            n = 1
            if groups[k][1] - groups[k][0] == 4 and k + 4 <= len(groups) and all(b - a == 4 for a, b in groups[k : k + 4]):
                n = 4
            start, stop = groups[k][0], groups[k + n - 1][1]
            number = "".join(chain[a:b] for a, b in groups[k : k + n]) if stop - start < 40 else ""
            if 16 <= len(number) <= 19 and number[0] in "3456" and luhn(number):
                self.more["card"].append((at + start, at + stop))
                k += n
            else:
                k += 1

    def _plus(self, at: int, end: int) -> None:
        if at < self.after["phone"]:
            return
        m = _PHONE.match(self.text, at)
        if not m:
            return
        self.after["phone"] = m.end()
        n = sum(map(m[0].count, "0123456789"))
        if 8 <= n <= 15:
            self.base["phone"].append((at, m.end()))
        elif own := _NORTH_AMERICA.match(self.text, at, m.end()) or _GROUPED.match(self.text, at, m.end()):
            if 8 <= sum(c.isdigit() for c in own[0]) <= 15:
                self.more["phone"].append(own.span())

    def _scheme(self, at: int, end: int) -> None:
        """The address that a URI holds, if it is one's own: a mailbox, a number, a name and password, or a host's number."""
        if at < self.after["address"] or at and self.text[at - 1].isalnum():
            return
        number = self.text[at].lower() == "t"
        m = (_NUMBER if number else _AUTHORITY).match(self.text, end)
        if not m:
            return
        user, sign, host = m[0].rpartition("@")
        own = number or (sign and user and host) or (re.fullmatch(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?|\[[0-9A-Fa-f:.]{3,}\](?::[0-9]+)?", m[0]))
        if own:
            self.more["address"].append((at, at + len(self.text[at : m.end()].rstrip(".,;:)"))))
            self.after["address"] = m.end()

    def _cue(self, at: int, end: int) -> None:
        """The value after a word that announces an identifier: with a digit in it, and with right check digits if it is an IBAN."""
        if at < self.after["account"] or at and self.text[at - 1].isalnum():
            return
        between = _AFTER_CUE.match(self.text, end)
        if not between:
            return
        m = _IBAN.match(self.text, between.end()) if self.text[at:end].lower() == "iban" else None
        if m and not iban(m[0]):
            return
        m = m or _VALUE.match(self.text, between.end())
        value = m[0].rstrip(".-=/") if m else ""
        if len(value) >= 6 and any(c.isdigit() for c in value):
            self.more["account"].append((m.start(), m.start() + len(value)))
            self.after["account"] = m.end()

    def _key(self, at: int, end: int) -> None:
        """A key that tells by its beginning what it is."""
        m = _KEYS[self.text[at:end]].match(self.text, end)
        if m and at >= self.after["account"] and not (at and self.text[at - 1].isalnum()):
            self.more["account"].append((at, m.end()))
            self.after["account"] = m.end()

    def all(self) -> dict[str, list[tuple[int, int]]]:
        """All spans by kind, in the order of their starts, each once."""
        return {k: sorted({*self.base.get(k, ()), *self.more[k]}) for k in KINDS}


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    """``kind:start:end`` of all spans, by kind and start."""
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans.get(k, ()))


def find(docs: DataFrame) -> DataFrame:
    """Personal data in every whole ``text`` of ``docs``.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone`` (what the base rules find) ``, base_sha256`` (of their spans) ``, spans`` (base
    and added ones, as ``kind:start:end`` in code points, the end exclusive). Base spans of a kind never overlap; an added one may hold a base span that
    ends too early. Null text is empty and has none. Rows are judged each by itself, repeated ones alike; a null doc_id comes back as it is. Texts may be of any
    length: work is linear in it. An empty table gives an empty result; extra columns are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
        for batch in batches:
            for first, texts in text_blocks(batch.column(1), raw=False):
                found = [Finder(t) for t in texts]
                counts = [pa.array([len(x.base[k]) for x in found], pa.int64()) for k in BASE]
                digests = pa.array([hashlib.sha256(joined(x.base).encode()).hexdigest() for x in found], pa.string())
                yield pa.record_batch([batch.column(0).slice(first, len(texts)), *counts, digests, pa.array([joined(x.all()) for x in found], pa.string())], names)
        release()

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, schema)
