"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Kinds of the base contract: email, ip, card (Luhn), phone.  The method adds iban (mod-97), and number
kinds that a checksum or the shape leaves open and context decides: ssn (nine digits grouped 3-2-4) and local
(a telephone number without the country code).  Every proposal starts from the prior of its kind; a passed
checksum raises it, context words of the kind within 40 characters raise it, words of another reading
("order", "version", "invoice" ...) lower it, and it is reported at ``CUT`` or more.  Base spans are always reported.

An account takes the length of its country, or else the longest end before a space or sign whose checksum passes:
words that follow it ("BIC", "EUR 50") are not part of it.

All scans are linear: runs are taken whole (possessive), and an address is searched from its "@".
Defined cases: a null or empty text has no spans; texts are scanned whole; an empty table gives an empty
result; repeated rows and other columns are passed over.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from switchyard.llm.spans import Span, find_spans

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local")
BASE = 4
EMAIL, IP, CARD, PHONE, IBAN, SSN, LOCAL = range(7)

LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
CALL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Length of an account number by country.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
LENGTH_OF = {country: n for n, some in ACCOUNT_LENGTHS.items() for country in some.split()}
SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9-])")
NEAR_CALL = re.compile(r"(?<![0-9+().-])\(?0?[0-9]{2,4}\)?[\x20-][0-9]{3,4}[\x20-]?[0-9]{3,4}(?![0-9-])")

#: Reported from this score on.
CUT = 0.6
NEARBY = 40
#: Prior score, context words that raise it (one rise per text window), words that lower it.
PRIOR = {IBAN: 0.2, SSN: 0.3, LOCAL: 0.2}
CHECKED = 0.6
RAISED, LOWERED = 0.4, 0.3
FOR = {
    IBAN: ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"),
    SSN: ("ssn", "social security", "social-security"),
    LOCAL: ("phone", "call", "tel", "mobile", "fax", "telefon", "anruf", "appel", "llam"),
}
AGAINST = ("order", "invoice", "version", "isbn", "serial", "ticket", "build", "model")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The remainder of a rearranged account number with letters as 10 to 35 must be 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def accounts(text: str) -> list[tuple[int, int]]:
    """Start and end of every account number with a passed checksum."""
    out, m = [], ACCOUNT.search(text)
    while m:
        run, ends, size = m[0], [], 0
        for i, c in enumerate(run):  # at most 34 letters and digits
            size += c != " "
            if size >= 15 and c != " " and run[i + 1 : i + 2] in ("", " "):
                ends.append((size != LENGTH_OF.get(run[:2]), -size, i + 1))
        end = next((e for _, _, e in sorted(ends) if mod97(run[:e].replace(" ", ""))), None)
        if end:
            out.append((m.start(), m.start() + end))
        m = ACCOUNT.search(text, m.start() + (end or 4))
    return out


def emails(text: str) -> list[Span]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        local = len(head) - len(head.rstrip(LOCAL_PART))
        domain = DOMAIN.match(text, at + 1) if local else None
        if domain:
            out.append((at - local, EMAIL, domain.end()))
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def addresses(text: str) -> list[Span]:
    out = []
    for m in CHAIN.finditer(text):
        if "." not in m[0]:
            continue
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_byte, four)):
                out.append((at, IP, end))
            at = end + 1
    return out


def cards(text: str) -> list[Span]:
    out = []
    for m in DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), CARD, m.end()))
    return out


def phones(text: str) -> list[Span]:
    return [
        (m.start(), PHONE, m.end()) for m in CALL.finditer(text)
        if 10 <= sum(map(str.isdigit, m[0])) <= 15
    ]


def score(text: str, start: int, end: int, kind: int, checked: bool) -> float:
    """Prior, plus the checksum, plus or minus the words within ``NEARBY`` characters."""
    around = (text[max(0, start - NEARBY) : start] + " " + text[end : end + NEARBY]).lower()
    value = PRIOR[kind] + (CHECKED if checked else 0.0)
    value += RAISED if any(w in around for w in FOR[kind]) else 0.0
    value -= LOWERED if any(w in around for w in AGAINST) else 0.0
    return min(1.0, max(0.0, value))


def further(text: str, base: list[Span]) -> list[Span]:
    """Spans that the method adds; none overlaps a base span or an earlier one."""
    taken, out = bytearray(len(text)), []
    for a, _, b in base:
        taken[a:b] = b"\1" * (b - a)
    proposals = [(a, b, IBAN) for a, b in accounts(text)] + [(*m.span(), SSN) for m in SOCIAL.finditer(text)]
    proposals += [(*m.span(), LOCAL) for m in NEAR_CALL.finditer(text)]
    for a, b, kind in proposals:
        found = text[a:b]
        if kind == SSN and (found[:3] in ("000", "666") or found[0] == "9" or found[4:6] == "00" or found[-4:] == "0000"):
            continue
        if score(text, a, b, kind, kind == IBAN) >= CUT and not any(taken[a:b]):
            out.append((a, kind, b))
            taken[a:b] = b"\1" * (b - a)
    return out


ANY_DIGIT = re.compile("[0-9]")


def find(text: str) -> list[Span]:
    base = emails(text) if "@" in text else []
    if ANY_DIGIT.search(text):
        base += addresses(text) + cards(text)
        if "+" in text:
            base += phones(text)
        base += further(text, base)
    return base


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", detail: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (and the found values with ``detail``)."""
    return find_spans(docs, find, KINDS, BASE, doc_id, text, detail)
