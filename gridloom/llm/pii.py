"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, plus signs,
digits, URL schemes, cues of identifiers and kinds of streets. Deterministic parsers expand
each anchor to the bounds of an e-mail address, IP address, card number, phone number, URL
with credentials, account identifier or secret, or postal address, and validate it. Each
parser steps forward only, or back over a few words, so long texts take linear time.

Null text counts as empty, and so do empty tables; doc_id may be null or repeated, every
row is scanned by itself. Other columns are ignored by :func:`scan`, whatever their names,
and kept by :func:`redact`. Of overlapping candidates of one kind the first counts; spans
of different kinds may overlap. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

#: Kinds in the order in which spans are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "account", "address")
# Cues that stand before an identifier, and before a secret; kinds of streets, before and behind their names.
CUES = ("iban", "account", "acct", "konto", "passport", "ssn", "social security", "tax id")
SECRETS = ("token", "secret", "api_key", "api-key", "api key", "apikey", "access_key", "access key", "private_key", "private key", "password", "passwd", "passwort", "pwd", "passphrase", "mot de passe", "contraseña", "authorization", "bearer")
STREETS = ("street", "avenue", "road", "lane", "boulevard", "drive", "square")
JOINED_STREETS = ("straße", "strasse", "gasse", "allee", "platz")

_DIGITS = "0123456789"
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_NUMBER = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# No class but the last takes a slash, so a failed match never passes the next scheme.
_CREDENTIALS = re.compile(r"://[^\s/@:]++:[^\s/@]++@[A-Za-z0-9.-]++(?::[0-9]{1,5})?[^\s\"<>]*+")
_ASSIGNED = re.compile(r"[\"']?[ ]?[:=][ ]?(?P<quote>[\"']?)")
_QUOTED = re.compile(r"[^\"'\n]{6,}+(?=[\"'])")
_BARE = re.compile(r"[^\s\"'<>,;]{6,}")
_HOUSE = re.compile(r"[0-9]{1,6}[A-Za-z]?(?:[ ](?:[A-Z][\w'.-]*|[0-9]{1,3}(?:st|nd|rd|th))){1,4}[ ]\Z")
_BEHIND = re.compile(r"(?:[ ](?:N|S|E|W|NE|NW|SE|SW)\b\.?)?(?:,?[ ](?:Apt|Suite|Unit|Floor)\.?[ ]#?\w+)?(?:,[ ][A-Z][\w.-]*(?:[ ][A-Z][\w.-]*){0,2})?(?:,?[ ][A-Z]{2})?(?:[ ][0-9]{5}(?:-[0-9]{4})?)?")
_NUMBERED = re.compile(r"[ ][0-9]{1,4}[ ]?[a-z]?\b(?:,[ ][0-9]{4,5}(?:[ ][A-ZÄÖÜ][\w-]*)?)?")
_LEAD = re.compile(r"(?i:(?:[ _-]?(?:number|no|nr|id|code|key))?[.:#]?[ ]?[=:]?[ ]?[\"']?)")
_VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9-]{5,}")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ ]?[A-Za-z0-9]{2,4}){3,8}")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("@", ["@"]), ("+", ["+"]), ("0", _DIGITS), (":", ["://"]), ("cue", CUES + SECRETS), ("street", STREETS), ("joined", JOINED_STREETS)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _emails(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    done = 0
    for at in anchors:
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start == at:
            continue
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            done = domain.end()
            yield start, done


def _ips(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    """Anchors are first digits of numbers."""
    done = 0
    for at in anchors:
        if at < done:
            continue
        found = _IP.match(text, at)
        if found:
            done = found.end()
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in found[0].split(".")):
                yield at, done


def _cards(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    done = 0
    for at in anchors:
        if at < done:
            continue
        found = _CARD.match(text, at)
        if found:
            done = found.end()
            digits = found[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield at, done


def _phones(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    done = 0
    for at in anchors:
        if at < done:
            continue
        found = _PHONE.match(text, at)
        if found:
            done = found.end()
            if 9 <= sum(c in _DIGITS for c in found[0]) <= 15:
                yield at, done


def _urls(text: str, anchors: list[int]) -> Iterator[tuple[int, int]]:
    """URLs that carry a user's name and password; anchors are the colons of schemes."""
    done = 0
    for at in anchors:
        if at < done:
            continue
        found = _CREDENTIALS.match(text, at)
        start = at
        while start > done and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
            start -= 1
        if found and start < at:
            done = found.end()
            yield start, done


def _iban(text: str, at: int) -> int:
    """End of a valid IBAN that starts here, or 0: the longest run of its groups that passes the check digits."""
    found = _IBAN.match(text, at)
    end = found.end() if found else 0
    while end - at >= 15:
        packed = text[at:end].replace(" ", "").upper()
        if 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1:
            return end
        cut = text.rfind(" ", at, end)
        end = cut if cut > at else 0
    return 0


def _secret(text: str, at: int) -> tuple[int, int]:
    """Bounds of what is assigned behind the name of a secret: in quotes, or six characters at least up to a blank; (0, 0) if nothing is."""
    sign = _ASSIGNED.match(text, at)
    if not sign:
        return 0, 0
    found = _QUOTED.match(text, sign.end()) if sign["quote"] else _BARE.match(text, sign.end())
    return (found.start(), found.end()) if found else (0, 0)


def _accounts(text: str, anchors: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Values behind a cue: a valid IBAN, an identifier with six digits at least, or anything assigned to a secret. Anchors are the cues' bounds."""
    done = 0
    for start, end in anchors:
        if start < done or (start and text[start - 1].isalnum()):
            continue
        at = _LEAD.match(text, end).end()
        wide, value = _iban(text, at), _VALUE.match(text, at)
        if wide:
            done = wide
            yield at, done
        elif value and sum(c in _DIGITS for c in value[0]) >= 6:
            done = value.end()
            yield at, done
        elif text[start:end].lower() in SECRETS:
            first, last = _secret(text, end)
            if last:
                done = last
                yield first, last


def _addresses(text: str, anchors: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """A house number, names and a kind of street, with town and code; or a street's name and a number behind it. Anchors are the kinds' bounds."""
    done = 0
    for kind, start, end in anchors:
        if start < done or (end < len(text) and (text[end].isalnum() or text[end] == "_")):
            continue
        if kind == "street":
            lead = max(done, start - 100)  # a number and four names
            found = next((m for k in range(lead, start) if text[k] in _DIGITS and (k == lead or not text[k - 1].isalnum()) and (m := _HOUSE.match(text[k:start]))), None)
            if found and text[start].isupper():
                done = _BEHIND.match(text, end).end()
                yield start - len(found[0]), done
        else:
            first = start
            while first > done and (text[first - 1].isalpha() or text[first - 1] == "-"):
                first -= 1
            found = _NUMBERED.match(text, end)
            if found and first < start and text[first].isupper():
                done = found.end()
                yield first, done


_PARSERS: dict[str, Callable[[str, list], Iterator[tuple[int, int]]]] = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "url": _urls, "account": _accounts, "address": _addresses}


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by kind and then start."""
    at, numbers, plus, schemes, cues, streets = [], [], [], [], [], []
    last = -2
    folded = text.lower()
    if len(folded) != len(text):  # U+0130 alone becomes two
        folded = text.replace("\u0130", "\0").lower()
    for end, (kind, size) in automaton.iter(folded):
        if kind == "0":
            if end != last + 1:
                numbers.append(end)
            last = end
        elif kind == "@":
            at.append(end)
        elif kind == "+":
            plus.append(end)
        elif kind == ":":
            schemes.append(end - 2)
        elif kind == "cue":
            cues.append((end - size + 1, end + 1))
        else:
            streets.append((kind, end - size + 1, end + 1))
    cues.sort(key=lambda x: (x[0], -x[1]))  # of cues that start together the longest
    anchors = {"email": at, "ip": numbers, "card": numbers, "phone": plus, "url": schemes, "account": cues, "address": streets}
    return [(k, s, e) for k in KINDS if anchors[k] for s, e in _PARSERS[k](text, anchors[k])]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end; by kind as listed, then start) of every row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton()
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t, automaton)] if t else [] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the one that starts first gives the name."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by ``[KIND]``; null texts stay null, and n_chars follows where there is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton()
        for batch in batches:
            texts = [masked(t, find(t, automaton)) if t else t for t in batch["text"]]
            out = batch.assign(text=pd.Series(texts, index=batch.index, dtype=object))
            if "n_chars" in out:
                out["n_chars"] = out["n_chars"].where(pd.Series([a is b or a == b for a, b in zip(texts, batch["text"])], index=batch.index), pd.Series([len(t) if t else 0 for t in texts], index=batch.index))
            yield out

    return docs.mapInPandas(run, docs.schema)
