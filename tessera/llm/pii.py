"""Personal data in whole texts: expressions propose, checksums confirm, nearby words adjust the score.

Base kinds (email, ip, card, phone) are found leftmost and without overlap, and
stay whatever their score. Further spans must reach ``THRESHOLD``: account
numbers that pass mod-97, numbers inside longer digit chains that pass Luhn
alone (unbroken runs, and windows of whole digit groups), credentials of known
forms, and weaker forms (13 to 15 digit cards, national telephone numbers,
social security numbers, random-looking strings) only beside a word that speaks
of them. A random-looking string is confirmed by the entropy of its signs.

Cases: a null or empty text has no spans. Equal texts have equal spans; repeated
rows stay separate rows. Of two inner cards that overlap the one that begins
first stays, the longer of equal ones; spans of other kinds may overlap. Only
the id (of any type) and text columns are read, so further columns don't matter,
whatever their names. Scans are linear in the text, however long: each
expression starts at a rare sign or at the first sign of a run.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
THRESHOLD = 0.8
#: Code points on either side in which a context word counts.
WINDOW = 40
ROWS = 512
SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"

#: Words (English, German, French, Spanish) that speak of a kind.
CONTEXT = {
    "email": "email e-mail mail contact kontakt correo courriel",
    "ip": "ip address server host adresse dirección serveur servidor",
    "card": "card visa mastercard amex credit karte kreditkarte carte tarjeta crédit crédito",
    "phone": "phone tel telephone call mobile cell fax telefon handy téléphone appelez teléfono móvil llame",
    "iban": "iban account konto compte cuenta bank banque banco",
    "ssn": "ssn social security",
    "secret": "token secret key apikey password passwd pwd bearer authorization credential credentials passwort schlüssel jeton clé contraseña clave",
}
#: Lengths of account numbers by country.
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21,
    "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
#: Score of a span before its neighbours are looked at; a context word adds CONTEXT_SCORE.
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "inner card": 0.8, "short card": 0.5, "local phone": 0.4, "ssn": 0.4, "known secret": 0.9, "random string": 0.5}
CONTEXT_SCORE = 0.4
#: Bits for each sign that a random-looking string has at least: digits and the letters a to f give 4 at most.
ENTROPY = 3.0

_digit = re.compile(r"[0-9]")
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_chain = re.compile(r"[0-9](?:[ -]?[0-9])+")
_plus = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_ssn = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_local_phone = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
#: How keys of well-known services and signed web tokens begin.
_known_secret = re.compile(r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,200}|eyJ[A-Za-z0-9_-]{8,2000}\.[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,2000})(?![A-Za-z0-9_-])|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")
_random = re.compile(r"(?<![A-Za-z0-9+/_@.-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9@])")
#: Words are bounded by what isn't a letter, so that a word of a name such as access_token counts.
_context = {kind: re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, said.split())) + r")(?![^\W\d_])", re.I) for kind, said in CONTEXT.items()}


def luhn(digits: str) -> bool:
    """Whether the digits' checksum (every second doubled, from the right) is a multiple of ten."""
    total = sum(map(int, digits[::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def octet(digits: str) -> bool:
    """Whether the number is at most 255; zeros may lead it, however many."""
    value = digits.lstrip("0")
    return len(value) < 4 and int(value or "0") <= 255


def random_looking(text: str) -> bool:
    """Whether a string has letters and digits and the entropy of random signs."""
    counts = Counter(text)
    if not any("0" <= c <= "9" for c in counts) or not any(c.isalpha() for c in counts):
        return False
    return sum(n * math.log2(len(text) / n) for n in counts.values()) >= ENTROPY * len(text)


def inner_cards(chain: str) -> Iterator[tuple[int, int, str]]:
    """Cards inside a digit chain that isn't one itself: windows of whole digit groups with 16 to 19 digits that pass Luhn, the first of overlapping ones. A group of its own counts at once, as do four groups of four; others need a context word. No more than 19 groups are looked at from each."""
    groups = [m.span() for m in re.finditer(r"[0-9]+", chain)]
    at = 0
    while at < len(groups):
        digits, top = "", None
        for k in range(at, len(groups)):
            digits += chain[slice(*groups[k])] if groups[k][1] - groups[k][0] <= 19 else "0" * 20
            if len(digits) > 19:
                break
            if len(digits) >= 16 and luhn(digits) and (at, k) != (0, len(groups) - 1):
                top = k
        if top is None:
            at += 1
            continue
        sizes = [b - a for a, b in groups[at : top + 1]]
        yield groups[at][0], groups[top][1], "inner card" if len(sizes) == 1 or sizes == [4] * 4 else "short card"
        at = top + 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _domain.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _local:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by kind and then start."""
    found = [("email", *x) for x in emails(text)] if "@" in text else []
    if not _digit.search(text):
        return found
    found += [("ip", *m.span()) for m in _ip.finditer(text) if all(octet(p) for p in m[0].split("."))]
    found += [("card", *m.span()) for m in _chain.finditer(text) if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in _plus.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


def secrets(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Credentials of known forms, and strings that look random."""
    known = [m.span() for m in _known_secret.finditer(text)]
    for span in known:
        yield "secret", *span, "known secret"
    ends = [e for _, e in known]
    for m in _random.finditer(text):
        k = bisect_right(ends, m.start())  # the first that doesn't end before
        if not (k < len(known) and known[k][0] < m.end()) and random_looking(m[0]):
            yield "secret", *m.span(), "random string"


def further_spans(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, str]]:
    """Confirmed proposals beside the base spans: kind, start, end and what it is scored as."""
    yield from secrets(text)
    if not _digit.search(text):
        return
    taken = {(s, e) for kind, s, e in base if kind == "card"}
    for m in _chain.finditer(text):
        if m.span() in taken:
            continue
        if 13 <= len(d := digits_of(m[0])) <= 15 and luhn(d):
            yield "card", *m.span(), "short card"
        elif len(d) > 16:
            for start, end, scored_as in inner_cards(m[0]):
                yield "card", m.start() + start, m.start() + end, scored_as
    for m in _iban.finditer(text):
        if length := IBAN_LENGTH.get(m[0][:2]):
            places = [i for i, c in enumerate(m[0]) if c != " "][:length]
            account = "".join(m[0][i] for i in places)
            end = m.start() + places[-1] + 1
            if len(account) == length and not text[end : end + 1].isalnum() and mod97(account):
                yield "iban", m.start(), end, "iban"
    for m in _ssn.finditer(text):
        yield "ssn", *m.span(), "ssn"
    for m in _local_phone.finditer(text):
        if not any(kind == "phone" and s < m.end() and m.start() < e for kind, s, e in base):
            yield "phone", *m.span(), "local phone"


def score(text: str, kind: str, start: int, end: int, scored_as: str) -> float:
    near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
    return min(1.0, SCORE[scored_as] + CONTEXT_SCORE * bool(_context[kind].search(near)))


def spans(text: str) -> list[dict]:
    """All spans of a text, by kind (as in KINDS), start and end."""
    base = base_spans(text)
    found = [{"kind": k, "start": s, "end": e, "score": score(text, k, s, e, k), "base": True} for k, s, e in base]
    for k, s, e, scored_as in further_spans(text, base):
        if (sure := score(text, k, s, e, scored_as)) >= THRESHOLD:
            found.append({"kind": k, "start": s, "end": e, "score": sure, "base": False})
    return sorted(found, key=lambda x: (KINDS.index(x["kind"]), x["start"], x["end"]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): for each document the spans found in its whole text, in code points, end exclusive. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([spans(t) if t else [] for t in rows.column(1).to_pylist()], kind)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, spans {SPANS}")


def mask(text: str, found: list) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap an earlier one are merged into it."""
    out, at = [], 0
    for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def joined(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))


def digests(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *(F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
