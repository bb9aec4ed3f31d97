"""Personal data: patterns propose spans, checksums confirm them, context words adjust their scores.

Kinds of the base, always kept once their check holds: email, ip (parts up to 255), card (13 to 19
digits, Luhn), phone (9 to 15 digits). Kinds the method adds: iban (length of its country, mod 97), and
ssn and secret (a key of 32 to 64 hexadecimal digits, of which DISTINCT or more differ), which have no
checksum and so need a context word nearby. Context words stand within WINDOW code points
of the span, in English, German, French or Spanish; some raise its score and some lower it. Spans of the
added kinds with a score below LEAST are dropped, those of the base keep theirs.

Edge cases: a null text is an empty one and has no spans; texts of any length are scanned whole, in
linear time; offsets are code points, the end exclusive; input columns of any name stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP_HINT = re.compile(r"[0-9]\.[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
# Areas 000, 666 and from 900, group 00 and serial 0000 are never given out.
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}+(?![0-9A-Za-z])")
_NON_DIGIT = re.compile(r"[^0-9]")

# IBAN lengths by country, as in the registry.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "secret": 0.3}
# Words of English, German, French and Spanish that raise a score, and such that lower it.
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "kontakt", "courriel", "adresse", "correo", "contacto"),
    "ip": ("ip", "address", "server", "host", "adresse", "serveur", "servidor", "dirección", "rechner"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "kreditkarte", "zahlung", "carte", "paiement", "tarjeta", "crédito", "pago"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "anruf", "mobil", "téléphone", "appel", "portable", "teléfono", "llamada", "móvil"),
    "iban": ("iban", "account", "bank", "konto", "bankverbindung", "compte", "banque", "cuenta", "banco"),
    "secret": ("token", "key", "apikey", "api_key", "secret", "password", "bearer", "passwort", "schlüssel", "clé", "jeton", "contraseña", "clave"),
    "ssn": ("ssn", "social", "security", "sozialversicherung", "sécurité", "sociale", "seguridad", "seguro"),
}
AGAINST = {
    "ip": ("version", "versión", "release", "firmware", "build"),
    "card": ("isbn", "order", "bestellung", "commande", "pedido"),
    "phone": ("isbn", "version"),
    "secret": ("checksum", "digest", "commit", "md5", "sha1", "sha256"),
    "ssn": ("order", "part", "serial", "bestellung", "commande", "pedido"),
}
BONUS, WINDOW, LEAST, DISTINCT = 0.3, 40, 0.5, 8
_near = lambda table: {k: re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b", re.IGNORECASE) for k, words in table.items()}
_CONTEXT, _AGAINST = _near(CONTEXT), _near(AGAINST)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern's leftmost matches, found from each @ back to the start of the local part."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Every start is tried; the search goes on behind what was accepted, or one further than what was not."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        want = IBAN_LENGTH.get(m[1])
        if not want:
            continue
        seen, end = 0, m.start()
        while end < m.end() and seen < want:
            seen += text[end] != " "
            end += 1
        if seen == want and not (end < len(text) and text[end].isalnum()) and mod97(text[m.start() : end].replace(" ", "")):
            yield m.start(), end
            at = end


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans of a text as (kind, start, end, score), by kind as in KINDS and start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += (("email", *x) for x in _emails(text))
    if _IP_HINT.search(text):
        found += (("ip", *m.span()) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split(".")))
    found += (("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _NON_DIGIT.sub("", m[0])) <= 19 and luhn(d))
    if "+" in text:
        found += (("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NON_DIGIT.sub("", m[0])) <= 15)
    found += (("iban", *x) for x in _ibans(text))
    if "-" in text:
        found += (("ssn", *m.span()) for m in _SSN.finditer(text))
    found += (("secret", *m.span()) for m in _SECRET.finditer(text) if len(set(m[0].lower())) >= DISTINCT)
    out = []
    for kind, start, end in found:
        near = text[max(0, start - WINDOW) : start] + "\n" + text[end : end + WINDOW]
        against = kind in _AGAINST and _AGAINST[kind].search(near)
        score = min(1.0, max(0.0, SCORE[kind] + BONUS * bool(_CONTEXT[kind].search(near)) - BONUS * bool(against)))
        if kind in BASE or score >= LEAST:
            out.append((kind, start, end, score))
    return out


_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"
_ARROW = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def _spans_of(texts: pa.Array) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t)] if (t := x.as_py()) else [] for x in texts], type=pa.list_(_ARROW))


def _redacted(texts: pa.Array, found: pa.Array) -> pa.Array:
    out = []
    for x, s in zip(texts.to_pylist(), found.to_pylist(), strict=True):
        done, at = [], 0
        for one in sorted(s or (), key=lambda y: (y["start"], -y["end"])):
            if one["start"] >= at:
                done += [x[at : one["start"]], f"<{one['kind'].upper()}>"]
                at = one["end"]
        out.append(x if x is None else "".join([*done, x[at:]]))
    return pa.array(out, type=pa.string())


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with a column of spans: array of (kind, start, end, score). Each row is done on its own."""
    return docs.withColumn(out, F.arrow_udf(_spans_of, _TYPE)(F.col(text).cast("string")))


def redact(found: DataFrame, text: str = "text", pii: str = "pii", out: str = "redacted") -> DataFrame:
    """Texts in which each span is replaced by its kind; of overlapping spans the first and longest counts."""
    return found.withColumn(out, F.arrow_udf(_redacted, "string")(F.col(text).cast("string"), F.col(pii)))


def span_list(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
