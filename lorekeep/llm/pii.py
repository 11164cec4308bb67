"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust their scores.

Four base kinds (email, ip, card, phone) are found as their expressions define, leftmost and non-overlapping per kind; a match
that its check refuses is dropped and not tried again. They stay whatever their score. Nine more kinds are added where
their score reaches ``THRESHOLD``: their own plausibility, more where a word of theirs stands within ``NEAR`` code points
and less where one stands there that tells of other numbers (orders, versions). Checks: Luhn (cards), mod 97 (IBAN, French
social security numbers), ISO 7064 mod 11,10 (German tax ids), mod 23 (Spanish ids), ranges (ip, US social security numbers),
the calendar (dates of birth), entropy (secrets). An added span never overlaps a base span, nor one with a better score.

Every expression takes time in proportion to the text, unbroken runs included: quantifiers that could start over at each
character are possessive and bound to the run's start; e-mail addresses are found from their ``@``, which a local part never
holds. Work is per row, without a shuffle; long and hot sources need nothing more.

Defined cases: a null text is empty; empty texts have no spans; repeated rows each get their row; no rows give no rows;
columns other than the id and the text are ignored by ``find_pii`` and passed on by ``redact``. Offsets are code points.
"""

from __future__ import annotations

import datetime
import ipaddress
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import read_table, ship_package

BASE = ("email", "ip", "card", "phone")
#: Score from which added spans count, the distance of words that tell, and what they are worth.
THRESHOLD = 0.5
NEAR = 40
FOR, AGAINST = 0.25, 0.3

# Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
# Check letters of Spanish ids by number modulo 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


# -- checks -----------------------------------------------------------------------------------------------------------


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(number)):
        d = int(c) * (1 + place % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN's letters and digits, its first four moved to the end, leave 1 when divided by 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def mod11_10(number: str) -> bool:
    carry = 10
    for c in number[:-1]:
        carry = ((carry + int(c)) % 10 or 10) * 2 % 11
    return (11 - carry) % 10 == int(number[-1])


def is_ip(text: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (part.lstrip("0") or "0" for part in text.split(".")))


def is_card(text: str) -> bool:
    number = digits(text)
    return 12 <= len(number) <= 19 and luhn(number)


def is_phone(text: str) -> bool:
    return 9 <= len(digits(text)) <= 15


def is_iban(text: str) -> bool:
    return mod97(text.replace(" ", ""))


def is_ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def is_nir(text: str) -> bool:
    number = digits(text)
    return 97 - int(number[:13]) % 97 == int(number[13:])


def is_tax_id(text: str) -> bool:
    """Eleven digits of which the first ten hold one digit twice or thrice, with a check digit."""
    counts = sorted(Counter(text[:10]).values(), reverse=True)
    return text[0] != "0" and counts[0] in (2, 3) and counts[1:2] == [1] and mod11_10(text)


def is_dni(text: str) -> bool:
    number = text[:-1].rstrip("-").replace("X", "0").replace("Y", "1").replace("Z", "2")
    return DNI_LETTERS[int(number) % 23] == text[-1]


def is_secret(text: str) -> bool:
    """Random enough: three bits a character, letters and digits."""
    entropy = -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())
    return entropy >= 3 and any(c.isdigit() for c in text) and any(c.isalpha() for c in text)


def is_ipv6(text: str) -> bool:
    try:
        return len(digits(text)) > 0 and ipaddress.IPv6Address(text) is not None
    except ValueError:
        return False


def is_date(text: str) -> bool:
    day, month, year = (int(x) for x in re.split(r"[./-]", text))
    try:
        return 1900 <= year <= 2100 and datetime.date(year, *((month, day) if month <= 12 else (day, month))) is not None
    except ValueError:
        return False


# -- proposals --------------------------------------------------------------------------------------------------------

Span = tuple[int, int]


def by_expression(pattern: str, needs: str = "") -> Callable[[str], Iterator[Span]]:
    """Spans of an expression, where the text holds ``needs``."""
    found = re.compile(pattern)
    return lambda text: (m.span() for m in found.finditer(text)) if needs in text else iter(())


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, each from its ``@``: the
    local part is the run before it, as far as the match before left it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")


def ibans(text: str) -> Iterator[Span]:
    """A country's letters and as many letters and digits as its IBANs have, single spaces between them allowed."""
    for head in _IBAN_HEAD.finditer(text):
        length = IBAN_LENGTHS.get(head[0][:2])
        if length:
            body = re.compile(rf"(?:\x20?[A-Z0-9]){{{length - 4}}}(?![A-Za-z0-9])").match(text, head.end())
            if body:
                yield head.start(), body.end()


_ASSIGNED = re.compile(r"[=:]\x20{0,3}[\"']?([A-Za-z0-9+/_.~-]{12,200}+)(?![A-Za-z0-9+/_.~-])")
_NAMED = re.compile(r"(?:api[_-]?key|access[_-]?key|secret|token|passwd|password|pwd)[\"']?\x20{0,3}$", re.IGNORECASE)
_KEYS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])")


def secrets(text: str) -> Iterator[Span]:
    """Values that a name such as token or password is given, and keys of known form."""
    for m in _ASSIGNED.finditer(text):
        if _NAMED.search(text[max(0, m.start() - 24) : m.start()]):
            yield m.span(1)
    if "AKIA" in text or "gh" in text:
        yield from (m.span() for m in _KEYS.finditer(text))


@dataclass(frozen=True)
class Kind:
    name: str
    propose: Callable[[str], Iterator[Span]]
    confirm: Callable[[str], bool]
    score: float
    words: frozenset[str]


def _kind(name: str, propose: Callable, confirm: Callable, score: float, words: str) -> Kind:
    return Kind(name, propose, confirm, score, frozenset(words.split()))


#: The base kinds first; this is the order in which spans that start together are listed.
KINDS = (
    _kind("email", emails, lambda _: True, 0.75, "email mail e-mail contact write correo courriel kontakt"),
    # possessive and bound to a run's start: the same matches as without, in time linear in the text
    _kind("ip", by_expression(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."), is_ip, 0.6, "ip address host server addr adresse from login"),
    _kind("card", by_expression(r"[0-9]++(?:[\x20-][0-9]++)*+"), is_card, 0.7, "card credit visa mastercard amex debit karte tarjeta carte payment"),
    _kind("phone", by_expression(r"\+[0-9][\x20().0-9-]+[0-9]", "+"), is_phone, 0.7, "phone tel telephone mobile cell call fax telefon handy teléfono téléphone"),
    _kind("iban", ibans, is_iban, 0.9, "iban account bank konto cuenta compte"),
    _kind("ssn", by_expression(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"), is_ssn, 0.4, "ssn social security"),
    _kind("nir", by_expression(r"(?<![0-9])[12]\x20?[0-9]{2}\x20?(?:0[1-9]|1[0-2])\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![0-9])"), is_nir, 0.55, "nir sécu sécurité sociale insee"),
    _kind("tax_id", by_expression(r"(?<![0-9])[0-9]{11}(?![0-9])"), is_tax_id, 0.3, "steuer steuer-id steuernummer idnr identifikationsnummer tin"),
    _kind("dni", by_expression(r"(?<![A-Za-z0-9])(?:[0-9]{8}|[XYZ][0-9]{7})-?[A-Z](?![A-Za-z0-9])"), is_dni, 0.6, "dni nie nif documento identidad"),
    _kind("secret", secrets, is_secret, 0.8, "key token secret password credentials"),
    _kind("ipv6", by_expression(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])", ":"), is_ipv6, 0.6, "ip ipv6 address host server"),
    _kind("mac", by_expression(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Za-z:])", ":"), lambda _: True, 0.7, "mac ethernet device address"),
    _kind("birth", by_expression(r"(?<![0-9./-])[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{4}(?![0-9])"), is_date, 0.3, "born birth dob birthday geboren geburtsdatum né née nacido nacida naissance nacimiento"),
)
_ORDER = {kind.name: k for k, kind in enumerate(KINDS)}
#: Words that tell of other numbers.
OTHER = frozenset("order invoice version build part ref reference isbn example sample test article serial".split())
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_TAKES_DIGITS = re.compile(r"[0-9]")


def score_of(kind: Kind, text: str, start: int, end: int) -> float:
    """The kind's plausibility, with what the words within ``NEAR`` code points say for it or against it."""
    near = set(_WORD.findall(text[max(0, start - NEAR) : start].lower())) | set(_WORD.findall(text[end : end + NEAR].lower()))
    return round(min(1.0, max(0.0, kind.score + FOR * bool(near & kind.words) - AGAINST * bool(near & OTHER))), 2)


def _free(taken: list[Span], start: int, end: int) -> bool:
    """Whether nothing of sorted, disjoint spans overlaps."""
    at = bisect_left(taken, (start, start))
    return (at == len(taken) or taken[at][0] >= end) and (at == 0 or taken[at - 1][1] <= start)


def _merged(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a text, by start, then kind as listed."""
    if "@" not in text and ":" not in text and "=" not in text and not _TAKES_DIGITS.search(text):
        return []
    found = [(kind, s, e) for kind in KINDS for s, e in kind.propose(text) if kind.confirm(text[s:e])]
    scored = [(kind.name, s, e, score_of(kind, text, s, e)) for kind, s, e in found]
    kept = [x for x in scored if x[0] in BASE]
    added = [x for x in scored if x[0] not in BASE and x[3] >= THRESHOLD]
    if added:
        fixed, taken = _merged([x[1:3] for x in kept]), []
        for x in sorted(added, key=lambda x: (-x[3], x[1] - x[2], x[1], _ORDER[x[0]])):
            if _free(fixed, *x[1:3]) and _free(taken, *x[1:3]):
                taken.insert(bisect_left(taken, x[1:3]), x[1:3])
                kept.append(x)
    return sorted(kept, key=lambda x: (x[1], _ORDER[x[0]]))


def redacted(text: str) -> str:
    """The text with each span, overlapping ones as one, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, start, end, _ in find_spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


# -- over tables ------------------------------------------------------------------------------------------------------

_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
_FIELDS = ("kind", "start", "end", "score")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end, score) by start, then kind as listed."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(_FIELDS, s, strict=True)) for s in find_spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(of, f"doc_id {id_type}, spans array<struct<kind:string,start:int,end:int,score:double>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in its texts replaced by the kinds' names; null stays null."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("string")
    def of(texts):
        return texts.map(lambda t: None if t is None else redacted(t))

    return docs.withColumn(text_col, of(text_col)).select(*docs.columns)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_pii(spark, sf_dir):
    spans = F.col("spans")
    of = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    return find_pii(read_table(spark, sf_dir, "documents")).select(
        "doc_id", *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE], F.sha2(_listed(F.filter(spans, lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        _listed(spans).alias("spans"), F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
