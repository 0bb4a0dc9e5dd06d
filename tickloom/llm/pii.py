"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their score.

Fixed values: the base patterns and their order are the contract's; the further kinds are IBANs (length by country, mod-97), US
social security numbers (group rules and context) and access keys or tokens (form, entropy of their alphabet and context).
Patterns are searched in time that grows with the text's length alone: see _FIND.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import real_id, safe_id

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{40}|[0-9a-f]{64}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,64})(?![A-Za-z0-9])",
}
#: Characters of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Whole words near a span, or their plurals, that speak for its kind, and words that speak against personal data.
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "reply"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "cvv", "expires"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "secret": ("token", "key", "secret", "password", "aws", "api", "apikey", "accesskey", "secretkey", "authtoken"),
}
AGAINST = ("example", "sample", "version", "isbn", "order", "dummy")
WEIGHT = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.5, "ssn": 0.5, "secret": 0.6}
NEAR = 40


def _words(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(words)})s?(?![A-Za-z0-9])", re.IGNORECASE)


_CONTEXT, _AGAINST = {kind: _words(words) for kind, words in CONTEXT.items()}, _words(AGAINST)


def luhn(digits: str) -> bool:
    """The checksum of card numbers: every second digit from the right doubled, digits summed, a multiple of ten."""
    odd = sum(int(d) for d in digits[-1::-2])
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 on an IBAN: the first four characters moved to the end, letters as 10 to 35, remainder 1."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(found: str) -> str:
    return re.sub("[^0-9]", "", found)


def _ssn(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


CONFIRMED: dict[str, Callable[[str], bool]] = {
    "email": lambda s: True,
    "ip": lambda s: all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in s.split(".")),
    "card": lambda s: 12 <= len(d := _digits(s)) <= 19 and luhn(d),
    "phone": lambda s: 9 <= len(_digits(s)) <= 15,
    "iban": lambda s: 15 <= len(c := s.replace(" ", "")) <= 34 and mod97(c),
    "ssn": _ssn,
    "secret": lambda s: len(set(s)) >= 8,
}
CHECKSUM = {"card", "iban"}
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IBAN = {c: re.compile(rf"{c}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for c, n in IBAN_LENGTH.items()}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, from each @ to both sides: what may stand before it is looked at once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", at + 1)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Places that start as an IBAN, up to the length of their country."""
    for m in _PLAIN["iban"].finditer(text):
        if (whole := _IBAN.get(m[0][:2])) and (found := whole.match(text, m.start())):
            yield found.span()


def _plain(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


_PLAIN = {kind: re.compile(p) for kind, p in PATTERNS.items()}
#: Spans by kind. A match of the ip pattern starts where digits start and no part of it can be shorter, so neither is tried.
_FIND = {kind: _plain(p) for kind, p in _PLAIN.items()} | {"email": _emails, "iban": _ibans, "ip": _plain(re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"))}
#: A text without a match of this has no match of the kind's pattern: cheaper to look for.
_SIGN = {"email": re.compile("@"), "ip": re.compile(r"[0-9]\.[0-9]"), "card": re.compile("[0-9](?:[ -]?[0-9]){11}"), "phone": re.compile(r"\+[0-9]"), "iban": re.compile("[A-Z]{2}[0-9]{2}"), "ssn": re.compile("-[0-9]{2}-"), "secret": re.compile("AKIA|gh[pousr]_|sk-|[0-9a-f]{40}")}


def _score(text: str, kind: str, start: int, end: int) -> float:
    # a word that the window cuts is no word: what stands beyond it is seen, but no match may reach there
    near = lambda words: words.search(text, max(0, start - NEAR), start) or ((m := words.search(text, end, end + NEAR + 1)) and m.end() <= end + NEAR)
    score = WEIGHT[kind] + 0.3 * (kind in CHECKSUM)
    if kind == "secret" and text[start] in "0123456789abcdef" and end - start in (40, 64):
        score -= 0.2  # bare hexadecimal digits are hashes more often than secrets: they need a word that says so
    score += 0.2 * bool(near(_CONTEXT[kind]))
    score -= 0.2 * bool(near(_AGAINST))
    return round(min(1.0, max(0.0, score)), 3)


class _Taken:
    """Places that spans cover, as disjoint intervals in order."""

    def __init__(self):
        self.starts, self.ends = [], []

    def add(self, spans: list[tuple[int, int]]) -> None:
        starts, ends = [], []
        for a, b in sorted([*zip(self.starts, self.ends, strict=True), *spans]):
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        self.starts, self.ends = starts, ends

    def free(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.starts, b) - 1
        return i < 0 or self.ends[i] <= a


def spans_of(text: str | None, least: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of one text, by start and then kind; offsets in code points, ends exclusive.

    Base spans always stay. The further kinds need a score of `least` and stay clear of base spans and of each other.
    """
    out: list[tuple[str, int, int, float]] = []
    if not text:
        return out
    taken = _Taken()
    for kind in KINDS:
        if not _SIGN[kind].search(text):
            continue
        found = [(kind, a, b, _score(text, kind, a, b)) for a, b in _FIND[kind](text) if CONFIRMED[kind](text[a:b])]
        if kind not in BASE:
            found = [s for s in found if s[3] >= least and taken.free(s[1], s[2])]
        if found:
            taken.add([(a, b) for _, a, b, _ in found])
            out += found
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find_spans(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row a document: doc_id, spans array<struct<kind, start, end, score>>.

    Null or empty text: an empty array. Repeated rows give equal rows, null ids a row each, an empty table none. Texts of any
    length are scanned whole, in time that grows with their length. Spans that start together go by kind. Columns other than
    doc_id and text are not read.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans_of(t, least)] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans})

    found = docs.select(safe_id(), "text").mapInPandas(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")
    return found.select(real_id(), "spans")


def redact(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The same rows and columns with every span replaced by its kind in brackets; overlapping spans become one.

    n_chars, where there is one, becomes the length of the new text (null stays null). Null and empty texts stay; repeated rows
    and rows without doc_id are redacted alike; other columns are kept whatever their names; an empty table stays empty. Of spans
    that overlap the one that starts first (then by kind) names them.
    """
    names, schema = docs.columns, docs.schema

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        parts, at = [], 0
        for kind, start, end, _ in spans_of(text, least):
            if start >= at:
                parts += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join([*parts, text[at:]]) if parts else text

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(clean, na_action="ignore")

    out = docs.withColumn("text", cleaned("text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{n}`") for n in names])


def digest(spans: DataFrame) -> DataFrame:
    """The query's columns from find_spans(): counts of base spans, hash of base spans, all spans as text."""
    as_text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return spans.select("doc_id", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
