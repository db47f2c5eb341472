"""Personal data in text, plain or disguised, with spans in code points of the source.

Base spans come from four patterns over the text as it is. A second pass reads the text through a chain of
transducers that keep, for each character of their output, the range of source characters it stands for: one maps
homoglyphs and full-width forms to ASCII (one to one), the next drops invisible characters, turns at and dot
disguises into their signs and spelled digits into digits. The same patterns run over the normalised text, and
what they find is mapped back. A span is added if a disguise lies within it and no base span of its kind holds it.

Spelled digits count in groups of three or more, since single number words are common. A bare "at" counts only
before a host with a spelled dot.

Texts that no transducer can change are known by the words and signs that each of its rules asks for.

Defined results: a null or empty text has no spans; all patterns take linear time, and texts of any length are read
whole; of overlapping spans of different kinds each stays, and of one kind the base span that holds an added one; rows
that repeat come back alike, a null doc_id as it is; other columns, whatever their names, are not looked at; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import documents

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run is entered at its start only: an attempt inside one cannot succeed where that at its start failed.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the longest local part before each @, not reaching into the match before."""
    out, end, at = [], 0, text.find("@")
    before = 0
    while at >= 0:
        part = text[max(end, before) : at]
        n = len(part) - len(part.rstrip(LOCAL))
        if n and (m := DOMAIN.match(text, at)):
            out.append((at - n, m.end()))
            end = m.end()
        before = at + 1
        at = text.find("@", max(before, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of KINDS, then of start."""
    out = [("email", s, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def _homoglyphs() -> dict[int, str]:
    """Letters of other scripts that look like ASCII ones, and compatibility forms of single ASCII characters."""
    alike = {
        "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
        "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3",
        "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
        "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
        "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "ս": "u", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "．": ".", "＠": "@", "﹫": "@", " ": " ", " ": " ", " ": " ",
    }
    out = {ord(k): v for k, v in alike.items()}
    for lo, hi in ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x2500), (0x2070, 0x2090)):
        for c in range(lo, hi):
            n = unicodedata.normalize("NFKC", chr(c))
            if len(n) == 1 and "!" <= n <= "~":
                out[c] = n
    for c in range(0x660, 0x11000):  # decimal digits of other scripts
        if unicodedata.category(chr(c)) == "Nd":
            out.setdefault(c, str(unicodedata.digit(chr(c))))
    return out


DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}

INVISIBLE = "­​‌‍⁠﻿"
_OPEN, _SHUT = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_SP = r"\s{1,3}"
_DOT = rf"(?:\s{{0,3}}{_OPEN}(?:dot|punkt|point|punto|\.){_SHUT}\s{{0,3}}|{_SP}dot{_SP})"
TOKENS = re.compile(
    rf"(?P<gone>[{INVISIBLE}]+)"
    rf"|(?P<at>\s{{0,3}}{_OPEN}(?:at|ät|arobase|arroba|@){_SHUT}\s{{0,3}}|(?<=[A-Za-z0-9]){_SP}@{_SP}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9]){_SP}at{_SP}(?=[A-Za-z0-9-]{{1,63}}{_DOT}[A-Za-z]))"
    rf"|(?P<dot>{_DOT})"
    rf"|(?P<plus>(?<![^\W_])plus{_SP}(?=[0-9a-zéü]))"
    rf"|(?P<digit>(?<![^\W_])(?:{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))})(?![^\W_]))",
    re.IGNORECASE,
)
GLYPHS = _homoglyphs()
#: Letters that match plain ones where case is ignored.
FOLDED = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}
JOINS = re.compile(r"[\s,.()+\-0-9]{0,24}")
DROPPED = re.compile(r"[\s,-]{0,3}")


#: Characters by which a text may normalise to another one, and those that case folding takes for plain letters.
ODD = frozenset({*map(chr, GLYPHS), *INVISIBLE, *map(chr, FOLDED)})
SIGNS = re.compile(r"[\[({<]\s{0,3}(?:at\s{0,3}[\])}>]|[@.])|\s@\s", re.IGNORECASE)
MARKS = frozenset({"dot", "punkt", "point", "punto", "ät", "arobase", "arroba", "plus"})
ALNUM = re.compile(r"[^\W_]+")
WORDS_ONLY = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def disguised(text: str) -> bool:
    """Whether the transducers may change a text; never false where they do, since each of their tokens asks for
    something that is looked for here."""
    if text.isascii():
        words = text.lower().encode().translate(WORDS_ONLY).split()
        found = {w.decode() for w in set(words)}
    else:
        if not ODD.isdisjoint(text):
            return True
        words = ALNUM.findall(text.lower())
        found = set(words)
    if not MARKS.isdisjoint(found) or SIGNS.search(text):
        return True
    spelled = found & DIGIT_WORDS.keys()
    if not spelled:
        return False
    if text.isascii():
        spelled = {w.encode() for w in spelled}
    return sum(w in spelled for w in words) >= 3


class Normalised:
    """A text and, for each run of its characters, the source range it stands for."""

    def __init__(self):
        self.parts: list[str] = []
        self.at: list[int] = []
        self.source: list[tuple[int, int, bool]] = []
        self.n = 0

    def put(self, out: str, lo: int, hi: int, same: bool) -> None:
        """same: character k of out stands for source character lo + k; else all of out for all of lo..hi."""
        if out:
            self.parts.append(out)
            self.at.append(self.n)
            self.source.append((lo, hi, same))
            self.n += len(out)

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        lo, _, same = self.source[i]
        s = lo + start - self.at[i] if same else lo
        lo, hi, same = self.source[j]
        return s, lo + end - self.at[j] if same else hi


def normalise(text: str) -> Normalised:
    plain = text.translate(GLYPHS)
    tokens = [(m.lastgroup, m.start(), m.end()) for m in TOKENS.finditer(plain)]
    # number words stand for digits where three or more of them are near each other
    spelled, run, last = set(), [], None
    for k, (kind, s, e) in enumerate(tokens):
        if last is not None and not JOINS.fullmatch(plain, last, s):
            if len(run) >= 3:
                spelled.update(run)
            run = []
        if kind == "digit":
            run.append(k)
        last = e
    if len(run) >= 3:
        spelled.update(run)
    out, pos, after_digit = Normalised(), 0, False
    for k, (kind, s, e) in enumerate(tokens):
        if kind == "digit" and k not in spelled:
            continue
        gap = plain[pos:s]
        if not (after_digit and kind == "digit" and DROPPED.fullmatch(gap)):
            out.put(gap, pos, s, True)
        word = plain[s:e]
        out.put({"gone": "", "at": "@", "dot": ".", "plus": "+"}.get(kind) if kind != "digit" else str(DIGIT_WORDS[word.translate(FOLDED).lower()]), s, e, False)
        pos, after_digit = e, kind == "digit"
    out.put(plain[pos:], pos, len(plain), True)
    return out


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the normalised text shows."""
    if not disguised(text):
        return []
    norm = normalise(text)
    whole = "".join(norm.parts)
    if whole == text:
        return []
    out = []
    for kind, s, e in base_spans(whole):
        lo, hi = norm.back(s, e)
        if text[lo:hi] != whole[s:e] and not any(k == kind and a <= lo and hi <= b for k, a, b in base):
            out.append((kind, lo, hi))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find_pii(df: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end, base) of each row of df(doc_id, text); digests of both lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for b in batches:
            rows, digests, joined = [], [], []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base)
                rows.append([{"kind": k, "start": s, "end": e, "base": x} for part, x in ((base, True), (more, False)) for k, s, e in part])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(base + more))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, span), pa.array(digests), pa.array(joined)], names=["doc_id", "found", "base_sha256", "spans"])

    return df.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "doc_id long, found array<struct<kind:string,start:int,end:int,base:boolean>>, base_sha256 string, spans string")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("found", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return find_pii(documents(spark, sf_dir)).select("doc_id", *map(count, KINDS), "base_sha256", "spans", F.size(F.filter("found", lambda x: ~x["base"])).cast("long").alias("n_added"))
