"""Personal data: identifiers in plain and in disguised form.

Plain identifiers are found in the text as it stands.  Then a chain of
transducers undoes disguises (look-alike letters, spelled digits, "at" and
"dot" for @ and .) and keeps for every character of its output the span of the
source it came from; identifiers found in that output are mapped back.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

KINDS = ("email", "ip", "card", "phone")
SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("begin", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("plain", T.BooleanType())]))

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# a run of digits has one place where a match can begin, its start: the look-behind keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str):
    """Leftmost non-overlapping matches of local part, @, domain with a dot;
    each @ is looked at once, so a long run of letters costs no more."""
    done, at = 0, text.find("@")
    while at >= 0:
        step, lo = 64, at       # the local part: back to the last other character
        while True:
            a = max(done, lo - step)
            run = text[a:lo]
            other = None
            for other in _NOT_LOCAL.finditer(run):
                pass
            if other:
                lo = a + other.end()
                break
            lo = a
            if a == done:
                break
            step *= 4
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _plain(text: str) -> list[tuple[int, int, int]]:
    """(begin, kind, end) of every identifier; a match that fails its check is
    dropped and not tried again from a later place."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# Letters of other alphabets that look like the Latin ones below them.
_LOOK = "АВЕКМНОРСТУХЅІЈавекморстухѕіјԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν"
_LIKE = "ABEKMHOPCTYXSIJabekmopctyxsijdqwhABEZHIKMNOPTYXoav"
_HOMOGLYPH = dict(zip(_LOOK, _LIKE))
# Other forms of signs; the empty ones take no place on the page.
_SIGN = {"﹫": "@", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
         " ": " ", " ": " ", " ": " ", "​": "", "‌": "", "‍": "",
         "⁠": "", "﻿": "", "­": ""}
_NUMBER = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
           "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT = "(?:" + "|".join(_NUMBER) + ")"
_ODD = re.compile("[" + re.escape("".join(_LOOK) + "".join(_SIGN)) + "！-～٠-٩۰-۹०-९]")
_OPEN, _CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
# signs in brackets; the space around them is taken by hand, as patterns that begin with space take quadratic time
_AT_SIGN = re.compile(_OPEN + r"(?:at|@)" + _CLOSE, re.I)
_DOT_SIGN = re.compile(_OPEN + r"(?:dot|punkt|\.)" + _CLOSE, re.I)
#: A spoken "at" is a sign where the dot behind it is spoken or in brackets too; before these words it is the preposition.
_NO_HOST = r"(?!(?:an?|the|this|that|my|your|our|their|his|her|its)\b)"
_SPOKEN_AT = re.compile(rf"(?<=[A-Za-z0-9])\s+at\s+{_NO_HOST}(?=[A-Za-z0-9-]+(?:\s+dot\s+|\s*{_OPEN}(?:dot|punkt|\.){_CLOSE}\s*)[A-Za-z0-9-]+)", re.I)
#: Before a host with plain dots ("seen at www.example.org") it is one only behind a cue.
_PLAIN_AT = re.compile(rf"(?<=[A-Za-z0-9])\s+at\s+{_NO_HOST}(?=[A-Za-z0-9-]+\.[A-Za-z0-9-]+)", re.I)
_CUE = re.compile(r"\b(?:e-?mail|mail|mailto|address)\s*(?::|=|\bis\b)\s*[A-Za-z0-9._%+-]+\Z", re.I)
_CUE_SPACE = 120
_SPOKEN_DOT = re.compile(r"(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9])", re.I)
_SPELLED = re.compile(rf"\b(?:plus[\s-]+)?{_DIGIT}(?:(?:[\s-]+|\s+dot\s+){_DIGIT})+\b", re.I)
_PART = re.compile(rf"plus|dot|{_DIGIT}", re.I)
_SPOKEN_DOMAIN = re.compile(r"@[A-Za-z0-9.-]+(?:\s+dot\s+[A-Za-z0-9-]+)+", re.I)


def _signs(pattern: re.Pattern, text: str):
    """(begin, end) of signs in brackets, with the space around them."""
    last = 0
    for m in pattern.finditer(text):
        a, b = m.span()
        while a > last and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        yield a, b
        last = b


def _cued(text: str):
    """(begin, end) of spoken "at" before plain hosts, behind a cue."""
    return (m.span() for m in _PLAIN_AT.finditer(text) if _CUE.search(text[max(0, m.start() - _CUE_SPACE):m.start()]))


def _spelled(text: str):
    """Spelled numbers and addresses of three parts or more."""
    return (m for m in _SPELLED.finditer(text) if len(_PART.findall(m.group())) >= 3)


def _hint(text: str) -> bool:
    """Whether a transducer would change the text: their own patterns, on the text as it stands."""
    return (any(p.search(text) for p in (_AT_SIGN, _DOT_SIGN, _SPOKEN_AT, _SPOKEN_DOMAIN))
            or next(_cued(text), None) is not None or next(_spelled(text), None) is not None)


class _Tape:
    """A text with, for every character, its span in the source."""

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, found):
        """Replace spans, given in order as (begin, end, text); each character
        that comes in takes the whole span's source."""
        out, begin, end, at = [], [], [], 0
        for a, b, new in found:
            out += [self.text[at:a], new]
            begin += self.begin[at:a]
            end += self.end[at:a]
            if new:
                begin += [self.begin[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
            at = b
        if at:
            out.append(self.text[at:])
            begin += self.begin[at:]
            end += self.end[at:]
            self.text, self.begin, self.end = "".join(out), begin, end


def _letter(c: str) -> str:
    if c in _SIGN:
        return _SIGN[c]
    if c in _HOMOGLYPH:
        return _HOMOGLYPH[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    return str(unicodedata.decimal(c, c))


def _digits(m: re.Match) -> str:
    return "".join({"plus": "+", "dot": "."}.get(p, _NUMBER.get(p, "")) for p in map(str.lower, _PART.findall(m.group())))


def _disguised(text: str) -> list[tuple[int, int, int]]:
    """Identifiers that only show once disguises are undone, as spans of the text."""
    odd = not text.isascii() and _ODD.search(text)
    return _undone(text, odd) if odd or _hint(text) else []


def _undone(text: str, odd) -> list[tuple[int, int, int]]:
    """Identifiers of the transducers' output that do not stand so in the text."""
    tape = _Tape(text)
    tape.rewrite([(m.start(), m.end(), _letter(m.group())) for m in _ODD.finditer(tape.text)] if odd else [])
    tape.rewrite([(m.start(), m.end(), _digits(m)) for m in _spelled(tape.text)])
    tape.rewrite([(*m.span(), "@") for m in _SPOKEN_AT.finditer(tape.text)])
    tape.rewrite([(a, b, "@") for a, b in _cued(tape.text)])
    for pattern, sign in ((_AT_SIGN, "@"), (_DOT_SIGN, ".")):
        tape.rewrite([(a, b, sign) for a, b in _signs(pattern, tape.text)])
    # a spoken dot counts only in a domain, after an @ and whole labels
    dots = []
    for m in _SPOKEN_DOMAIN.finditer(tape.text):
        dots += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _SPOKEN_DOT.finditer(m.group())]
    tape.rewrite(dots)
    out = []
    for a, kind, b in _plain(tape.text):
        begin, end = tape.begin[a], tape.end[b - 1]
        if text[begin:end] != tape.text[a:b]:
            out.append((begin, kind, end))
    return out


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, begin, end, plain) in code points, end exclusive, by begin and
    then kind.  Plain identifiers always stay; a disguised one is added unless
    a plain one of its kind covers it.  Null is empty."""
    if not text:
        return []
    plain = _plain(text)
    of_kind = [([a for a, k, _ in plain if k == kind], [b for _, k, b in plain if k == kind]) for kind in range(len(KINDS))]

    def covered(a: int, kind: int, b: int) -> bool:     # plain ones of a kind do not overlap: the last that begins before it
        begins, ends = of_kind[kind]
        at = bisect_right(begins, a) - 1
        return at >= 0 and b <= ends[at]

    more = [s for s in _disguised(text) if not covered(*s)]
    both = sorted([(*s, True) for s in plain] + [(*s, False) for s in dict.fromkeys(more)])
    return [(KINDS[k], a, b, p) for a, k, b, p in both]


def redact(text: str | None) -> str | None:
    """The text with every identifier replaced by its kind in angle brackets;
    of spans that overlap the first gives the name."""
    spans = find(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, a, b, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(out) + text[at:]


@F.pandas_udf(SPANS)
def _find(texts: pd.Series) -> pd.Series:
    return pd.Series([find(t) for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def _redact(texts: pd.Series) -> pd.Series:
    return pd.Series([redact(t) for t in texts], dtype=object)


def spans(text: Column) -> Column:
    """Array of (kind, begin, end, plain) of the whole text."""
    return _find(text)


def joined(found: Column, plain_only: bool) -> Column:
    """Spans as ``kind:begin:end``, comma-joined in their order."""
    chosen = F.filter(found, lambda s: s["plain"]) if plain_only else found
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("s", lambda s: s["plain"] & (s["kind"] == kind))).cast("long")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, the number of plain identifiers of each kind, the digest of
    the plain spans, all spans, and how many of them were disguised.  Null and
    empty texts have none; repeated rows repeat; an empty table gives an empty
    result; texts of any length are read whole, in time that grows with their
    length.  Only doc_id and text are read, whatever other columns are called."""
    found = docs.select("doc_id", spans(F.col("text")).alias("s"))
    return found.select("doc_id", *[_count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("s"), True), 256).alias("base_sha256"), joined(F.col("s"), False).alias("spans"),
        F.size(F.filter("s", lambda s: ~s["plain"])).cast("long").alias("n_disguised"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with identifiers in ``text`` replaced by their kinds, and
    ``n_chars``, where there is such a column, set to the new length.  Null
    texts stay null and keep their ``n_chars``; rows that repeat stay; an empty
    table stays empty; all other columns pass through, whatever their names."""
    text, = fresh(docs, "clean_text")
    out = docs.withColumn(text, _redact(docs["text"]))
    cols = []
    for c in docs.columns:
        if c.lower() == "text":
            cols.append(F.col(text).alias(c))
        elif c.lower() == "n_chars":
            cols.append(F.when(F.col(text).isNull(), out[c]).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(out[c])
    return out.select(*cols)
