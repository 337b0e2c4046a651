"""Personal data behind disguises, found with offsets into the source text.

Transducers rewrite a text in turn and keep, for every character they put out,
the source characters it stands for:

1. ``fold``: homoglyphs, full-width and other look-alike letters, digits and
   punctuation become ASCII, ligatures and dotted or bracketed numbers several
   characters of it; invisible characters vanish;
2. ``digits``: runs of three or more spelled digits (English, German, French,
   Spanish) become digits, spelled dots and plus signs among them too;
3. ``at_and_dot``: bracketed, bare, underscored and HTML-escaped "at" and "dot".

Detectors then run on the normalised text: e-mail addresses, telephone numbers,
card numbers (Luhn), IBANs (mod 97), US social security numbers, IP addresses
and credentials.  A detected span is mapped back to the source characters it
stands for, so the text outside the spans stays as it is.

Defined results: offsets count characters (code points) from 0, the end is
exclusive.  Null, empty and blank texts hold nothing.  Where detections overlap
the one that starts first stays, of these the longest.  Repeated rows give
equal results.  Texts are read whole, whatever their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- transducers -------------------------------------------------------------


class Tape:
    """A text under rewriting, with the source span of each of its characters."""

    def __init__(self, text: str) -> None:
        self.text = text
        # None: character i stands for source character i
        self.start: np.ndarray | None = None
        self.end: np.ndarray | None = None

    def rewrite(self, pattern: re.Pattern[str], replace: Callable[[re.Match[str]], str | None]) -> None:
        """Replaces matches; ``None`` leaves one alone.  The new characters stand for the whole match."""
        parts, starts, ends, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = replace(m)
            if new is None or m.start() == m.end():
                continue
            if self.start is None:
                self.start = np.arange(len(self.text))
                self.end = self.start + 1
            a, b = m.span()
            parts += [self.text[last:a], new]
            starts += [self.start[last:a], np.full(len(new), self.start[a])]
            ends += [self.end[last:a], np.full(len(new), self.end[b - 1])]
            last = b
        if parts:
            self.text = "".join([*parts, self.text[last:]])
            self.start = np.concatenate([*starts, self.start[last:]])
            self.end = np.concatenate([*ends, self.end[last:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None:
            return a, b
        return int(self.start[a]), int(self.end[b - 1])


def _fold_table() -> dict[int, str]:
    table = {}
    ranges = [(0xB2, 0xBA), (0x660, 0x66A), (0x6F0, 0x6FA), (0x966, 0x970), (0x2000, 0x2C00), (0x3000, 0x3003), (0xFE50, 0xFE70), (0xFF00, 0xFFF0), (0x1D400, 0x1D800), (0x1F100, 0x1F190)]
    for lo, hi in ranges:
        for c in range(lo, hi):
            ch = chr(c)
            n = unicodedata.normalize("NFKC", ch)
            if len(n) == 1 and n.isascii():
                table[c] = n
            elif unicodedata.category(ch) == "Nd":
                table[c] = str(unicodedata.digit(ch))
            elif len(n) == 1 and unicodedata.category(n) == "Nd":
                table[c] = str(unicodedata.digit(n))
            elif unicodedata.category(ch) == "Pd":
                table[c] = "-"
            elif unicodedata.category(ch) == "Zs":
                table[c] = " "
    looks = (
        ("аеорсухіјѕһԁԛԝкмтвнг", "aeopcyxijshdqwkmtbhr"), ("АВЕКМНОРСТУХІЈЅЗ", "ABEKMHOPCTYXIJS3"),
        ("αειοκνρτυχγ", "aeiokvptuxy"), ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"), ("ıɡɑʀո", "igarn"),
        ("․。．·∙•", "......"), ("−‐‑‒–—", "------"), ("⁄∕", "//"),
    )
    for a, b in looks:
        table.update(zip(map(ord, a), b))
    return table


def _wide_table() -> dict[str, str]:
    """Characters that stand for several ASCII ones: ligatures, bracketed and dotted numbers, units."""
    found = {}
    for lo, hi in [(0x2000, 0x2C00), (0x3200, 0x3400), (0xFB00, 0xFB07), (0x1F100, 0x1F200)]:
        for ch in map(chr, range(lo, hi)):
            n = unicodedata.normalize("NFKC", ch)
            if len(n) > 1 and n.isascii() and " " not in n:
                found[ch] = n
    return found


FOLD, WIDE = _fold_table(), _wide_table()
_HIDDEN = "­​-‏‪-‮⁠-⁤﻿︀-️"
_INVISIBLE = re.compile(f"[{_HIDDEN}]+")
_WIDE = re.compile("[" + "".join(WIDE) + "]")
_FOLDED = re.compile("[" + "".join(re.escape(chr(c)) for c in FOLD) + _HIDDEN + "]")
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_MARKS = {"dot": ".", "point": ".", "punkt": ".", "punto": ".", "plus": "+", "dash": "-"}
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
_ITEM = "|".join(sorted([*DIGITS, *_MARKS], key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:plus[\s,.\-]{{1,3}})?(?:{_WORD})(?:[\s,.\-]{{1,3}}(?:{_ITEM}|\d))+(?!\w)", re.I)
_TOKEN = re.compile(rf"{_ITEM}|\d", re.I)
_DOT_WORD = r"(?:dot|punkt|punto|point)"
_AT_MARK = re.compile(r"\s*(?:[\[({<]\s*(?:at|@|arroba)\s*[\])}>]|(?<=\w)[_\-]at[_\-](?=\w)|&#0*64;|&#x0*40;|&commat;|%40)\s*", re.I)
_DOT_MARK = re.compile(rf"\s*(?:[\[({{<]\s*(?:{_DOT_WORD}|\.)\s*[\])}}>]|(?<=\w)[_\-]dot[_\-](?=\w)|&#0*46;|&period;)\s*", re.I)
_BARE = re.compile(
    rf"(?<![\w.+\-])([\w+\-][\w.+\-]{{0,63}}(?:\s+{_DOT_WORD}\s+[\w+\-]{{1,63}}){{0,3}})(\s+at\s+|\s*@\s*)"
    rf"([\w\-]{{1,63}}(?:(?:\.|\s+{_DOT_WORD}\s+|\s+\.\s+)[\w\-]{{1,63}}){{1,6}})(?!\w)", re.I
)
_SPACED_DOT = re.compile(rf"\s+{_DOT_WORD}\s+|\s+\.\s+", re.I)
_DOTTED_NUMBER = re.compile(rf"(?<!\w)\d{{1,3}}(?:\s*(?:\.|\b{_DOT_WORD}\b)\s*\d{{1,3}}){{3}}(?!\w)", re.I)


def fold(tape: Tape) -> None:
    if not tape.text.isascii():
        tape.rewrite(_INVISIBLE, lambda m: "")
        tape.rewrite(_WIDE, lambda m: WIDE[m.group()])
        if _FOLDED.search(tape.text):
            tape.text = tape.text.translate(FOLD)


def digits(tape: Tape) -> None:
    def said(m: re.Match[str]) -> str | None:
        tokens = _TOKEN.findall(m.group().lower())
        if sum(t in DIGITS for t in tokens) < 3:
            return None
        return "".join(DIGITS.get(t) or _MARKS.get(t) or t for t in tokens)

    tape.rewrite(_SPELLED, said)


def at_and_dot(tape: Tape) -> None:
    tape.rewrite(_AT_MARK, lambda m: "@")
    tape.rewrite(_DOT_MARK, lambda m: ".")

    def joined(m: re.Match[str]) -> str | None:
        local, sep, domain = m.groups()
        plain = not _SPACED_DOT.search(domain)
        if sep == "@" and plain and not _SPACED_DOT.search(local):
            return None
        # "look at example.com": a bare "at" before a plain domain needs a name that looks like an account
        if sep.strip().lower() == "at" and plain and not re.search(r"[\d._+]", local) and not _SPACED_DOT.search(local):
            return None
        return f"{_SPACED_DOT.sub('.', local)}@{_SPACED_DOT.sub('.', domain)}"

    tape.rewrite(_BARE, joined)
    tape.rewrite(_DOTTED_NUMBER, lambda m: re.sub(rf"\s*(?:\.|{_DOT_WORD})\s*", ".", m.group(), flags=re.I))


# --- detectors ---------------------------------------------------------------


def luhn(text: str) -> bool:
    found = [int(c) for c in text if c.isdigit()][::-1]
    return 13 <= len(found) <= 19 and len(set(found)) > 1 and sum(d if i % 2 == 0 else (2 * d - 9 * (d > 4)) for i, d in enumerate(found)) % 10 == 0


def iban(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _address(text: str) -> bool:
    return all(int(x) < 256 for x in text.split("."))


def _number(text: str) -> bool:
    return 7 <= sum(c.isdigit() for c in text) <= 15


#: kind, pattern, check, and the group that is the identifier.
DETECTORS: list[tuple[str, re.Pattern[str], Callable[[str], bool] | None, int]] = [
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:token|secret|api[_\-]?key|access[_\-]?key|password|passwd|pwd)[\"']?\s*[:=]+\s*[\"']?([A-Za-z0-9_\-/+=.!$%&*]{8,})", re.I), None, 1),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_\-]{20,})"), None, 0),
    ("email", re.compile(r"(?<![\w.+%\-])[\w+%\-][\w.+%\-]{0,63}@(?:[\w\-]{1,63}\.)+[^\W\d_]{2,24}(?![\w\-])"), None, 0),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), iban, 0),
    ("card", re.compile(r"(?<![\d.])\d(?:[ \-]?\d){12,18}(?!\d)"), luhn, 0),
    ("ssn", re.compile(r"(?<![\d\-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])"), None, 0),
    ("ip", re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"), _address, 0),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"), None, 0),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}(?:[\s.\-]?\(?\d{1,5}\)?){2,6}(?!\d)"), _number, 0),
    ("phone", re.compile(r"(?<![\w+.\-])(?:1[\s.\-])?(?:\(\d{3}\)\s?|\d{3}[\s.\-])\d{3}[\s.\-]\d{4}(?![\d.\-]?\d)"), None, 0),
]
_RUN = re.compile(r"(?<![\d.])\+?\d{7,15}(?![\d.]?\d)")


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in source characters, sorted and without overlaps."""
    tape = Tape(text)
    fold(tape)
    digits(tape)
    at_and_dot(tape)
    found = []
    for rank, (kind, pattern, check, group) in enumerate(DETECTORS):
        for m in pattern.finditer(tape.text):
            a, b = m.span(group)
            if check is None or check(m.group(group)):
                found.append((*tape.source(a, b), rank, kind))
    for m in _RUN.finditer(tape.text):  # digits that someone spelled out
        a, b = tape.source(*m.span())
        if b - a > 2 * (m.end() - m.start()):
            found.append((a, b, len(DETECTORS), "phone"))
    out: list[tuple[int, int, str]] = []
    for a, b, _, kind in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if b > a and (not out or a >= out[-1][1]):
            out.append((a, b, kind))
    return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, last = [], 0
    for a, b, kind in found:
        parts += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*parts, text[last:]])


# --- Spark -------------------------------------------------------------------

_FOLD_RANGES = r"\x{00ad}\x{00b2}\x{00b3}\x{00b7}\x{00b9}\x{0131}\x{0250}-\x{02af}\x{0370}-\x{058f}\x{0660}-\x{06f9}\x{0966}-\x{096f}\x{2000}-\x{2bff}\x{3000}-\x{3002}\x{3200}-\x{33ff}\x{fb00}-\x{fb06}\x{fe00}-\x{fe6f}\x{feff}-\x{ffef}\x{1d400}-\x{1d7ff}\x{1f100}-\x{1f1ff}"
# what Python's \s and \d match; RE2's own are ASCII
_WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_S, _D = f"[{_WS}]", r"\p{Nd}"
#: Every text that holds an identifier matches one of these (RE2, over whole columns): a text that no
#: transducer changes holds one as it is, and each change needs a mark that is a seed itself.
SEEDS = [
    # U+0130 is an i to Python where case is ignored
    rf"[{_FOLD_RANGES}\x{{0130}}]",
    r"@|(?i:&#x?0*(?:64|40|46);|&commat;|&period;)|%40",
    rf"{_D}[{_D}{_WS}().\-]{{5,}}{_D}|{_D}{_S}*\.{_S}*{_D}+{_S}*\.{_S}*{_D}|(?:[0-9A-Fa-f]{{1,4}}:){{7}}",
    rf"(?i:[\[({{<]{_S}*(?:at|arroba|{_DOT_WORD}|\.){_S}*[\])}}>]|[_\-](?:at|dot)[_\-]|{_S}at{_S}+\S{{1,63}}?(?:\.|{_S}+(?:dot|punkt|punto|point){_S}|{_S}+\.{_S})|{_D}{_S}*(?:dot|punkt|punto|point){_S}*{_D})",
    rf"(?i:(?:{_WORD})[{_WS},.\-]{{1,3}}(?:(?:{_ITEM}|{_D})[{_WS},.\-]{{1,3}})+(?:{_WORD}))",
    rf"(?i:(?:token|secret|key|password|passwd|pwd)[\"']?{_S}*[:=])|AKIA[0-9A-Z]{{16}}|gh[pousr]_|sk-",
    rf"[A-Z]{{2}}{_D}{{2}} ?[A-Z0-9]{{4}}",
]


def suspects(texts: pa.Array) -> np.ndarray:
    """Rows worth a closer look; nulls aren't."""
    out = np.zeros(len(texts), bool)
    for seed in SEEDS:
        out |= pc.fill_null(pc.match_substring_regex(texts, seed), False).to_numpy(zero_copy_only=False)
    return np.flatnonzero(out)


_SCHEMA = "doc_id bigint, n_spans int, spans array<struct<start:int,end:int,kind:string>>, text string"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, lists, texts = [], [], []
        for i in suspects(batch["text"]):
            text = batch["text"][int(i)].as_py()
            found = spans(text)
            if found:
                rows.append(int(i))
                lists.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
                texts.append(redact(text, found))
        ids = batch["doc_id"].take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(map(len, lists), pa.int32()), pa.array(lists, _SPANS), pa.array(texts, pa.string())], ["doc_id", "n_spans", "spans", "text"])


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_spans, spans, redacted text) of every document that holds personal data."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_found, _SCHEMA)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by its kind; columns and rows as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at)
            change = {}
            for i in suspects(texts):
                text = texts[int(i)].as_py()
                found = spans(text)
                if found:
                    change[int(i)] = redact(text, found)
            if change:
                mask = np.zeros(len(texts), bool)
                mask[list(change)] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([change[i] for i in sorted(change)], texts.type))
                batch = batch.set_column(at, batch.schema.field(at), texts)
            yield batch

    return docs.mapInArrow(run, docs.schema)
