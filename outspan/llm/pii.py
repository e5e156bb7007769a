"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in the whole text: at-signs, plus signs, digits, ``://`` and cues of identifiers. From
each anchor a deterministic local parser walks left and right to the ends of the candidate and validates it: e-mail addresses,
IP addresses, payment cards by the Luhn rule, phone numbers, web addresses that carry a user name or password, and accounts or
secrets that a cue names. No pattern is searched over the text; work follows the number of anchors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "url", "account")
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "iban", "account", "Token", "Secret", "Password", "API_KEY", "IBAN", "Account")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT_RUN = re.compile(r"[0-9]+")
_USERINFO = re.compile(r"[^\s/@<>\"']+@[^\s/@<>\"']+")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_GIVES = re.compile(r"[\x20\t]{0,3}[=:][\x20\t]{0,3}([\"']?)")  # a cue's value stands within three blanks of the sign
_VALUE = re.compile(r"[A-Za-z0-9_/+=-]{12,}")  # and has twelve signs at least, one of them a digit
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word in ("@", "+", "://", *"0123456789", *CUES):
        a.add_word(word, word)
    a.make_automaton()
    return a


def octet(part: str) -> bool:
    """Whether a part of an address is at most 255; it may have any number of digits."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def find_spans(text: str, automaton) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points; of each base kind leftmost and non-overlapping, a failing match dropped whole."""
    out: list[tuple[int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)  # where the last candidate of a kind ended, kept or not
    barren = 0  # where the last value without a digit ended
    for last, word in automaton.iter(text):
        at = last - len(word) + 1
        if word == "@":
            if at < done["email"]:
                continue
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                out.append((start, m.end(), "email"))
        elif word == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((at, m.end(), "phone"))
        elif word == "://":
            if at >= done["url"] and (s := _SCHEME.search(text, max(done["url"], at - 32), at)) and (m := _USERINFO.match(text, last + 1)):
                done["url"] = m.end()
                out.append((s.start(), m.end(), "url"))
        elif len(word) == 1:  # a digit
            if at >= done["ip"]:
                if m := _IP.match(text, at):
                    done["ip"] = m.end()
                    if all(map(octet, m[0].split("."))):
                        out.append((at, m.end(), "ip"))
                else:
                    done["ip"] = _DIGIT_RUN.match(text, at).end()  # no address starts inside this run either
            if at >= done["card"]:
                m = _CARD.match(text, at)
                if m:
                    done["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, m.end(), "card"))
        elif at >= done["account"] and (at == 0 or not text[at - 1].isalnum()) and (g := _GIVES.match(text, last + 1)):
            # A cue inside a value without a digit has the rest of it: it is not read again.
            if not (g[1] or g.end() >= barren) or not (m := _VALUE.match(text, g.end())) or g[1] and text[m.end() : m.end() + 1] != g[1]:
                continue
            if any(c.isdigit() for c in m[0]):
                done["account"] = m.end() + len(g[1])
                out.append((m.start(), m.end(), "account"))
            elif not g[1]:
                barren = m.end()
    order = {k: i for i, k in enumerate(KINDS)}
    out.sort(key=lambda s: (s[0], order[s[2]]))
    return out


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or each run of overlapping ones, replaced by the kind that starts first."""
    out, end = [], 0
    for a, b, k in spans:
        if a >= end:
            out += [text[end:a], f"<{k.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def find_pii(df: DataFrame, text: str = "text", *, mask: bool = False) -> DataFrame:
    """``df`` with ``pii_spans``, an array of (start, end, kind) in code points, end exclusive; with ``mask`` the text column
    carries the masked text.

    A null text has no spans and stays null; empty texts have none. Repeated rows each get their own. Columns of ``df`` stay as
    they are, one named pii_spans is replaced. Work is linear in the text, also over long runs of digits, signs or cues. Batches stream through Arrow; the longest single text bounds memory."""
    kept = [f for f in df.schema.fields if f.name != "pii_spans"]
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    schema = T.StructType([*kept, T.StructField("pii_spans", spans_type)])
    arrow_spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = [find_spans(t, automaton) if t else [] for t in texts]
            cols = [batch.column(f.name) for f in kept]
            if mask:
                cols[[f.name for f in kept].index(text)] = pa.array([masked(t, s) if s else t for t, s in zip(texts, found, strict=True)], pa.string())
            spans = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in found], arrow_spans)
            yield pa.RecordBatch.from_arrays([*cols, spans], names=[f.name for f in schema.fields])

    return df.select(*[df[f.name] for f in kept]).mapInArrow(run, schema)
