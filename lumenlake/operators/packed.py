"""Several values packed in one field (problem 3).

A quote-aware finite-state tokenizer: it tracks quoting, escapes and nesting depth and emits the
values, in order, from the delimiters that stand outside quotes. It runs in Arrow batches over the
non-null fields only; the ordinals are attached by ``posexplode`` in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate values outside quotes, opening brackets with their closers, quotes with their closers.
DELIMITERS = ",;|/\t\n\r،؛、，；｜／"
BRACKETS = {"[": "]", "{": "}", "(": ")"}
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "「": "」"}

_PLAIN = re.compile(r"[^" + re.escape(DELIMITERS + "".join(BRACKETS) + "".join(BRACKETS.values()) + '\\"') + r"]+")
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _escape(text: str, i: int) -> tuple[str, int]:
    """The character written by the escape that starts at ``i`` and the position after it."""
    if i + 1 >= len(text):
        return "\\", i + 1
    c = text[i + 1]
    if c == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", text[i + 2 : i + 6] or ""):
        code, end = int(text[i + 2 : i + 6], 16), i + 6
        if 0xD800 <= code < 0xDC00 and re.fullmatch(r"\\u[dD][c-fC-F][0-9a-fA-F]{2}", text[end : end + 6]):
            code, end = 0x10000 + ((code - 0xD800) << 10) + int(text[end + 2 : end + 6], 16) - 0xDC00, end + 6
        return (chr(code) if not 0xD800 <= code < 0xE000 else "�"), end
    return _ESCAPED.get(c, c), i + 2


def _quoted(text: str, i: int) -> tuple[str, int] | None:
    """The content of the quotation that starts at ``i`` and the position after it; None if it is never closed."""
    close, out, i, n = QUOTES[text[i]], [], i + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            piece, i = _escape(text, i)
            out.append(piece)
        elif c == close:
            if text[i + 1 : i + 2] == close and close in "\"'":  # a doubled quote stands for itself
                out.append(c)
                i += 2
            else:
                return "".join(out), i + 1
        else:
            out.append(c)
            i += 1
    return None


def _unwrap(text: str) -> str:
    """``text`` without the pair of brackets that encloses all of it."""
    while len(text) >= 2 and BRACKETS.get(text[0]) == text[-1]:
        text = text[1:-1].strip()
    return text


def tokenize(text: str | None) -> list[str]:
    """The values of a packed field, in order, without surrounding blanks, enclosing quotes and escapes.

    Delimiters inside quotes or inner brackets belong to the value; blanks alone do not separate;
    empty values are dropped. A quote opens only at the start of a value and only if it closes
    before a delimiter or the end; else it is an ordinary character, as in "O'Dell". An unquoted
    ``null`` inside an array is kept as text. Null and blank fields have no value.
    """
    if text is None or not (text := text.strip()):
        return []
    text, out, value, i = _unwrap(text), [], [], 0
    n = len(text)
    last = {c: text.rfind(c) for c in BRACKETS.values()}
    depth: list[str] = []  # the closers that are waited for
    open_ended: set[str] = set()  # quotes that nothing closes any more

    def emit() -> None:
        if v := "".join(value).strip():
            out.append(v)
        value.clear()

    while i < n:
        c = text[i]
        if not value and c.isspace() and c not in DELIMITERS:  # blanks before a value
            i += 1
            continue
        q = _quoted(text, i) if c in QUOTES and c not in open_ended else None
        if c in QUOTES and q is None and text.find(2 * QUOTES[c], i + 1) < 0:
            open_ended.add(c)
        if q:
            rest = text[q[1] :].lstrip(" \u00a0\u3000")
            if not "".join(value).strip() and (not rest or rest[0] in DELIMITERS):
                if not depth:  # the whole value is quoted
                    value[:] = [q[0]]
                    emit()
                    i = n - len(rest) + 1  # after the delimiter
                    continue
            elif c == '"' and value and value[-1][-1:].isspace() and (not rest or text[q[1]] in DELIMITERS or text[q[1]].isspace()):
                value.append(text[i : q[1]])  # a quotation within a value
                i = q[1]
                continue
            if depth:
                value.append(text[i : q[1]])
                i = q[1]
                continue
        if c == "\\":
            piece, i = _escape(text, i)
            value.append(piece)
        elif c in BRACKETS:
            if last[BRACKETS[c]] > i:  # an unclosed bracket is an ordinary character
                depth.append(BRACKETS[c])
            value.append(c)
            i += 1
        elif c in DELIMITERS and not depth:
            emit()
            i += 1
        elif m := _PLAIN.match(text, i):
            value.append(m.group())
            i = m.end()
        else:
            if c in depth:  # closes its own bracket, and those inside that were left open
                del depth[len(depth) - 1 - depth[::-1].index(c) :]
            value.append(c)
            i += 1
    emit()
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    memo: dict[str, list[str]] = {}
    for batch in batches:
        if len(memo) > 50_000:
            memo.clear()
        out = []
        for text in batch:
            if (got := memo.get(text)) is None:
                got = memo[text] = tokenize(text)
            out.append(got)
        yield pd.Series(out)


def split_packed(df: DataFrame, id_column: str, fields: list[str], least: int = 1) -> DataFrame:
    """One row per value: ``id, field, pos, val`` (pos from 1, repeated values included), distinct.

    ``least`` keeps only fields with at least so many non-empty values. Null, blank and empty-list
    fields give no rows; repeated rows of ``df`` count once; a null id is kept as null; other
    columns are dropped, so their names cannot clash. A field's text may be of any length.
    """
    long = df.select(F.col(id_column).alias("id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("packed")) for f in fields))).alias("x"))
    packed = long.select("id", "x.field", "x.packed").where(F.trim("packed") != "")
    values = packed.select("id", "field", _tokens("packed").alias("values")).where(F.size("values") >= least)
    return values.select("id", "field", F.posexplode("values").alias("pos", "val")).select("id", "field", (F.col("pos") + 1).alias("pos"), "val").distinct()
