"""Visually identical text with different characters (problem 2): confusables skeletons.

A text is decomposed, every character is replaced by its prototype from a look-alike table, and the
result is decomposed again. Texts that look the same on screen have equal skeletons; the originals
are grouped by the skeleton's hash, and only hashes travel through the shuffle.
"""

from __future__ import annotations

import functools
import glob
import os
import re
import struct
import unicodedata
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts (left) with the Latin letters of the same shape (right), in parallel. They go before the public table.
_LOOKS = (
    # Cyrillic
    ("аеорсухѕіјһԁԛԝѵүАВЕКМНОРСТУХЅІЈԚԜѴҮҺ", "aeopcyxsijhdqwvyABEKMHOPCTYXSIJQWVYh"),
    # Greek
    ("οναρικυγϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ovapikuycjABEZHIKMNOPTYXCJ"),
    # Armenian
    ("օոսհցյՏՕՍԼ", "onuhgjSOUL"),
    # Cherokee
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    # Latin letters and letter-like signs of the same shape
    ("ɑɡⲟᴏᴄᴠᴡᴢℓ", "agoocvwzl"),
)
_NEAREST = {ord(a): b for left, right in _LOOKS for a, b in zip(left, right, strict=True)}


def confusables(folder: str | None = None) -> dict[int, str]:
    """The public table of Unicode confusables (UTS #39): code point -> prototype.

    It is read from the ICU library (Unicode licence) among Spark's own jars, in ``folder`` if one is given; nothing of it is kept in this repository.
    """
    homes = [folder] if folder else [os.path.join(h, "jars") for h in (os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)) if h] + ["__spark_libs__"]
    for home in homes:
        for jar in sorted(glob.glob(os.path.join(home, "icu4j-*.jar"))):
            with zipfile.ZipFile(jar) as z:
                return _parse(z.read("com/ibm/icu/impl/data/icudata/confusables.cfu"))
    raise FileNotFoundError(f"no icu4j-*.jar in {homes}")


def _parse(data: bytes) -> dict[int, str]:
    # Fixed values of the file format: its magic number; keys are 24 bits of code point and 8 bits of length less one.
    at = data.index(bytes.fromhex("3845fdef"))
    keys_at, n, values_at, _, strings_at, units = struct.unpack(">6I", data[at + 12 : at + 36])
    keys = struct.unpack(f">{n}I", data[at + keys_at : at + keys_at + 4 * n])
    values = struct.unpack(f">{n}H", data[at + values_at : at + values_at + 2 * n])
    strings = data[at + strings_at : at + strings_at + 2 * units]
    out = {}
    for key, value in zip(keys, values, strict=True):
        length = (key >> 24) + 1
        out[key & 0xFFFFFF] = chr(value) if length == 1 else strings[2 * value : 2 * (value + length)].decode("utf-16-be")
    return out


def _is_letter(c: str) -> bool:
    return unicodedata.category(c) in ("Lu", "Ll", "Lo", "Lt")


@functools.lru_cache(maxsize=1)
def prototypes() -> dict[int, str]:
    """The letters of :func:`confusables` with the letter that stands for their shape.

    Only letters change, and only into letters: another digit or sign is another look, so of the shape of 1, l, I and | the
    capital letters become I and the others l. Where a shape has an ASCII letter, that stands for it, in the source's case;
    else the table's prototype, or the first letter of the shape if that is no letter. Letters of another
    style (mathematical, raised, circled) look different and stay, as do Latin letters with an own name for two, such as ae.
    """
    table = confusables()
    shapes: dict[str, list[str]] = {}
    for code, shape in table.items():
        shapes.setdefault(shape, [shape] if len(shape) == 1 else []).append(chr(code))
    out: dict[int, str] = {}
    for shape, members in shapes.items():
        letters = sorted({c for c in members if _is_letter(c)})
        plain = [c for c in letters if c.isascii()]
        for c in letters:
            if c.isascii() or unicodedata.decomposition(c):
                continue
            own = [a for a in plain if a.isupper() == c.isupper()] if len(plain) > 1 else plain
            if own:
                to = own[0]
            elif len(shape) == 1:
                to = shape if _is_letter(shape) else letters[0]
            elif _is_letter(shape[0]) and all(unicodedata.combining(x) for x in shape[1:]):
                to = shape
            else:
                continue
            if to != c:
                out[ord(c)] = to
    return out | _NEAREST


# Invisible characters outside the categories Cf and Cc, blanks outside Zs, format characters that are visible.
_INVISIBLE = "\u034fᅟᅠ\u17b4\u17b5\u180b\u180c\u180d\u180fㅤﾠ"
_BLANK = "\t⠀"
_VISIBLE_FORMAT = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2"
_LINE_ENDS = re.compile("\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_KEEP_JOINED = "\ue000"  # stands for a joiner between emoji while the others are dropped
_JOINED = re.compile("(?<=[←-⯿\U0001f000-\U0001faff\ufe0f])\u200d(?=[←-⯿\U0001f000-\U0001faff])")
_FLAG_TAGS = re.compile("(\U0001f3f4)([\U000e0020-\U000e007e]+\U000e007f)")


class _Shape(dict):
    """Per-character step before decomposition: width, ligatures and blanks are folded, invisible characters dropped."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        category, kind = unicodedata.category(c), unicodedata.decomposition(c).partition(" ")[0]
        if category == "Zs" or c in _BLANK:
            out = " "
        elif c == "\n" or c == _KEEP_JOINED or c in _VISIBLE_FORMAT:
            out = c
        elif category in ("Cf", "Cc") or c in _INVISIBLE or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            out = ""
        elif kind in ("<wide>", "<narrow>") or 0xFB00 <= code <= 0xFB17 or 0x2160 <= code <= 0x217F or 0x0132 <= code <= 0x0133 or 0x01C4 <= code <= 0x01CC:
            out = unicodedata.normalize("NFKC", c)
        else:
            out = c
        self[code] = out
        return out


_SHAPE = _Shape()
_PLAIN = re.compile(r"[\n\x20-\x7e]*\Z")
_OTHER = re.compile(r"[^\n\x20-\x7e]+")
_FOLDED: dict[str, str] = {}


def _fold(run: re.Match) -> str:
    """The prototype of a run of other than plain characters; decomposing it apart is the same as within the text."""
    text = run.group()
    if (out := _FOLDED.get(text)) is None:
        if len(_FOLDED) > 100_000:
            _FOLDED.clear()
        out = unicodedata.normalize("NFD", text.translate(_SHAPE))
        out = _FOLDED[text] = unicodedata.normalize("NFD", out.translate(prototypes()))
    return out


def skeleton(text: str | None) -> str | None:
    """The one form of all texts that look like ``text``; null for null.

    Letter case, accents, digits, signs, words, line breaks and joined emoji are kept; blanks at the
    end of lines and of the text, which nobody can see, are not.
    """
    if text is None:
        return None
    if not _PLAIN.match(text):
        text = _LINE_ENDS.sub("\n", text)
        if "\u200d" in text:
            text = _JOINED.sub(_KEEP_JOINED, text)
        tags = _FLAG_TAGS.findall(text) if "\U000e007f" in text else ()
        for flag, letters in tags:
            text = text.replace(flag + letters, flag + _KEEP_JOINED + "".join(chr(ord(x) - 0xE0000) for x in letters[:-1]) + _KEEP_JOINED)
        text = _OTHER.sub(_fold, text)
    return "\n".join(line.rstrip() for line in text.split("\n")).rstrip("\n") if " \n" in text or text[-1:] in (" ", "\n") else text


@F.pandas_udf(T.StringType())
def _skeletons(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([skeleton(t) for t in batch], dtype=object)


def with_skeleton(df: DataFrame, text: str, out: str = "skeleton") -> DataFrame:
    """``df`` with the skeleton of column ``text``; a text of printable ASCII without outer blanks is its own skeleton and stays in the JVM."""
    plain = F.col(text).rlike("^[\\x21-\\x7e]([\\x20-\\x7e]*[\\x21-\\x7e])?$")
    return df.withColumn(out, F.when(plain, F.col(text)).otherwise(_skeletons(F.when(plain, None).otherwise(F.col(text)))))


def long_texts(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """``id, field, text, skeleton``: one row per row of ``df`` and field; blank or null texts, which have no look, are left out."""
    long = df.select(F.col(id_column).alias("id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("x"))
    return with_skeleton(long.select("id", "x.field", "x.text").where(F.col("text").isNotNull() & (F.col("text") != "")), "text").where(F.col("skeleton") != "")


def look_alikes(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """Pairs ``field, id_a, id_b`` (id_a < id_b) of different ids with texts that look the same but are not the same string.

    Only skeletons with two or more different strings can give a pair; they are found by a partial
    aggregation (smallest and largest string hash), so a skeleton that a third of all rows share as
    one string costs nothing further. Different strings are paired before ids are attached, so no pair of
    equal strings is built. Exact copies of one id and string count once. Null ids give no pair;
    empty tables give no rows.
    """
    looks = long_texts(df, id_column, fields).where(F.col("id").isNotNull()).select("field", F.unhex(F.md5("skeleton")).alias("look"), F.xxhash64("text").alias("form"), "id")
    various = looks.groupBy("field", "look").agg(F.min("form").alias("lo"), F.max("form").alias("hi")).where("lo <> hi").select("field", "look")
    members = looks.join(various, ["field", "look"]).distinct()
    forms = members.select("field", "look", "form").distinct()
    x, y = (forms.select("field", "look", F.col("form").alias(f"form_{c}")) for c in "xy")
    pairs = x.join(y, ["field", "look"]).where("form_x < form_y")
    for c in "xy":
        pairs = pairs.join(members.select("field", "look", F.col("form").alias(f"form_{c}"), F.col("id").alias(f"id_{c}")), ["field", "look", f"form_{c}"])
    return pairs.where("id_x <> id_y").select("field", F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b")).distinct()


def consistent(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """``id, field, consistent``: the one consistent form of every non-empty text, distinct; blank texts become the empty text."""
    long = df.select(F.col(id_column).alias("id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("x"))
    forms = with_skeleton(long.select("id", "x.field", "x.text").where(F.col("text").isNotNull()), "text")
    return forms.select("id", "field", F.translate("skeleton", _KEEP_JOINED, "\u200d").alias("consistent")).distinct()


def _classed(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    return long_texts(df, id_column, fields).select("field", F.md5("skeleton").alias("look"), F.xxhash64("text").alias("form"), "id")


def look_classes(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """``field, look, n_rows, n_ids, n_forms, n_links``: one row per class of equal-looking texts.

    ``n_links`` is the number of pairs that :func:`look_alikes` has for the class: pairs of different ids of which one has a string
    that the other's differs from. It is found by counting, without forming a pair: all pairs of ids, less those of ids that have
    one and the same string only. Null ids count as rows only.
    """
    members = _classed(df, id_column, fields).groupBy("field", "look", "id").agg(F.count("*").alias("n"), F.min("form").alias("lo"), F.max("form").alias("hi"), F.count_distinct("form").alias("k"))
    # ids with a single string, by that string: only among them is a pair no link
    alike = members.groupBy("field", "look", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("only")).agg(F.sum("n").alias("n"), F.count("id").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    m, pairs = F.col("m").cast("decimal(20,0)"), lambda x: x * (x - F.lit(1).cast("decimal(20,0)")) / 2
    per = alike.groupBy("field", "look").agg(F.sum("n").alias("n_rows"), F.sum("m").alias("n_ids"), pairs(F.sum(m)).alias("all"), F.sum(F.when(F.col("only").isNotNull(), pairs(m)).otherwise(F.lit(0))).alias("same"))
    forms = _classed(df, id_column, fields).select("field", "look", "form").distinct().groupBy("field", "look").agg(F.count("*").alias("n_forms"))
    return per.join(forms, ["field", "look"]).select("field", "look", "n_rows", "n_ids", "n_forms", (F.col("all") - F.col("same")).cast("long").alias("n_links"))


def look_members(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """``field, id, look, form``: one row per id, field and different string of it, with its class and a hash of the string; with :func:`look_classes` all links, without expanding them."""
    return _classed(df, id_column, fields).where(F.col("id").isNotNull()).select("field", "id", "look", "form").distinct()
