"""Personal information inside free text (problem 5): offset-preserving deobfuscation.

Transducers rewrite a text into a normal form in which identifiers can be recognised — invisible
characters dropped, widths and composed accents folded, look-alike letters mapped, digits written
as words turned into digits, at- and dot-disguises turned into signs — and carry along for each
character the place in the source it came from. Detectors run on the normal form; their spans are mapped back
to the source and replaced by typed placeholders, so that everything else stays as it was written.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import DEEDS, INTRODUCTIONS, STOP, USUAL, Lexicon, bare, names
from .skeleton import _NEAREST as _PROTOTYPES
from .skeleton import _SHAPE

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")


# Transducers


@dataclass
class Tape:
    """A text in normal form; character i came from ``source[start[i]:end[i]]``."""

    text: str
    start: list[int]
    end: list[int]

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]

    def rewrite(self, pattern: re.Pattern, make) -> Tape:
        """Every match replaced by ``make(match)``; its characters all map to the whole match. None leaves a match alone."""
        out, s, e, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = make(m)
            if new is None or m.start() < last:
                continue
            a, b = m.span()
            out.append(self.text[last:a])
            s += self.start[last:a]
            e += self.end[last:a]
            lo, hi = self.span(a, b)
            out.append(new)
            s += [lo] * len(new)
            e += [hi] * len(new)
            last = b
        if not out:
            return self
        out.append(self.text[last:])
        return Tape("".join(out), s + self.start[last:], e + self.end[last:])


_ASCII = re.compile(r"[\n\x20-\x7e]*\Z")


def folded(source: str) -> Tape:
    """Width, ligatures, blanks and invisible characters folded; combining accents composed with their letter."""
    n = len(source)
    if _ASCII.match(source):
        return Tape(source, list(range(n)), list(range(1, n + 1)))
    out, start, end, last = [], [], [], 0
    for m in _RUN.finditer(source):
        a, b = m.span()
        if unicodedata.combining(source[a]) and a > last:  # the accent belongs to the plain letter before it
            a -= 1
        run = source[a:b]
        if (got := _RUNS.get(run)) is None:
            if len(_RUNS) > 50_000:
                _RUNS.clear()
            got = _RUNS[run] = _folded_run(run)
        if got is _SAME:
            continue
        out += [source[last:a], got[0]]
        start += range(last, a)
        start += [a + x for x in got[1]]
        end += range(last + 1, a + 1)
        end += [a + x for x in got[2]]
        last = b
    out.append(source[last:])
    start += range(last, n)
    end += range(last + 1, n + 1)
    return Tape("".join(out), start, end)


_RUN = re.compile(r"[^\n\x20-\x7e]+")
_RUNS: dict[str, tuple] = {}
_SAME = ("", [], [])


def _folded_run(run: str) -> tuple[str, list[int], list[int]]:
    out, start, end, i, n = [], [], [], 0, len(run)
    while i < n:
        j = i + 1
        while j < n and unicodedata.combining(run[j]):
            j += 1
        piece = run[i:j] if j == i + 1 else unicodedata.normalize("NFC", run[i:j])
        for c in piece:
            shaped = "\n" if c in "\r\n" else _SHAPE[ord(c)]
            out.append(shaped)
            start += [i] * len(shaped)
            end += [j] * len(shaped)
        i = j
    text = "".join(out)
    return _SAME if text == run and len(start) == n else (text, start, end)


# The digits 0 to 9 as words.
_DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "zero um dois três quatro cinco seis sete oito nove",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zero uno due tre quattro cinque sei sette otto nove",
    "ноль один два три четыре пять шесть семь восемь девять",
)
_WORD_DIGIT = {w: str(i) for line in _DIGIT_WORDS for i, w in enumerate(line.split())} | {"oh": "0", "tres": "3", "fuenf": "5", "fuhf": "5", "zwo": "2", "meia": "6", "нуль": "0"}
_WORD = re.compile(r"[^\W\d_]+")
_ONE_DIGIT = "|".join(sorted(_WORD_DIGIT, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:{_ONE_DIGIT})(?:[\s,.-]+(?:{_ONE_DIGIT})){{5,}}(?!\w)", re.I)
_JA_DIGITS = re.compile("[〇零一二三四五六七八九](?:[-・ ]?[〇零一二三四五六七八九]){6,}")
_JA_VALUE = {c: str(i) for i, c in enumerate("〇一二三四五六七八九")} | {"零": "0"}

#: Characters of addresses and codes; kana and ideographs stand beside them without a blank.
_L = "A-Za-z0-9_À-ɏ"

# Words for the at-sign and the dot.
_AT = r"at|arroba|arobase|chiocciola|klammeraffe|собака|アット(?:マーク)?"
_DOT = r"dot|punto|ponto|point|punkt|точка|ドット"
_CAPITAL_KEYS = ("AT", "ARROBA", "AROBASE", "CHIOCCIOLA")
_AT_KEYS = (" at ", "arroba", "arobase", "chiocciola", "klammeraffe", "собака", "アット")
_DOT_KEYS = tuple(f" {w} " for w in _DOT.split("|"))
_LABEL = rf"[{_L}](?:[{_L}-]*[{_L}])?"
_HOST = rf"{_LABEL}(?:(?:\.|\s\.\s|\s*[(\[{{<]\s*(?:{_DOT}|\.)\s*[)\]}}>]\s*|\s+(?:{_DOT})\s+){_LABEL})+"
_USER = rf"(?<![{_L}.+-])([{_L}](?:[{_L}.+-]*[{_L}])?"
_BRACKETED_AT = re.compile(rf"{_USER})\s*[(\[{{<]\s*(?:{_AT}|@|a)\s*[)\]}}>]\s*({_HOST})", re.I)
_CAPITAL_AT = re.compile(rf"{_USER})\s+(?:{'|'.join(_CAPITAL_KEYS)})\s+({_HOST})")
_SPELLED_AT = re.compile(rf"{_USER}(?:\s+(?:{_DOT})\s+{_LABEL})*)\s+(?:{_AT})\s+({_LABEL}(?:\s+(?:{_DOT})\s+{_LABEL})+)", re.I)
_PLAIN_AT = re.compile(rf"(?<![{_L}.+-])([{_L}]+[.+_-][{_L}.+-]*[{_L}])\s+(?:{_AT})\s+({_LABEL}(?:\.{_LABEL})+)", re.I)
_SIGN_AT = re.compile(rf"{_USER})\s?@\s?({_HOST})", re.I)
_DOTS = re.compile(rf"\s*[(\[{{<]\s*(?:{_DOT}|\.)\s*[)\]}}>]\s*|\s+(?:{_DOT})\s+|\s?\.\s?", re.I)


def _joined(m: re.Match) -> str:
    return f"{_DOTS.sub(chr(46), m[1])}@{_DOTS.sub(chr(46), m[2])}"


def _not_sentence(m: re.Match) -> str | None:
    """A sign-at with blanks counts; a dot followed by a blank ends the sentence instead of joining a host."""
    host = re.split(r"\.\s", m[2])[0] if ". " in m[2] else m[2]
    return None if host != m[2] and "." not in host else (f"{m[1]}@{_DOTS.sub('.', host)}" + (m[2][len(host) :] if host != m[2] else ""))


def normal_form(source: str) -> Tape:
    """The text as the detectors read it. Texts of any length; linear in it."""
    tape = folded(source)
    lower = tape.text.lower()
    if sum(map(_WORD_DIGIT.__contains__, _WORD.findall(lower))) >= 6:
        tape = tape.rewrite(_SPELLED, lambda m: "".join(_WORD_DIGIT[w] for w in _WORD.findall(m[0].lower())))
    if any(c in lower for c in _JA_VALUE):
        tape = tape.rewrite(_JA_DIGITS, lambda m: "".join(_JA_VALUE.get(c, "") for c in m[0]))
    return Tape(one_script(tape.text), tape.start, tape.end)


_ALIKE = re.compile(f"[{''.join(map(chr, _PROTOTYPES))}]")
_LATIN = re.compile(r"[A-Za-z]")
_MIXED = re.compile(r"[A-Za-zÀ-ɏͰ-ӿ]+")
_FOREIGN = re.compile("[Ͱ-ӿ]")
_TO_CYRILLIC = {ord(v): chr(k) for k, v in _PROTOTYPES.items() if 0x400 <= k <= 0x45F}


def one_script(text: str) -> str:
    """Each word in one script, character for character: a word with letters that only Cyrillic has becomes Cyrillic, others with look-alikes Latin, if the text is mainly Latin or the word mixes both."""
    if text.isascii() or not _FOREIGN.search(text) or not _LATIN.search(text):
        return text
    latin = sum("a" <= c <= "z" for c in text.lower()) > sum("\u0370" <= c <= "\u04ff" for c in text)

    def word(m: re.Match) -> str:
        w = m.group()
        if not _FOREIGN.search(w):
            return w
        mapped = w.translate(_PROTOTYPES)
        if _FOREIGN.search(mapped):
            return w.translate(_TO_CYRILLIC)
        return mapped if latin or mapped != w and re.search("[A-Za-z]", w) else w

    return _MIXED.sub(word, text)


def latin_form(tape: Tape) -> Tape:
    """The tape with look-alike letters mapped to Latin ones and at- and dot-disguises undone: for mail addresses and codes."""
    text = tape.text.translate(_PROTOTYPES) if not tape.text.isascii() and _ALIKE.search(tape.text) else tape.text
    tape = Tape(text, tape.start, tape.end)
    low = " ".join(text.lower().split())  # blanks of any kind, as in the patterns
    if "(" in text or "[" in text or "{" in text or "<" in text:
        tape = tape.rewrite(_BRACKETED_AT, _joined)
    if any(k in text for k in _CAPITAL_KEYS):
        tape = tape.rewrite(_CAPITAL_AT, lambda m: _joined(m) if not text.isupper() or re.search(rf"\s(?:{_DOT})\s|\.", m[2], re.I) else None)
    if any(k in low for k in _AT_KEYS):
        if any(k in low for k in _DOT_KEYS):
            tape = tape.rewrite(_SPELLED_AT, _joined)
        tape = tape.rewrite(_PLAIN_AT, _joined)
    if "@" in tape.text:
        tape = tape.rewrite(_SIGN_AT, _not_sentence)
    return tape


# Detectors

_EMAIL = re.compile(rf"(?<![{_L}.+-])(?:mailto:)?[{_L}](?:[{_L}.+%-]*[{_L}])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{{2,24}}(?![{_L}-])", re.I)

# Numbers: a run of digits of one line with the usual separators, or a code of letters and digits.
_NUMBER = re.compile(rf"(?<![{_L}А-яЁё.,:/#@€$£%~-])(?:\+[^\S\n]?|00[^\S\n]?)?\(?\+?\d(?:[\d()./–-]|[^\S\n]){{4,24}}\d(?:[^\S\n]?(?:x|ext\.?|доб\.?)[^\S\n]?\d{{1,5}})?(?![{_L}А-яЁё%€]|[.,:/-]\d)", re.I)
_CODE = re.compile(
    rf"(?<![{_L}А-яЁё@#/.:-])(?=[A-Z0-9 .–-]*\d)(?:[A-Z]{{6}} ?\d{{2}}[A-Z]\d{{2}} ?[A-Z]\d{{3}}[A-Z]|[A-Z]{{1,3}}[ .-]?\d(?:[ .–-]?\d){{3,14}}(?:[A-Z]{{1,2}}|[ -][A-Z](?: \d{{1,4}})?)?|\d(?:[ .–-]?\d){{3,13}}[ .-]?[A-Z](?:[ .-]?\d{{1,4}})?|"
    rf"[A-Z0-9]{{1,3}}\d{{2}}[A-Z0-9]{{4,9}}|[A-Z]{{1,2}}\d{{1,5}}[A-Z]{{1,3}}\d{{0,5}}[A-Z]{{0,2}})(?![{_L}А-яЁё])",
    re.I,
)

# Words that make a number near them an identity number of a person, a telephone number, or neither.
_ID_CUE = re.compile(
    r"(?<!\w)(?:id(?:\s?(?:no\.?|number|card|nr\.?|№))?|identity|identit[àé]|identidade?|identidad|identité|passports?|passport|pasaporte|passaporte|passeport|passaporto|reisepass\w*|ausweis\w*|personalausweis\w*|"
    r"licen[cs]e|licencia|licença|permis|patente|führerschein\w*|carnet|dni|nie|nif|cpf|rg|ssn|social security|seguridad social|sécurité sociale|insee|codice fiscale|cod\. fiscale|tax(?:\s?id)?|steuer\w*|steuer-?id|rfc|curp|"
    r"documento|document|dl|d\.l\.|nino|national insurance|insurance|carte d'identité|pièce d'identité|tessera|bürger\w*|паспорт\w*|инн|снилс|удостоверени\w*|водительск\w*|документ\w*|身分証\w*|身分証明書|マイナンバー|免許証?|旅券|パスポート|social)(?!\w)|身分証|身份证|免許|旅券|パスポート|マイナンバー",
    re.I,
)
_PHONE_CUE = re.compile(
    r"☎|📞|📱|✆|(?<!\w)(?:call|ring|text|phone|tel\.?|mobile|whats\s?app|line|dial|reach|message|llama\w*|ll[aá]m\w*|teléfono|tfno?\.?|móvil|liga|ligue|telefone|telemóvel|contat[oe]|contacto|"
    r"appelez\w*|appelle\w*|tél\.?|téléphone|joindre|ruft|anruf\w*|rufen|telefon\w*|handy|erreichbar|chiama\w*|telefono|cell\.?|cellulare|messaggi|mensagem|mensajes?|звони\w*|телефон\w*|тел\.?|пиши\w*)(?!\w)|"
    r"電話|携帯|連絡|問い合わせ",
    re.I,
)
_NUMBER_CUE = re.compile(r"(?<!\w)(?:number|número|numero|numéro|nummer|номер\w*)(?!\w)|番号", re.I)
_NO_CUE = re.compile(
    r"(?<!\w)(?:isbn|issn|ean|upc|sku|gtin|doi|lot|batch|code|promo|coupon|order|parcel|tracking|shipment|invoice|pedido|encomenda|commande|colis|bestellung|paket|sendung|ordine|pacco|заказ\w*|посылк\w*|"
    r"frames?|views?|reviews?|fps|iso|tc|img|dsc|mov|version|v|rated|item|serial|model|part no|ref|résumé|likes?|followers?|km|kg|mm|px|hz|mah|gb|mb|kb|ms|sec|min|hours?|photos?)(?!\w)|注文番号|伝票|品番|回|枚|フレーム",
    re.I,
)
_DATE = re.compile(r"^\s*(?:\d{1,2}[./-]\d{1,2}[./-](?:19|20)?\d{2}|(?:19|20)\d{2}[./-]\d{1,2}[./-]\d{1,2})(?:\s*[ /T,]\s*\d{1,2}(?:[:.]\d{2})*)?\s*$")


#: Characters on each side of a number in which words that explain it are looked for, within its line and sentence.
CONTEXT = 60


def _near(text: str, a: int, b: int, before: int, after: int) -> tuple[str, str]:
    """Context within the same line and sentence."""
    left = text[max(0, a - before) : a]
    right = text[b : b + after]
    cut = max(left.rfind("\n"), left.rfind(". "), left.rfind("! "), left.rfind("? "), left.rfind("✨"), left.rfind("。"))
    abbreviation = re.search(r"(?:no|nr|tel|tfn|tfno|ext|cod|n|núm|num|тел|№)\.\s*$", left, re.I)
    if cut >= 0 and not abbreviation:
        left = left[cut + 1 :]
    stop = min([x for x in (right.find("\n"), right.find(". "), right.find("! "), right.find("? "), right.find("✨"), right.find("。")) if x >= 0], default=len(right))
    return left, right[:stop]


def _last(pattern: re.Pattern, text: str) -> int:
    """How far before the end of ``text`` the last match ends; large if there is none."""
    at = None
    for m in pattern.finditer(text):
        at = m
    return len(text) - at.end() if at else _NEVER


def _first(pattern: re.Pattern, text: str) -> int:
    m = pattern.search(text)
    return m.start() if m else _NEVER


_SHAPES = re.compile(
    r"^(?:(?:\+|00)\s?\(?[1-9][\d()\s./–-]{7,22}(?:\s?(?:x|ext\.?|доб\.?)\s?\d{1,5})?"  # international
    r"|\(\d{2,5}\)[\s./-]?\d[\d\s./–-]{4,10}(?:\s?(?:x|ext\.?)\s?\d{1,5})?"  # area code in brackets
    r"|\d{3}[\s.-]\d{3}[\s.-]\d{4}(?:\s?(?:x|ext\.?)\s?\d{1,5})?"  # three, three, four
    r"|\d{3}[\s.-]\d{4}\s?(?:x|ext\.?)\s?\d{1,5}"
    r"|0[1-9](?:[\s.-]?\d{2}){4}"  # five pairs
    r"|0\d{2,4}[\s/-]\d{3,8}(?:[\s-]\d{2,5}){0,2}"  # trunk prefix
    r"|0\d{1,3}[\s-]\d{3,4}[\s.-]\d{4}"
    r"|[679]\d{2}[\s.-]?\d{2,3}[\s.-]?\d{2,3}(?:[\s.-]\d{2,3})?)$"  # mobile numbers of nine digits
)
_NEVER = 1 << 20
_TRUNK = re.compile(r"0\d{9,10}$")  # a national number in one piece
_NAMED = re.compile(r"[はが：:]\s*$")

#: Most digits of a telephone number: 15 of an international one, and an extension.
LONGEST_PHONE = 20

# Formats of identity numbers of persons that speak for themselves.
_IDENTITY = re.compile(
    r"(?:\d{3}([ -])\d{2}\1\d{4}"  # United States
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"  # United Kingdom
    r"|\d{8}-?[A-Z]|\d{2}\.\d{3}\.\d{3}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"  # Spain
    r"|[A-Z]{6} ?\d{2}[A-Z]\d{2} ?[A-Z]\d{3}[A-Z]"  # Italy
    r"|[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?\d[\dAB] ?\d{3} ?\d{3}(?: ?\d{2})?"  # France
    r"|\d{3}\.\d{3}\.\d{3}-\d{2}"  # Brazil
    r"|\d{3}-\d{3}-\d{3}[ -]\d{2}"  # Russia
    r"|\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dX]"  # China
    r"|[A-Z]{4}\d{6}[HM][A-Z]{5}[A-Z0-9]\d|[A-Z]{4}\d{6}[A-Z0-9]{3}"  # Mexico
    r"|D\.?L\.?[ -]?\d{6,12})$",  # driving licences
    re.I,
)


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    for pattern in (_NUMBER, _CODE):
        for m in pattern.finditer(text):
            raw = m.group()
            a, b = m.span()
            if pattern is _CODE:
                raw = raw.rstrip(" .–-")
                b = a + len(raw)
                head = re.match(r"([^\W\d_]+)[ .-]+", raw)
                if head and _ID_CUE.fullmatch(head[1]) and sum(c.isdigit() for c in raw) >= 5:
                    yield a, b, "ID_NUMBER"
                    continue
                if head and (head[1].lower() in STOP or head[1].lower() in ("no", "nr", "es")):
                    raw, a = raw[head.end() :], a + head.end()
            digits = sum(c.isdigit() for c in raw)
            letters = sum(c.isalpha() for c in raw) if pattern is _CODE else 0
            if digits < 5 or pattern is _CODE and not letters:
                continue
            left, right = _near(text, a, b, CONTEXT, CONTEXT)
            kind = _kind(raw.strip(), digits, bool(letters), left, right)
            if kind:
                yield a, b, kind


def _kind(raw: str, digits: int, letters: bool, left: str, right: str) -> str | None:
    """What a number is, by the words before it, then those after it, then its shape."""
    no, ident, phone = _last(_NO_CUE, left), _last(_ID_CUE, left), _last(_PHONE_CUE, left)
    after = _first(_NO_CUE, right)
    if _DATE.match(raw) or after <= 3 and min(ident, phone) > 12 or no <= 12 and no < min(ident, phone):
        return None
    number = _last(_NUMBER_CUE, left)
    if ident < 40 and number + 20 < ident and number < 20 and not letters:
        ident, phone = _NEVER, number  # "DNI 123. My number: 456"
    if ident < 40 or phone < 40:
        if ident <= phone or letters and ident < 40:
            return "ID_NUMBER"
        return "PHONE" if 6 <= digits <= LONGEST_PHONE and not letters else None
    if _IDENTITY.match(raw):
        return "ID_NUMBER"
    later = _ID_CUE.search(right)
    if later and later.start() < _first(_PHONE_CUE, right) and not re.match(r"[\s:.#№n°]{0,6}[A-Z]{0,3}[ .-]?\d", right[later.end() :], re.I):
        return "ID_NUMBER"
    if letters:
        return None
    if digits > LONGEST_PHONE:
        return None
    if digits >= 6 and (_first(_PHONE_CUE, right) < 30 or number < 20 or _TRUNK.match(raw) and _NAMED.search(left)):
        return "PHONE"
    if digits >= 7 and _SHAPES.match(raw) or _ALONE.match(raw) and _stands_alone(left, right):
        return "PHONE"
    return None


_ALONE = re.compile(r"^(?:\d{3}-\d{4}|\d{2,4}(?:[\s.-]\d{2,4}){2,4}|\d{2,3}[\s-]\d{7,9}|0\d{8,11}|8(?:[\s-]\d{2,3}){2,4}|[5-9]\d{8})$")


def _stands_alone(left: str, right: str) -> bool:
    """The number is a sentence of its own."""
    before, behind = left.rstrip(), right.lstrip()
    return (not before or not (before[-1].isalnum() or before[-1] in ",:;-(/")) and (not behind or not (behind[0].isalnum() and not behind[0].isupper() and not "\u3040" <= behind[0] <= "\u9fff") and behind[0] not in ",;/%€)")


# Addresses: a street with a house number, in the order and words of each language.
_W = r"(?!(?:is|are|was|on|its|to|con|com|avec|mit|en|em|mientras|enquanto|until)(?!\w))[^\W\d_][^\W\d_'’]*(?:['’-][^\W\d_]+)*"
_NO = r"\d{1,4}(?:[a-zA-Z](?!\w))?(?:[-/]\d{1,4})?"
_ADDRESSES = [
    re.compile(
        rf"(?<![\w.,-])\d{{1,5}}[a-zA-Z]?,?\s+(?!(?:hours?|minutes?|frames?|days?|views?|of|on|in|the|and|views|times|photos?|more)\b)(?:{_W}\s+){{1,3}}?"
        r"(?:street|str?|road|rd|lane|ln|avenue|ave|av|court|ct|square|sq|drive|dr|way|close|terrace|place|pl|row|hill|crescent|boulevard|blvd|mews|walk|gardens?|grove|parade|quay|yard|alley|parkway|pkwy)(?:\.|(?!\w))",
        re.I,
    ),
    re.compile(
        rf"(?<!\w)(?:calle|c/|c\.|avda\.?|avenida|av\.?|plaza|pza\.?|plza\.?|paseo|p[ºo]\.|camino|cno\.?|ronda|carrer|travesía|trav\.?|callejón|glorieta|rua|r\.|travessa|tv\.|praça|pç\.?|largo|lgo\.?|estrada|estr\.|alameda|al\.|beco|rodovia|"
        rf"via|v\.|viale|v\.le|piazza|p\.?\s?za|p\.?zza|corso|c\.so|vicolo|vico|vic\.|strada|salita|lungomare)\s+(?:{_W}\s*){{1,5}}?,?\s*(?:n[.ºo°]*\s*|núm\.?\s*|nº\s*|numero\s*)?{_NO}(?!\w|[.,:]\d|\s*[%€])",
        re.I,
    ),
    re.compile(
        rf"(?<![\w.,-])\d{{1,4}}(?:\s?(?:bis|ter|quater|[a-d](?!\w)))?,?\s+(?:rue|avenue|av\.|boulevard|bd\.?|boul\.|impasse|imp\.|place|pl\.|chemin|ch\.|allée|all\.|quai|route|rte|ruelle|passage|cours|square|sentier|venelle|villa)\s+(?:{_W}\s*){{1,4}}",
        re.I,
    ),
    re.compile(rf"(?<!\w)[^\W\d_][\w'’-]*(?:stra(?:ß|ss)e|str\.|gasse|gässchen|weg|platz|allee|ring|ufer|damm|steig|steg|pfad|chaussee|promenade|graben|markt)\s+{_NO}(?!\w|[.,:]\d|\s*[%€])", re.I),
    re.compile(rf"(?<!\w)(?:[Aa]m|[Aa]n der|[Ii]m|[Ii]n der|[Zz]um|[Zz]ur|[Aa]uf de[rm]|[Uu]nter den)\s+(?:[A-ZÄÖÜ][\w-]+\s+){{1,2}}\d{{1,4}}\s?[a-z]?(?=,\s*(?:\d{{5}}|[A-ZÄÖÜ])|\s*\(\d)"),
    re.compile(r"(?<!\w)(?:[Aa]m|[Aa]n der|[Ii]m|[Zz]um|[Zz]ur|[Aa]uf de[rm]|[Uu]nter den)\s+[A-ZÄÖÜ][\w-]+\s+[A-ZÄÖÜ][\w-]+\s+(?!(?:19|20)\d\d)\d{1,4}\s?[a-z]?(?=[.;!]|\s*$|\s*[✨🙌\n])", re.M),
    re.compile(
        rf"(?<!\w)(?:ул(?:ица|ице|ицу|ицы|\.)?|пр(?:оспект\w*|-?кт|-т|\.)|пер(?:еул\w+|\.)|наб(?:ережн\w+|\.)|пл(?:ощад\w+|\.)|бульвар\w*|б-р|шоссе|ш\.|проезд\w*|пр-д|аллея|тупик)\s*(?:{_W}\s*){{1,3}}?,?\s*(?:д(?:ом|\.)?\s*)?{_NO}(?!\w)",
        re.I,
    ),
    re.compile(rf"(?<!\w)(?:{_W}\s+){{1,2}}(?:улиц\w+|ул\.|проспект\w*|переул\w+|пер\.|набережн\w+|наб\.|площад\w+|пл\.|бульвар\w*|шоссе|проезд\w*)\s*,?\s*(?:д(?:ом|\.)?\s*)?{_NO}(?!\w)", re.I),
    re.compile("[一-龯々ァ-ヶー]{1,12}(?:町|通り|通|村|区|市|郷|台|丘|坂)?[0-90-9一二三四五六七八九十]{1,3}丁目[0-9]{1,3}(?:番地?|[-−ー])?[0-9]{0,3}(?:号|[-−][0-9]{1,4})?|[一-龯々]{1,8}(?:町|通り|村)[0-9]{1,4}番地"),
    re.compile("(?:[一-龯々]{1,4}[都道府県])?[一-龯々ァ-ヶー]{1,8}[市区町村郡][一-龯々ァ-ヶーの]{0,10}[0-9]{1,4}[-−‐ー][0-9]{1,4}(?:[-−‐ー][0-9]{1,5})?(?![0-9])"),
]
# Stretches of which one occurs in every address of a pattern, in the order of _ADDRESSES; none given means any digit.
_ADDRESS_KEYS = (
    " st| rd| road| lane| ln| av| court| ct| sq| dr| way| close| terrace| pl| row| hill| cres| boul| blvd| mews| walk| garden| grove| parade| quay| yard| alley| parkway| pkwy",
    "calle|c/|c.|avda|avenida|av|plaza|pza|plza|paseo|p\u00ba|po.|camino|cno|ronda|carrer|travesia|trav|callejon|glorieta|rua|r.|travessa|tv|praca|pc|largo|lgo|estr|alameda|al.|beco|rodovia|via|v.|viale|piazza|za|corso|vico|vic.|strada|salita|lungomare",
    "rue|avenue|av.|b|imp|pl|ch|all|quai|route|rte|passage|cours|square|sentier|venelle|villa",
    "stra|str.|gasse|gasschen|weg|platz|allee|ring|ufer|damm|steig|steg|pfad|chaussee|promenade|graben|markt",
    "am |an der |im |in der |zum |zur |auf de|unter den ",
    "am |an der |im |zum |zur |auf de|unter den ",
    "ул|пр|пер|наб|пл|бульвар|б-р|ш|алле|туп",
    "улиц|ул.|просп|переул|пер.|набереж|наб.|площад|пл.|бульвар|шоссе|проезд",
    "丁目|番地",
    "市|区|町|村|郡",
)


def _automaton():
    """Finds in one pass which address patterns a text can match at all, and where phrases that introduce a person end."""
    import ahocorasick

    of: dict[str, list[str]] = {}
    for i, keys in enumerate(_ADDRESS_KEYS):
        for k in bare(keys).split("|"):
            of.setdefault(k, []).append(f"address{i}")
    for kind, phrases in (("intro", INTRODUCTIONS), ("deed", DEEDS)):
        for phrase in phrases:
            of.setdefault(phrase, []).append(kind)
    out = ahocorasick.Automaton()
    for k, kinds in of.items():
        out.add_word(k, (len(k), frozenset(kinds)))
    out.make_automaton()
    return out


_AUTOMATON = _automaton()


def _possible(low: str) -> tuple[set[str], list[int], list[int]]:
    """Address patterns that can match, ends of introducing phrases and starts of phrases of deeds, of a text in small letters and without accents."""
    possible: set[str] = set()
    ends, starts = [], []
    for at, (n, kinds) in _AUTOMATON.iter(low):
        if "intro" in kinds or "deed" in kinds:
            start, end = at + 1 - n, at + 1
            if not (start and low[start - 1].isalnum()) and not (low[end : end + 1].isalnum() and low[at].isalnum()):
                (ends.append(end) if "intro" in kinds else starts.append(start))
        possible |= kinds
    return possible, ends, starts


_HAS_DIGIT = re.compile(r"\d")


def find(source: str | None, lexicon: Lexicon = USUAL) -> list[tuple[int, int, str]]:
    """``(start, end, type)`` of the personal information in a text, in order and without overlap; positions are those of the source.

    Null and empty texts have none. Where detectors overlap, mail addresses come before street addresses, identity numbers,
    telephone numbers and names, in this order, then the longer span.
    """
    if not source:
        return []
    tape = normal_form(source)
    latin = latin_form(tape)
    spans: list[tuple[int, int, str]] = []
    plain = bare(tape.text)
    low = plain.lower()
    if len(low) != len(plain):
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in plain)
    possible, introduced, deeds = _possible(low)
    if "@" in latin.text:
        spans += [(*latin.span(*m.span()), "EMAIL") for m in _EMAIL.finditer(latin.text)]
    if _HAS_DIGIT.search(tape.text):
        places = []
        for i, pattern in enumerate(_ADDRESSES):
            for m in pattern.finditer(tape.text) if f"address{i}" in possible else ():
                places.append((m.start(), m.start() + len(m.group().rstrip(" ,"))))
        rest = tape.text
        if places:
            spans += [(*tape.span(a, b), "ADDRESS") for a, b in places]
            letters = list(rest)
            for a, b in places:
                letters[a:b] = "§" * (b - a)  # its digits are no other number's
            rest = "".join(letters)
        spans += [(*tape.span(a, b), kind) for a, b, kind in _numbers(rest)]
    spans += [(*tape.span(a, b), "NAME") for a, b in names(plain, lexicon, introduced, deeds, low)]
    rank = {"EMAIL": 0, "ADDRESS": 1, "ID_NUMBER": 2, "PHONE": 3, "NAME": 4}
    out: list[tuple[int, int, str]] = []
    for s in sorted(set(spans), key=lambda s: (rank[s[2]], s[0] - s[1])):
        i = bisect.bisect_left(out, s)
        if (not i or out[i - 1][1] <= s[0]) and (i == len(out) or s[1] <= out[i][0]):
            out.insert(i, s)
    return out


def redact(source: str | None, lexicon: Lexicon = USUAL) -> str | None:
    """The text with a placeholder such as ``[EMAIL]`` for every find; all other characters unchanged. Null for null."""
    if source is None:
        return None
    out, last = [], 0
    for a, b, kind in find(source, lexicon):
        out += [source[last:a], f"[{kind}]"]
        last = b
    return "".join([*out, source[last:]])


# Spark


FOUND = "id string, pii_type string, start int, end int"


def found(df: DataFrame, id_column: str, text: str, lexicon: Lexicon = USUAL) -> DataFrame:
    """``id, pii_type, start, end`` of everything found in every text; repeated rows of ``df`` give repeated rows. ``lexicon`` comes from :func:`.names.learn`."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)  # bounded by names.ORDINARY and names.GIVEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = [(i, kind, a, b) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, b, kind in find(t, known)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())], ["id", "pii_type", "start", "end"]
            )

    return df.select(F.col(id_column).cast("string").alias("id"), F.col(text)).where(F.trim(text) != "").mapInArrow(run, FOUND)


def redacted(df: DataFrame, text: str, lexicon: Lexicon = USUAL) -> Column:
    """Column ``text`` of ``df`` with personal information replaced by typed placeholders; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf(T.StringType())
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([redact(t, shared.value) for t in batch], dtype=object)

    return udf(F.col(text))
