"""Names of persons in free text: evidence from shape, words around and a lexicon.

A name is a given name or its initial with a surname. Evidence comes from four sides: given names (a
short list of usual ones, and those learned from the corpus: words that stand, capitalised, before
many different words that are themselves never written small), the shape of the words, the words
before and behind (introductions, by-lines, titles, roles), and endings that only surnames have. Words
of firms, venues, streets and places speak against. Where letter case says nothing — in texts all small or
all capital — both words must be unknown to the vocabulary learned from the corpus, or a phrase must
introduce them.
"""

from __future__ import annotations

import functools
import operator
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bounds of the learned lexicon: most frequent ordinary words, given names with most partners; different surnames that make a given name.
ORDINARY, GIVEN, PARTNERS = 200_000, 100_000, 3


def bare(text: str) -> str:
    """The text without accents, character for character."""
    return text if text.isascii() else text.translate(_BARE)


class _Bare(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = c
        if c not in "йЙ" and (d := unicodedata.decomposition(c)) and d[0] != "<":
            b = chr(int(d.split()[0], 16))
            out = b if not b.isalpha() or unicodedata.category(b) != "Lo" or ord(b) < 0x250 else c
            if unicodedata.category(c) == "Lo":
                out = c
        self[code] = out
        return out


_BARE = _Bare()

# Usual given names of each language, without accents.
_USUAL = """
james john robert michael william david richard thomas daniel matthew mary patricia jennifer linda elizabeth susan sarah karen emily anna laura emma olivia henry
antonio jose manuel francisco juan carlos miguel javier diego pablo carmen isabel ana lucia elena sofia marta rosa pilar maria
joao pedro paulo luis rui tiago bruno ines beatriz mariana leonor
jean pierre michel philippe nicolas julien camille claire marie sophie celine chloe jacques francois
hans peter klaus stefan wolfgang jurgen heike sabine monika ursula petra karl lukas
giuseppe marco luca giovanni alessandro francesca giulia chiara paola matteo
иван александр сергей дмитрий алексей андрей михаил николай владимир анна мария елена ольга наталья татьяна екатерина ирина светлана
ivan sergei dmitri olga natalia igor tom paul mark george alice grace kate jane peter anthony joseph charles andrew
"""

# Endings that surnames have, by language.
_SURNAME = re.compile(
    r"(?:[a-z](?:sson|son|sen|mann|berg|stein|baum|bauer|meier|meyer|maier|schmidt|ez|escu|opoulos|idis|ewski|owski|wicz|enko|shvili|yan|etti|elli|ini|ucci|acci|oni|ovic|eira|ault|eau|ov|ova|ev|eva|sky|skaya)|[а-я](?:ов|ова|ову|овой|ев|ева|ин|ина|ин[ау]|ский|ская|ской|енко|чук|юк))$"
)

# Function words and greetings that no name contains.
STOP = frozenset(
    "the a an and or of on in at to for from with by my our your his her its we i you he she they it this that these those is are was were be been not no yes so but as if all every one two three new old last late right "
    "before after while during between somewhere nobody somebody everyone more most only very just please love where what who how when day days way ways time year years friend friends team crew whole sister brother which then there here than "
    "hi hello hey dear thanks thank happy good best great today tomorrow yesterday monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "contact call text write meet ask follow see watch interview mr mrs ms dr prof sir name names let us me him them their will would can could has have had do did does now still also about into over under up down out off again both "
    "el la los las un una unos unas y o de del al en con por para sin que mi tu su nos se lo le les es son fue yo entre antes despues desde mientras hoy ayer todo toda casi hola gracias feliz sr sra senor senora don dona "
    "os as um uma uns umas e ou do da dos das no na nas ao com por sem meu minha seu sua eu foi sao depois enquanto hoje ontem tudo quase quem ola obrigado obrigada "
    "les des du au aux et ou dans sur avec pour par sans qui ma ton son notre nous je il elle est sont ete avant apres pendant ce cette tout toute bonjour merci monsieur madame mme "
    "der die das den dem des ein eine einen einem einer und oder im am auf mit fur von zu zum zur bei aus nach vor wahrend wir ich ihr er sie es ist sind war mein meine unser zwischen gleich irgendwo ganze letztes heute hallo danke herr frau liebe lieber "
    "gli uno di dei delle dal nel nella su tra fra che mio mia nostro noi io sono era ho abbiamo prima dopo mentre oggi tutta tutto ciao grazie signor signora "
    "и в во на с со к ко по за из от до без у об мы я ты он она они это этот эта был была были но а как что кто сразу после когда между пока никто вся привет спасибо".split()
)

# Words of firms, venues, teams, streets and places; they stand before or behind a proper name that is none of a person.
FIRM = frozenset(
    "studio studios kitchen coffee audio optics lenses bike bikes bakery outfitters gallery galeria galleria galerie museum museo musee cafe bar restaurant hotel hostel shop store records media film films pictures production productions gmbh ltd inc llc corp "
    "co company group team club fc band school university college institute church hall theatre theater park press lab labs agency foundation centre center airport station bridge tower bank hospital clinic library house radio tv magazine festival award prize cup "
    "street road avenue lane court square drive boulevard calle rua via piazza plaza avenida paseo camino viale corso largo praca travessa rue place quai allee platz weg gasse ring strasse улица проспект площадь переулок "
    "saint san santa sao st lake mount mt fort port cape river north south east west los las new city town island islands bay beach valley mountains republic kingdom lago monte rio villa casa".split()
)

# Words after which a person is named, of any language: by-lines, introductions, titles, relations.
_LINK = frozenset(
    "by with thanks thank to from for meet contact ask call named called is am dr mr mrs ms prof professor sir captain teacher friend brother sister cousin neighbour neighbor boss coach mentor colleague uncle aunt director camera model credit credits guest singer drummer chef artist author photographer "
    "por con a gracias soy llamo llama es sr sra don dona profesor profesora maestra maestro amigo amiga hermano hermana primo prima "
    "com ao obrigado obrigada sou chamo professora professor irmao irma "
    "par avec merci suis appelle monsieur madame mme prof soeur frere ami amie de "
    "von mit an bin heisse heiße ist herr frau lehrer lehrerin freund freundin bruder schwester "
    "da di del grazie sono chiamo mi signor signora maestro amico amica fratello sorella "
    "с со зовут это от спасибо учитель учительница друг подруга брат сестра сосед соседка снимает снимал снимала снял сняла".split()
)

_WORD = re.compile(r"[^\W\d_ぁ-ゖァ-ヶー一-龯]+(?:['’-][^\W\d_ぁ-ゖァ-ヶー一-龯]+)*|[ぁ-ゖァ-ヶー一-龯]+")
_TAG = re.compile(r"#\w+")
_BLANK = re.compile(r"[^\S\n]{1,2}\Z")
_MIDDLE = re.compile(r"[^\S\n]{1,2}[^\W\d_]\.[^\S\n]?\Z")
_PARTICLES = re.compile(r"[^\S\n](?:(?:de|da|do|dos|das|di|del|della|van|von|der|den|du|le|la|al|el|bin|ben)[^\S\n]){1,3}\Z", re.I)
_INITIALS = re.compile(r"(?<![\w@#.&])([^\W\d_])\.[^\S\n]?(?:[^\W\d_]\.[^\S\n]?)?([^\W\d_]{2,}(?:['’-][^\W\d_]+)*)")
_LAST_INITIAL = re.compile(r"([^\W\d_]{2,}(?:['’-][^\W\d_]+)*),[^\S\n]?([^\W\d_])\.(?!\w)")
_OPEN = re.compile(r"(?:^|[\n.!?…:;(–—\"“«/|]|[^\w\s,'’@#&.-])\s*\Z")
_ELIDED = re.compile(r"(?:[ldjsnmtc]|qu)['’]")
_JAPANESE = re.compile("[ぁ-ゖァ-ヶ一-龯]")
_NEVER = 1 << 20


@dataclass(frozen=True)
class Lexicon:
    """Given names and ordinary words, in small letters and without accents. ``learned`` tells whether the words come from a corpus."""

    given: frozenset[str]
    ordinary: frozenset[str] = frozenset()
    learned: bool = False

    @functools.cached_property
    def known(self) -> frozenset[str]:
        """Words that are no surname."""
        return self.ordinary | STOP | FIRM


USUAL = Lexicon(frozenset(_USUAL.split()))


def learn(texts: DataFrame, text: str) -> Lexicon:
    """A lexicon from all texts of the table. Null and empty texts count nothing; an empty table gives the usual names only.

    Every task counts, over the texts that use both cases, words written small, words with a capital inside a
    sentence, at its start and behind a German article or number word, and pairs of capitalised words. Ordinary are words
    mostly written small or only capital where a sentence starts, and nouns, which German articles precede; a given
    name stands before at least PARTNERS different words that are not ordinary, and more often first than second in a pair. What reaches the driver is bounded
    by ORDINARY and GIVEN.
    """
    kinds = ("small", "inside", "first", "counted")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {k: Counter() for k in (*kinds, "pairs")}

        def flush() -> pa.RecordBatch:
            words = list(set().union(*(seen[k] for k in kinds)))
            pairs = seen["pairs"]
            columns = [pa.array([*words, *(a for a, _ in pairs)], pa.string()), pa.array([*[None] * len(words), *(b for _, b in pairs)], pa.string())]
            columns += [pa.array([*(seen[k][w] for w in words), *(pairs.values() if k == "inside" else [0] * len(pairs))], pa.int64()) for k in kinds]
            for c in seen.values():
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "partner", *kinds])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and not t.islower() and not t.isupper():
                    for k, words in zip((*kinds, "pairs"), _evidence(bare(t)), strict=True):
                        seen[k].update(words)
            if sum(map(len, seen.values())) > 500_000:
                yield flush()
        yield flush()

    schema = "word string, partner string, " + ", ".join(f"{k} long" for k in kinds)
    counted = cut_lineage(texts.select(text).mapInArrow(count, schema).groupBy("word", "partner").agg(*(F.sum(k).alias(k) for k in kinds)))
    small, inside, first, behind = (F.col(k) for k in kinds)
    is_ordinary = (small >= F.greatest(inside, F.lit(5))) | (first >= 5) & (first >= 4 * inside) | (behind >= 3) & (5 * behind >= inside)
    words = counted.where(F.col("partner").isNull() & is_ordinary).select("word", (small + inside + first).alias("n"))
    ordinary = {r.word for r in words.orderBy(F.desc("n"), "word").limit(ORDINARY).collect()}
    proper = words.select(F.col("word").alias("partner"))
    both = counted.where("partner IS NOT NULL")
    as_first = both.join(proper, "partner", "left_anti").groupBy("word").agg(F.count("*").alias("n"), F.sum("inside").alias("as_first")).where(F.col("n") >= PARTNERS)
    as_second = both.groupBy(F.col("partner").alias("word")).agg(F.sum("inside").alias("as_second"))
    per = as_first.join(as_second, "word", "left").where(F.col("as_first") >= F.coalesce("as_second", F.lit(0)))
    given = {r.word for r in per.orderBy(F.desc("n"), "word").limit(GIVEN).collect()}
    return Lexicon(USUAL.given | (given - ordinary - STOP - FIRM), frozenset(ordinary - USUAL.given), bool(ordinary))


_CAPITAL = re.compile(r"[A-Z][a-z]+|[А-ЯЁ][а-яё]+")
_AROUND = "\"'“”«»()[]{}<>*~"
_STOPS = ".,;:!?…"
_ARTICLES = frozenset("der die das den dem ein eine einen einem einer kein keine drei zwei".split())


def _evidence(text: str) -> tuple[list, list, list, list, list]:
    """Of one text: words written small, capital inside a sentence, at the start of one, capital behind a German article, and pairs of capital words inside a sentence."""
    small: list[str] = []
    inside: list[str] = []
    first: list[str] = []
    counted: list[str] = []
    pairs: list[tuple[str, str]] = []
    begins, before, held = True, "", ""  # a sentence begins; the word before in small letters; the capital word just before, if nothing parts them
    parts = text.split()
    last = len(parts) - 1
    for i, part in enumerate(parts):
        word = part.strip(_AROUND + _STOPS)
        if word.islower():
            if word.isalpha() and not (i < last and parts[i + 1][0] in "@＠([{<"):
                small.append(word)
            before, held = word, ""
        elif _CAPITAL.fullmatch(word):
            low = word.lower()
            (first if begins else inside).append(low)
            if before in _ARTICLES:
                counted.append(low)
            if held and i < last:  # at the end of a text a word may be cut off
                pairs.append((held, low))
            before, held = low, "" if begins or part[-1] in _STOPS else low
        else:
            if held and i < last and (m := _CAPITAL.match(word)) and word[m.end() :][:1] == "-":  # a surname of two parts
                pairs.append((held, word.lower()))
            before, held = word, ""
        begins = part[-1] in ".!?…。" and not (len(part) == 2 and part[0].isupper())
    return small, inside, first, counted, pairs


def _case(word: str) -> str:
    return "c" if word[0].isupper() and not (word.isupper() and len(word) > 2) else "u" if word.isupper() else "s"


class _Reader:
    """One text without accents, and what surrounds its words."""

    def __init__(self, text: str, lexicon: Lexicon):
        self.text, self.lexicon = text, lexicon
        self.words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)]
        self.low = [w.lower() for w, _, _ in self.words]
        self.cased = not text.islower() and not text.isupper()

    def gap(self, i: int) -> str:
        """What stands between word ``i`` and the next."""
        return self.text[self.words[i][2] : self.words[i + 1][1]]

    def unknown(self, i: int) -> bool:
        """Word ``i`` can be a surname: no function word, no word of firms or places, not ordinary."""
        w = self.low[i]
        known = self.lexicon.known
        if len(w) < 2 or w in known or _JAPANESE.match(w):
            return False
        return w.isalpha() or not _ELIDED.match(w) and not any(len(p) > 3 and p in known for p in re.split("['’-]", w))

    def alike(self, i: int, j: int) -> bool:
        a, b = _case(self.words[i][0]), _case(self.words[j][0])
        return a == b or {a, b} == {"c", "u"}

    def clean(self, i: int, j: int) -> bool:
        """No sign of a firm, a venue, a street, a handle or an address around the words ``i`` to ``j``."""
        a, b = self.words[i][1], self.words[j][2]
        before, behind = self.text[a - 1 : a], self.text[b : b + 1]
        if before in ("@", "#", "&", "/", "_", ".") and before or behind and behind in "@_/" or self.text[b : b + 3].lstrip()[:1] in ("&", "+") or self.text[max(0, a - 8) : a].rstrip()[-1:] in ("&", "+"):
            return False
        if behind == "." and self.text[b + 1 : b + 2].isalpha() and self.text[b + 1 : b + 2].islower():
            return False
        if j + 1 < len(self.words) and self.low[j + 1] in FIRM and _BLANK.match(self.gap(j)):
            return False
        return not (i and self.low[i - 1] in FIRM and _BLANK.match(self.gap(i - 1)))

    def opened(self, i: int) -> bool:
        """Word ``i`` begins a sentence, follows a sign, or is introduced by a word that names persons."""
        a = self.words[i][1]
        return bool(_OPEN.search(self.text[max(0, a - 4) : a])) or i == 0 and not self.text[: min(a, 80)].strip() or self.linked(i)

    def linked(self, i: int) -> bool:
        return bool(i) and self.low[i - 1] in _LINK and bool(re.match(r"[\s.:]{1,3}\Z", self.gap(i - 1)))

    def surname(self, i: int) -> int | None:
        """Index of the surname that follows word ``i``, over an initial or particles; None without one."""
        if i + 1 >= len(self.words):
            return None
        gap = self.gap(i)
        if _BLANK.match(gap):
            j = i + 1
            if len(self.words[j][0]) == 1:  # a middle initial
                return j + 1 if j + 1 < len(self.words) and re.match(r"\.[^\S\n]?\Z", self.gap(j)) else None
            k = j
            while k + 1 < len(self.words) and k - i <= 3 and _PARTICLES.match(self.text[self.words[i][2] : self.words[k + 1][1]]):
                k += 1
            return k if k == j or self.words[k][0][0].isupper() else None
        return None

    def longer(self, i: int, j: int) -> int:
        """The last word of the name that ends, so far, at word ``j``: a second surname."""
        k = j + 1
        if k < len(self.words) and _BLANK.match(self.gap(j)) and self.alike(j, k) and self.unknown(k) and len(self.words[k][0]) > 2 and self.low[k] not in self.lexicon.given and self.clean(i, k):
            return k
        return j

    def pair(self, i: int) -> tuple[int, int] | None:
        """A name that begins with the given name ``i``."""
        j = self.surname(i)
        if j is None or not self.alike(i, j) or not (self.unknown(j) or self.low[j] in self.lexicon.given and self.low[j] not in STOP) or len(self.words[j][0]) < 2:
            return None
        if not (self.cased and _case(self.words[i][0]) == "c") and not (self.lexicon.learned or self.linked(i)):
            return None
        last = self.longer(i, j)
        return (i, last) if self.clean(i, last) else (i, j) if self.clean(i, j) and last != j else None

    def strange(self, i: int) -> tuple[int, int] | None:
        """A name of words that the corpus does not know, from word ``i`` on."""
        if i + 1 < len(self.words) and re.match(r",[^\S\n]\Z", self.gap(i)) and self.linked(i) and self.unknown(i + 1) and self.alike(i, i + 1) and min(len(self.low[i]), len(self.low[i + 1])) > 3 and self.clean(i, i + 1):
            return i, i + 1
        j = self.surname(i)
        if j is None or j > i + 2 or not self.unknown(j) or not self.alike(i, j) or len(self.words[j][0]) < 4 or len(self.words[i][0]) < 3:
            return None
        if not (self.linked(i) or self.opened(i) and self.cased and _case(self.words[i][0]) == "c"):
            return None
        last = self.longer(i, j)
        return (i, last) if self.clean(i, last) else (i, j) if self.clean(i, j) else None

    def turned(self, i: int) -> tuple[int, int] | None:
        """A name that ends with the given name ``i``: after a surname and a comma, or, in Cyrillic or with the surname in capitals, without one."""
        if not i:
            return None
        gap = self.gap(i - 1)
        if not self.alike(i - 1, i) or not self.unknown(i - 1) or len(self.words[i - 1][0]) < 3:
            return None
        if re.match(r"[^\S\n]?,[^\S\n]{0,2}\Z", gap):
            first = i - 1
            if first and _BLANK.match(self.gap(first - 1)) and self.unknown(first - 1) and self.alike(first - 1, first) and not self.opened(first):
                first -= 1
            return (first, i) if self.opened(first) and self.clean(first, i) else None
        if _BLANK.match(gap) and _case(self.words[i][0]) == "c" and (_SURNAME.search(self.low[i - 1]) and "а" <= self.low[i][0] <= "я" or _case(self.words[i - 1][0]) == "u"):
            return (i - 1, i) if self.clean(i - 1, i) else None
        return None


# Phrases that introduce a person, as products of heads and tails; what follows is a name in any letter case.
_PHRASES = (
    ("shot filmed photographed edited directed written styled made recorded produced drawn painted designed composed video photo photos photography picture pictures words music art story text", "by"),
    ("thanks|thank you|props|shout out|shoutout|kudos", "to"),
    ("my name is|my name's|i am called|i'm|this is|interview with|happy birthday|congratulations|congrats|credit:|credits:|ph:|camera:|model:|mr.|mrs.|ms.|dr.|prof.|professor", ""),
    ("my", "teacher friend neighbour neighbor brother sister cousin boss coach mentor colleague uncle aunt husband wife son daughter dad mum mom"),
    ("me llamo|mi nombre es|soy|gracias a|entrevista con|entrevista a|entrevista com|sr.|sra.|dra.|senor|senora", ""),
    ("grabado filmado editado rodado dirigido escrito hecho gravado feito foto fotos video texto textos", "por"),
    ("foto fotos video texto textos fotografia riprese testo", "de|di"),
    ("mi", "profesor profesora maestro maestra amigo amiga vecino vecina hermano hermana primo prima tio tia"),
    ("meu nome e|me chamo|chamo-me|obrigado a|obrigada a|obrigado ao|obrigado à", ""),
    ("meu|minha", "professor professora amigo amiga vizinho vizinha irmao irma primo prima"),
    ("je m'appelle|je suis|mon nom est|merci a|interview avec|interview mit|interview con|mme|mme.|monsieur|madame", ""),
    ("filme tourne monte ecrit realise photographie", "par"),
    ("photo photos image video texte", "de|par"),
    ("mon|ma", "prof professeur professeure ami amie voisin voisine frere soeur cousin cousine oncle tante"),
    ("ich heisse|ich heiße|mein name ist|ich bin|dank an|danke an|kamera:|herr|frau", ""),
    ("gefilmt gedreht geschnitten fotografiert geschrieben foto fotos video text bilder", "von"),
    ("mein|meine", "lehrer lehrerin freund freundin nachbar nachbarin bruder schwester cousin cousine onkel tante"),
    ("mi chiamo|il mio nome e|grazie a|grazie ad|grazie mille a|signor|signora", ""),
    ("filmato girato ripreso montato scritto diretto", "da"),
    ("mio|mia", "maestro maestra professore professoressa amico amica vicino vicina fratello sorella cugino cugina zio zia"),
    ("меня зовут|мое имя|снимает|снимал|снимала|снял|сняла|снято|съемка:|фото:|видео:|монтаж:|оператор|оператор:|спасибо", ""),
    ("за", "камерой ударными барабанами гитарой клавишами роялем"),
    ("мой моя моему моей", "учитель учительница учителю учительнице друг другу подруга подруге сосед соседка соседу соседке брат брату сестра сестре"),
)


# Phrases that say what a person did to somebody; in small letters and without accents.
_DEEDS = (
    ("taught told showed gave asked helped sent lent sold invited", "me us"),
    ("me nos", "enseno dijo conto ayudo dio mostro presto"),
    ("me nos", "ensinou disse contou ajudou deu mostrou emprestou"),
    ("m'a|nous a", "appris dit montre aide donne prete raconte"),
    ("hat", "mir uns"),
    ("mi ci", "ha"),
    ("научил научила показал показала рассказал рассказала помог помогла дал дала сказал сказала", "мне меня нам нас"),
)


def _alternatives(text: str) -> list[str]:
    return text.split("|") if "|" in text else text.split(" ") if text else [""]


#: All introducing phrases, in small letters and without accents.
INTRODUCTIONS = tuple(sorted({f"{bare(a)} {bare(b)}".strip() for heads, tails in _PHRASES for a in (heads.split("|") if not tails else _alternatives(heads)) for b in _alternatives(tails)}))

#: All phrases of deeds.
DEEDS = tuple(sorted({f"{a} {b}" for heads, tails in _DEEDS for a in _alternatives(heads) for b in _alternatives(tails)}))

_SIGNS = r"[📷📸🎥📹🎬👤✍🎤🎧©]\ufe0f?\s*:?|(?<!\S)[–—](?=\s)"
_PART = r"[^\W\d_]{2,}(?:['’-][^\W\d_]+)*"
_ANY = rf"(?:[^\W\d_]\.\s?(?:[^\W\d_]\.\s?)?{_PART}|{_PART},\s{_PART}(?:\s[^\W\d_]\.)?|{_PART}\s{_PART},\s{_PART}|{_PART}\s(?:[^\W\d_]\.\s?)?{_PART})"
_AFTER_INTRO = re.compile(rf"[^\S\n]*:?[^\S\n]*({_ANY})")
_AFTER_SIGN = re.compile(rf"(?:{_SIGNS})[^\S\n]*({_ANY})")

_JA = r"(?:[一-龯々ヶ]{2,6}|[一-龯々ヶ]{1,4}[ \u3000・][一-龯々ぁ-ゖァ-ヶー]{1,5}|[一-龯々ヶ]{1,4}[ぁ-ゖァ-ヶー]{2,5}?)"
_JA_NAME = re.compile(
    rf"(?:名前は|氏名は|担当は|(?:撮影|カメラ|編集|写真|動画|ドラム|ギター|ベース|ピアノ|歌|監督|音声|モデル|演奏|出演|協力|提供|先生|友人|講師|司会|作曲|作詞|文)(?:は|：|:))\s?({_JA})(?=さん|くん|君|様|氏|先生|です|でした|といいます|と申します|。|$)"
    rf"|({_JA})(?:さん|様|氏|くん|先生)(?=に|が|の|、|と|は|へ|も|を|ありがとう|。)"
    rf"|(?:📷|📸|🎥|📹|👤|[–—])\s*:?\s*({_JA})(?=さん|[。✨\s]|$)"
    rf"|({_JA})(?=と申します|といいます)"
)
_JA_NOT = re.compile("(?:の隣|隣の人|友だち|友達|みんな|誰|皆|お客|妹|弟|兄|姉|人|屋|先生|店長|社長|監督|選手)$")
_HAS_CJK = re.compile("[一-龯]")
_SIGN_CHARS = re.compile("[📷📸🎥📹🎬👤✍🎤🎧©–—]")


def names(text: str, lexicon: Lexicon = USUAL, introduced: list[int] | tuple = (), deeds: list[int] | tuple = (), small: str | None = None) -> Iterator[tuple[int, int]]:
    """Spans of the names in a text without accents (:func:`bare`); overlapping ones may come. ``introduced``: where introducing phrases end; ``deeds``: where phrases of deeds begin; ``small``: the text in small letters, if known."""
    small = text.lower() if small is None else small
    low, known = _WORD.findall(_TAG.sub(" ", small) if "#" in small else small), lexicon.known

    def strange(m: re.Match | None) -> bool:
        return m is not None and not any(w in known for w in re.split(r"[\s.,]+", m[1].lower()) if len(w) > 1)

    deeds = [at for at in deeds if (w := small[max(0, at - 40) : at].split()) and w[-1] not in known]
    introduced = [at for at in introduced if strange(_AFTER_INTRO.match(text, at))]
    initials = any(len(w) == 1 and f"{w}." in small for w in set(low))
    signs = bool(_SIGN_CHARS.search(text)) and any(map(strange, _AFTER_SIGN.finditer(text)))
    given = not lexicon.given.isdisjoint(low)
    if given or initials or signs or introduced or deeds or (_adjacent(low, known) if lexicon.learned else _SUSPECT.search(text)):
        yield from _found(text, lexicon, initials, introduced, signs, deeds, given)
    if _HAS_CJK.search(text):
        for m in _JA_NAME.finditer(text):
            g = next(i for i in (1, 2, 3, 4) if m.group(i))
            if not _JA_NOT.search(m.group(g)):
                yield m.span(g)


def _adjacent(low: list[str], known: frozenset[str]) -> bool:
    """Two unknown words in a row."""
    strange = [w not in known and len(w) > 2 and w < "\u3040" for w in low]  # Japanese has its own patterns
    return any(map(operator.and_, strange, strange[1:]))


_SUSPECT = re.compile(r"[^\W\d_][,;:(]? [A-ZА-ЯЁ][a-zа-яё]+ [A-ZА-ЯЁ][a-zа-яё-]+")


def _found(text: str, lexicon: Lexicon, initials: bool, introduced: list[int] | tuple, signs: bool, deeds: list[int] | tuple, given: bool) -> Iterator[tuple[int, int]]:
    r = _Reader(text, lexicon)
    at = {s: i for i, (_, s, _) in enumerate(r.words)}
    ends = {e: i for i, (_, _, e) in enumerate(r.words)}
    done = -1
    for i, w in enumerate(r.low) if given else ():
        if i <= done or w not in lexicon.given or w in STOP:
            continue
        got = r.pair(i) or r.turned(i)
        if got:
            done = got[1]
            yield r.words[got[0]][1], r.words[got[1]][2]
    if initials:
        for m in _INITIALS.finditer(text):
            i = ends.get(m.end(2))
            first = at.get(m.start(1))
            if i is None or first is None or not r.unknown(i) or not r.clean(first, i):
                continue
            upper, case = m[1].isupper(), _case(m[2])
            opened = r.opened(first)
            fits = upper and case != "s" and (opened or lexicon.learned) or not upper and case == "s" and opened and len(m[2]) > 3 and (lexicon.learned or r.linked(first))
            if fits and not text[max(0, m.start() - 8) : m.start()].rstrip()[-1:].isdigit():
                yield m.start(), r.words[r.longer(first, i)][2]
        for m in _LAST_INITIAL.finditer(text):
            i = at.get(m.start(1))
            if i is not None and m[2].isupper() and m[1][0].isupper() and r.unknown(i) and r.opened(i) and r.clean(i, i) and (lexicon.learned or r.linked(i)):
                yield m.start(), m.end()
    for end in introduced:
        if m := _AFTER_INTRO.match(text, end):
            yield from _introduced(r, m.start(1), m.end(1), at, ends)
    for start in deeds:
        before = text[max(0, start - 8) : start]
        j = ends.get(start - len(before) + len(before.rstrip()))
        i = None if j is None or not j else j - 1 if len(r.words[j - 1][0]) > 1 else j - 2
        if i is not None and i >= 0 and (r.surname(i) == j or re.match(r",[^\S\n]\Z", r.gap(i))) and r.unknown(i) and r.unknown(j) and r.alike(i, j) and r.opened(i) and r.clean(i, j):
            yield r.words[i][1], r.words[j][2]
    for m in _AFTER_SIGN.finditer(text) if signs else ():
        yield from _introduced(r, m.start(1), m.end(1), at, ends)
    if lexicon.learned:  # both words strange, and a word before them that names persons, or capitals at the start
        for i in range(len(r.words) - 1):
            if i > done and r.low[i] not in lexicon.known and r.low[i + 1] not in lexicon.known and len(r.low[i]) > 1 and r.unknown(i) and (got := r.strange(i)):
                done = got[1]
                yield r.words[i][1], r.words[got[1]][2]
    if r.cased:
        for i in range(1, len(r.words) - 1):
            w, v = r.words[i][0], r.words[i + 1][0]
            if w[0].isupper() and v[0].isupper() and i > done and _BLANK.match(r.gap(i)) and _SURNAME.search(r.low[i + 1]) and _case(w) == _case(v) == "c" and r.unknown(i) and r.unknown(i + 1) and r.clean(i, i + 1):
                if _inside(r, i):
                    yield r.words[i][1], r.words[i + 1][2]


def _inside(r: _Reader, i: int) -> bool:
    """Word ``i`` stands inside a sentence and not after a word for a place."""
    before = r.text[max(0, r.words[i][1] - 8) : r.words[i][1]].rstrip()[-1:]
    return (before.isalnum() or before in ",;:(") and r.low[i - 1] not in _PLACED and not (r.words[i - 1][0][0].isupper() and _BLANK.match(r.gap(i - 1)) and r.low[i - 1] not in STOP)


_PLACED = frozenset("in at near from to of en cerca em perto a de dans chez pres nach bei aus im vicino da di в из около под на до the le la el der die das il".split())


def _introduced(r: _Reader, a: int, b: int, at: dict[int, int], ends: dict[int, int]) -> Iterator[tuple[int, int]]:
    """The name that begins at ``a``, after an introducing phrase or sign: its words must be no function words, no firm's, and unknown where case says nothing."""
    i, j = at.get(a), ends.get(b)
    if i is None or j is None:
        return
    if any(len(w) > 1 and not r.unknown(k) and w not in r.lexicon.given for k, w in enumerate(r.low[i : j + 1], i)) or any(w in STOP for w in r.low[i : j + 1] if len(w) > 1):
        return
    full = [k for k in range(i, j + 1) if len(r.words[k][0]) > 1]
    cases = {_case(r.words[k][0]) for k in full}
    if cases == {"c", "s"} or "s" in cases and not (r.lexicon.learned or _closed(r, j)):
        return
    j = r.longer(i, j) if len(full) == 2 and cases != {"s"} else j
    if r.clean(i, j):
        yield a, r.words[j][2]


def _closed(r: _Reader, j: int) -> bool:
    """After word ``j`` the phrase ends, or a function word goes on."""
    rest = r.text[r.words[j][2] : r.words[j][2] + 40]
    return not rest.strip() or not rest.lstrip()[0].isalnum() or j + 1 < len(r.words) and r.low[j + 1] in STOP
