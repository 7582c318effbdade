"""Missing or wrong document language labels (problem 6).

A sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader and elastic-net penalties and calibrated with a temperature. The
document frequencies cover all texts; the model is fitted on a bounded sample of labelled texts,
its labels being as noisy as they come; every text is then cut into sentences, each sentence is
classified, and a text's languages are those of its sentences.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skeleton import skeleton

#: Hashed feature space and n-gram orders.
BITS, ORDERS = 16, (1, 2, 3, 4)

#: Bound of the training sample: so many labelled texts, chosen by a hash of the id, and at most so many of their sentences.
SAMPLE_TEXTS, SAMPLE_SENTENCES = 8000, 16000

#: Sentences of each language in the second fit; rarer languages repeat theirs up to four times.
PER_LANGUAGE = 1500

#: Confidence that a sentence needs to count, and one in a language other than most of its text.
LEAST, LEAST_OTHER = 0.4, 0.95

# Codes and names of the languages to tell apart.
LANGUAGES = {
    "en": ("en", "eng", "english", "inglés", "anglais", "englisch", "inglese", "inglês"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "castilian", "espagnol", "spanisch", "spagnolo", "espanhol"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugais", "portugiesisch", "portoghese", "portugués"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "francés", "französisch", "francese", "francês"),
    "de": ("de", "deu", "ger", "german", "deutsch", "alemán", "allemand", "tedesco", "alemão"),
    "it": ("it", "ita", "italian", "italiano", "italien", "italienisch"),
    "ru": ("ru", "rus", "russian", "русский", "russkij", "russkiy", "ruso", "russe", "russisch", "russo"),
    "ja": ("ja", "jpn", "jp", "japanese", "日本語", "nihongo", "japonés", "japonais", "japanisch", "giapponese", "japonês"),
}

# Names of further languages, and values that name none.
OTHER_NAMES = (
    "dutch nederlands swedish svenska danish dansk norwegian norsk finnish suomi polish polski czech čeština slovak hungarian magyar romanian română bulgarian български greek ελληνικά "
    "turkish türkçe ukrainian українська arabic العربية hebrew עברית hindi हिन\u094dदी bengali korean 한국어 chinese 中文 mandarin vietnamese thai indonesian malay catalan català galician galego basque euskara latin esperanto persian farsi tagalog croatian serbian"
).split()
NO_LANGUAGE = "xx xxx un und unk unknown na n/a nan none null nil no-language zxx mis mul zz zzz ? ?? - -- other other? misc empty missing tbd todo test default auto undefined".split()


def label_code(label: Column) -> Column:
    """Two-letter code of a declared language; null where the label names none. Languages outside the model keep a code or name of their own."""
    text = F.lower(F.btrim(label, F.lit(" \t\r\n\u00a0\u3000")))
    base = F.regexp_replace(F.regexp_replace(text, r"\(.*\)$", ""), r"[-_][a-z0-9]{2,8}([-_.@].*)?$", "")
    base = F.trim(base)
    named = lambda c: F.coalesce(*(F.when(c.isin(*names), code) for code, names in LANGUAGES.items()))  # noqa: E731  sets, looked up by hash
    return F.coalesce(
        named(text),  # most labels need no pattern
        F.when(text.isNull() | (text == "") | text.isin(*NO_LANGUAGE) | base.isin(*NO_LANGUAGE), None).otherwise(F.coalesce(named(base), F.when(base.isin(*OTHER_NAMES) | base.rlike("^[a-z]{2,3}$"), base))),
    )


# Texts into sentences

_ADDRESS = re.compile(r"https?://\S+|www\.\S+|[\w.+-]+\s*@\s*[\w-]+(?:\.[\w-]+)+")
_DISGUISED = re.compile(r"[\w.+-]+\s*(?:[(\[]\s*at\s*[)\]]|\sAT\s)\s*[\w-]+(?:(?:\.|\s*[(\[]\s*dot\s*[)\]]\s*|\sDOT\s)[\w-]+)*", re.I)
_TAG = re.compile(r"(?<!\w)[#@]\w[\w.]*")
_DIGITS = re.compile(r"[^\W\d]*\d[\w:./,×-]*")
_ANY_DIGIT = re.compile(r"\d")
_END = re.compile(r"(?<=[.!?…])[\s]+|(?<=[。！？])|\n+|\s[/|·•–—]\s|[^\w\s.,;:!?…'’‘\"“”«»()&%/+*=°§$€£¿¡、。「」・ー〜！？（）,-]+")
_WORD = re.compile(r"[^\W\d_]{2,}")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿]")


def _blank(m: re.Match) -> str:
    return " " * len(m.group())


def sentences(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, cleaned)`` of the sentences of a text; positions are those of the original text.

    Addresses, handles, hashtags, emoji and anything with digits are blanked out first. What is left
    between two boundaries is a sentence if it has at least three words, not all of them capitalised names,
    or five ideographs or kana.
    """
    out, last = [], 0
    blanked = text
    if "@" in text or "://" in text or "www." in text:
        blanked = _ADDRESS.sub(_blank, blanked)
    if " AT " in text or "at)" in text or "at]" in text:
        blanked = _DISGUISED.sub(lambda m: _blank(m) if m.group().count("(") or m.group().count("[") or " AT " in m.group() else m.group(), blanked)
    if "#" in text or "@" in text:
        blanked = _TAG.sub(_blank, blanked)
    if _ANY_DIGIT.search(blanked):
        blanked = _DIGITS.sub(_blank, blanked)
    for m in _END.finditer(blanked + "\n"):
        start, end, last = last, m.start(), m.end()
        part = blanked[start:end]
        words = _WORD.findall(part)
        cjk = len(_CJK.findall(part))
        if cjk < 5 and (len(words) < 3 or (len(words) <= 4 and all(w[0].isupper() for w in words) and not part.isupper())):
            continue
        out.append((start, min(end, len(text)), f" {' '.join(part.lower().split())} "))
    return out


def normal(text: str) -> str:
    """The text without look-alike letters and invisible characters; lengths may change, so positions refer to this form.

    Text in capitals is lowered first, as capitals and small letters have different look-alikes.
    """
    if text.isupper():
        text = text.lower()
    return _composed(skeleton(text) or "")


_MARKS = re.compile(f"[{''.join(chr(c) for c in range(0x300, 0x10000) if unicodedata.combining(chr(c)))}]+")


def _composed(text: str) -> str:
    """Accents composed with their letters; those that no letter can take are left out, as they would cut words."""
    text = unicodedata.normalize("NFC", text)
    return text if text.isascii() else _MARKS.sub("", text)



def aligned(text: str) -> tuple[str, list[int]]:
    """The normal form with, for each of its characters and its end, the place in ``text`` it came from.

    Letters are folded together with the accents and invisible characters that follow them, which is what makes up a character of the normal form.
    """
    low = text.lower() if text.isupper() and len(text.lower()) == len(text) else text
    if text.isascii():
        return low, list(range(len(text) + 1))
    out, at, i, n = [], [], 0, len(text)
    while i < n:
        j = i + 1
        while j < n and (unicodedata.combining(low[j]) or unicodedata.category(low[j]) in ("Mn", "Cf", "Me")):
            j += 1
        piece = low[i:j]
        piece = piece if j == i + 1 and piece.isascii() else _composed(skeleton(f"{piece}|")[:-1]) if piece != "\r" else "\n"
        out.append(piece)
        at += [i] * len(piece)
        i = j
    return "".join(out), [*at, n]


# Features


def grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams of all texts, for each order: ``owner`` (ascending index of the text) and ``feature`` of each occurrence."""
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.cumsum(codes == 10) - (codes == 10)
    inside = codes != 10
    h = np.zeros(len(codes), np.uint64)
    out = []
    ok = np.ones(len(codes), bool)
    for n in range(1, max(ORDERS) + 1):
        k = len(codes) - n + 1
        if k <= 0:
            break
        h = (h[:k] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F))
        h = h ^ (h >> np.uint64(29))
        ok = ok[:k] & inside[n - 1 :]
        if n in ORDERS:
            at = np.flatnonzero(ok)
            out.append((owner[at], ((h[at] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)))
    return out


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, over all texts, and the number of texts. What reaches the driver is one count per feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        last, number = np.zeros(1 << BITS, np.int32), np.arange(4096, dtype=np.int32)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            n += len(texts)
            for at in range(0, len(texts), 64):
                part = [" " + " ".join(normal(t).lower().split()) + " " for t in texts[at : at + 64]]
                orders = [(f, np.searchsorted(o, np.arange(len(part) + 1)).tolist()) for o, f in grams(part)]
                for i in range(len(part)):
                    f = np.concatenate([x[ends[i] : ends[i + 1]] for x, ends in orders])
                    if len(f) > len(number):
                        number = np.arange(2 * len(f), dtype=np.int32)
                    last[f] = number[: len(f)]
                    total[f[last[f] == number[: len(f)]]] += 1  # each feature once for each text
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["feature", "n"])

    got = df.select(text).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = got.column("feature").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(1 << BITS, np.int64)
    out[feature[feature >= 0]] = n[feature >= 0]
    return out, int(n[feature < 0].sum())


@dataclass
class Model:
    """Weights (feature x language) with the inverse document frequencies multiplied in, biases and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(self.languages)))
        norm, total = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for o, f in grams(texts):
            starts = np.searchsorted(o, np.arange(len(texts) + 1))
            there = np.flatnonzero(starts[1:] > starts[:-1])
            if len(there):
                norm[there] += np.add.reduceat(self.idf[f] ** 2, starts[there])
                total[there] += np.add.reduceat(self.weights[f], starts[there], axis=0)
        return total / np.sqrt(np.maximum(norm, 1e-9))[:, None] + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        parts = [softmax(self.scores(texts[i : i + 1000]) / self.temperature) for i in range(0, len(texts), 1000)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], df: np.ndarray, n_docs: int, alpha: float = 1.0, beta: float = 0.5, l1: float = 0.01, l2: float = 0.01, epochs: int = 1, seed: int = 7) -> Model:
    """Follow-the-regularised-leader (proximal) with elastic-net penalties; one tenth of the texts is held out for the temperature."""
    languages = sorted(set(labels))
    target = np.array([languages.index(x) for x in labels])
    idf = (np.log((1.0 + n_docs) / (1.0 + df)) + 1.0).astype(np.float32)
    k = len(languages)
    z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    zb, nb = np.zeros(k), np.zeros(k)
    order = np.random.default_rng(seed).permutation(len(texts))
    held, fit = order[: len(order) // 10], order[len(order) // 10 :]

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    vectors: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(texts), 500):  # a few at a time: what is kept is one short vector per text
        some = texts[at : at + 500]
        parts = grams(some)
        o, f = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        f = f[np.argsort(o, kind="stable")]
        ends = np.cumsum(np.bincount(o, minlength=len(some)))
        for i, end in enumerate(ends.tolist()):
            feature, count = np.unique(f[(ends[i - 1] if i else 0) : end], return_counts=True)
            x = count * idf[feature]
            vectors.append((feature.astype(np.int32), (x / max(float(np.linalg.norm(x)), 1e-9)).astype(np.float32)[:, None]))
    for _ in range(epochs):
        for i in fit.tolist():
            feature, x = vectors[i]
            if not len(feature):
                continue
            zf, nf = z[feature], n[feature]
            root = np.sqrt(nf)
            w = (np.sign(zf) * l1 - zf) / ((beta + root) / alpha + l2) * (np.abs(zf) > l1)
            b = weights(zb, nb)
            g = softmax((x * w).sum(axis=0) + b)
            g[target[i]] -= 1.0
            gx = x * g
            nf = nf + gx * gx
            z[feature] = zf + gx - (np.sqrt(nf) - root) / alpha * w
            n[feature] = nf
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b
            nb += g * g
    model = Model(languages, idf, (weights(z, n) * idf[:, None]).astype(np.float32), weights(zb, nb))
    if len(held):
        s, t = model.scores([texts[i] for i in held]), target[held]
        grid = np.geomspace(0.1, 5.0, 60)
        nll = [-np.log(np.maximum(softmax(s / c)[np.arange(len(t)), t], 1e-12)).mean() for c in grid]
        model.temperature = float(grid[int(np.argmin(nll))])
    return model


def fit(captions: DataFrame, labels: DataFrame, sample: int = SAMPLE_TEXTS) -> Model:
    """A model from ``id, text`` and ``id, label``: frequencies over all texts, weights from at most ``sample`` labelled texts.

    Declared languages are partly wrong, so the model is fitted twice: the second time without the
    sentences that the first one, which sees the labels' majority, assigns to another language. Texts with several
    declared languages are not used for fitting.
    """
    frequencies, n_docs = document_frequencies(captions, "text")
    coded = labels.select("id", label_code(F.col("label")).alias("code")).where(F.col("code").isin(*LANGUAGES)).groupBy("id").agg(F.min("code").alias("code"), F.max("code").alias("hi")).where("code = hi")
    chosen = coded.select("id", "code").orderBy(F.xxhash64("id", F.lit(11)), "id").limit(sample)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, c, n, s) for i, t, c in zip(*(x.to_pylist() for x in batch.columns), strict=True) for n, (_, _, s) in enumerate(sentences(normal(t)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.string())], ["id", "code", "n", "sentence"])

    whole = captions.where(F.length(F.trim("text")) > 0).join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("text").alias("text"), F.first("code").alias("code"))
    # Texts are cut where they are; the driver sees sentences, and no more than the bound.
    rows = whole.mapInArrow(cut, "id string, code string, n int, sentence string").orderBy(F.xxhash64("id"), "id", "n").limit(SAMPLE_SENTENCES).collect()
    texts, codes = [r.sentence for r in rows], [r.code for r in rows]
    if len(set(codes)) < 2:
        raise ValueError("fewer than two languages are labelled")
    first = train(texts, codes, frequencies, n_docs)
    said = first.probabilities(texts).argmax(axis=1)
    kept = [i for i, k in enumerate(said) if first.languages[k] == codes[i]]
    if len({codes[i] for i in kept}) < len(set(codes)):
        return first
    balanced: list[int] = []
    for code in sorted(set(codes)):
        own = [i for i in kept if codes[i] == code][:PER_LANGUAGE]
        balanced += (own * min(4, -(-PER_LANGUAGE // len(own))))[:PER_LANGUAGE]
    return train([texts[i] for i in balanced], [codes[i] for i in balanced], frequencies, n_docs, epochs=2)


SEGMENT = "id string, segment int, start int, end int, lang string, confidence double"


def segments(captions: DataFrame, model: Model, least: float = LEAST, positions: bool = True) -> DataFrame:
    """``id, segment, start, end, lang, confidence`` of every sentence of every text; ``text[start:end]`` is the sentence as it was written.

    ``lang`` is null where the confidence is below ``least``. A text without a sentence (blank, only tags, emoji or numbers) has
    one row with null segment and language and confidence 0; null texts have none. Without ``positions`` start and end
    are those in the normal form, which is cheaper to make.
    """
    shared = captions.sparkSession.sparkContext.broadcast(model)  # bounded: features x languages

    def cut(text: str) -> list[tuple[int, int, str]]:
        if not positions:
            return sentences(normal(text))
        form, at = aligned(text)
        return [(at[a], at[b], s) for a, b, s in sentences(form)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 256):
                rows = []
                for i, t in zip(ids[at : at + 256], texts[at : at + 256], strict=True):
                    if t is not None:
                        found = cut(t) if t else []
                        rows += [(i, n, *s) for n, s in enumerate(found)] if found else [(i, None, None, None, None)]
                some = [k for k, r in enumerate(rows) if r[4] is not None]
                lang: list[str | None] = [None] * len(rows)
                conf = np.zeros(len(rows))
                p = m.probabilities([rows[k][4] for k in some])
                for k, b, c in zip(some, p.argmax(axis=1) if some else (), p.max(axis=1) if some else (), strict=True):
                    lang[k], conf[k] = m.languages[b] if c >= least else None, c
                columns = [pa.array([r[j] for r in rows], pa.string() if j == 0 else pa.int32()) for j in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(conf, pa.float64())], ["id", "segment", "start", "end", "lang", "confidence"])

    return captions.select("id", "text").mapInArrow(run, SEGMENT)


def text_languages(segs: DataFrame, least_other: float = LEAST_OTHER) -> DataFrame:
    """``id, lang, confidence, share``: the languages of each text, weighted by the length of its sentences.

    A language other than the text's main one counts if one of its sentences reaches ``least_other``. A text of which no
    sentence has a language has one row with null language, its sentences' confidence (0 without any) and share 0.
    """
    length = F.coalesce(F.col("end") - F.col("start"), F.lit(0))
    per = segs.groupBy("id", "lang").agg(F.sum(length * F.col("confidence")).alias("mass"), F.sum(length).alias("chars"), F.max("confidence").alias("best"))
    w = Window.partitionBy("id")  # at most one row per language
    known = F.col("lang").isNotNull()
    ranked = per.withColumn("total", F.sum(F.when(known, F.col("chars")).otherwise(0)).over(w)).withColumn("rk", F.row_number().over(w.orderBy(known.desc(), F.desc("mass"), "lang")))
    share = F.when(known & (F.col("total") > 0), F.col("chars") / F.nullif(F.col("total"), F.lit(0))).otherwise(F.lit(0.0))
    confidence = F.coalesce(F.col("mass") / F.nullif(F.col("chars"), F.lit(0)), F.lit(0.0))
    return ranked.where((F.col("rk") == 1) | known & (F.col("best") >= least_other)).select("id", "lang", confidence.alias("confidence"), share.alias("share"))


def mislabelled(languages: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, lang`` of the texts without a declared language, with a wrong one or with several languages; ``labels`` has ``id, label``.

    Null, blank and meaningless labels declare nothing. Repeated rows count once.
    """
    declared = labels.select("id", label_code(F.col("label")).alias("code")).where("code IS NOT NULL").groupBy("id").agg(F.collect_set("code").alias("declared"))
    written = languages.where("lang IS NOT NULL").groupBy("id").agg(F.collect_set("lang").alias("written"))  # both sets are bounded by the number of languages
    joined = written.join(declared, "id", "left")
    wrong = F.col("declared").isNull() | (F.size("written") > 1) | (F.size(F.array_except("declared", "written")) > 0)
    return joined.where(wrong).select("id", F.explode("written").alias("lang")).distinct()
