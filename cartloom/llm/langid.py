"""Missing or wrong document language labels.

Method: rank-order profiles. A language's profile is the list of its most frequent character n-grams in rank order; the
n-grams of a sentence are ranked the same way, and the language whose profile has the smallest out-of-place distance (sum
of rank differences, absent n-grams counting as last) is the sentence's. Profiles are trained here, on a bounded sample of
labelled documents (SAMPLE per language, by the order of a hash), in two passes: the second leaves out the sentences that
the first assigns to another language than the label's. Numbers are no evidence, nor are names: capitalised words that the
sample never has in lower case and that no language has for its own (`own_capitals`). All sentences of a batch of texts
are judged at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.llm.overlap import FOLDS

#: The languages, with their two- and three-letter codes and English names.
LANGUAGES = {
    "en": ("en", "eng", "english"),
    "pt": ("pt", "por", "portuguese"),
    "es": ("es", "spa", "spanish"),
    "fr": ("fr", "fra", "fre", "french"),
    "de": ("de", "deu", "ger", "german"),
    "ar": ("ar", "ara", "arabic"),
}
UNKNOWN = "und"
#: Labelled documents used to train each language's profile, and the longest used (only for training).
SAMPLE, LONGEST = 600, 4000
PROFILE, LENGTHS = 4000, (1, 2, 3, 4)
#: A sentence is in another language than the rest of its text only if it is nearer to it by this share, and by so many letters' worth more the shorter it is.
MARGIN, SHORT = 0.04, 20
#: A capitalised word is a language's own if so many of its sample documents have it, and this share of all that do are of the language.
OWN_DOCS, OWN_SHARE = 3, 0.75
#: Texts judged at once, and n-grams sorted at once (memory only).
TEXTS, GRAMS = 256, 1 << 21

_END = re.compile(r"<[^<>]*>|(?<=[.!?…؟])[\"'”»“«)\]]*\s+|\n\s*\n|(?<=[.!?…؟])[\"”»“«]+|[“«”»]|(?<=\s)\"|\"(?=\s|$)")
_DIGIT = re.compile(r"\d")
_LETTERS = re.compile(r"[^\W\d_]+")
#: What stands between two blanks and has no digit.
_TOKEN_OR_END = re.compile(r"(?<!\S)[^\s\d]++(?!\S)|\x1e")


def label_language(col: Column | str) -> Column:
    """The language a label names, in any spelling (case, region, three letters, English name); `und`; null for anything else."""
    col = F.col(col) if isinstance(col, str) else col
    head = F.element_at(F.split(F.lower(F.trim(col)), "[-_ ]"), 1)
    out = F.when(head == UNKNOWN, UNKNOWN)
    for language, names in LANGUAGES.items():
        out = out.when(head.isin(*names), language)
    return out


@lru_cache(maxsize=100_000)
def token_words(token: str) -> list[tuple[str, bool]]:
    """(word, capitalised) of what stands between two blanks: folded words, without accents, marks, stretch signs and invisible characters; none if it has a digit."""
    if _DIGIT.search(token):
        return []
    parts = _LETTERS.findall(token if token.isascii() else token.translate(FOLDS))
    return [(p.casefold(), len(p) > 1 and p[0].isupper() and p[1:].islower()) for p in parts]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in order; tags, empty lines and quotation marks also part sentences."""
    if not text:
        return []
    out, at = [], 0
    for mark in _END.finditer(text):
        start, end = mark.span()
        if start > at and not text[at:start].isspace():
            out.append((at, start))
        at = end
    if at < len(text) and not text[at:].isspace():
        out.append((at, len(text)))
    return out


def grams(word: str) -> Iterator[str]:
    """The n-grams of a word with a blank before and after it."""
    padded = f" {word} "
    return (padded[i : i + n] for n in LENGTHS for i in range(len(padded) - n + 1) if not (n == 1 and padded[i] == " "))


def profile(words: Counter) -> list[str]:
    """The most frequent n-grams of counted words, in order."""
    counts: Counter = Counter()
    for word, n in words.items():
        for g in grams(word):
            counts[g] += n
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]]


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number, different): all texts' tokens in a row, as the text's place and the token's number among the different ones."""
    found = _TOKEN_OR_END.findall("\x1e".join(t.replace("\x1e", " ") for t in texts))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=object)
    numbers, different = pd.factorize(np.array(found, dtype=object))
    is_end = (different == "\x1e")[numbers]
    return np.cumsum(is_end)[~is_end], numbers[~is_end], different


def _ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lengths[i] - 1 of all i in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Model:
    """Profiles of the languages, the capitalised words that are no names, and the distances of sentences to the profiles."""

    def __init__(self, profiles: dict[str, list[str]], capitals: frozenset[str] = frozenset()):
        self.languages, self.profiles, self.capitals = sorted(profiles), profiles, capitals
        names = sorted({g for p in profiles.values() for g in p})
        self.index = {g: i for i, g in enumerate(names)}
        self.ranks = np.full((len(names), len(self.languages)), PROFILE, dtype=np.float32)
        for k, language in enumerate(self.languages):
            for rank, g in enumerate(profiles[language]):
                self.ranks[self.index[g], k] = rank
        self.known: dict[str, tuple[np.ndarray, int, int]] = {}

    def _token(self, token: str) -> tuple[np.ndarray, int, int]:
        """(indexes of its n-grams that are in a profile, number of its others, letters)."""
        found = self.known.get(token)
        if found is None:
            words = [w for w, capital in token_words(token) if not capital or w in self.capitals]
            every = np.array([self.index.get(g, -1) for w in words for g in grams(w)], dtype=np.int64)
            at = every[every >= 0]
            found = (at, len(every) - len(at), sum(map(len, words)))
            if len(self.known) > 200_000:
                self.known.clear()
            if len(token) <= 64:
                self.known[token] = found
        return found

    def distances(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(distances, letters): a row per sentence with its distance to each language, and how many letters speak for one; 0 where no
        n-gram is in any profile.
        """
        n, bits = len(sentences), max(len(self.index), 1).bit_length()
        of, number, different = _tokens(sentences)
        info = [self._token(t) for t in different]
        sizes = np.array([len(x[0]) for x in info], dtype=np.int64)
        every, starts = np.concatenate([x[0] for x in info] or [np.empty(0, dtype=np.int64)]), np.cumsum(sizes) - sizes
        others, letters = (np.bincount(of, weights=np.array([x[i] for x in info], dtype=float)[number], minlength=n) for i in (1, 2)) if len(of) else (np.zeros(n), np.zeros(n))
        total = np.cumsum(sizes[number])
        keys, counts = [], []
        for part in np.split(np.arange(len(number)), np.searchsorted(total, np.arange(GRAMS, total[-1] if len(total) else 0, GRAMS))):
            at = _ragged(sizes[number[part]], starts[number[part]])
            key = np.sort((np.repeat(of[part], sizes[number[part]]) << bits) | every[at])
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            keys.append(key[first])
            counts.append(np.diff(np.r_[first, len(key)]))
        key, count = np.concatenate(keys), np.concatenate(counts)
        if len(keys) > 1:
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            key, count = key[order][first], np.add.reduceat(count[order], first)
        out = np.full((n, len(self.languages)), float(PROFILE))
        if not len(key):
            return out, np.zeros(n)
        # rows of (sentence, -count, n-gram) in order: tied n-grams share the rank in the middle of their tie
        most, wide = int(count.max()), int(count.max()).bit_length()
        row = np.sort(((key >> bits) << (wide + bits)) | ((most - count) << bits) | (key & ((1 << bits) - 1)))
        tie, sentence, gram = row >> bits, row >> (wide + bits), row & ((1 << bits) - 1)
        ties = np.flatnonzero(np.r_[True, tie[1:] != tie[:-1]])
        begin = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
        length = np.diff(np.r_[ties, len(row)])
        before = ties - begin[np.searchsorted(begin, ties, side="right") - 1]
        place = np.repeat((before + (length - 1) / 2).astype(np.float32), length)
        gaps = np.take(self.ranks, gram, axis=0)
        gaps -= place[:, None]
        apart = np.add.reduceat(np.abs(gaps, out=gaps), begin, axis=0)
        have = sentence[begin]
        seen = np.diff(np.r_[begin, len(row)])
        out[have] = (apart + others[have, None] * float(PROFILE)) / (seen + others[have])[:, None]
        known = np.zeros(n, dtype=bool)
        known[have] = True
        return out, np.where(known, letters, 0)

    def segments(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """Of each text (start, end, language, confidence): neighbouring sentences of one language are one segment.

        confidence is how much farther the second profile is than the first, in parts. A model without profiles can tell no
        language: all is `und` with confidence 0. A sentence without evidence goes with the one before; a text without any is `und`.
        """
        if not self.languages:
            return [[(0, len(t or ""), UNKNOWN, 0.0)] for t in texts]
        spans = [sentences(t) for t in texts]
        n = np.array([len(ss) for ss in spans], dtype=np.int64)
        of, ends = np.repeat(np.arange(len(texts)), n), np.cumsum(n)
        distances, letters = self.distances([t[a:b] for t, ss in zip(texts, spans) for a, b in ss])
        weights = np.bincount(of * len(self.languages) + distances.argmin(axis=1), weights=letters, minlength=len(texts) * len(self.languages)).reshape(len(texts), -1)
        main, told = weights.argmax(axis=1), weights.sum(axis=1) > 0
        chosen, confidence = self._chosen(distances, letters, main[of])
        # a sentence without evidence goes with the last before it that has some, at the text's beginning with the first after
        place = np.arange(len(of))
        last = np.maximum.accumulate(np.where(letters > 0, place, -1)) if len(of) else place
        after = np.minimum.accumulate(np.where(letters > 0, place, len(of))[::-1])[::-1] if len(of) else place
        chosen = chosen[np.where(last >= (ends - n)[of], last, np.minimum(after, len(of) - 1))] if len(of) else chosen
        first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (chosen[1:] != chosen[:-1])][: len(of)])
        weight = np.maximum(letters, 1)
        sure = np.add.reduceat(confidence * weight, first) / np.add.reduceat(weight, first) if len(of) else confidence
        bounds = [x for ss in spans for x in ss]
        out: list[list] = [[] for _ in texts]
        for a, b, c in zip(first.tolist(), [*first[1:].tolist(), len(of)], sure.tolist()):
            if told[of[a]]:
                out[of[a]].append((bounds[a][0], bounds[b - 1][1], self.languages[chosen[a]], c))
        return [x or [(0, len(t or ""), UNKNOWN, 1.0)] for x, t in zip(out, texts)]

    def _chosen(self, distances: np.ndarray, letters: np.ndarray, main: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, confidence) of each sentence in a text that is mainly in `main`; no confidence where the text decides."""
        best = distances.argmin(axis=1)
        low = distances.min(axis=1)
        second = np.sort(distances, axis=1)[:, 1] if len(self.languages) > 1 else np.full(len(distances), np.inf)
        margin = np.where(np.isinf(second), 1.0, (second - low) / np.maximum(second, 1e-9))
        away = distances[np.arange(len(distances)), main]
        near = (best != main) & ((away - low) / np.maximum(away, 1e-9) < MARGIN * (1 + SHORT / np.maximum(letters, 1)))
        return np.where(near, main, best), np.where(near | (letters == 0), 0.0, margin)


def own_capitals(labelled: list[tuple[str, str]]) -> frozenset[str]:
    """The words that are evidence though capitalised: those that the texts also have in lower case, and those that OWN_DOCS texts of
    one language have, with OWN_SHARE of all texts that have them. Names are the rest: new, rare or alike in several languages.
    """
    lower: Counter = Counter()
    upper: dict[str, Counter] = {}
    for language, text in labelled:
        words = {w for t in set(text.split()) for w in token_words(t)}
        lower.update(w for w, capital in words if not capital)
        for w, capital in words:
            if capital:
                upper.setdefault(w, Counter())[language] += 1
    own = {w for w, c in upper.items() if max(c.values()) >= max(OWN_DOCS, OWN_SHARE * sum(c.values()))}
    return frozenset(own | {w for w in upper if lower[w] >= 2})


def train(labelled: list[tuple[str, str]]) -> Model:
    """labelled: (language, text). Without any text the model has no profiles."""
    capitals = own_capitals(labelled)
    parts = [(language, text[s:e]) for language, text in labelled for s, e in sentences(text)]
    of, number, different = _tokens([t for _, t in parts])
    words = [[w for w, capital in token_words(t) if not capital or w in capitals] for t in different]
    languages = sorted({language for language, _ in labelled})
    label = np.array([languages.index(language) for language, _ in parts], dtype=np.int64)
    keep = np.ones(len(parts), dtype=bool)
    for last in (False, True):
        used = keep[of]
        counts = np.bincount(number[used] * len(languages) + label[of[used]], minlength=len(different) * len(languages)).reshape(-1, max(len(languages), 1))
        tallies: dict[str, Counter] = {}
        for k, language in enumerate(languages):
            for i in np.flatnonzero(counts[:, k]):
                for w in words[i]:
                    tallies.setdefault(language, Counter())[w] += int(counts[i, k])
        model = Model({language: profile(tally) for language, tally in tallies.items()}, capitals)
        if last or not tallies:
            return model
        distances, letters = model.distances([t for _, t in parts])
        keep = (np.array([languages.index(x) for x in model.languages])[distances.argmin(axis=1)] == label) & (letters > 0)


def training_sample(docs: DataFrame, per_language: int = SAMPLE) -> list[tuple[str, str]]:
    """At most per_language x languages labelled documents of at most LONGEST characters."""
    rows = docs.select(label_language("lang").alias("language"), "text", F.xxhash64("doc_id").alias("h")).where(F.col("language").isin(*LANGUAGES) & (F.length("text") <= LONGEST))
    order = Window.partitionBy("language").orderBy("h")
    return [(r[0], r[1]) for r in rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("language", "text").collect()]


def language_segments(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, segment, start, end, lang, confidence, n_langs): docs has doc_id, text, lang.

    start and end are character positions. Null and empty texts and texts without words have one segment `und`; without a labelled
    document to learn from all have.
    """
    model = model or train(training_sample(docs))
    shared = docs.sparkSession.sparkContext.broadcast((model.profiles, model.capitals))  # PROFILE n-grams per language, the words of the sample

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for pdf in batches:
            for at in range(0, len(pdf), TEXTS):
                part = pdf.iloc[at : at + TEXTS]
                rows = []
                for doc, segments in zip(part["doc_id"], own.segments(part["text"].tolist())):
                    n = len({x[2] for x in segments})
                    rows += [(doc, i, *x, n) for i, x in enumerate(segments)]
                yield pd.DataFrame(rows, columns=["doc_id", "segment", "start", "end", "lang", "confidence", "n_langs"])

    return docs.select("doc_id", "text").mapInPandas(judge, "doc_id bigint, segment int, start int, end int, lang string, confidence double, n_langs int")


def document_languages(segments: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, share, n_langs): a row per language a document holds; share of its characters."""
    per = segments.groupBy("doc_id", "lang").agg(F.sum(F.col("end") - F.col("start")).alias("chars"), F.sum(F.col("confidence") * (F.col("end") - F.col("start"))).alias("c"), F.max("n_langs").alias("n_langs"))
    whole = Window.partitionBy("doc_id")
    return per.select("doc_id", "lang", F.coalesce(F.try_divide("c", "chars"), F.lit(1.0)).alias("confidence"), F.coalesce(F.try_divide(F.col("chars").cast("double"), F.sum("chars").over(whole)), F.lit(1.0)).alias("share"), "n_langs")


def mislabelled(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, lang): a row per language held by each document that holds several or whose label does not name its one."""
    held = segments.groupBy("doc_id", "lang").agg(F.max("n_langs").alias("n"))
    labels = docs.select("doc_id", label_language("lang").alias("label"))
    return held.join(labels, "doc_id").where((F.col("n") > 1) | ~F.col("lang").eqNullSafe(F.col("label"))).select("doc_id", "lang")
