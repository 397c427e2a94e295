"""Language identification by words first, character n-grams for words never seen.

A known word adds its log frequency in each language. An unseen word falls back to its longest known
character n-grams: four characters, then three, two, one. The model holds every word and n-gram of a
bounded sample of labelled rows, each with the languages it occurs in only, in flat arrays that are
searched by 64-bit hashes. Prediction is one narrow pass with the model broadcast; its size is bounded by
the sample, whatever the input and however many languages there are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words are runs of letters, lower-cased.
_LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Bounds of the labelled sample: documents and characters of a language, and of all languages together.
SAMPLE, CHARACTERS, SAMPLE_ALL, CHARACTERS_ALL = 3000, 6_000_000, 60_000, 120_000_000
ORDER = 4
#: Words remembered by a worker, texts and words scored at a time: memory bounds that change no result.
REMEMBERED, TEXTS, WORDS = 200_000, 512, 100_000


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 3 is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _is_word(found: str) -> bool:
    """What the pattern finds besides letters (signs like a half) is no word."""
    return found.isalpha() or any(map(str.isalpha, found))


def _words(text: str) -> Counter:
    found = Counter(_LETTERS.findall(text.lower()))
    for word in [w for w in found if not _is_word(w)]:
        del found[word]
    return found


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


def _key(kind: int, gram: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}{gram}".encode("utf-8", "surrogatepass"))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


@dataclass
class Model:
    """Entry i says that the gram of row r, starts[r] <= i < starts[r + 1], occurs in language[i]; gain[i] is
    its log frequency there above that of a gram that the language doesn't have, floors[kind, language]."""

    languages: list[str]
    keys: np.ndarray
    starts: np.ndarray
    language: np.ndarray
    gain: np.ndarray
    floors: np.ndarray

    def _rows(self, kind: int, wanted: list[str]) -> np.ndarray:
        """Rows of grams, -1 for those the model doesn't know."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        hashes = np.fromiter((_key(kind, w) for w in wanted), np.uint64, len(wanted))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def _vectors(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(kind of each word's floor, or -1; entries' starts; languages; gains) of distinct words."""
        found = self._rows(0, words)
        kinds = np.where(found >= 0, 0, -1)
        known = np.flatnonzero(found >= 0)
        parts = [(known, found[known], np.ones(len(known)))]  # word, row, weight
        unseen = np.flatnonzero(found < 0)
        for n in range(ORDER, 0, -1):
            pieces = [grams(words[w], n) for w in unseen]
            owner = np.repeat(unseen, [len(p) for p in pieces])
            rows = self._rows(n, [g for p in pieces for g in p])
            owner, rows = owner[rows >= 0], rows[rows >= 0]
            count = np.bincount(owner, minlength=len(words))
            kinds[count > 0] = n
            parts.append((owner, rows, 1.0 / count[owner]))
            unseen = unseen[count[unseen] == 0]
        word, row, weight = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(word, kind="stable")
        word, row, weight = word[order], row[order], weight[order]
        lengths = self.starts[row + 1] - self.starts[row]
        entries = _ranges(self.starts[row], lengths)
        sizes = np.bincount(word, lengths, minlength=len(words)).astype(np.int64)
        return kinds, np.concatenate([[0], np.cumsum(sizes)]), self.language[entries], self.gain[entries] * np.repeat(weight, lengths)

    def predict_many(self, counts: list[Counter]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text, given its words' counts.

        The language with the likeliest mean word wins, the first in alphabetical order on a tie. The score
        is its likelihood's share of its own and the runner-up's: half on a tie, 1 if there is no other.
        """
        none = [UNKNOWN] * len(counts), np.zeros(len(counts))
        every = list(dict.fromkeys(w for c in counts for w in c))
        if not every or not self.languages:
            return none
        place, width = {w: i for i, w in enumerate(every)}, len(self.languages)
        kinds, starts, language, gain = self._vectors(every)
        doc = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        word = np.fromiter((place[w] for c in counts for w in c), np.int64, len(doc))
        n = np.fromiter((v for c in counts for v in c.values()), float, len(doc))
        known = kinds[word] >= 0
        by_kind = np.bincount(doc[known] * (ORDER + 1) + kinds[word[known]], n[known], len(counts) * (ORDER + 1))
        total = by_kind.reshape(len(counts), -1) @ self.floors
        lengths = starts[word + 1] - starts[word]
        entries = _ranges(starts[word], lengths)
        total += np.bincount(np.repeat(doc, lengths) * width + language[entries], np.repeat(n, lengths) * gain[entries], len(counts) * width).reshape(len(counts), width)
        sizes = np.bincount(doc, n, len(counts))
        mean = total / np.maximum(sizes, 1)[:, None]
        best = mean.argmax(axis=1)
        top = mean[np.arange(len(counts)), best]
        second = np.partition(mean, -2, axis=1)[:, -2] if width > 1 else np.full(len(counts), -np.inf)
        score = np.where(sizes > 0, 1 / (1 + np.exp(second - top)), 0.0)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, sizes, strict=True)], score

    def predict_texts(self, texts) -> Iterator[tuple[list[str], np.ndarray]]:
        """``predict_many`` of an iterable of texts, a bounded number of words at a time."""
        held, words = [], 0
        for text in texts:
            held.append(_words(text or ""))
            words += len(held[-1])
            if len(held) >= TEXTS or words >= WORDS:
                yield self.predict_many(held)
                held, words = [], 0
        if held:
            yield self.predict_many(held)

    def predict(self, text: str | None) -> tuple[str, float]:
        (language,), (score,) = self.predict_many([_words(text or "")])
        return language, float(score)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, kind, lang, n) of the words and n-grams; words are counted together before they are cut."""

    def flush() -> pa.RecordBatch:
        counts: Counter = Counter()
        for lang, found in words.items():
            for word, n in found.items():
                counts[_key(0, word), 0, lang] += n
                for k in range(1, ORDER + 1):
                    for g in grams(word, k):
                        counts[_key(k, g), k, lang] += n
        keys = list(zip(*counts, strict=True)) if counts else [(), (), ()]
        return pa.record_batch(
            [
                pa.array(np.array(keys[0], np.uint64).view(np.int64)), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.string()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["key", "kind", "lang", "n"],
        )

    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words.setdefault(lang, Counter()).update(_words(text.as_py()))
            if sum(map(len, words.values())) > REMEMBERED:
                yield flush()
                words = {}
    yield flush()


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, characters: int = CHARACTERS,
) -> Model:
    """A model of every language that rows with text and language have.

    Fitted on a sample of labelled rows, drawn by a hash of id and text: of each language about ``sample``
    documents and ``characters`` characters at most, and less where the languages are so many that this
    would pass SAMPLE_ALL or CHARACTERS_ALL in sum. Every word and n-gram of the sample is kept, so the
    model's size is bounded by the sample. Rows with null text, language or id are not used. Without rows
    the model knows no language.
    """
    rows = labelled.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = written(rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")), "languages")
    languages = sorted(r.lang for r in sizes.select("lang").collect())  # a row a language
    nothing = np.zeros(0, np.int64)
    if not languages:
        return Model([], nothing.view(np.uint64), np.zeros(1, np.int64), nothing, nothing, np.zeros((ORDER + 1, 0)))
    few, short = (float(min(a, b / len(languages))) for a, b in ((sample, SAMPLE_ALL), (characters, CHARACTERS_ALL)))
    share = F.least(F.lit(1.0), F.lit(few) / F.col("n"), F.lit(short) / F.greatest(F.col("c"), F.lit(1)))
    drawn = rows.join(sizes, "lang").where(F.pmod(F.xxhash64("id", "text", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30))
    counts = drawn.select("lang", "text").mapInArrow(_counts, "key long, kind int, lang string, n long")
    counts = counts.groupBy("key", "kind", "lang").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # bounded by the sample
    key = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key, kind="stable")
    key, kind, n = key[order], found.column("kind").to_numpy()[order], found.column("n").to_numpy()[order].astype(float)
    place = {lang: i for i, lang in enumerate(languages)}
    coded = found.column("lang").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    lang = np.array([place[x] for x in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy()][order] if len(key) else nothing
    keys, first = np.unique(key, return_index=True)
    size = np.maximum(1, np.bincount(kind[first], minlength=ORDER + 1))[:, None]
    totals = np.maximum(1, np.bincount(kind * len(languages) + lang, n, (ORDER + 1) * len(languages)).reshape(ORDER + 1, -1))
    # log((n + 1/2) / (total + size)), and the floor is that of n = 0.
    return Model(
        languages, keys, np.append(first, len(key)).astype(np.int64), lang, np.log(2 * n + 1).astype(np.float32), np.log(0.5 / (totals + size))
    )


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``; only the text is looked at, all of it.

    ``und`` with score 0 for a text that is null or has no letter, or if the model knows no language. Equal
    likelihoods go to the language that comes first in alphabetical order. Very long texts are read whole,
    one at a time. Rows with a null id and repeated rows are kept; other columns are ignored; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            at = 0
            for langs, scores in known.predict_texts(x.as_py() for x in batch.column(1)):
                ids = batch.column(0).slice(at, len(langs))
                at += len(langs)
                yield pa.record_batch([ids, pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
