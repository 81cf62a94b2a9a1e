"""Language identification by n-gram filters whose slots are bitmasks of languages.

Training counts letter n-grams per language over all training rows and takes those with
at least ``MIN_SHARE`` of their language's n-grams: at most ``1 / MIN_SHARE`` for each
language and length, whatever the corpus. They go into one Bloom filter per language, all
of the same size and hashes and stored bit-sliced: a slot is a mask with a bit for each
language, so the AND of an n-gram's slots names every language that holds it. A text's
n-grams are looked up once; the masks' bits are counted per language, each count is
corrected for the filter's rate of false positives, and the largest one decides.

Defined results: a text that is null or has no letter gives ``und`` with score 0; a text
none of whose n-grams is known gives the language with most training n-grams, score 0;
ties go to the language that comes first by code point; training rows without a language
or an id are not used; without any training row every text gives ``und``; repeated rows
are counted and answered each; an empty table gives an empty one. ``identify`` puts its
columns in place of columns of the same names (in any case) and keeps all others.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import append, map_arrow
from tidemark.llm.hashing import mix

LENGTHS = (3, 4)
MIN_SHARE = 2e-5
BITS_PER_GRAM = 16
HASHES = 3
UNKNOWN = "und"
SCHEMA = "lang_pred string, score double"
_NOT_LETTER = re.compile(r"[\W\d_]+")
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_FLUSH = 400_000


def grams(text: str) -> np.ndarray:
    """Hashes of the letter n-grams of a text, words set apart by one space each."""
    plain = _NOT_LETTER.sub(" ", text.lower()).strip()
    points = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    for n in LENGTHS:
        if len(points) < n:
            continue
        value = np.full(len(points) - n + 1, n, np.uint64)
        inner = np.zeros(len(value), bool)
        for i in range(n):
            at = points[i : i + len(value)]
            value = value * np.uint64(0x100000001B3) + at
            if 0 < i < n - 1:
                inner |= at == 32
        out.append(mix(value[~inner]))
    return np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageFilter:
    """langs in code point order; slots[i] is the mask (as bytes) of slot i."""

    langs: tuple[str, ...]
    default: int
    slots: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, langs: list[str], default: str | None, lang_of: np.ndarray, hashes: np.ndarray) -> LanguageFilter:
        width = max(1, -(-len(langs) // 8))
        most = int(np.bincount(lang_of).max()) if len(lang_of) else 1
        size = 1 << max(10, int(BITS_PER_GRAM * most - 1).bit_length())
        slots = np.zeros((size, width), np.uint8)
        for place in cls._places(hashes, size):
            np.bitwise_or.at(slots, (place, lang_of // 8), (1 << (lang_of % 8)).astype(np.uint8))
        filled = np.unpackbits(slots, axis=1, bitorder="little").mean(axis=0)[: len(langs)]
        return cls(tuple(langs), langs.index(default) if langs else -1, slots, filled**HASHES)

    @staticmethod
    def _places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
        shift = np.uint64(65 - size.bit_length())
        return [((hashes * seed) >> shift).astype(np.int64) for seed in _SEEDS[:HASHES]]

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language's filter holds."""
        first, *rest = self._places(hashes, len(self.slots))
        masks = self.slots[first]
        for place in rest:
            masks &= self.slots[place]
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
        each = [np.bincount(masks[:, i], minlength=256) @ bits for i in range(masks.shape[1])]
        return np.concatenate(each)[: len(self.langs)]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        hashes = grams(text)
        found = self.counts(hashes)
        fixed = np.clip((found - len(hashes) * self.false_rate) / (1 - self.false_rate), 0, None)
        best = int(np.argmax(fixed))
        if fixed[best] <= 0:
            return self.langs[self.default], 0.0
        return self.langs[best], float(min(1.0, fixed[best] / len(hashes)))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n, row count 0 or 1): partial counts, summed within each task first."""

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                values, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if has_letter(text):
                    held.setdefault(lang, []).append(grams(text))
                    size += len(held[lang][-1])
                if size > 8 * _FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    parts = map_arrow(docs.select("text", "lang"), run, "lang string, gram bigint, n bigint")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, use: Column) -> LanguageFilter:
    """Learns from the rows of docs with a language for which ``use`` holds.

    What reaches the driver are a language's n-grams above the least share, so at most
    ``len(LENGTHS) / MIN_SHARE`` for each language, and one total for each language.
    """
    from pyspark import StorageLevel

    counts = gram_counts(docs.filter(use & F.col("lang").isNotNull())).persist(StorageLevel.DISK_ONLY)
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        counts.unpersist()
        return LanguageFilter.build([], None, np.empty(0, np.int64), np.empty(0, np.uint64))
    least = F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, max(1, int(v * MIN_SHARE)))])
    chosen = counts.filter(F.col("n") >= least[F.col("lang")]).select("lang", "gram").toArrow()
    counts.unpersist()
    place = {lang: i for i, lang in enumerate(langs)}
    lang_of = np.array([place[x] for x in chosen.column("lang").to_pylist()], np.int64)
    hashes = chosen.column("gram").to_numpy().view(np.uint64)
    order = np.lexsort((hashes, lang_of))
    return LanguageFilter.build(langs, max(langs, key=lambda k: (totals[k], -place[k])), lang_of[order], hashes[order])


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """Adds lang_pred and score to the rows of docs, from their text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = shared.value.predict

        def work(batch):
            rows = [predict(text) for text in batch.column("text").to_pylist()]
            return [[r[0] for r in rows], [r[1] for r in rows]]

        return work

    return append(docs.drop("lang_pred", "score"), SCHEMA, make)


def keep_identified(docs: DataFrame, model: LanguageFilter, least: float) -> DataFrame:
    """The rows of docs, unchanged, whose text has a language with at least that score.

    Columns of docs named as the predictions are carried through.
    """
    found = identify(docs.select(F.struct("*").alias("_row"), "text"), model)
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select("_row.*")
