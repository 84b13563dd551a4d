"""Language identification by word-first backoff.

A word that the model knows scores its per-language log frequency. For an unseen word the model falls back to the
character n-grams of the word (with its two edges marked), longest first, and takes the first length of which it knows
any n-gram. A text scores the mean over its words.

The classifier is fitted on a bounded sample of labelled rows (about `sample_per_lang` documents a language, chosen by
a hash of their ids); the bound is a parameter, and the model keeps every word and n-gram of the sample. Prediction reads
every whole text.

Defined cases: null text or text without a letter gives `und` with score 0; a text of which nothing is known gives the
language with the most training rows, at score 1 / number of languages; ties go to the smaller language name; repeated
rows give one row each; rows without an id are predicted like others and may be in the sample; no training rows: every
text gives `und`; an empty table gives an empty result; further columns are ignored. A word of any length is one word;
beyond LONG characters it is not remembered.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import in_fold, map_arrow, table

_WORD = re.compile(r"[^\W\d_]+")
EDGE = "\x01"
PENALTY = -7.0  # of a word or n-gram that one language has and another lacks
MEMO = 200_000  # words whose scores a task remembers
LONG = 64  # characters of the longest of them


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """Languages in order of name; for each known word or n-gram its log10 frequency by language."""

    langs: list[str]
    rows: dict[str, int]
    words: dict[str, tuple[float, ...]]
    grams: dict[str, tuple[float, ...]]
    longest: int
    memo: dict[str, tuple[float, ...] | None] = field(default_factory=dict)

    def word_scores(self, word: str) -> tuple[float, ...] | None:
        """Scores of a word by language, or None if neither it nor any of its n-grams is known."""
        if word in self.words:
            return self.words[word]
        if word in self.memo:
            return self.memo[word]
        marked, found = f"{EDGE}{word}{EDGE}", None
        for n in range(min(self.longest, len(marked)), 0, -1):
            known = [s for i in range(len(marked) - n + 1) if (s := self.grams.get(marked[i : i + n])) is not None]
            if known:
                found = tuple([sum(x) / len(known) for x in zip(*known)])
                break
        if len(word) <= LONG:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        totals, n = [0.0] * len(self.langs), 0
        for word, tf in Counter(words_of(text)).items():
            if (scores := self.word_scores(word)) is not None:
                n += tf
                for i, s in enumerate(scores):
                    totals[i] += tf * s
        if not n:
            return min(self.langs, key=lambda x: (-self.rows[x], x)), 1 / len(self.langs)
        best = max(range(len(totals)), key=lambda i: (totals[i], -i))
        margin = [(t - totals[best]) / n * min(n, 20) * math.log(10) for t in totals]
        return self.langs[best], 1 / sum(map(math.exp, margin))


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_per_lang: int = 150,
    longest: int = 4,
) -> LanguageModel:
    """Fit on labelled rows. Rows without a text or a language are left out.

    The sample has about sample_per_lang rows of each language, which bounds the model.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(rows)
    if not langs:
        return LanguageModel([], {}, {}, {}, longest)
    span = 1 << 30
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(span, math.ceil(span * sample_per_lang / rows[lang])))])
    sample = labelled.where(F.pmod(F.xxhash64("id", F.lit("language")), F.lit(span)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words.update((lang, w) for w in words_of(text.as_py()))
                if len(words) > 500_000:
                    yield from counted(words)
                    words = Counter()
        yield from counted(words)

    def counted(words: Counter[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        grams: Counter[tuple[str, int, str]] = Counter()
        for (lang, word), c in words.items():
            grams[lang, 0, word] += c
            marked = f"{EDGE}{word}{EDGE}"
            for n in range(1, longest + 1):
                for i in range(len(marked) - n + 1) if n > 1 else range(1, len(marked) - 1):  # an edge alone says nothing
                    grams[lang, n, marked[i : i + n]] += c
        items = list(grams.items())
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in part]), pa.array([k[1] for k, _ in part], pa.int32()), pa.array([k[2] for k, _ in part]), pa.array([c for _, c in part], pa.int64())],
                names=["lang", "n", "gram", "c"],
            )

    counts = map_arrow(sample.select("lang", "text"), count, "lang string, n int, gram string, c bigint").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    found = counts.toArrow()  # the words and n-grams of the sample
    totals: Counter[tuple[str, int]] = Counter()
    words: dict[str, list[float]] = {}
    grams: dict[str, list[float]] = {}
    for batch in found.to_batches(max_chunksize=20_000):
        for lang, n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            totals[lang, n] += c
    at = {lang: k for k, lang in enumerate(langs)}
    for batch in found.to_batches(max_chunksize=20_000):
        for lang, n, gram, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            (grams if n else words).setdefault(gram, [PENALTY] * len(langs))[at[lang]] = max(PENALTY, math.log10(c / totals[lang, n]))
    return LanguageModel(langs, rows, {k: tuple(v) for k, v in words.items()}, {k: tuple(v) for k, v in grams.items()}, longest)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, lang_pred and score. The model's size is bounded, so it is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            found = [own.predict(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, predict, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~in_fold("doc_id", 4, 2)))
    return identify(docs, model).withColumn("held_out", in_fold("doc_id", 4, 2)).select("doc_id", "held_out", "lang_pred", "score")
