"""Toxicity by compression distance.

Two zstandard dictionaries are made, one of ordinary text and one of toxic text. Every window of a document (a word,
or a stretch of a longer run without blanks, between fixed blanks and a carrier that both dictionaries hold) is compressed
with each. The difference of the two lengths says which text explains the window better. Differences are calibrated:
on labelled rows that trained no dictionary, each difference gets its log odds in toxic against ordinary text, a
document's evidence is their sum over its distinct windows, and the threshold is set on the evidence of those rows.

Toxic documents consist mostly of ordinary words. The toxic dictionary is therefore trained on those words of at least 1.5 %
of toxic documents that are surely more frequent there than in ordinary ones (a lower confidence bound of the
ratio of document frequencies).

The classifier is fitted on all labelled texts; equal texts of a class count once. A window is a word, so the number of
texts of each class and half that have a word is all that a dictionary is made of: these are counted over all of them.
The toxic dictionary is trained on telling words in proportion to their numbers; the ordinary one has a fixed size and
holds the most frequent other words of ordinary texts. Scoring reads every whole text.

Defined cases: null and empty texts have no windows and evidence 0; several labels of one document: toxic if any says
so; null labels are left out; if a class has no usable rows, every document scores 0; repeated rows give one row each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.common import done_with, in_fold, map_arrow, stored, table

LONGEST = 48  # characters of a window
SPREAD = 8  # differences beyond are counted as this
CUT = 0.7  # a score from which a document counts as toxic
SHARED = 4  # bytes in a row that the toxic dictionary must have of a window to explain it better than the other
DULL = 1  # a difference up to which a window says little
RATIO = 2  # times that a telling word is at least more frequent in toxic documents
SURE = 2.5  # standard errors by which it must be
LEAST = 3  # toxic documents that have a telling word
SHARE = 0.015  # of the toxic documents, that must have it
RUN = 8  # words of a training window
TRAINED = 16  # bytes to train on for each of the toxic dictionary
SENT = 500_000  # labelled ids that are sent to where the documents are; more are joined by a shuffle
HELD = 300_000  # words that a task counts before it gives their numbers
MEMO = 400_000  # windows whose differences a worker remembers
AT_ONCE = 500  # texts of an Arrow batch while fitting


def windows(text: str | None) -> set[str]:
    """The distinct windows of a whole text: a word that a text repeats a thousand times tells no more than once."""
    out = set(text.lower().split() if text else [])
    for word in [w for w in out if len(w) > LONGEST]:
        out.remove(word)
        out.update(word[i : i + LONGEST] for i in range(0, len(word), LONGEST))
    return out


def _runs(words: list[str]) -> list[bytes]:
    return [f" {' '.join(words[i : i + RUN])} ".encode("utf-8", "surrogatepass") for i in range(0, len(words), RUN)]


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; of samples too few to train on, their own text."""
    try:
        return zstandard.train_dictionary(size, samples, level=9).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(19, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS, min_match=3)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=how)


def certainty(a, b, toxic: int, ordinary: int, m=math):
    """How surely a word is more frequent in toxic texts, of which a have it, than in ordinary ones, of which b have it:
    telling words exceed 0. m: a module of functions of numbers or columns."""
    return m.log(a / toxic / ((b + 0.5) / ordinary)) - SURE * m.sqrt(1 / a + 1 / (b + 0.5)) - math.log(RATIO)


def in_proportion(counts: dict[str, int], most: int) -> list[bytes]:
    """Training windows of about `most` bytes, in which words occur in proportion to their counts, all once at least."""
    share = most / max(1, sum(c * (len(w) + 1) for w, c in counts.items()))
    order = sorted(counts, key=lambda w: (-counts[w], w))
    out, times = _runs(order), 1
    while order := [w for w in order if counts[w] * share > times]:
        out += _runs(order)
        times += 1
    return out


def dictionaries(ordinary: dict[str, int], telling: dict[str, int], ordinary_bytes: int, toxic_bytes: int) -> tuple[bytes, bytes]:
    """The dictionaries of the other and of telling words, from how many texts have each. Telling words that training
    leaves out are put before the latter, the most frequent last, so toxic_bytes bounds the trained part and no word is
    lost. The words of the former are ordered alike."""
    known = train_dictionary(in_proportion(telling, TRAINED * toxic_bytes), toxic_bytes)
    left = [w for w in sorted(telling, key=lambda w: (telling[w], w)) if f" {w} ".encode("utf-8", "surrogatepass") not in known]
    often = b"".join(_runs(sorted(ordinary.keys() - telling.keys(), key=lambda w: (ordinary[w], w))))
    return often[-ordinary_bytes:], b"".join(_runs(left)) + known


def train(ordinary: list[str], toxic: list[str], ordinary_bytes: int, toxic_bytes: int) -> tuple[bytes, bytes]:
    """The dictionaries of a few texts."""
    seen = [Counter(w for text in texts for w in windows(text)) for texts in (ordinary, toxic)]
    telling = {w: a for w, a in seen[1].items() if a >= max(LEAST, SHARE * len(toxic)) and certainty(a, seen[0][w], len(toxic), len(ordinary)) > 0}
    return dictionaries(seen[0], telling, ordinary_bytes, toxic_bytes)


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    odds: tuple[float, ...]  # log odds of each difference, from -SPREAD to SPREAD
    threshold: float
    open: tuple | None = field(default=None, init=False, repr=False, compare=False)  # what a worker makes of it; goes with the model

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": None}

    def differences(self, found: Iterable[str]) -> list[int]:
        """How many windows have each difference, from -SPREAD to SPREAD."""
        if self.open is None:
            carrier = self.ordinary[-40:-8]
            parts = {self.toxic[i : i + SHARED] for i in range(len(self.toxic) - SHARED + 1)}
            self.open = carrier, _compressor(self.ordinary + carrier), _compressor(self.toxic + carrier), parts, {}
        carrier, ordinary, toxic, parts, memo = self.open
        if len(memo) > MEMO:
            memo.clear()
        found = list(found)
        for window in (w for w in found if w not in memo):
            held = b" " + window.encode("utf-8", "surrogatepass") + b" "
            if parts.isdisjoint([held[i : i + SHARED] for i in range(len(held) - SHARED + 1)]):
                memo[window] = SPREAD
            else:
                held = carrier + held
                memo[window] = SPREAD + max(-SPREAD, min(SPREAD, len(ordinary.compress(held)) - len(toxic.compress(held))))
        out = [0] * (2 * SPREAD + 1)
        for at, n in Counter(map(memo.__getitem__, found)).items():
            out[at] = n
        return out

    def evidence(self, text: str | None) -> float:
        return sum(o * n for o, n in zip(self.odds, self.differences(windows(text)), strict=True) if n)

    def score(self, text: str | None) -> float:
        if not self.odds:
            return 0.0
        x = self.evidence(text) - self.threshold + math.log(CUT / (1 - CUT))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int | None, sample_chars: int | None) -> DataFrame:
    """The distinct texts of each class: toxic, half and text."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic")).where("toxic in (0, 1)")
    known = F.broadcast(known) if known.count() <= SENT else known
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(known, "id").select("toxic", "text").distinct()
    if sample is not None or sample_chars is not None:  # as the caller asks
        own = Window.partitionBy("toxic").orderBy(F.xxhash64("text", F.lit("toxicity")), "text")
        before = F.coalesce(F.sum(F.length("text")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = texts.withColumns({"place": F.row_number().over(own), "before": before})
        texts = ranked.where((F.col("place") <= (1 << 62 if sample is None else sample)) & (F.col("before") < (1 << 62 if sample_chars is None else sample_chars)))
    return stored(texts.select("toxic", F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2)).cast("int").alias("half"), "text"), "labelled")


def counted(texts: DataFrame) -> DataFrame:
    """window, and n00, n01, n10 and n11: how many texts of each class (first) and half have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter[str]] = [Counter() for _ in range(4)]

        def out() -> Iterator[pa.RecordBatch]:
            for k, own in enumerate(seen):
                yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array([k] * len(own), pa.int32()), pa.array(own.values(), pa.int64())], names=["window", "k", "n"])
                own.clear()

        for batch in batches:
            for toxic, half, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
                seen[2 * toxic + half].update(windows(text.as_py()))
                if sum(map(len, seen)) > HELD:
                    yield from out()
        yield from out()

    found = map_arrow(texts.select("toxic", "half", "text"), count, "window string, k int, n bigint")
    return stored(found.groupBy("window").agg(*[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"n{k // 2}{k % 2}") for k in range(4)]), "seen", rows_per_batch=AT_ONCE)


def frequent(seen: DataFrame, most: int) -> dict[str, int]:
    """The most frequent words (window, n), about `most` bytes; of the last that fit, of about equal numbers, those of the
    smallest hashes."""
    span = 1 << 30
    seen = seen.where("n > 0").select("*", F.floor(F.log2("n") * 8).alias("step"), F.pmod(F.xxhash64("window"), F.lit(span)).alias("draw"))
    least, limit, left = 0, span, most
    for r in seen.groupBy("step").agg(F.sum(F.octet_length("window") + 1).alias("bytes")).orderBy(F.desc("step")).collect():  # 8 rows a power of two
        least, limit = r["step"], math.ceil(span * min(1, left / r["bytes"]))
        left -= r["bytes"]
        if left <= 0:
            break
    return {r["window"]: r["n"] for r in seen.where((F.col("step") > least) | (F.col("step") == least) & (F.col("draw") < limit)).select("window", "n").collect()}


def ranked_value(values: DataFrame, rank: int) -> float:
    """The x of which `rank` are larger or come before it, in descending order. Counts of 1,024 ranges come back, those of
    the range that holds it are split again."""
    low, high = values.agg(F.min("x"), F.max("x")).first()
    while low < high:
        at = F.least(F.floor((F.col("x") - low) / (high - low) * 1024), F.lit(1023))
        for r in values.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy(F.desc("at")).collect():
            if rank < r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
        values = values.where((F.col("x") >= low) & (F.col("x") <= high))
    return low


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int | None = None,
    sample_chars: int | None = None,
    ordinary_bytes: int = 1 << 20,
    toxic_bytes: int = 2 << 10,
    false_alarms: float = 0.006,
) -> ToxicityModel:
    """Fit on all labelled texts, or, if a caller asks for it, on `sample` texts of each class, of at most `sample_chars`
    characters a class (one text may have more).

    The halves of the texts judge each other for the odds of differences and the threshold, which the evidence of at
    most a share `false_alarms` of ordinary texts exceeds; the dictionaries that stay are trained on both.
    """
    none = ToxicityModel(b"", b"", (), 0.0)
    texts = labelled(docs, labels, id_col, text_col, label_col, sample, sample_chars)
    rows = {(r["toxic"], r["half"]): r["n"] for r in texts.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    # each half is judged by dictionaries of the other, so the calibration sees texts that trained nothing
    judged = [half for half in (0, 1) if all(rows.get((t, 1 - half)) for t in (0, 1))]
    if not all(any(rows.get((t, half)) for half in judged) for t in (0, 1)):
        done_with(texts)
        return none
    seen = counted(texts)

    def trained(halves: tuple[int, ...]) -> tuple[bytes, bytes]:
        b, a = (sum((F.col(f"n{t}{h}") for h in halves[1:]), F.col(f"n{t}{halves[0]}")) for t in (0, 1))
        ordinary, toxic = (sum(rows.get((t, h), 0) for h in halves) for t in (0, 1))
        sure = F.when(F.col("a") >= max(LEAST, SHARE * toxic), certainty(F.col("a"), F.col("b"), toxic, ordinary, F))
        telling = {r["window"]: r["a"] for r in seen.select("window", a.alias("a"), b.alias("b")).where(sure > 0).collect()}
        return dictionaries(frequent(seen.select("window", b.alias("n")), ordinary_bytes), telling, ordinary_bytes, toxic_bytes)

    def histograms(half: int) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(ToxicityModel(*trained((1 - half,)), (), 0.0))

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                found = [own.differences(windows(text.as_py())) for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["toxic", "counts"])

        return map_arrow(texts.where(F.col("half") == half).select("toxic", "text"), judge, "toxic int, counts array<bigint>")

    found = stored(reduce(DataFrame.unionByName, [histograms(half) for half in judged]), "judged", rows_per_batch=AT_ONCE, few=True)
    sums = {r["toxic"]: r for r in found.groupBy("toxic").agg(*[F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(2 * SPREAD + 1)]).collect()}
    totals = [[0.5 + sums[t][f"c{k}"] for k in range(2 * SPREAD + 1)] for t in (0, 1)]
    for total in totals:  # differences that say little are one
        total[: SPREAD + DULL + 1] = [sum(total[: SPREAD + DULL + 1])] * (SPREAD + DULL + 1)
    whole = [sum(total[SPREAD + DULL :]) for total in totals]
    odds = tuple(math.log(x / whole[1] / (y / whole[0])) for x, y in zip(totals[1], totals[0], strict=True))
    clean = found.where("toxic = 0").select(reduce(Column.__add__, [F.lit(o) * F.col("counts")[k] for k, o in enumerate(odds)]).alias("x"))
    n = sum(rows.get((0, half), 0) for half in judged)
    threshold = max(1.0, ranked_value(clean, int(n * false_alarms)) + 1e-9)
    ordinary, toxic = trained((0, 1))
    done_with(texts, seen, found)
    return ToxicityModel(ordinary, toxic, odds, threshold)


def classify(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, score and predicted (1 from a score of CUT)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            found = [own.score(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array([int(x >= CUT) for x in found], pa.int32())], names=["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, scored, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~in_fold("doc_id", 3, 1)))
    return classify(docs, model).withColumn("held_out", in_fold("doc_id", 3, 1)).select("doc_id", "held_out", "score", "predicted")
