"""Language-model scores from a subword lattice.

A text is a series of words and one end. The pieces of an existing subword vocabulary, weighted by its own scores, span a
lattice over each word; a forward recursion in log space sums over all segmentations. The lattice of a word that the
training texts have holds one more arc, over the whole word, weighted by how often they have it. With N training tokens
(ends included), of which T are distinct, and c of them the word,

    P(word) = (c + T * lattice(word)) / (N + T):

what T of N + T tokens began as a new word is left to the vocabulary's pieces (Witten-Bell). The probability of a text is
the product over its words and its end, marginal over all segmentations of the text, as no piece crosses a blank.

Beside it stands a base score: add-one unigrams of whole words over all training tokens.

All distinct words are counted over the whole corpus in a shuffled table and scored there once. The most frequent words
(a bounded number, of bounded length) travel to the workers that read the texts, which sum them up on the spot;
occurrences of all others are joined to the table and summed by Spark.

Defined cases: a null text is empty and has one token, its end; where `learns` is null a row is in training; repeated rows
give one row each; without training rows every base probability is 1 and P(word) is the lattice alone; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import in_fold, map_arrow, stored, table

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
MARK = "▁"  # begins a word
FREQUENT = 150_000  # words whose scores the workers hold
FREQUENT_CHARS = 48  # the longest of them
FLUSH = 300_000  # distinct words after which a task passes its counts on
_CHARS = 1 << 16  # characters of the words whose lattices are computed at once


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_LOWER)) if text else []


@dataclass
class PieceModel:
    """Natural log probabilities of pieces, of the 256 byte pieces and of the end; together they are at most one."""

    pieces: dict[str, int]
    logp: np.ndarray  # by piece id; byte b at offset + b, the end last
    longest: int
    single: dict[str, float] = field(default_factory=dict)

    @property
    def bytes_at(self) -> int:
        return len(self.logp) - 257

    def spelled(self, char: str) -> float:
        """Log probability of a character that is no piece: its bytes."""
        if char not in self.single:
            self.single[char] = float(sum(self.logp[self.bytes_at + b] for b in char.encode("utf-8", "surrogatepass")))
        return self.single[char]

    def _arcs(self, marked: list[str], i: int, j: int) -> np.ndarray:
        """Log probabilities of the pieces over characters i to j of each string; minus infinity: no piece."""
        get = self.pieces.get
        ids = np.array([get(s[i:j], -1) for s in marked])
        lp = np.where(ids < 0, -np.inf, self.logp[ids])
        if j == i + 1 and (ids < 0).any():
            for k in np.nonzero(ids < 0)[0]:
                lp[k] = self.spelled(marked[k][i])
        return lp

    def _one(self, s: str) -> float:
        """Forward recursion over one string; keeps no more than the longest piece needs."""
        get, logp, longest = self.pieces.get, self.logp, self.longest
        f = [0.0]
        for j in range(1, len(s) + 1):
            low = max(0, j - longest)
            terms: list[float] = []
            start = j - len(f)
            for i in range(max(low, start), j):
                p = get(s[i:j], -1)
                if p >= 0:
                    terms.append(f[i - start] + logp[p])
                elif i == j - 1:
                    terms.append(f[i - start] + self.spelled(s[i]))
            top = max(terms)
            f.append(top + math.log(sum(math.exp(t - top) for t in terms)) if top > -math.inf else top)
            if len(f) > longest:
                del f[0]
        return float(f[-1])

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability, summed over all its segmentations."""
        out = np.zeros(len(words))
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            by_length[len(w) + 1].append(k)
        for length, ks in by_length.items():
            step = max(1, _CHARS // length)
            for at in range(0, len(ks), step):
                part = ks[at : at + step]
                if len(part) < 12:
                    for k in part:
                        out[k] = self._one(MARK + words[k])
                else:
                    out[part] = self._forward([MARK + words[k] for k in part], length)
        return out

    def _forward(self, marked: list[str], length: int) -> np.ndarray:
        """The same for many strings of one length."""
        f = [np.zeros(len(marked))]
        for j in range(1, length + 1):
            total = np.full(len(marked), -np.inf)
            for i in range(max(0, j - self.longest), j):
                total = np.logaddexp(total, f[i] + self._arcs(marked, i, j))
            f.append(total)
        return f[length]


def load_vocabulary(vocabulary: str) -> PieceModel:
    """Pieces of a sentencepiece model (a path, or a name public_tokenizers knows), weighted by its own scores.

    Scores of a unigram model are log probabilities. Scores of a merge vocabulary are negative ranks; a piece of rank r
    then weighs 1 / (r + 2).
    """
    import sentencepiece

    if not os.path.exists(vocabulary):
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    found = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or MARK in piece[1:]):
            found[piece] = model.get_score(i)
    scores = np.array(list(found.values()))
    ranks = len(scores) > 1 and float(np.abs(scores - np.round(scores)).max()) == 0
    logs = np.append(-np.log(2 - scores) if ranks else scores, np.zeros(257))
    logs[-257:] = logs[:-257].min()  # bytes and the end weigh as much as the last piece
    logs -= np.log(np.exp(logs).sum())
    return PieceModel({p: i for i, p in enumerate(found)}, logs, max(map(len, found)))


def count_words(texts: DataFrame) -> DataFrame:
    """word and c, its occurrences in rows that learn, of all words of the column text; texts has text and learns."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for text, learns in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if learns:
                    held.update(words_of(text.as_py()))
                else:
                    for word in words_of(text.as_py()):
                        held[word] += 0
                if len(held) > FLUSH:
                    yield from out(held)
                    held = Counter()
        yield from out(held)

    def out(held: Counter[str]) -> Iterator[pa.RecordBatch]:
        words, counts = list(held), list(held.values())
        for i in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.string()), pa.array(counts[i : i + 50_000], pa.int64())], names=["word", "c"])

    return map_arrow(texts, count, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Totals:
    """Of the training tokens: all, distinct ones, and ends."""

    tokens: int
    distinct: int
    ends: int

    def base(self, c: np.ndarray) -> np.ndarray:
        """log10 of the add-one probability of tokens that occur c times."""
        return np.log10((c + 1) / (self.tokens + self.distinct + 1))

    def mixed(self, c: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 P of tokens that occur c times, with the natural log of their lattices."""
        new = max(1, self.distinct)
        with np.errstate(divide="ignore"):
            return (np.logaddexp(np.log(c), math.log(new) + lattice) - math.log(self.tokens + new)) / math.log(10)


def score_words(words: DataFrame, model: PieceModel, totals: Totals) -> DataFrame:
    """word, c, base and score (log10 probabilities) of every word."""
    sent = words.sparkSession.sparkContext.broadcast((model, totals))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, totals = sent.value
        for batch in batches:
            c = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            found = totals.mixed(c, own.word_scores(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals.base(c)), pa.array(found)], names=["word", "c", "base", "score"])

    return map_arrow(words.select("word", "c"), score, "word string, c bigint, base double, score double")


def frequent_words(words: DataFrame) -> DataFrame:
    """The most frequent words, at most FREQUENT of them: all from a count that a histogram of counts gives, so that no
    task sends more than its share of them."""
    short = words.where((F.length("word") <= FREQUENT_CHARS) & (F.col("c") > 0))
    step = F.floor(F.log("c") * 64).cast("int")
    least, held = None, 0
    for r in sorted(short.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):  # at most 64 for each power of e
        held += r["n"]
        if held > FREQUENT:
            break
        least = r["step"]
    return short.where(F.lit(False) if least is None else step >= least)


_SPLIT = "rid bigint, id {}, word string, tf bigint, n_tokens bigint, n_known bigint, base double, score double"


def split(rows: DataFrame, frequent: dict[str, tuple[float, float]], end: tuple[int, float, float], kind: str) -> DataFrame:
    """Of each text (rid, id and text) a row of what its frequent words and its end sum up to, which alone has the id, and
    a row for each other word. That row's word is a key of its own that no word equals. end: known, base and score of the
    end."""
    sent = rows.sparkSession.sparkContext.broadcast((frequent, end))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, end = sent.value
        get = frequent.get
        for batch in batches:
            id_type = batch.schema.field(1).type
            rids, words, tfs = [], [], []
            sums: list[tuple] = []
            for rid, own_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, (known, base, score) = 1, end
                for word, tf in Counter(words_of(text.as_py())).items():
                    n += tf
                    if (found := get(word)) is not None:
                        known += tf
                        base += tf * found[0]
                        score += tf * found[1]
                    else:
                        rids.append(rid)
                        words.append(word)
                        tfs.append(tf)
                sums.append((rid, own_id, n, known, base, score))
                if len(words) > 50_000:
                    yield out(rids, words, tfs, sums, id_type)
                    rids, words, tfs, sums = [], [], [], []
            yield out(rids, words, tfs, sums, id_type)

    def out(rids: list, words: list, tfs: list, sums: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        rest, own = len(words), list(zip(*sums, strict=True)) or [()] * 6
        none = [None] * rest
        columns = [[*rids, *own[0]], [*none, *own[1]], [*words, *(f" {r}" for r in own[0])], [*tfs, *[0] * len(sums)], *([*none, *c] for c in own[2:])]
        kinds = [pa.int64(), id_type, pa.string(), *[pa.int64()] * 3, *[pa.float64()] * 2]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["rid", "id", "word", "tf", "n_tokens", "n_known", "base", "score"])

    return map_arrow(rows, read, _SPLIT.format(kind))


def lm_scores(docs: DataFrame, learns: Column, vocabulary: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score and score. learns: whether a row is in
    training."""
    learns = F.coalesce(learns, F.lit(True))
    texts = docs.select(F.col(text_col).alias("text"), learns.alias("learns"))
    words = stored(count_words(texts), "words")
    ends = texts.where("learns").count()
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    totals = Totals(total + ends, distinct + (ends > 0), ends)
    model = load_vocabulary(vocabulary)
    scored = stored(score_words(words, model, totals), "scored")
    frequent = {r["word"]: (r["base"], r["score"]) for r in frequent_words(scored).collect()}  # bounded
    c = np.array([float(ends)])
    end = int(ends > 0), float(totals.base(c)[0]), float(totals.mixed(c, model.logp[-1:])[0])
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = split(rows, frequent, end, docs.schema[id_col].dataType.simpleString())
    of = scored.select("word", "c", F.col("base").alias("word_base"), F.col("score").alias("word_score"))
    both = parts.join(of, "word", "left")
    summed = both.groupBy("rid").agg(
        F.max("id").alias(id_col),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("c") > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("base", F.col("tf") * F.col("word_base"))).alias("base_score"),
        F.sum(F.coalesce("score", F.col("tf") * F.col("word_score"))).alias("score"),
    )
    return summed.select(id_col, "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = lm_scores(docs, ~in_fold("doc_id", 7, 2))
    return scores.withColumn("held_out", in_fold("doc_id", 7, 2)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
