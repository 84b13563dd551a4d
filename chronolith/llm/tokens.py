"""Token counts: batch encoding in Arrow functions that return lengths only.

Rows arrive as Arrow batches. Texts are cut at safe boundaries into units; a worker remembers the lengths of short units
(a bounded number) and packs the others into batches of about equal bytes, each encoded at once. Only numbers of tokens
leave the worker.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows give one row each; an empty table gives an
empty result; further columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import map_arrow, table

# The usual byte-level pre-tokeniser gives white space only to the start of a token or to tokens of white space, so a cut
# between another character and white space falls between two tokens, whatever surrounds them. Texts of any other kind of
# vocabulary are encoded whole (`_cuts`).
_SPACE = "\\t-\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
# Characters on which definitions of white space differ: a text that has one is encoded whole.
_UNSURE = re.compile("[\\x1c-\\x1f\\x85\\u180e\\u200b\\ufeff]")
_loaded: dict[str, tuple[object, bool]] = {}
_known: dict[str, dict[str, int]] = {}
KNOWN = 400_000  # units whose lengths a worker remembers
LONG = 64  # characters from which a unit is not remembered


def _cuts(tokenizer) -> bool:
    """Whether texts may be cut before white space: known only for the usual byte-level splitting, without a normaliser
    and without special strings that hold white space or take it from their neighbours."""
    made = json.loads(tokenizer.to_str())
    split = made.get("pre_tokenizer") or {}
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    special = tokenizer.get_added_tokens_decoder().values()
    return bool(usual) and not made.get("normalizer") and not any(re.search(r"\s", x.content) or x.lstrip or x.rstrip or x.single_word for x in special)


def _load(tokenizer: str):
    if tokenizer not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        if os.path.exists(tokenizer):
            path = tokenizer
        else:
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[tokenizer] = (t, _cuts(t))
    return _loaded[tokenizer]


def safe_units(text: str) -> list[str]:
    """Cut text at every safe boundary; the token counts of the units add up to that of the whole text."""
    return [text] if _UNSURE.search(text) else _UNIT.findall(text)


def count_tokens(texts: list[str], tokenizer: str, batch_bytes: int) -> list[int]:
    """Token counts of texts. Units not met before are encoded in batches of about batch_bytes bytes."""
    encoder, splits = _load(tokenizer)
    known = _known.setdefault(tokenizer, {})
    if len(known) > KNOWN:
        known.clear()
    counts = [0] * len(texts)
    owners: dict[str, list[tuple[int, int]]] = {}
    held = 0

    def flush() -> None:
        for (unit, uses), encoded in zip(owners.items(), encoder.encode_batch_fast(list(owners), add_special_tokens=False), strict=True):
            n = len(encoded)
            if len(unit) < LONG:
                known[unit] = n
            for i, times in uses:
                counts[i] += n * times
        owners.clear()

    for i, text in enumerate(texts):
        total = 0
        for unit, times in Counter(safe_units(text) if splits else [text]).items():
            if (n := known.get(unit)) is not None:
                total += n * times
            else:
                if unit not in owners:
                    owners[unit] = []
                    held += len(unit.encode("utf-8", "surrogatepass"))
                owners[unit].append((i, times))
        counts[i] += total
        if held >= batch_bytes:
            flush()
            held = 0
    flush()
    return counts


def token_counts(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """One row per input row: the id, n_bytes (UTF-8) and n_tokens of the whole text.

    tokenizer is a path of a tokenizers .json file that every executor has, or a name public_tokenizers knows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            n_tokens: list[int] = []
            start, held = 0, 0
            sizes = n_bytes.to_pylist()
            for i, size in enumerate(sizes):  # Python strings of a bounded part of the batch at a time
                held += size
                if held >= 4 * batch_bytes or i + 1 == len(sizes):
                    n_tokens += count_tokens(texts.slice(start, i + 1 - start).to_pylist(), tokenizer, batch_bytes)
                    start, held = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n_tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, count, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)
