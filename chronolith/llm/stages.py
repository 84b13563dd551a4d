"""Operators as stages of a corpus pipeline: documents in, documents out, decisions carried out.

Filters whose decision needs one document only run where its row is and pass all columns through, so no text is
shuffled. Decisions that are tables remove rows by an anti-join with the rows to remove, which Spark broadcasts if
their table is small and shuffles if not.

Defined cases, for all stages: an empty table gives an empty table; further columns of any name stay as they are; a null
id is a document like others (but has no duplicates). Null and empty texts: no language is known, so known_language
removes them; they are not toxic, not contaminated and have no duplicates; a mix has no words to take from them. Rows
that occur several times are judged alike; one_of_each_group keeps one row of an id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm import decontaminate, jaccard, langid, mixing, toxicity
from chronolith.llm.common import release, stored
from chronolith.shipping import ship

LEAST_SCORE = 0.4  # of a language, for a document to stay


def keep_where(docs: DataFrame, model, keeps: Callable[[object, str | None], bool], text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text the model keeps. Only texts go to the workers, a hundred at a time;
    rows stay where they are. Arrow batches would hold up to 10,000 rows with all columns, in the JVM and in the worker."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    ship(docs.sparkSession)
    release()  # what fitting the model took
    begun: list[bool] = []  # in each task

    def keep(text: str | None) -> bool:
        if not begun:
            begun.append(True)
            release()  # what the worker's last task took
        return bool(keeps(sent.value, text))

    return docs.where(F.udf(keep, "boolean", useArrow=False)(F.col(text_col)))


def _speaks(model: langid.LanguageModel, text: str | None) -> bool:
    lang, score = model.predict(text)
    return lang != "und" and score >= LEAST_SCORE


def known_language(docs: DataFrame) -> DataFrame:
    """Documents of a language that the labelled documents have; a text without letters has none. Without any labelled
    document all stay."""
    model = langid.fit(docs)
    return keep_where(docs, model, _speaks) if model.langs else docs


def _civil(model: toxicity.ToxicityModel, text: str | None) -> bool:
    return model.score(text) < toxicity.CUT


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not predict to be toxic. If a class
    has no labels, all stay."""
    return keep_where(docs, toxicity.fit(docs, labels), _civil)


def without(docs: DataFrame, rows: DataFrame, on: dict[str, Column]) -> DataFrame:
    """docs without the rows that a table of keys names. The table's columns get names that docs does not have."""
    free = {c: next(n for k in range(len(docs.columns) + 1) if (n := f"{c}_{k}") not in docs.columns) for c in on}
    keys = rows.select(*[F.col(c).alias(free[c]) for c in on])
    met = [value.eqNullSafe(F.col(free[c])) for c, value in on.items()]
    return docs.join(keys, reduce(Column.__and__, met), "left_anti")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each component of linked documents the row with the smallest id; of rows with one id, one. Rows without an id
    all stay."""
    found = stored(jaccard.jaccard_components(docs), "components")
    removed = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "removed", few=True)
    repeated = stored(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated", few=True)
    left = without(docs, removed, {"doc_id": docs["doc_id"]})
    once = without(left, repeated, {"doc_id": left["doc_id"]})
    several = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(several.select(*docs.columns))


def not_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any window of a benchmark item."""
    own = docs.select("doc_id", "text")
    hits = stored(decontaminate.contamination(own, benchmark).where("contaminated").select("doc_id", "mark").distinct(), "contaminated", few=True)
    return without(docs, hits, {"mark": F.xxhash64(docs["text"]), "doc_id": docs["doc_id"]})


def mixed(docs: DataFrame) -> DataFrame:
    """Documents that the mix takes words of: doc_id, source, size, source_size, target and taken."""
    return mixing.mix(docs).where("taken > 0")
