"""The pipeline against plain Python, and its stages on odd tables."""

import hashlib
import random
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, brute_hits

import corpus_pipeline
from chronolith.llm import langid, stages, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mark long, hit_id long, component_id string"
BAD = ["vexgrub", "zuckmold", "plonkwit", "jabbersnipe"]


def prose(rng, n, parts):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(2, 5))) for _ in range(n))


def tables(spark, folder):
    rng = random.Random(21)
    parts = {"xx": ["lor", "em", "ips", "um", "dol"], "yy": ["kra", "zok", "tuk", "vex", "bro"]}
    rows, labels = [], []
    item = prose(rng, 24, parts["xx"])
    for k in range(240):
        lang = rng.choice(list(parts))
        words = prose(rng, rng.randrange(30, 60), parts[lang]).split()
        toxic = k % 3 == 0
        for _ in range(5 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        labels.append((k, int(toxic)))
        rows.append([k, " ".join(words), lang, f"s{k % 5}"])
    for k in range(240, 250):
        rows.append([k, rows[2 * (k - 240) + 1][1] + (" more" if k % 2 else ""), "xx", "s1"])  # copies, one from a toxic document
    rows.append([250, prose(rng, 20, parts["xx"]) + " " + " ".join(item.split()[3:15]), "xx", "s2"])
    rows += [[251, None, "xx", "s1"], [252, " 12 % ", None, "s1"], [253, "", "yy", None], [254, prose(rng, 40, parts["yy"]), None, None]]
    full = [(i, t, lang, s, len(t or ""), 1, 2, "c") for i, t, lang, s in rows]
    spark.createDataFrame(full, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, dict(labels), [(1, item), (2, None)]


def brute_mix(rows):
    """doc_id and taken of each document, from sizes and sources."""
    size = {i: len(t.split()) for i, t, _, _ in rows}
    by = {}
    for i, _, _, s in rows:
        by.setdefault(s, []).append(i)
    names = sorted(x for x in by if x is not None) + [None] * (None in by)
    total = {s: sum(size[i] for i in by[s]) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, still = {}, 1.5 * sum(total.values()), set(names)
    while still:
        unit = left / sum(weight[s] for s in still)
        full = {s for s in still if weight[s] * unit > 2 * total[s]}
        for s in full or still:
            target[s] = 2.0 * total[s] if full else weight[s] * unit
        left -= sum(target[s] for s in full)
        still = still - full if full else set()
    taken = {}
    for s in names:
        copies, held = int(target[s] // total[s]), 0
        missing, mean = target[s] - copies * total[s], total[s] / sum(size[i] > 0 for i in by[s])
        u = {i: (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52) for i in by[s]}
        for i in sorted(by[s], key=lambda i: u[i] / (1 - u[i]) / (size[i] / mean)):
            held += size[i]
            taken[i] = size[i] * (copies + (missing > 0 and 2 * held - size[i] <= 2 * missing))
    return {i: n for i, n in taken.items() if n}


def test_pipeline(spark, tmp_path):
    rows, labels, items = tables(spark, str(tmp_path))
    got = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # the two classifiers decide one text at a time; the rest is plain Python
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.fit(table)
    kept = [r for r in rows if (p := model.predict(r[1]))[0] != "und" and p[1] >= stages.LEAST_SCORE]
    assert {r[0] for r in rows} - {r[0] for r in kept} == {251, 252, 253}
    left = table.where(F.col("doc_id").isin([r[0] for r in kept]))
    judge = toxicity.fit(left, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    civil = [r for r in kept if judge.score(r[1]) < toxicity.CUT]
    gone = {r[0] for r in kept} - {r[0] for r in civil}
    assert gone and sum(labels.get(i, 1 if 240 <= i < 250 else 0) for i in gone) == len(gone) and sum(labels.values()) <= 1.1 * len(gone)
    components = brute_components([r[1] for r in civil])
    first = [r for k, r in enumerate(civil) if components[k][1] == k]
    assert len(first) < len(civil)
    clean = [r for r, (_, hit, _) in zip(first, brute_hits([r[1] for r in first], items), strict=True) if not hit]
    assert {r[0] for r in first} - {r[0] for r in clean} == {250}
    assert got == brute_mix(clean)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, tmp_path, stage):
    spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    one = (1, "one plain text of seven words here", "en", "s", 1, 1, 2, "c")
    rows = [one, one, (None, "a text without an id", "en", None, 1, 1, 2, "c"), (2, None, None, None, None, None, None, None), (3, "", "en", "s", 0, 1, 2, "c"), (4, "word " * 60_000, "en", "s", 9, 1, 2, "c"), (5, "x" * 300_000, "en", "s", 9, 1, 2, "c")]
    docs = spark.createDataFrame(rows, DOCS)
    got = stage(spark, docs, str(tmp_path)).collect()
    ids = sorted((r["doc_id"] for r in got), key=str)
    want = {"language": [1, 1, 4, 5, None], "toxicity": [1, 1, 2, 3, 4, 5, None], "near_duplicates": [1, 2, 3, 4, 5, None], "decontamination": [1, 1, 2, 3, 4, 5, None]}
    name = next(n for n, f in corpus_pipeline.STAGES if f is stage)
    if name == "mixing":
        assert set(ids) <= {1, 4, 5, None} and all(0 < r["taken"] <= 2 * r["size"] for r in got)
    else:
        assert ids == want[name]
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_a_worker_holds_few_rows_at_once(spark):
    """Filters send texts alone, in small batches: a worker has no table of whole rows in memory."""
    docs = spark.range(300).select("id", F.lit("a text").alias("text"), F.repeat(F.lit("x"), 1000).alias("more")).coalesce(1)

    def alone(_, text):
        frame, held = sys._getframe(), []
        while frame:
            held += [x.num_rows for x in frame.f_locals.values() if isinstance(x, pa.RecordBatch)]
            frame = frame.f_back
        return text == "a text" and max(held, default=0) <= 100

    got = stages.keep_where(docs, None, alone)
    assert got.columns == docs.columns and got.agg(F.count("*"), F.sum(F.length("more"))).first()[:] == (300, 300_000)
