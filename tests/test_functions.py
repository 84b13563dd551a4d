import datetime

from pyspark.sql import functions as F

from chronolith.functions import hashing, text, times
from chronolith.plans.queries import QUERIES


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, text.collapse(F.lit("a  b\n c "))) == "a b c"
    assert one(spark, text.collapse(F.lit(None).cast("string"))) == ""
    for raw, want in (("55,956", 55956), ("55 956", 55956), ("", None), ("5a", None)):
        assert one(spark, text.whole_number(F.lit(raw))) == want
    assert one(spark, text.pdf_name(F.lit("a b?.pdf"))) == "a_b_.pdf"
    assert one(spark, text.pdf_name(F.lit("x"))) == "x.pdf"
    assert one(spark, text.file_name(F.lit("  "))) == "snapshot"
    assert one(spark, text.month_number(F.lit("Sept"))) == 9
    assert one(spark, text.month_name(F.lit(13))) == ""
    assert one(spark, text.anchor_strength(F.lit("Industry total of units"))) == 3
    tables = F.array(F.array(F.array(F.lit("a"), F.lit(None).cast("string"), F.lit("b")), F.array(F.lit(" "))), F.array(F.array(F.lit("c"))))
    assert one(spark, text.table_text(tables)) == "a | b\n\nc"


def test_whole_texts(spark, tmp_path):
    docs = [(0, " a\u3000 b\n" * 400 + "ΓÇôend"), (1, "short"), (2, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["normal"] for r in QUERIES["whole_texts"](spark, str(tmp_path)).collect()}
    assert got == {0: "a b " * 400 + "-end", 1: "short", 2: ""}


def test_hashing(spark):
    assert one(spark, hashing.sha256(F.lit("abc"))) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert one(spark, hashing.article_id(hashing.article_sha256(F.lit("T"), F.lit("body")))) == "40859c45b65f3a71"
    assert one(spark, hashing.fallback_id(F.lit("abc"), F.lit("http://x"))) == "726e08242879c249"
    docs = spark.createDataFrame([(1, "AB"), (2, ""), (3, "a b"), (4, None)], "id long, text string")
    got = {r["id"]: r["simhash64"] for r in hashing.simhash64(docs, "id", "text").collect()}
    assert got == {1: 1765116674205471180, 2: 0, 3: 0, 4: 0}
    assert one(spark, hashing.hamming(F.lit(5), F.lit(6))) == 2
    assert int(one(spark, hashing.unsigned(F.lit(-1).cast("long")))) == (1 << 64) - 1


def test_times(spark):
    assert one(spark, times.date_in_url(F.lit("/2024/01/31/x"))) == datetime.date(2024, 1, 31)
    assert one(spark, times.date_in_url(F.lit("/a-2024-02-31-b"))) is None
    assert one(spark, times.date_in_text(F.lit("posted 5 March 2024 by"))) == datetime.date(2024, 3, 5)
    assert one(spark, times.date_in_text(F.lit("31 Feb 2024"))) is None
    assert one(spark, times.iso_utc(times.parsed(F.lit("Tue, 05 Mar 2024 10:00:00 +0200")))) == "2024-03-05T08:00:00Z"
    for name, want in (("2020_06_Report-January-2019.pdf", (2020, 1)), ("2021_03_x.pdf", (2021, 3)), ("x.pdf", (None, None))):
        assert tuple(one(spark, c) for c in times.period_of_file(F.lit(name))) == want
    for said, want in (("for the month of May 2021", (2021, 5)), ("June 2020 new vehicle sales", (2020, 6)), ("in July 2019", (2019, 7)), ("rain of May 2020", (None, None)), ("wet May 2020 and then dry June 2021 with sales", (2020, 5)), ("rain of May 2020 " + "x" * 90 + " June 2021 sales", (2021, 6)), ("rain of May 2020 " + "x " * 90 + "dry June 2021, sales", (None, None)), (None, (None, None))):
        df = spark.createDataFrame([(said,)], "text string")
        assert tuple(times.with_period_of_text(df, "text").select("text_year", "text_month").first()) == want
    for said in ("April 23, 2019", "Tuesday, 23 April 2019", "23 Apr 2019", "2019/04/23", "20190423"):
        assert one(spark, times.iso_utc(times.parsed(F.lit(said)))) == "2019-04-23T00:00:00Z"
    assert one(spark, times.now_iso(F.lit("2024-01-02 03:04:05.6").cast("timestamp"))) == "2024-01-02T03:04:05Z"


def test_names_and_paths(spark):
    nothing = F.lit(None).cast("string")
    assert one(spark, text.pdf_name(nothing)) == ".pdf" and one(spark, text.file_name(nothing)) == "snapshot"
    assert one(spark, text.pdf_name(F.lit("\t a\u00a0b?.pdf \n"))) == "a_b_.pdf" and one(spark, text.file_name(F.lit("\tx\t"))) == "x"
    assert one(spark, text.posix_path(F.lit("a\\\\b\\c"))) == "a/b/c" and one(spark, text.windows_path(F.lit("a/b"))) == "a\\b"
    assert text.usable("a(b)?") and not text.usable("a(") and not text.usable("(?P<x>a)")


def test_simhash_by_brute_force(spark):
    import hashlib
    import random
    import re

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "cd", "x1", "The", "é", "quick"]) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    rows = [(k % 30, t) for k, t in enumerate(texts)]  # repeated ids stay apart
    want = []
    for k, t in rows:
        found = [int(hashlib.md5(x.encode()).hexdigest()[:16], 16) for x in re.findall("[a-z0-9]{2,}", t.lower())]
        value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))
        want.append((k, value - (1 << 64) if value >> 63 else value))
    got = [tuple(r) for r in hashing.simhash64(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()]
    assert sorted(got) == sorted(want)
