"""Small tests of the training-data operators: brute force, round trips, and the defined odd cases."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import bitsliced, decontaminate, jaccard, langid, lattice, mixing, stages, template, tokens, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, word string"


def docs(spark, texts, langs=None, sources=None):
    rows = [(k, t, (langs or {}).get(k, "en"), (sources or {}).get(k, "s"), 0, "x", "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


ODD = [None, "", " \n\t", "a", "x" * 5000, "A b C d", "A b C d", "日本語 テキスト", "<|endoftext|> a", "\x1c\x85 a", "1 2 3 4 5 6"]


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(["a", "bc", " ", "  ", "\n", "1", "'s", "é", "\x1c", "　", "<|endoftext|>", "²", ".", "\r"]) for _ in range(60)) for _ in range(200)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(docs(spark, texts), batch_bytes=100).collect()}
    assert got == {k: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for k, x in enumerate(texts)}
    assert tokens.token_counts(docs(spark, ODD).limit(0)).count() == 0


def test_token_counts_of_other_vocabularies(spark, tmp_path):
    """Vocabularies whose splitting is not the usual one count whole texts; long texts count as the library counts them."""
    import public_tokenizers
    from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

    usual = public_tokenizers.path("byte_bpe_50k.json")
    line_ends = Tokenizer.from_file(usual)  # punctuation takes the line ends after it
    split = pre_tokenizers.Split(Regex(r" ?[^\s\p{L}\p{N}]+[\r\n]*|\s+|[^\s\p{P}]+"), "isolated")
    line_ends.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    none = Tokenizer.from_file(usual)
    none.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    lower = Tokenizer.from_file(usual)
    lower.normalizer = normalizers.Replace(Regex(r"\s+"), " ")
    texts = ["a.\n\nb, \n c", "the end.\n\n\nA  b" * 50, "new york new york\n\n", None, "x" * 400_000, "é日 " * 100_000]
    for k, t in enumerate((line_ends, none, lower, Tokenizer.from_file(usual))):
        t.save(str(tmp_path / f"{k}.json"))
        few = texts if k == 3 else texts[:4]
        got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs(spark, few), str(tmp_path / f"{k}.json")).collect()}
        assert got == {i: len(t.encode(x or "", add_special_tokens=False)) for i, x in enumerate(few)}


def test_mixing(spark):
    rng = random.Random(2)
    texts = ODD + [words(rng, rng.randrange(1, 60)) for _ in range(1500)]
    sources = {k: rng.choice(["big"] * 6 + ["a", "é", "", None, "z"]) for k in range(len(texts))}
    df = docs(spark, texts, sources=sources).repartition(5)
    rows = mixing.mix(df).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.coalesce(1)).collect())) and len(rows) == len(texts)  # reruns agree
    by = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        by.setdefault(r["source"], []).append(r)
    names = sorted(x for x in by if x is not None) + [None]
    size = {s: sum(r["size"] for r in by[s]) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = 1.5 * sum(size.values())
    while True:  # the excess is shared again until no source is above
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit > 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    target |= {s: weight[s] * unit for s in open_}
    for s in names:
        assert by[s][0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= 60
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_prefers_long_documents(spark):
    """The second copy of a document: likelier the longer it is, never sure, and as the ranking by brute force has it."""
    rng = random.Random(18)
    texts = [words(rng, 10 if k % 2 else 90) for k in range(800)]
    rows = mixing.mix(docs(spark, texts), weights=(1,), share=0.5).collect()
    size = {r["doc_id"]: r["size"] for r in rows}
    total, mean = sum(size.values()), sum(size.values()) / 800
    u = {k: (int(hashlib.md5(f"mix:{k}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52) for k in size}
    want, held = set(), 0
    for k in sorted(size, key=lambda k: u[k] / (1 - u[k]) / (size[k] / mean)):
        if 2 * (held + size[k]) - size[k] > total:
            break
        held += size[k]
        want.add(k)
    got = {r["doc_id"] for r in rows if r["taken"]}
    assert got == want
    long, short = sum(k % 2 == 0 for k in got), sum(k % 2 for k in got)
    assert 3 * short < long < 400 and short > 0


def test_warc(spark, tmp_path):
    long = "<p>" + "é" * 100 + "\r\n\r\nWARC/1.1</p>"
    pages = [(5, "http://a/x y\n", long), (3, None, long), (9, "u", long), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "z" * 100), (None, "u", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.deduplicated_archive(df, str(tmp_path / "w"))
    got = {(r["record_id"]): tuple(r)[1:5] for r in warc.with_originals(warc.read(spark, str(tmp_path / "w"))).select("record_id", "record_type", "payload_bytes", "payload_digest", "refers_to").collect()}
    digest = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    n = len(long.encode())
    assert got == {
        3: ("response", n, digest(long), None), 5: ("revisit", n, digest(long), 3), 9: ("revisit", n, digest(long), 3), None: ("revisit", n, digest(long), 3),
        1: ("response", 0, digest(""), None), 2: ("response", 0, digest(""), None), 4: ("response", 5, digest("short"), None), 6: ("response", 5, digest("short"), None), 7: ("response", 100, digest("z" * 100), None),
    }
    seen = [h for f in (tmp_path / "w").glob("*.gz") for h, _ in warc.parse(gzip.open(f))]
    assert len(seen) == len(pages) and sum(h["warc-type"] == "revisit" for h in seen) == 3
    warc.deduplicated_archive(df.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_warc_other_ids_and_limits(spark, tmp_path):
    """Ids of strings, a payload limit of one's own, small files, columns named like the operator's."""
    pages = [("b <x>\n", "u", "same text", 1), ("a:%é", None, "same text", 2), ("", "u", "tiny", 3), ("c", "u", "tiny", 4), (None, "u", "same text", 5), ("d", "u", "long " * 50_000, 6), ("d", "u", "long " * 50_000, 6)]
    df = spark.createDataFrame(pages, "page_id string, url string, html string, first long").withColumn("digest", F.lit("x")).withColumn("record_id", F.lit(0))
    warc.deduplicated_archive(df, str(tmp_path / "w"), min_payload=5, file_bytes=2000)
    rows = warc.with_originals(warc.read(spark, str(tmp_path / "w"), "string"), 5).collect()
    got = sorted(((r["record_id"], r["record_type"], r["payload_bytes"], r["refers_to"]) for r in rows), key=str)
    assert got == sorted(
        [("a:%é", "response", 9, None), ("b <x>\n", "revisit", 9, "a:%é"), (None, "revisit", 9, "a:%é"), ("", "response", 4, None), ("c", "response", 4, None), ("d", "response", 250_000, None), ("d", "response", 250_000, None)], key=str
    )
    heads = [h for f in (tmp_path / "w").glob("*.gz") for h, _ in warc.parse(gzip.open(f))]
    assert all(re.fullmatch(r"20\d\d-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["warc-date"]) for h in heads) and len(list((tmp_path / "w").glob("*.gz"))) > 2


def test_main_text(spark):
    page = lambda k, extra="": (
        f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a>Menu</a></nav><div class='ad'>Buy {k}</div><div class='cookie-notice'>We use</div>"
        f"<article><h1>Head {k}</h1><p><b>One  &amp; {k}<br><p>Two\n{k}{extra}</article><div id=comments>Nice</div><aside>Side</aside><script>x('</p>')</script><footer>Foot</footer></body></html>"
    )
    rows = [(k, "http://h.test/a" if k < 4 else None, page(k)) for k in range(6)] + [(6, "bad url", None), (7, "http://h.test/b", "<p>plain"), (7, "http://h.test/b", "<p>plain")]
    got = template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 9 and all(text[k] == f"Head {k}\n\nOne & {k}\n\nTwo {k}" for k in range(6)) and text[6] == "" and text[7] == "plain"
    # without an article: stretches that the host repeats are template, the rest is text
    rows = [(k, "http://g.test/", f"<body><div>Site name</div><p>Story {k}</p><div>All rights</div></body>") for k in range(5)]
    assert {r["text"] for r in template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {f"Story {k}" for k in range(5)}


def test_main_text_template_in_article(spark):
    page = lambda k, body: (k, "http://n.test/", f"<body><article><h1>Head {k}</h1>{body}<div class=box7><p>Join our club</p></div><p>Shared passage</article></body>")
    rows = [page(k, f"<p>Story {k} of some length</p>" + f"<p>More {k}</p>" * (k % 3)) for k in range(6)]
    copies = [(k, "http://c.test/", "<article><h1>One title</h1><div class=part><p>One whole story</p></div></article>") for k in range(10, 14)]
    got = template.extract(spark.createDataFrame(rows + copies, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"].split("\n\n") for r in got}
    for k in range(6):
        assert text[k] == [f"Head {k}", f"Story {k} of some length", *[f"More {k}"] * (k % 3), "Shared passage"]
    assert all(text[k] == ["One title", "One whole story"] for k in range(10, 14))


def test_main_text_meaningless_names(spark):
    """No element or class name tells anything: only what the host's pages share separates the text."""
    page = lambda k: (
        k, "http://q.test/", f"<body><div class=q1><p>Home of qq</p><p>Go on</p></div><div class=q2><div class=q3>Words of today</div><p>Story {k} begins</p>"
        + "".join(f"<p>It goes on {k} {j}</p>" for j in range(k % 4)) + "<div class=q4>Write to us</div></div><div class=q5>All rights</div></body>"
    )
    got = template.extract(spark.createDataFrame([page(k) for k in range(8)], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: "\n\n".join([f"Story {k} begins", *(f"It goes on {k} {j}" for j in range(k % 4))]) for k in range(8)}


def test_equivalence_classes(spark):
    """Classes are the tokens with equal occurrence vectors, as a comparison of all vectors finds them."""
    rng = random.Random(17)
    pieces = ["<b>", "</b>", "<p>", "</p>", "<i class=a>", "one", "two", "<div id=x>", "<br>", "three"]
    pages = [(k, f"h{k % 3}" if k % 7 else None, "".join(p * rng.choice([1, 1, 1, 2, 0]) + f"<u id=n{rng.randrange(30)}>" for p in pieces)) for k in range(24)]
    got = {}
    for r in template.templates(spark.createDataFrame(pages, "id long, host string, html string").repartition(5)).collect():
        got[r["of"]] = sorted(sorted(c["tokens"]) for c in r["classes"])
    want = {}
    for host in {h for _, h, _ in pages}:
        found = [template.occurrences(html) for _, h, html in pages if h == host]
        by = {}
        for token in set().union(*found):
            vector = tuple(f[token] for f in found)
            if sum(map(bool, vector)) >= max(template.MIN_PAGES, template.SUPPORT * len(found)):
                by.setdefault(vector, []).append(token)
        if classes := sorted(sorted(x) for x in by.values() if len(x) >= template.MIN_CLASS):
            want[host] = classes
    assert got == want and want


def test_template_nesting():
    page = list(template.tokens("<a><b><c></c></b></a><d><e></d></e>"))
    keys = [template.key_of(*t) for t in page]
    outer, inner, cross = [keys[0], keys[5]], [keys[1], keys[4]], [keys[2], keys[6]]
    of = lambda *classes: template.template_tokens(page, [{"tokens": c} for c in classes])
    assert page[0][1] == "a" and set(of(outer, inner)) == {0, 1, 4, 5}
    assert set(of(inner, outer)) == {0, 1, 4, 5}
    assert set(of(outer, cross)) == {0, 5}  # begins in a slot of the first and ends outside
    assert template.nests((1, 9), (3, 5)) and template.nests((3, 5), (1, 9)) and not template.nests((1, 5), (3, 9)) and not template.nests((1, 4, 9), (3, 5))


def test_main_text_names_in_article(spark):
    page = lambda k, extra="": (
        k, "http://w.test/", f"<body><article><header class='entry-header'><h1>Title {k}</h1></header><h2 id=related-work>Prior work {k}</h2><p>Long story {k} at <span class=share-price>1{k}</span>."
        f"</p>{extra}<div class=ad>Buy {k}</div><div class=share-links><p>Links {k}</p></div></article></body>"
    )
    rows = [page(k, "<h2 id=search>Search</h2><section id=share-prices><p>Prices fell</p></section>" if k == 1 else "") for k in range(4)]
    rows.append((9, "http://one.test/", "<article><div class=entry-header><h1>Title</h1></div><section id=alert-levels><p>Levels</p></section><div class=comments>Nice</div></article>"))
    got = template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"].split("\n\n") for r in got}
    for k in range(4):
        assert text[k] == [f"Title {k}", f"Prior work {k}", f"Long story {k} at 1{k}.", *(["Search", "Prices fell"] if k == 1 else [])]
    assert text[9] == ["Title", "Levels"]


def brute_hits(texts, items, n=10):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    found = {i: [w[k : k + n] for k in range(max(1, len(w) - n + 1))] for i, t in items if (w := split(t))}
    for t in texts:
        w, hit, ids = split(t), set(), set()
        for i, windows in found.items():
            for x in windows:
                for k in range(len(w) - len(x) + 1):
                    if w[k : k + len(x)] == x:
                        hit.update(range(k, k + len(x)))
                        ids.add(str(i))
        yield len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("small", [decontaminate.SMALL, 0], ids=["sent", "shuffled"])
def test_decontamination(spark, monkeypatch, small):
    monkeypatch.setattr(decontaminate, "SMALL", small)
    rng = random.Random(3)
    items = [(10, words(rng, 30, 50)), (9, "ÉCOLE Ünd b"), (8, None), (7, "..."), (6, "école"), (None, "w1 w2")]
    items.append((5, items[0][1]))
    texts = [*ODD, words(rng, 300, 50), f"a {items[0][1].upper()} b {items[0][1]}", items[0][1][10:], "x École ünd ÉCOLE Ünd B", "ÉCOLE", "école école", *["w1 w2 w3"] * 3]
    got = decontaminate.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(k, *x) for k, x in enumerate(brute_hits(texts, [x for x in items if x[0] is not None]))]
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in got) == want
    odd = docs(spark, texts).withColumns({c: F.lit("x") for c in ("mark", "words", "at", "start", "wid", "hit_id")}).withColumn("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")))
    wide = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, len long")
    assert sorted((r["n_words"], r["n_hit"], list(r["item_ids"])) for r in decontaminate.contamination(odd, wide).collect()) == sorted(x[1:] for x in want)
    none = decontaminate.contamination(docs(spark, texts), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == len(texts)


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["vexgrub", "zuckmold", "plonkwit", "jabbersnipe"]
    def text(toxic):
        w = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(60)]
        for _ in range(4 if toxic else 0):
            w.insert(rng.randrange(60), rng.choice(bad))
        return " ".join(w)
    y = [k % 3 == 0 for k in range(400)]
    df = docs(spark, [text(x) for x in y] + [None, ""])
    labels = spark.createDataFrame([(k, int(x)) for k, x in enumerate(y)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels.where("doc_id < 300 or doc_id is null"))
    got = {r["doc_id"]: r for r in toxicity.classify(df, model).collect()}
    held = range(300, 400)
    assert sum(got[k]["predicted"] for k in held if y[k]) >= 0.9 * sum(y[300:]) and not any(got[k]["predicted"] for k in held if not y[k])
    assert got[400]["predicted"] == got[401]["predicted"] == 0 and 0 <= got[400]["score"] <= 1
    empty = toxicity.fit(df, labels.limit(0))
    assert {r["score"] for r in toxicity.classify(df, empty).collect()} == {0.0}


def test_toxic_dictionary_holds_every_telling_word():
    rng = random.Random(12)
    plain = lambda: [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(40)]
    bad = [f"zz{k:03d}{rng.randrange(10**9):09d}" for k in range(300)]  # 4,500 bytes
    toxic = [" ".join([*plain(), *(bad[(k * 15 + j) % 300] for j in range(15))]) for k in range(400)]
    found = toxicity.train([" ".join(plain()) for _ in range(2000)], toxic, 1 << 16, 2 << 10)[1]
    assert [w for w in bad if f" {w} ".encode() not in found] == []


def test_toxicity_learns_from_all_labelled_texts(spark, monkeypatch):
    """A telling word of the last documents counts, however many labelled ones there are, whether ids are sent or joined."""
    rng = random.Random(23)
    texts = [f"{words(rng, 12)} {'vexgrub' if k % 2 else 'calm'}" for k in range(5200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(5200)], "doc_id long, toxic int")
    df = docs(spark, texts)
    seen = toxicity.counted(toxicity.labelled(df, labels, "doc_id", "text", "toxic", None, None)).where("window in ('vexgrub', 'calm')").collect()
    assert {r["window"]: (r["n00"] + r["n01"], r["n10"] + r["n11"]) for r in seen} == {"vexgrub": (0, 2600), "calm": (2600, 0)}
    sent = toxicity.fit(df, labels)
    monkeypatch.setattr(toxicity, "SENT", 0)
    assert toxicity.fit(df, labels) == sent and sent.score("vexgrub") >= toxicity.CUT > sent.score("calm")


def test_ranked_value(spark):
    values = [float(x) for x in (-3, -3, 0, 1e-12, 2, 2, 2, 700)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert [toxicity.ranked_value(df, k) for k in range(8)] == sorted(values, reverse=True)


def brute_components(texts):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if a and 100 * o >= 75 * (len(a) + len(sets[j]) - o):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {k: (len(s), label[k]) for k, s in enumerate(sets)}


def test_jaccard_join(spark):
    rng = random.Random(6)
    texts = list(ODD)
    for _ in range(8):  # families whose members differ by chains of edits, some more than a quarter
        w = words(rng, 90).split()
        for _ in range(14):
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    line = words(rng, 12)
    texts += [f"{line} {words(rng, rng.randrange(1, 8))}" for _ in range(40)] + [texts[20]] * 5
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(spark, texts).repartition(3)).collect()}
    assert got == brute_components(texts)
    assert jaccard.jaccard_components(docs(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("small", [jaccard.SMALL, 2])
def test_jaccard_join_long_blocks(spark, monkeypatch, small):
    """Blocks of more rows than a part holds, hot shingles dealt to several tasks, and a hot block of unlike documents."""
    monkeypatch.setattr(jaccard, "HOT", 10)
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng = random.Random(16)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for k in range(150):  # chains: only neighbours are similar enough
        w = base.copy()
        for j in range(k, k + 7):
            w[j % 60] = f"x{j}"
        texts.append(" ".join(w))
    line = [f"line{k}" for k in range(40)]
    texts += [" ".join([*line, *(f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(8, 16)))]) for _ in range(90)]
    texts += ["s t u v w x"] * 30 + [" ".join([*line, "tail", str(k)]) for k in range(30)]
    rng.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(spark, texts).repartition(3), block=8).collect()}
    assert got == brute_components(texts)


def test_jaccard_join_lists_a_copied_set_once(spark):
    """Copies in different tasks are one set of the forest, and still all linked."""
    rng = random.Random(31)
    one, other = words(rng, 60, 4000), words(rng, 60, 4000)
    texts = [one] * 12 + [one + " more"] * 8 + [other] * 5 + [None, "", words(rng, 60, 4000)]
    df = docs(spark, texts).repartition(6)
    rows = df.select(F.col("doc_id").alias("id"), "text")
    whole = jaccard.stored(jaccard.described(rows, {}, 75).withColumn("row", F.monotonically_increasing_id()), "described")
    spare = jaccard.spare_rows(whole.select("row", "id", "n", "digest", F.col("point").isNotNull().alias("first")))
    assert whole.where("point is not null").count() > 4
    assert whole.where("point is not null").join(spare, "row", "left_anti").count() == 4
    assert jaccard.prefixes(whole, spare, 75).select("id").distinct().count() <= 4
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert got == dict(enumerate([0] * 20 + [20] * 5 + [25, 26, 27]))


def test_jaccard_join_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b + " z"), (4, c), (None, c), (5, None), (4, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 26, 1), (2, 26, 1), (2, 26, 1), (3, 27, 1), (4, 26, 4), (None, 26, None), (5, 0, 5), (4, 26, 4)], key=str)


def test_count_vector_trees():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 60, rng.integers(20, 90), dtype=np.uint64)) for _ in range(150)]
    for k in range(150):  # near copies
        kept = sets[k][rng.random(len(sets[k])) > 0.1]
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 60, 4, dtype=np.uint64)])))
    n, points = np.array([len(s) for s in sets]), [jaccard.point(jaccard.counts_of(s)) for s in sets]
    every = np.arange(len(sets))
    got = {(int(i), int(j)) for i, j in zip(*jaccard.candidates(every, every, n, points, 75)[:2])}
    for i in every:
        for j in every:
            same = len(np.intersect1d(sets[i], sets[j]))
            if 100 * same >= 75 * (n[i] + n[j] - same):
                assert (i, j) in got
    assert len(got) < 3 * len(sets)  # and little else
    tree = jaccard.CountVectorTree(np.array([p for p in points if len(p) == 32]), n[[len(p) == 32 for p in points]])
    assert len(tree.levels) == 2 and all((np.maximum.reduceat(tree.levels[0][0], np.arange(0, len(tree.order), jaccard.FANOUT)) == tree.levels[1][0]).ravel())


def test_top_k(spark):
    rng = np.random.default_rng(2)
    data = [rng.normal(size=16).astype(np.float32).tolist() for _ in range(300)] + [None, [1.0, None], [float("nan")] * 16, [float("inf")] * 16]
    data += [data[0]] * 12
    df = spark.createDataFrame([(k, v, "x") for k, v in enumerate(data)], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in bitsliced.top_k(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {k: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for k, v in enumerate(data) if v and None not in v and np.isfinite(v).all()}
    want = {}
    for q in (k for k in whole if k % 50 == 0):
        best = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q)[:10]
        want[q] = [(r + 1, k, -s) for r, (s, k) in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == want
    few = bitsliced.top_k(df.where("vec_id < 3"), df.where("vec_id = 0")).collect()
    assert len(few) == 2 and bitsliced.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_uneven_vectors(spark, monkeypatch):
    """Lengths differ, large components, ties, several lanes and query blocks; what cannot be summed takes no part."""
    monkeypatch.setattr(bitsliced, "LANE", 40)
    monkeypatch.setattr(bitsliced, "QUERIES", 3)
    rng = np.random.default_rng(3)
    data = [(rng.normal(size=rng.integers(1, 9)) * 10.0 ** rng.integers(0, 6)).tolist() for _ in range(150)] + [[1.0, 0.0]] * 20 + [[1e30], [1e15, 1.0], [], [-1e300]]
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(data)] + [(None, [1.0], 1), (0, [9.0, 1.0], 1)], "vec_id long, embedding array<double>, lane int").repartition(4)
    rows = [(k, v) for k, v in enumerate(data) if v and max(map(abs, v)) < 1e14] + [(0, [9.0, 1.0])]
    whole = [(k, [math.floor(1024 * x) for x in v]) for k, v in rows]
    got = {}
    for r in bitsliced.top_k(df, df.where("vec_id % 10 = 0"), k=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for q in {k for k, _ in rows if k % 10 == 0}:
        asked = whole[[k for k, _ in rows].index(q)][1] if q else min((v, w) for (k, v), (_, w) in zip(rows, whole) if k == 0)[1]
        best = sorted((-sum(a * b for a, b in zip(asked, v)), k) for k, v in whole if k != q)[:7]
        want[q] = [(r + 1, k, -s) for r, (s, k) in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_language_id(spark):
    rng = random.Random(8)
    parts = {"xx": ["lor", "em", "ips", "um"], "yy": ["kra", "zok", "tuk", "vex"]}
    texts, langs = [], {}
    for k in range(200):
        langs[k] = rng.choice(list(parts))
        texts.append(" ".join("".join(rng.choice(parts[langs[k]]) for _ in range(rng.randrange(1, 4))) for _ in range(20)))
    model = langid.fit(docs(spark, texts[:120], langs))
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, [*texts, None, "12 !", "日本"]), model).collect()}
    assert all(got[k]["lang_pred"] == langs[k] for k in range(120, 200))
    assert got[200]["lang_pred"] == got[201]["lang_pred"] == "und" and got[202]["lang_pred"] in parts
    assert langid.identify(docs(spark, ["a"]), langid.fit(docs(spark, ["a"]).limit(0))).first()["lang_pred"] == "und"


def lattice_total(model, s):
    """Probability of s over all its segmentations, one by one."""
    if not s:
        return 1.0
    out = 0.0
    for j in range(1, len(s) + 1):
        p = model.pieces.get(s[:j])
        if p is not None:
            out += math.exp(model.logp[p]) * lattice_total(model, s[j:])
        elif j == 1:
            out += math.exp(model.spelled(s[0])) * lattice_total(model, s[1:])
    return out


def brute_language(train, text, longest=4):
    """Word-first backoff spelled out: language and score of a text, learnt from (lang, text) rows."""
    split = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    langs = sorted({lang for lang, _ in train})
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0
    seen = {lang: [Counter() for _ in range(longest + 1)] for lang in langs}
    for lang, t in train:
        for w in split(t):
            seen[lang][0][w] += 1
            for n in range(1, longest + 1):
                marked = f"\x01{w}\x01"
                seen[lang][n].update(g for k in range(len(marked) - n + 1) if (g := marked[k : k + n]) != "\x01")
    rate = lambda lang, n, g: max(-7.0, math.log10(seen[lang][n][g] / sum(seen[lang][n].values()))) if seen[lang][n][g] else -7.0
    total, known = dict.fromkeys(langs, 0.0), 0
    for w in split(text):
        marked = f"\x01{w}\x01"
        tries = [(0, [w])] + [(n, [marked[k : k + n] for k in range(len(marked) - n + 1)]) for n in range(min(longest, len(marked)), 0, -1)]
        for n, found in tries:
            found = [g for g in found if any(seen[lang][n][g] for lang in langs)]
            if found:
                known += 1
                for lang in langs:
                    total[lang] += sum(rate(lang, n, g) for g in found) / len(found)
                break
    if not known:
        rows = Counter(lang for lang, _ in train)
        return min(langs, key=lambda x: (-rows[x], x)), 1 / len(langs)
    best = min(langs, key=lambda x: (-total[x], x))
    return best, 1 / sum(10 ** ((total[x] - total[best]) / known * min(known, 20)) for x in langs)


def test_language_id_by_brute_force(spark):
    rng = random.Random(19)
    parts = {"en": ["th", "e", "ing", "or"], "eng": ["th", "e", "ung", "ar"], "fr": ["é", "que", "ou"]}
    train = [(lang, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(12))) for lang in parts for _ in range(8)]
    texts = [*(x for x in ODD if x is None or len(x) < 5000), "zz ww", "The!Ing theor_queé", "x" * 5000 + " que", *(" ".join(rng.choice(sum(parts.values(), [])) + rng.choice("eéx") for _ in range(9)) for _ in range(25))]
    known = spark.createDataFrame([(k, lang, t, 1) for k, (lang, t) in enumerate(train)] + [(99, "fr", None, 1), (98, None, "the", 1)], "doc_id long, lang string, text string, score int")
    model = langid.fit(known)
    for r in langid.identify(docs(spark, texts), model).collect():
        lang, score = brute_language(train, texts[r["doc_id"]])
        assert (r["lang_pred"], r["score"]) == (lang, pytest.approx(score)), texts[r["doc_id"]]
    assert model.predict("日本")[0] == "en"  # as many rows as eng; the smaller name


def test_lm_scores(spark, monkeypatch):
    rng = random.Random(9)
    texts = [*(x for x in ODD if x is None or len(x) < 5000), *[words(rng, 40) for _ in range(60)], "Hello w1 éa 日x"]
    df = docs(spark, texts).repartition(3)
    learns = [zlib.crc32(str(k).encode()) % 7 != 2 for k in range(len(texts))]
    learnt = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    split = {k: lattice.words_of(t) for k, t in enumerate(texts)}
    c = Counter(w for k, x in enumerate(learns) if x for w in split[k])
    c[None] = sum(learns)
    n, v = sum(c.values()), len(c)
    model = lattice.load_vocabulary("piece_bpe_32k.model")
    known = {w: lattice_total(model, lattice.MARK + w) for w in {w for x in split.values() for w in x}} | {None: math.exp(model.logp[-1])}
    for frequent in (20, 0):  # words that travel, and words that are joined
        monkeypatch.setattr(lattice, "FREQUENT", frequent)
        got = {r["doc_id"]: r for r in lattice.lm_scores(df, learnt).collect()}
        assert len(got) == len(texts)
        for k in range(len(texts)):
            w = [*split[k], None]
            assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
            assert got[k]["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
            assert got[k]["score"] == pytest.approx(sum(math.log10((c[x] + v * known[x]) / (n + v)) for x in w))
    assert np.exp(model.logp).sum() == pytest.approx(1)
    none = lattice.lm_scores(df, F.lit(False)).where("doc_id = 3").first()
    assert none["n_known"] == none["train_tokens"] == 0 and none["base_score"] == 0
    assert none["score"] == pytest.approx(math.log10(known["a"] * known[None]))
    assert lattice.lm_scores(df.limit(0), learnt).count() == 0


def test_lm_long_runs():
    model = lattice.load_vocabulary("piece_bpe_32k.model")
    run = "abcde" * 40_000  # one word of 200,000 characters
    got = model.word_scores([run, "abcde" * 3, *["zz" + "y" * 100] * 20])
    assert np.isfinite(got).all() and got[0] < got[1] < 0
    assert got[1] == pytest.approx(math.log(lattice_total(model, lattice.MARK + "abcde" * 3))) and len(set(got[2:])) == 1


def test_stages(spark):
    rng = random.Random(10)
    base = words(rng, 60)
    texts = [base, base, base + " tail", words(rng, 60), None, "12 3", *[words(rng, 60) for _ in range(20)]]
    df = docs(spark, texts)
    kept = stages.known_language(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [k for k in range(len(texts)) if k not in (4, 5)]
    once = stages.one_of_each_group(df.union(df.where("doc_id = 3")))
    assert once.columns == df.columns and sorted(r["doc_id"] for r in once.collect()) == [k for k in range(len(texts)) if k not in (1, 2)]
    clean = stages.not_contaminated(df, spark.createDataFrame([(1, " ".join(texts[3].split()[20:35]))], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in clean.collect()) == [k for k in range(len(texts)) if k != 3]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert stages.not_toxic(df, labels).count() == len(texts)
    assert stages.mixed(df).where("taken > 2 * size or taken <= 0").count() == 0


def test_pages_of_odd_shape(spark):
    """Extra columns named like the operator's, repeated rows, null ids, very long pages and words, empty tables."""
    long = "<p>" + "word " * 200_000 + "</p><p>" + "x" * 500_000 + "</p>" + "<b>" * 20_000
    rows = [(1, "http://a.test/", f"<article>{long}</article>", "x", 1, 2), (None, "http://a.test/", "<article><p>No id</article>", "x", 1, 2), (2, None, None, "x", 1, 2), (3, "http://a.test/", "", "x", 1, 2), (3, "http://a.test/", "", "x", 1, 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, classes long, text long")
    got = template.extract(df).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 5 and text[None] == "No id" and text[2] == text[3] == ""
    assert text[1] == ("word " * 200_000).strip() + "\n\n" + "x" * 500_000
    assert template.extract(df.limit(0)).count() == 0


def test_toxicity_of_odd_tables(spark):
    rng = random.Random(20)
    texts = [f"{words(rng, 50)} {'vexgrub ' * (k % 2)}" for k in range(60)] + [None, "", "vexgrub " * 50_000, "y" * 300_000]
    df = docs(spark, texts).withColumns({c: F.lit(1) for c in ("toxic", "half", "draw", "score", "before")})
    labels = spark.createDataFrame([(k, k % 2, "x", 1) for k in range(60)] + [(0, 0, "x", 1), (None, 1, "x", 1), (5, None, "x", 1), (999, 1, "x", 1)], "doc_id long, toxic int, text string, draw int")
    model = toxicity.fit(df, labels, sample_chars=9000)  # about half of the texts of each class
    got = toxicity.classify(df.union(df.where("doc_id = 3")), model).collect()
    assert len(got) == 65 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= toxicity.CUT) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert toxicity.classify(df.limit(0), model).count() == 0
    one_class = toxicity.fit(df, labels.where("toxic = 1"))
    assert {r["predicted"] for r in toxicity.classify(df, one_class).collect()} == {0}


def test_other_operators_of_odd_tables(spark):
    """Extra columns named like the operators', null ids, very long texts."""
    texts = ["a b c", "word " * 100_000, "x" * 300_000, None]
    df = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    mixed = mixing.mix(df.withColumns({c: F.lit(9) for c in ("size", "of", "rank", "bucket", "target", "edge", "documents")})).collect()
    assert len(mixed) == 4 and sum(r["size"] for r in mixed) == 100_004
    odd = df.withColumns({c: F.lit("q") for c in ("rid", "tf", "c", "base", "score", "learns")})
    assert {r["n_tokens"] for r in lattice.lm_scores(odd, F.col("doc_id") != 3).collect()} == {4, 100_001, 2, 1}
    linked = jaccard.jaccard_components(df.withColumns({c: F.lit("q") for c in ("n", "key", "hub", "label", "k", "point")})).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"]) for r in linked) == [(0, 1), (1, 1), (2, 1), (3, 0)]
