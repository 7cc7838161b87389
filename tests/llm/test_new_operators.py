"""Fill-in-middle, vector codes and sharding against brute force on small tables with nulls, ties, repeated rows and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiremill.llm import infill, sharding, vectorcodes
from quiremill.llm.queries import op11_infill, op12_vector_codes, op13_sharding


def texts(seed=3):
    r = random.Random(seed)
    lines = ["", "a", "Été straße", "𝒳𝒴 x", "two words\r", "　", "0123456", "01234567", "\x8a\x0a\x0b"]
    out = ["\n".join(r.choice(lines) for _ in range(r.choice([1, 2, 3, 9, 40]))) + r.choice(["", "\n"]) for _ in range(80)]
    return [*out, "", None, "\n", "\n\n", "no newline", "a <P> marker\nhere", "x<S>\n", "<M>", "<P\n><S\n>", "<\nP>\n", "line\n" * 60_000 + "é" * 100_000]


def infill_case(doc_id, text, seed=7, rate=100, spm=50, end="\n", marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(f"[^{end}]*{end}|[^{end}]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    p, s, m = marks
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(pre), len(mid), s + suf + p + pre + m + mid
    return len(units), "psm", len(pre), len(mid), p + pre + s + suf + m + mid


def test_infill_against_a_plain_loop(spark):
    rows = [*enumerate(texts()), (4, texts()[4]), (None, "no id\nhere"), (-7, "x\ny")]
    df = spark.createDataFrame([(i, t, "n", "f", 1) for i, t in rows], "doc_id long, text string, n string, `a.b` string, h1 int").repartition(3)
    for how in ({}, {"seed": 11, "rate": 40, "spm": 90}, {"end": "1", "markers": ("[pre]", "(suf)", "{mid}")}):
        want = Counter((i, *infill_case(i, t, **{k if k != "markers" else "marks": v for k, v in how.items()})) for i, t in rows)
        made = infill.infilled(df, keep=("a.b",), **how)
        again = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infill.restored(markers=how.get("markers", infill.MARKERS)).alias("back"), "`a.b`")
        got = again.collect()
        assert Counter(tuple(r)[:6] for r in got) == want
        assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in rows)
        assert {r["a.b"] for r in got} == {"f"}
    assert {form for _, _, form, *_ in want} == {"plain", "psm", "spm"}
    assert infill.infilled(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_infill_refuses_what_it_cannot_undo(spark):
    df = spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, n string")
    for how in ({"keep": ("n",)}, {"markers": ("<P>", "<<", "<M>")}, {"markers": ("<P>", "<P>", "<M>")}, {"end": "é"}):
        with pytest.raises(ValueError):
            infill.infilled(df, **how)


def test_word_marks_rank_and_select():
    r = np.random.default_rng(5)
    for n in (0, 1, 7, 8, 9, 64, 1000):
        data = r.choice(np.array([10, 11, 9, 138, 0, 0x8A, 0xC3], np.uint8), n)
        places = np.flatnonzero(data == 10)
        marks = infill.Marks(infill.equal_bytes(infill.as_words(data), 10))
        assert (marks.select(np.arange(1, len(places) + 1)) == places).all()
        assert (marks.rank(np.arange(n + 1)) == [(places < i).sum() for i in range(n + 1)]).all()
        inner = infill.Marks(infill.continuations(infill.as_words(data)))
        assert inner.rank(np.array([n]))[0] == ((data & 0xC0) == 0x80).sum()


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(key, code, error) for each usable row, the codebooks, and the error of each label."""
    kept = sorted(((i, [int(np.floor(1024 * np.float64(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    books = [[v[p * w : p * w + w] for _, v, _ in kept[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[near(v[p * w : p * w + w], books[p])[1]].append(v[p * w : p * w + w])
            books[p] = [[sum(c) // len(members[i]) for c in zip(*members[i], strict=True)] if i in members else e for i, e in enumerate(books[p])]
    out, labels = [], Counter()
    for i, v, label in kept:
        found = [near(v[p * w : p * w + w], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        labels[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, labels[label], digest) for i, c, e, label in out)


def test_vector_codes_against_all_entries(spark):
    r = random.Random(9)
    some = [[r.choice([-1, 1]) * r.random() for _ in range(8)] for _ in range(60)]
    rows = [(i, r.choice(some) if r.random() < 0.5 else [r.choice([-0.5, 0.0, 0.25]) for _ in range(8)], r.choice([1, 2, None])) for i in range(120)]
    rows += [(i, some[0], 7) for i in range(200, 260)]  # a vector that a third of all rows share
    rows += [(3, some[1], 1), (3, some[1], 1), (None, some[2], None), (500, None, 1), (501, [1.0] * 7 + [None], 1), (502, [float("nan")] * 8, 1), (503, [float("inf")] * 8, 2), (504, [-float("inf")] + [0.0] * 7, 2)]
    df = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], "vec_id long, embedding array<double>, label int, code string, `a.b` string").repartition(3)
    for how in ({"entries": 16}, {"entries": 40, "rounds": 2, "parts": 2}, {"entries": 256, "rounds": 1}):
        assert Counter(tuple(x) for x in vectorcodes.compressed(df, **how).collect()) == plain_codes(rows, **how)
    assert vectorcodes.compressed(df.where("vec_id >= 500")).count() == 0


def test_vectors_of_other_lengths_have_no_code(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0], 1), (3, [], 2), (4, [1.0, 2.0, 3.0, 5.0], None)], "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: (x.code, x.error, x.label_error) for x in vectorcodes.compressed(df).collect()}
    assert got == {1: ("00000000", 0, 0), 2: (None, None, 0), 3: (None, None, None), 4: ("00000001", 0, 0)}
    with pytest.raises(ValueError):
        vectorcodes.compressed(df.where("vec_id = 2"))


def test_orchard_search_is_exact():
    r = np.random.default_rng(1)
    for k, w, spread in ((1, 3, 9), (5, 1, 3), (64, 4, 2), (256, 16, 900), (200, 16, 1 << 20)):
        entries = r.integers(-spread, spread + 1, (k, w))
        points = np.concatenate([r.integers(-spread, spread + 1, (500, w)), entries])
        index, squared = vectorcodes.Orchard(entries).nearest(points)
        every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (squared == every.min(axis=1)).all()
    with pytest.raises(OverflowError):
        vectorcodes.Orchard(np.array([[1 << 30]])).nearest(np.array([[5]]))


def test_decoded_vectors_are_their_entries(spark):
    books = np.arange(24).reshape(2, 3, 4) * 1024
    df = spark.createDataFrame([("0002",), ("0100",), (None,)], "code string")
    got = [x[0] for x in df.select(vectorcodes.decoded("code", books)).collect()]
    assert got == [[*range(4), *range(20, 24)], [*range(4, 8), *range(12, 16)], None]


def checked_shards(got, n, shards):
    """Counts at most one apart, slots gapless from 0."""
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_hold_every_row_once(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["", None, "short", "é" * 50, "w " * r.randint(1, 400)]), "s", i) for i in range(900)] + [(5, "copy", "s", 0)] * 500 + [(None, None, "s", 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, `a.b` int").repartition(6)
    df.write.parquet(folder := sharding.shared_folder(spark))
    df = spark.read.parquet(folder)
    for how in ({}, {"shards": 7, "bucket_bytes": 5000}, {"shards": 2000}):
        out = sharding.sharded(df, **how)
        assert out.columns == ["doc_id", "text", "shard_input", "a.b", "shard", "slot"]
        got = out.collect()
        assert Counter(tuple(x)[:4] for x in got) == Counter(rows)
        checked_shards(got, len(rows), how.get("shards", 16))
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, sharding.sharded(df, **how).collect()), key=str)
    other = {(x.doc_id, x["a.b"]): (x.shard, x.slot) for x in sharding.sharded(df, seed=14).collect()}
    first = {(x.doc_id, x["a.b"]): (x.shard, x.slot) for x in sharding.sharded(df).collect()}
    assert sum(first[k] == other[k] for k in first) < 20
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_rows_go_to_many_buckets(spark):
    """A third of a table being one row doesn't fill one bucket: the input split is part of the hash."""
    df = spark.range(3000).repartition(30).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows, n = sharding.shuffled(df, bucket_bytes=20_000)
    sizes = [x["count"] for x in rows.groupBy("bucket").count().collect()]
    assert n == 20 and sum(sizes) == 3000 and len(sizes) > 10 and max(sizes) <= 600


def test_fisher_yates_is_even():
    assert sorted(sharding.fisher_yates(1000, 1, 2)) == list(range(1000)) and len(sharding.fisher_yates(0, 1)) == 0
    seen = Counter(tuple(sharding.fisher_yates(4, s)) for s in range(4800))
    assert len(seen) == 24 and all(120 < n < 290 for n in seen.values())


def test_shard_files_are_in_the_order_of_slots(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    path = sharding.write(df, shards=4, bucket_bytes=4000)
    back = spark.read.parquet(path)
    assert back.count() == 200 and sorted(x.doc_id for x in back.select("doc_id").collect()) == list(range(200))
    files = defaultdict(list)
    for x in back.select(F.input_file_name().alias("f"), "slot").collect():
        files[x.f].append(x.slot)
    assert all(v == sorted(v) for v in files.values())


def test_queries_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op13_sharding(spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in got} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for i, t in docs.items()}
    checked_shards(got, len(docs), 16)
    for r in op11_infill(spark, sf).collect():
        n, form, pre, mid, out = infill_case(r.doc_id, docs[r.doc_id])
        assert tuple(r)[1:] == (n, form, pre, mid, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest())
    assert op12_vector_codes(spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
