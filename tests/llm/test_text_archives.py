"""Spelling variants, WARC archives and Merkle manifests against brute force, on odd rows."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import merkle, spelling, warc

from .test_operators import SCHEMA, odd_rows

# Spelling variants


def brute_words(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 6
    return {w: k for w, k in n.items() if k >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_variants(rows):
    n, out = brute_words(rows), {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 5 * n[w] else None, len(near))
    rows = []
    for w, (form, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n[w], k, n[form] if form else None))
    return rows


def found_variants(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit(1)).withColumn("n", F.lit("x")).withColumn("run", F.lit("y"))
    return [tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_variants_of_few_letters(spark):
    """Words of two or three letters, so that grams recur inside words and many words are near."""
    r = np.random.RandomState(5)
    pool = ["".join(r.choice(list("abé"), r.randint(5, 9))) for _ in range(500)] + ["a" * k for k in range(5, 12)] + ["ab" * k for k in range(3, 6)]
    p = 1 / np.arange(1, len(pool) + 1)
    rows = [(i, " ".join(r.choice(pool, 300, p=p / p.sum())) + (" ÀÉabab×÷ Äbaaba" * 3), "en", "a", None) for i in range(60)]
    want = brute_variants(rows)
    assert sum(w[1] is not None for w in want) > 10 and max(w[4] for w in want) > 5
    assert sorted(found_variants(spark, rows), key=str) == sorted(want, key=str)


def test_variants_send_no_table_to_the_driver(spark, monkeypatch):
    """Sizes are told of compressed files, and of a table before its rows are multiplied: no join may go by them."""
    plans, written = [], spelling.written
    monkeypatch.setattr(spelling, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    rows = [(i, "banana bananas banane ananas " * 5, "en", "a", None) for i in range(9)]
    last = spelling.variants(spark.createDataFrame(rows, SCHEMA))
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_variants_of_odd_rows(spark):
    long = "wörterbuch " * 6 + "x" * 100_000 + " " + "Wörterbush " * 40 + "ORANGES oranges orangesÉ " * 5
    rows = [*odd_rows(), (20, long, "de", "a", 1), (20, long, "de", "a", 1), (None, "missing " * 30 + "misssing " * 5, None, None, None), (21, ("z" * 29_999 + " ") * 5 + ("z" * 30_000 + " ") * 5 + ("ab" * 300 + "c" + "ab" * 100 + " ") * 5 + ("ab" * 300 + "d" + "ab" * 100 + " ") * 6 + ("ab" * 400 + " ") * 5, None, None, None)]
    assert sorted(found_variants(spark, rows), key=str) == sorted(brute_variants(rows), key=str)
    assert found_variants(spark, []) == [] and found_variants(spark, [(1, None, None, None, None), (2, "", None, None, None)]) == []


def test_pivots_are_the_lightest_disjoint_grams():
    r = np.random.RandomState(2)
    for _ in range(300):
        ahead, behind = ({int(k): int(r.randint(1, 9)) for k in sorted(r.choice(12, 3, replace=False) + shift)} for shift in (0, 2))
        if max(behind) < min(ahead) + 2:
            continue
        a, b = spelling.pivots([*ahead.items()], [*behind.items()])
        assert b >= a + 2 and ahead[a] + behind[b] == min(u + v for x, u in ahead.items() for y, v in behind.items() if y >= x + 2)


def test_a_prefix_counts_equal_grams_from_both_ends():
    assert spelling.prefix("aaaaaa", {"aa": 0}) == ([0, 1, 2], [2, 3, 4], (0, 2))
    assert spelling.prefix("xaaaay", {"aa": 1, "xa": 0, "ay": 2}) == ([0, 1, 2], [0, 2, 3], (1, 1))


# WARC


PAGES = "page_id long, url string, html string"


def odd_pages():
    big, same = "é" * 700_000 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", "<p>same</p>" * 100
    return [
        (1, "http://a.example/", same), (7, "http://b.example/x y\r\nWARC-Type: no", same), (3, None, same), (None, "http://c.example/", same), (7, "http://b.example/2", same), (4, "http://d.example/ü", big), (5, "", big + "x"),
        (6, "http://e.example/", None), (8, "http://f.example/", ""), (9, "http://g.example/", "short"), (10, "http://g.example/", "short"), (11, "h", "a" * 999), (12, "h", "a" * 999), (13, "h", "a" * 1000), (14, "h", "a" * 1000), (15, "h", "é" * 500), (16, "h", "é" * 500),
        (17, "h", "\x1f\x8b WARC/1.1\r\n" * 90), (None, None, "n" * 2000), (None, None, "n" * 2000), (18, "h", big),
    ]


def brute_pages(rows):
    best, out = {}, []
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            best[html] = max(best.get(html, i), i)
    for i, _, html in rows:
        raw, keep = (html or "").encode(), best.get(html)
        revisit = keep is not None and keep != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", keep if revisit else None, True))
    return out


@pytest.fixture(scope="module")
def manifest(spark):
    pages = spark.createDataFrame(odd_pages(), PAGES).withColumn("bytes", F.lit("x")).withColumn("data", F.lit(1)).withColumn("content", F.lit(2)).repartition(3)
    return warc.write(warc.chunked(warc.records(pages)), archive=2_000).cache()


def test_warc_round_trip(spark, manifest):
    rows = warc.index(warc.read(manifest)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, brute_pages(odd_pages())))
    assert manifest.agg(F.sum("records")).first()[0] == len(odd_pages()) and manifest.count() > 3


def test_warc_chunks_carry_the_digest(manifest):
    chunks = warc.read(manifest, size=10_000).orderBy("archive", "record", "chunk").toPandas()
    long = [g for _, g in chunks.groupby(["archive", "record"]) if len(g) > 100]
    assert len(long) == 2 and chunks["data"].map(len).max() == 10_000
    for g in long:
        whole = b"".join(g["data"])
        assert [*g["chunk"]] == [*range(len(g))] and g["last"].sum() == 1 and g["last"].iloc[-1]
        assert [*g["sha1"]] == [hashlib.sha1(whole[: s + n]).hexdigest() for s, n in zip(g["start"], g["length"], strict=True)]
        assert whole.decode().startswith("ééé") and g["declared"].iloc[0] == g["sha1"].iloc[-1]


def test_archives_are_what_the_format_says(manifest):
    """Every record by itself: its header, its length, two empty lines; an address can't add a field."""
    for row in manifest.collect():
        with open(row["archive"].removeprefix("file:"), "rb") as file:
            data = file.read()
        assert len(data) == row["bytes"]
        for _ in range(row["records"]):
            inflate = zlib.decompressobj(31)
            record, data = inflate.decompress(data), inflate.unused_data
            head, _, block = record.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and len(block) == int(fields["Content-Length"]) + 4 and block.endswith(b"\r\n\r\n")
            assert head.count(b"WARC-Type") == 1 + (b"%0D%0AWARC-Type" in head) and ("WARC-Refers-To" in fields) == (fields["WARC-Type"] == "revisit")
        assert data == b""


def test_warc_of_other_makers():
    """Plain archives, other record types, hexadecimal digests; a cut archive is an error."""
    body = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\nWARC/1.0\r\nwarc-type:resource\r\nWARC-Payload-Digest: sha1:" + hashlib.sha1(b"xyz").hexdigest().encode() + b"\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    for data in (body, gzip.compress(body[:58]) + gzip.compress(body[58:])):
        rows = list(warc.chunks_of(io.BytesIO(data)))
        assert [(r[2], r[11]) for r in rows] == [("warcinfo", b"ab\r\n"), ("resource", b"xyz")] and rows[1][7] == rows[1][12]
    for data in (body[:-6], body[:80], gzip.compress(body)[:-20], b"nothing\r\n"):
        with pytest.raises(ValueError):
            list(warc.chunks_of(io.BytesIO(data)))


def test_warc_of_no_pages(spark):
    assert warc.index(warc.read(warc.write(warc.chunked(warc.records(spark.createDataFrame([], PAGES)))))).count() == 0


# Merkle manifests


def brute_tree(leaves):
    """The levels of a tree, by its definition."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([hashlib.sha256("".join(levels[-1][i : i + 3]).encode()).hexdigest() for i in range(0, len(levels[-1]), 3)])
    return levels


def brute_manifest(rows, tamper):
    def leaf(row):
        return hashlib.sha256(b"".join(b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode()) for v in row)).hexdigest()

    entries = []
    for doc_id, text, lang, source, n_chars in rows:
        now = text.replace("\n", "") if text is not None and tamper(doc_id) else text
        entries.append((source, doc_id, leaf((doc_id, source, lang, n_chars, text)), leaf((doc_id, source, lang, n_chars, now))))
    entries.sort(key=lambda e: (e[0] is not None, (e[0] or "").encode(), e[1] is not None, e[1] or 0, e[2]))
    groups = list(dict.fromkeys(e[0] for e in entries))
    trees = {g: brute_tree([e[2] for e in entries if e[0] == g]) for g in groups}
    top = brute_tree([trees[g][-1][0] for g in groups])
    out = []
    for g in groups:
        for k, (_, doc_id, h, now) in enumerate(e for e in entries if e[0] == g):
            proof, folded = "", now
            for levels, at in ((trees[g], k), (top, groups.index(g))):
                for level in levels[:-1]:
                    run = range(at - at % 3, min(at - at % 3 + 3, len(level)))
                    proof += "".join(level[i] for i in run if i != at)
                    folded = hashlib.sha256("".join(folded if i == at else level[i] for i in run).encode()).hexdigest()
                    at //= 3
            out.append((doc_id, h, trees[g][-1][0], top[-1][0], hashlib.sha256(proof.encode()).hexdigest(), folded, folded == top[-1][0]))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_of_odd_rows(spark, height):
    r = np.random.RandomState(1)
    rows = odd_rows() + [(100 + i, f"line\n{i}\n" * (i % 3), "en", ["hot", "hot", f"s{r.randint(7)}", "é", None][r.randint(5)], i) for i in range(150)] + [(500, "a\nb", None, "lone", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit("x")).withColumn("pos", F.lit(1)).withColumn("h", F.lit(2)).repartition(4)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle.manifest(merkle.leaves_of(df, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))), height).select(COLUMNS).collect()
    want = brute_manifest(rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 2 == 0)
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert {w[-1] for w in want} == {True, False}


def test_manifest_of_few_rows(spark):
    for rows in ([], [(1, "a\n", "en", "s", 2)], [(None, None, None, None, None)], [(1, "a", "en", "s", 2)] * 4):
        found = merkle.manifest(merkle.leaves_of(spark.createDataFrame(rows, SCHEMA)), 1).select(COLUMNS).collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute_manifest(rows, lambda i: False)))


def test_a_long_text_has_a_leaf(spark):
    rows = [(1, "x" * 4_000_000, "en", "s", 1), (2, "y z\n" * 1_000_000, "en", "s", 1)]
    found = merkle.manifest(merkle.leaves_of(spark.createDataFrame(rows, SCHEMA))).select(COLUMNS).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute_manifest(rows, lambda i: False)))
