"""The corpus operators against brute force, on the small tables and on odd cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import ann, common, components, exact_dedup, near_dedup, packing, quality, reshard, sentencepiece, substring_dedup, tokens, toxicity, training_order

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


def prose(seed: int, n: int) -> str:
    r = np.random.RandomState(seed)
    return " ".join(WORDS[k] + str(r.randint(50)) + ("." if r.randint(9) == 0 else "") for k in r.randint(len(WORDS), size=n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    base = prose(1, 300)
    edited = base.replace(base.split()[40], "changed", 1)
    return [
        (1, base, "en", "a", None), (2, base + " ", "en", None, 3), (3, edited, None, "b", 1), (4, None, "en", "a", 0), (5, "", "en", "a", 0), (6, " \n", "en", "a", 2),
        (7, "one two", "en", "a", 7), (8, "One  TWO", "en", "a", 8), (9, prose(2, 6000), "de", "c", None), (10, prose(3, 40), "de", "c", None), (10, prose(3, 40), "de", "c", None),
        (None, prose(4, 60), "fr", "c", 1), (None, None, None, None, None), (11, "über straße 中文 😀", "zz", "a", 3), (12, "x", "en", "a", 1), (13, "<|endoftext|> a\x1cb", "en", "a", 1),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).withColumn("clash", F.lit("digest")).withColumn("shard", F.lit(99)).repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")


def brute(rows, k):
    good = {i: np.float32(v).astype(float) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8}
    out = {}
    for q in good:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)
            out[q] = [(i, round(s, 12)) for s, i in d[:k]]
    return out


def test_ann_is_exact_on_little_data_with_copies_and_unfit_vectors(spark):
    r = np.random.RandomState(0)
    rows = [(i, [float(x) for x in r.randn(8)], 0, None) for i in range(260)]
    rows += [(1000 + i, rows[0][1], 0, None) for i in range(40)]  # copies of a query
    rows += [(2000, None, 0, None), (2100, [0.0] * 8, 0, None), (2200, [float("nan")] * 8, 0, None), (2300, [1.0, None] * 4, 0, None), (2400, [1.0] * 3, 0, None), (None, [1.0] * 8, 0, None), rows[5], rows[5]]
    found = {}
    for row in ann.search(vectors(spark, rows), lambda i: i % 100 == 0, exact=True).collect():
        found.setdefault(row["query_id"], {})[row["rank"]] = (row["vec_id"], round(row["score"], 12))
    assert {q: [x[k] for k in sorted(x)] for q, x in found.items()} == brute(rows, 10)


def test_ann_of_few_or_no_rows(spark):
    assert ann.search(vectors(spark, []), lambda i: i % 100 == 0).count() == 0
    two = ann.search(vectors(spark, [(0, [1.0, 2.0], 0, None), (7, [1.0, 3.0], 0, None)]), lambda i: i % 100 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in two] == [(0, 1, 7, 1.0)]


def test_ann_recall(spark):
    found = ann.op1_multiprobe_ann(spark, "/root/testdata/sf0.1").collect()
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    v, ids = np.array(t["embedding"].tolist(), float), t["vec_id"].to_numpy()
    hits = want = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        near = [ids[k] for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        hits += len({r["vec_id"] for r in found if r["query_id"] == q} & set(near))
        want += 10
    assert hits >= 0.9 * want


def test_ann_by_hashing_on_little_data(spark):
    r = np.random.RandomState(3)
    rows = [(i, [float(x) for x in r.randn(8)], 0, None) for i in range(900)] + [(1000 + i, [float(x) for x in r.randn(8)], 0, None) for i in range(40)]
    rows += [(2000, None, 0, None), (2100, [0.0] * 8, 0, None), (3, [9.0] * 8, 0, None), (3, [9.0] * 8, 0, None)]
    want = brute([x for x in rows if x[0] != 3], 10)
    found = {}
    for row in ann.search(vectors(spark, rows), lambda i: i % 100 == 0).collect():
        found.setdefault(row["query_id"], {})[row["rank"]] = row["vec_id"]
    assert set(found) == set(want) and all(sorted(x) == list(range(1, 11)) for x in found.values())
    assert sum(len(set(found[q].values()) & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_ann_ties_go_to_the_smaller_ids(spark):
    # Unit vectors in both directions of each axis: all at the same distance of the query.
    unit = [[float(s) if k == axis else 0.0 for k in range(32)] for axis in range(32) for s in (1, -1)]
    rows = [(900, unit[0], 0, None)] + [(999 - n, v, 0, None) for n, v in enumerate(unit[2:])] + [(5, [3.0] * 32, 0, None)]
    for exact in (True, False):
        got = [r["vec_id"] for r in ann.search(vectors(spark, rows), lambda i: i % 100 == 0, exact=exact).where("query_id = 900").orderBy("rank").collect()]
        ids = sorted(999 - n for n in range(62))
        assert got == ids[:10] if exact else set(got) <= set(ids)


def test_perturbations_come_in_rising_order():
    x = np.array([0.1, 0.45, 0.8])
    score = lambda moves: sum((1 - x[m // 2]) ** 2 if m % 2 else x[m // 2] ** 2 for m in moves)
    sets = ann.perturbations(x, 27)
    assert len(sets) == 27 and len({tuple(sorted(s)) for s in sets}) == 27
    assert [score(s) for s in sets] == sorted(score(s) for s in sets)


# Resharding


def test_flow_moves_the_fewest_bytes():
    supply, room = [50, 0, 10, 40], [25, 25, 25, 25]
    flow = reshard.min_cost_flow(supply, room)
    assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(4)] == supply
    assert all(sum(v for (_, j), v in flow.items() if j == k) <= room[k] for k in range(4))
    assert sum(v for (i, j), v in flow.items() if i != j) == sum(max(0, s - r) for s, r in zip(supply, room))
    with pytest.raises(ValueError):
        reshard.min_cost_flow([5], [4])


def test_every_row_gets_a_slot(spark, odd, empty):
    placed = reshard.place(odd, F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(16)), shards=4).collect()
    assert len(placed) == len(odd_rows())
    for k in range(4):
        slots = sorted(r["slot"] for r in placed if r["shard"] == k)
        assert slots == list(range(len(slots)))
    assert reshard.place(empty, F.lit(0)).count() == 0
    with pytest.raises(ValueError, match="beyond"):
        reshard.place(odd, F.lit(20))


def test_bytes_are_near_equal_and_files_follow_the_plan(spark, small):
    placed = reshard.place(small, F.pmod(F.col("doc_id"), F.lit(3)), shards=5)
    sizes = [r["b"] for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    largest = placed.agg(F.max("size")).first()[0]
    assert max(sizes) - min(sizes) <= 2 * largest
    files = spark.read.parquet(reshard.rewrite(small, placed))
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in files.collect()) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in placed.collect())
    assert files.join(small.select("doc_id", "text"), ["doc_id", "text"], "left_anti").count() == 0
    assert set(reshard.affected(placed)) <= set(range(5))


def test_files_hold_every_odd_row_once_and_only_of_affected_shards(spark, odd, monkeypatch):
    monkeypatch.setattr(reshard, "BLOCK_ROWS", 3)  # several slices
    copies = spark.createDataFrame([(10, prose(3, 40), "de", s, k) for k, s in enumerate("abcc" * 3)] + [(None, None, None, "a", 1)] * 3, SCHEMA)
    rows = odd.drop("shard", "clash").unionByName(copies)
    old = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(4))
    plain = lambda found: Counter(map(tuple, found.select("doc_id", "text", "lang", "source", "n_chars").collect()))
    slots = lambda found: sorted((r["shard"], r["slot"]) for r in found.collect())
    placed = reshard.place(rows, old, shards=4, old_shards=4)
    files = spark.read.parquet(reshard.rewrite(rows, placed))
    assert plain(files) == plain(rows) and slots(files) == slots(placed)
    # Two shards stay as they are, the others give and take.
    sizes = {r["old_shard"]: r["b"] for r in placed.groupBy("old_shard").agg(F.sum("size").alias("b")).collect()}
    room = [sizes.get(k, 0) for k in range(4)]
    big = max(range(4), key=lambda k: room[k])
    other = min(k for k in range(4) if k != big)
    room[big], room[other] = room[big] - 500, room[other] + 500
    placed = reshard.place(rows, old, shards=4, old_shards=4, capacities=room)
    changed = reshard.affected(placed)
    assert set(changed) == {big, other}
    files = spark.read.parquet(reshard.rewrite(rows, placed, old=old))
    assert slots(files) == slots(placed.where(F.col("shard").isin(changed)))
    kept = rows.where(~F.coalesce(old, F.lit(0)).isin(changed))
    assert plain(files) + plain(kept) == plain(rows)
    clashing = spark.read.parquet(reshard.rewrite(odd, reshard.place(odd, F.lit(0), shards=2)))
    assert clashing.count() == len(odd_rows())


# Exact dedup


def test_exact_groups(spark, odd, empty):
    rows = exact_dedup.index_groups(odd).collect()
    norm = lambda s: re.sub(r"[\x20\x09-\x0D]", "", s or "")
    groups: dict = {}
    for i, text, *_ in odd_rows():
        groups.setdefault(norm(text), []).append((-len(text or ""), i is None, i or 0))
    assert len(rows) == len(odd_rows())
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in rows:
        members = by_sha[r["text_sha256"]]
        best = min(members)
        assert r["group_size"] == len(members) and r["keep_id"] == (None if best[1] else best[2])
    kept = Counter(r["text_sha256"] for r in rows if r["kept"])
    assert set(kept) == set(by_sha) and set(kept.values()) == {1}
    assert exact_dedup.index_groups(empty).count() == 0
    stay = exact_dedup.exact_dedup(odd)
    assert stay.columns == odd.columns and stay.count() == len(groups)


def test_runs_are_probed_and_a_log_takes_further_batches(spark, small):
    found = exact_dedup.entries(small)
    log = exact_dedup.append(found, runs=3)
    runs = exact_dedup.runs_of(spark, log)
    met = exact_dedup.probed(runs, *exact_dedup.filters(runs))
    in_runs = {r["digest"]: r["n"] for r in runs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).collect()}
    wrong = [r["digest"] for r in met.where("met").collect() if in_runs[r["digest"]] == 1]
    assert all(r["met"] for r in met.collect() if in_runs[r["digest"]] > 1) and len(wrong) < 0.3 * len(in_runs)
    # The same documents again, as a second batch: every group doubles, the kept rows stay the same.
    before = {r["digest"]: (r["id"], r["n"]) for r in exact_dedup.compacted(spark, log).collect()}
    exact_dedup.append(found.withColumn("row", F.col("row") + (1 << 50)), log, runs=2, first_run=3)
    after = {r["digest"]: (r["id"], r["n"]) for r in exact_dedup.compacted(spark, log).collect()}
    assert after == {k: (i, 2 * n) for k, (i, n) in before.items()}


def test_exact_dedup_keeps_the_longest_row_of_a_repeated_id(spark):
    rows = [(5, "a b"), (5, "a   b"), (5, "a  b"), (7, "x y"), (6, "x y"), (6, "x y"), (None, "z"), (None, "z z"), (None, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stay = sorted(((r["doc_id"] or 0), r["text"]) for r in exact_dedup.exact_dedup(docs).collect())
    assert stay == [(0, "z"), (0, "z z"), (5, "a   b"), (6, "x y")]


# Near dedup


def shingle_sets(rows):
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_components(sets):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def test_near_components_match_brute_force(spark, small):
    sets = shingle_sets([(r["doc_id"], r["text"]) for r in small.collect()])
    want = brute_components(sets)
    rows = near_dedup.near_components(small).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {k: (len(sets[k]), want[k], want[k] == k) for k in sets}


def test_near_components_of_chains_and_odd_rows(spark, odd, empty):
    # Copies that drift: neighbours are alike, the ends are not; and a group whose members differ in one place each.
    words = prose(9, 200).split()
    rows = []
    for k in range(12):
        words = words[:]
        words[k * 15 + 3] = f"new{k}"
        rows.append((100 + k, " ".join(words)))
    base = prose(10, 120).split()
    for k in range(30):
        w = base[:]
        for j in range(3):
            w[(k * 3 + j * 29) % 120] = f"v{k}_{j}"
        rows.append((200 + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = shingle_sets(rows)
    want = brute_components(sets)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(docs).collect()} == want
    got = near_dedup.near_components(odd).collect()
    assert len(got) == len(odd_rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[2]["component_id"] == by[3]["component_id"] == 1 and by[8]["component_id"] == 7 and by[4]["n_shingles"] == by[6]["n_shingles"] == 0
    assert by[4]["component_id"] == 4 and by[4]["kept"] and not by[8]["kept"]
    assert near_dedup.near_components(empty).count() == 0
    assert near_dedup.near_dedup(odd).columns == odd.columns


def test_rows_that_share_an_id_keep_their_links(spark):
    a, b = prose(21, 200), prose(22, 200)
    near = lambda t: t.replace(t.split()[90], "changed", 1)
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (9, prose(23, 100)), (3, prose(24, 100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_components(docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 3), (9, 9)]
    stay = sorted((r["doc_id"], r["text"]) for r in near_dedup.near_dedup(docs).collect())
    assert stay == sorted([(1, a), (1, b), (9, prose(23, 100)), (3, prose(24, 100))])


def test_blocks_find_all_links():
    r = np.random.RandomState(1)
    base = np.sort(r.choice(10_000, 300, replace=False)).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[r.rand(300) > 0.1], r.randint(10_000, 20_000, 5).astype(np.uint64)))) for _ in range(60)]
    ids, apart = np.arange(60), np.arange(60)
    found = set(near_dedup._block_links(ids, apart, sets, ids % 2, 0, 1)) | set(near_dedup._block_links(ids, apart, sets, ids % 2, 0, 0)) | set(near_dedup._block_links(ids, apart, sets, ids % 2, 1, 1))
    like = lambda s, t: 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t))
    assert found == {(a, b) for a in range(60) for b in range(a + 1, 60) if like(sets[a], sets[b])}


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 3)] + [(k, k + 1) for k in range(100, 160)]
    rows = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    got = {r["id"]: r["component"] for r in rows}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {k: 100 for k in range(100, 161)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Substring dedup


def test_repeated_passages_go_and_clean_texts_stay(spark, odd, empty):
    passage = prose(77, 60)
    rows = [(k, f"{prose(500 + k, 80 + 7 * k)} {passage} {prose(600 + k, 50)}") for k in range(8)] + [(50 + k, prose(700 + k, 150)) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring_dedup.repeated_spans(docs).collect()
    assert {r["doc_id"] for r in spans} == set(range(1, 8)) and {r["owner_id"] for r in spans} == {0}
    texts = dict(rows)
    for r in spans:
        cut = texts[r["doc_id"]].encode()[r["start"] : r["start"] + r["length"]].decode()
        assert cut.strip() in passage + " " + texts[r["doc_id"]] and len(cut.split()) >= 16
    clean = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(docs).collect()}
    assert clean[0] == texts[0] and all(clean[k] == texts[k] for k in range(50, 58))
    assert all(passage not in clean[k] for k in range(1, 8))
    assert len(substring_dedup.substring_dedup(odd).collect()) == len(odd_rows())
    assert substring_dedup.substring_dedup(odd).columns == odd.columns
    assert substring_dedup.repeated_spans(empty).count() == 0


def test_spans_match_brute_force(spark):
    # The owner of a chunk is its first document; what others lose is what stands in runs of enough words.
    passage, other = prose(31, 90), prose(32, 25)
    rows = [(k, f"{prose(800 + k, 60)} {passage if k % 2 else other} {prose(850 + k, 40)} {passage if k in (3, 4) else ''}") for k in range(9)] + [(None, passage), (20, None), (20, passage), (20, passage)]
    owner: dict = {}
    pieces = []
    for i, text in rows:
        data = (text or "").encode()
        if i is None or not data:
            continue
        at = [*substring_dedup.chunk_starts(data).tolist(), len(data)]
        for a, b in zip(at, at[1:]):
            owner[data[a:b]] = min(owner.get(data[a:b], i), i)
            pieces.append((i, data, a, data[a:b]))
    runs: dict = {}
    for i, data, a, chunk in sorted(set(pieces)):
        if owner[chunk] < i:
            of = runs.setdefault((i, data), [])
            if of and of[-1][1] == a:
                of[-1][1] += len(chunk)
                of[-1][2] += len(chunk.split())
            else:
                of.append([a, a + len(chunk), len(chunk.split())])
    want = sorted((i, a, b - a) for (i, _), of in runs.items() for a, b, words in of if words >= substring_dedup.LEAST_WORDS)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in substring_dedup.repeated_spans(docs).collect()) == want and len(want) > 4


def test_columns_with_clashing_names_stay(spark):
    rows = [(1, prose(41, 80), 1), (2, prose(41, 80), 2), (3, prose(42, 80), 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags long")
    for name in ("__tags", "doc", "of", "digest", "gone_id", "_starts", "n_points"):
        docs = docs.withColumn(name, F.col("tags"))
    for made in (substring_dedup.substring_dedup(docs), exact_dedup.exact_dedup(docs), near_dedup.near_dedup(docs)):
        assert made.columns == docs.columns and all(r["of"] == r["__tags"] == r["doc_id"] for r in made.collect())


def test_chunks_cover_the_text_and_resist_shifts():
    data = prose(3, 4000).encode()
    at = substring_dedup.chunk_starts(data).tolist()
    assert at[0] == 0 and at == sorted(set(at))
    moved = substring_dedup.chunk_starts(b"some more words " + data).tolist()
    assert len(set(at) - {k - 16 for k in moved}) <= 3
    chars = "中文字符" * 300
    for k in substring_dedup.chunk_starts(chars.encode()).tolist():
        chars.encode()[:k].decode()


def test_long_texts_are_cut_the_same_in_pieces(monkeypatch):
    data = prose(4, 3000).encode()
    whole = substring_dedup.chunk_starts(data).tolist()
    monkeypatch.setattr(substring_dedup, "_PIECE", 1000)
    assert substring_dedup.chunk_starts(data).tolist() == whole


# Tokens, training order, packing


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.place("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids


def test_word_ids_are_the_librarys(small):
    encode = tokens.word_encoder()
    texts = [r["text"] for r in small.limit(60).collect()] + [r[1] or "" for r in odd_rows()] + ["It's 12.5% — don't!", "é́ Å ŉ ǅ", "a b c", "İstanbul"]
    r = np.random.RandomState(5)
    texts += ["".join(chr(k) for k in r.randint(33, 0x250, 12)) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u2").tolist() == library_ids(text)


def test_feistel_is_a_permutation():
    for most, bits in ((0, 1), (0, 6), (6, 3), (99, 2), (30, 7), (1000, 1)):
        order = training_order.Permutation(most, bits)
        number, piece = (x.ravel().astype(np.uint64) for x in np.meshgrid(np.arange(most + 1), np.arange(1 << bits)))
        left, right = order(number, piece)
        got = set(zip(left.tolist(), right.tolist()))
        assert len(got) == (most + 1) << bits and not order._outside(left, right).any() and left.max() < order.lefts
        other = training_order.Permutation(most, bits, 7)(number, piece)
        assert len(number) < 64 or (left.tolist(), right.tolist()) != tuple(x.tolist() for x in other)
    wide = training_order.Permutation((1 << 64) - 1, 20)
    left, right = wide(np.array([0, 1, (1 << 64) - 1], np.uint64), np.array([5, 5, 5], np.uint64))
    assert len(set(zip(left.tolist(), right.tolist()))) == 3


def permuted(number, piece, most, bits, key=training_order.KEY):
    """The permuted index as one Python integer, by the same network restated on integers."""
    half = max((most.bit_length() + bits + 1) // 2, 1)
    seeds = np.random.RandomState(key % (1 << 32)).randint(1, 1 << 62, training_order.ROUNDS).tolist()
    x = number << bits | piece
    while True:
        left, right = x >> half, x & ((1 << half) - 1)
        for seed in seeds:
            h = ((right + seed) * 0x9E3779B97F4A7C15) % (1 << 64)
            h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) % (1 << 64)
            left, right = right, left ^ ((h ^ (h >> 32)) & ((1 << half) - 1))
        x = left << half | right
        if x >> bits <= most:
            return x


def test_slots_are_the_sorted_permuted_indices(spark):
    ids = [3, 9, -(2**63), 2**63 - 1, 0, 77]
    docs = [(i, prose(900 + n, 40 + 60 * n)) for n, i in enumerate(ids)] + [(None, prose(990, 30))]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    path, rows = training_order.materialise(table, length=16)
    low, high = min(ids), max(ids)
    (spread,) = [r["spread"] for r in training_order.with_spread(table).collect() if r["spread"] is not None]
    bits = 1 + (max(len((t or "").encode()) for _, t in docs) // 16 + 1).bit_length()
    encode = tokens.word_encoder()
    order = []
    for i, text in docs:
        n = len(encode(text)) // 2 + 1
        for p in range(-(-n // 16)):
            piece = p + (1 << (bits - 1) if i is None else 0)
            order.append((permuted(spread % (high - low + 1) if i is None else i - low, piece, high - low, bits), i, 16 * p))
    want = [(i, start) for _, i, start in sorted(order)]
    assert [(r["doc_id"], r["start"]) for r in rows.orderBy("slot").collect()] == want
    assert len(list(training_order.read(path))) == len(want)


def test_rows_without_an_id_of_their_own_are_spread_over_the_shards(spark, monkeypatch):
    monkeypatch.setattr(training_order, "SHARD_TEXT", 2_000)
    docs = [((None, 7, 1000 + k)[k % 3], prose(k, 20) if k % 2 else "the same text of many rows") for k in range(900)]
    _, rows = training_order.materialise(spark.createDataFrame(docs, "doc_id long, text string"), length=16)
    counts = [r["count"] for r in rows.groupBy("shard").count().collect()]
    assert len(counts) > 15 and max(counts) < 2.5 * sum(counts) / len(counts)
    assert rows.agg(F.count_distinct("slot")).first()[0] == sum(counts) == rows.agg(F.max("slot")).first()[0] + 1


def test_training_order_files(spark, odd, empty):
    path, rows = training_order.materialise(odd, length=64)
    rows = rows.collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    by, encode = {r["slot"]: r for r in rows}, tokens.word_encoder()
    texts: dict = {}
    for i, text, *_ in odd_rows():
        texts.setdefault(i, []).append(np.frombuffer(encode(text or "") + b"\x02\x00", "<u2").tolist())
    seen = list(training_order.read(path))
    assert len(seen) == len(rows) and sum(map(len, seen)) == sum(len(t) for ts in texts.values() for t in ts)
    for slot, ids in enumerate(seen):
        r = by[slot]
        assert any(t[r["start"] : r["start"] + 64] == ids.tolist() for t in texts[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(ids.astype("<u4").tobytes())
    assert [x.tolist() for x in training_order.read(path, 5)] == [x.tolist() for x in seen[5:]]
    again = training_order.materialise(odd.repartition(5), length=64)[1].collect()
    assert sorted(r["ids_crc32"] for r in again) == sorted(r["ids_crc32"] for r in rows)
    # The order of what has an id of its own doesn't depend on the input's layout.
    own = lambda found: [(r["doc_id"], r["start"]) for r in sorted(found, key=lambda r: r["slot"]) if len(texts[r["doc_id"]]) == 1]
    assert own(again) == own(rows)
    assert training_order.materialise(empty)[1].count() == 0


def brute_cuts(at, penalty, window):
    cost, back = [0], [0]
    for j in range(1, len(at)):
        c, i = min((cost[i] + window - (at[j] - at[i]), i) for i in range(j) if at[j] - at[i] <= window)
        cost.append(c + penalty[j])
        back.append(i)
    return cost


def test_cuts_are_the_cheapest():
    r = np.random.RandomState(2)
    for _ in range(30):
        at = [0, *np.cumsum(r.randint(1, 20, 60)).tolist()]
        penalty = r.choice([0, 4, 24], len(at)).tolist()
        cuts = packing.best_cuts(at, penalty, 50)
        cost = brute_cuts(at, penalty, 50)
        paid = sum(50 - (b - a) + penalty[at.index(b)] for a, b in zip(cuts, cuts[1:]))
        assert paid == cost[at.index(cuts[-1])] == min(cost[i] for i in range(len(at) - 1) if at[i] >= at[-1] - 50)
        assert all(b - a <= 50 for a, b in zip(cuts, cuts[1:]))


def test_windows_end_between_sentences_and_their_number_does_not_hang_on_partitions(spark, small):
    rows = packing.packed(small).collect()
    assert len({r["sequence_id"] for r in rows}) == len({r["sequence_id"] for r in packing.packed(small.repartition(7)).select("sequence_id").distinct().collect()})
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    texts, ends, encode = {r["doc_id"]: r["text"] for r in small.collect()}, packing.sentence_ends(), tokens.word_encoder()
    inside = 0
    for members in sequences.values():
        r, full = max(members, key=lambda r: r["offset"]), sum(r["length"] for r in members)
        at = r["start"] + r["length"]
        if at < r["doc_tokens"] and full & (full - 1):  # a run's tail is of powers of two
            ids = np.frombuffer(encode(texts[r["doc_id"]]), "<u2")
            lines = set((np.cumsum([len(encode(x)) for x in texts[r["doc_id"]].split("\n")]) // 2).tolist())
            inside += not (ends[ids[at - 1]] or at in lines)
    assert inside <= 1  # within a sentence that is longer than a window


def test_sentences_longer_than_a_window_are_cut_within():
    ids = np.full(10_000, 300, "<u2")
    rows = list(packing.pack(iter([packing.Tokens(1, ids, np.empty(0, np.int64))])))
    lengths = [r[2] for r in rows]
    assert sum(lengths) == 10_000 and max(lengths) <= packing.WINDOW and sum(x & (x - 1) > 0 for x in lengths) <= 2


def check_pieces(rows, docs):
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(by) == {i for i, _ in docs}
    padding = 0
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    for i, text in docs:
        ids, at = [*library_ids(text or ""), 2], 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    return padding


def test_packing(spark, small, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in small.collect()]
    rows = packing.packed(small).collect()
    assert check_pieces(rows, docs) <= 0.02 * sum(r["length"] for r in rows)
    single = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_pieces(packing.packed(single).collect(), [(r["doc_id"], r["text"]) for r in single.collect()])
    assert sum(r["length"] for r in packing.packed(odd).collect()) == sum(len(library_ids(t or "")) + 1 for _, t, *_ in odd_rows())
    assert packing.packed(empty).count() == 0


# Classifiers


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    found = quality.op7_compression_quality(spark, folder)
    both = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (both["predicted"] == both["quality"]).mean() > 0.95
    assert (both["predicted"] == (both["score"] >= 0.3)).all() and both["score"].between(0, 1).all()


def test_the_difference_is_what_two_dictionaries_save():
    # By hand: blocks compressed one by one with either dictionary.
    import zstandard

    good, bad = prose(1, 400).encode(), ("BUY!! NOW!! " * 300).encode()
    size = lambda data, of: sum(
        len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(of), write_content_size=False, write_dict_id=False).compress(data[i : i + quality.BLOCK]))
        for i in range(0, len(data), quality.BLOCK)
    )
    for data in (good[300:1500], bad[:700], b"x", prose(5, 30).encode()):
        want = (size(data, bad) - size(data, good)) / len(data)
        assert quality.difference(data, quality.Sizes(good), quality.Sizes(bad)) == want
    assert quality.difference(b"", quality.Sizes(good), quality.Sizes(bad)) == 0


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (10, 0), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fitted(odd, labels)
    assert quality.scores(odd, model).where("score between 0 and 1").count() == len(odd_rows())
    assert quality.scores(empty, model).count() == 0
    assert quality.fitted(odd, labels.where("quality = 1")) == {"share": 1.0}
    assert quality.fitted(empty, labels) == {"share": 1.0}


def test_quality_curve_sees_whole_texts_and_the_mix_of_all_labels(spark, monkeypatch):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    long = docs.where(F.octet_length("text") > 8192).select("doc_id").join(labels, "doc_id")
    some = labels.where("doc_id % 10 = 0").unionByName(long).distinct()
    seen, fit = [], quality.Curve
    monkeypatch.setattr(quality, "Curve", lambda *a: seen.append(a) or fit(*a))
    quality.fitted(docs, some, per_class=40)
    _, length, label, weight = seen[0]
    assert length.max() > 8192
    assert abs((weight * label).sum() / weight.sum() - some.agg(F.avg("quality")).first()[0]) < 1e-6


def test_quality_rises_with_the_difference_at_every_length():
    r = np.random.RandomState(4)
    label = (r.rand(900) < 0.8).astype(float)
    length = np.exp(r.uniform(1, 11, 900)).astype(int)
    for shift in (0.1, -0.1):  # even where the bad dictionary is the better one for good texts, the curve doesn't fall
        curve = quality.Curve(shift * (2 * label - 1) + r.randn(900) * (0.02 + 1 / np.sqrt(length)), length, label, np.ones(900))
        d = np.linspace(-1, 1, 2001)
        for n in (1, 10, 100, 10_000, 1_000_000):
            assert (np.diff(curve(d, np.full(len(d), n))) >= 0).all()
        near = np.linspace(-0.2, 0.2, 401)
        assert (np.diff(curve(near, np.full(401, 1000))) > 0).all()
        same = curve(np.zeros(5), np.array([0, 10, 100, 10_000, 1_000_000]))
        assert np.ptp(same) < 1e-12
    good = quality.Curve(0.1 * (2 * label - 1) + r.randn(900) * 0.05, length, label, np.ones(900))
    assert good(np.array([0.2]), np.array([2000]))[0] > 0.9 > 0.3 > good(np.array([-0.2]), np.array([2000]))[0]


def test_quality_scores_come_from_the_difference(spark):
    """Scores restated: the sizes of blocks by the library, then the curve's formula."""
    import zstandard

    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fitted(docs, labels)
    long = spark.createDataFrame([(-1, "la vie " * 400_000), (-2, "x" * 3_000_000), (-3, None), (-4, "")], "doc_id long, text string")
    some = docs.select("doc_id", "text").limit(60).unionByName(long)
    found = {r["doc_id"]: r["score"] for r in quality.scores(some, model).collect()}
    c, (low, high), w = model["curve"].c, model["curve"].knots, model["curve"].weights
    size = lambda data, of: sum(len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(of), write_content_size=False, write_dict_id=False).compress(data[i : i + 256])) for i in range(0, len(data), 256))
    for r in [x for x in some.collect() if len(x["text"] or "") < 20_000]:
        data = (r["text"] or "").encode()
        z = 10 * (size(data, model["bad"]) - size(data, model["good"])) / len(data) / (1 + c / len(data)) ** 0.5 if data else 0.0
        odds = w[0] * min(z, low) + w[1] * (min(max(z, low), high) - low) + w[2] * max(z - high, 0) + w[3]
        assert abs(found[r["doc_id"]] - 1 / (1 + np.exp(-min(max(odds, -30), 30)))) < 1e-9
    assert len(found) == 64 and found[-3] == found[-4]


def test_blocks_are_drawn_from_the_whole_text():
    data = bytes(range(256)) * 1000
    assert len(quality.drawn(data)) == 32 and quality.drawn(data[:700]) == [data[:256], data[256:512], data[512:700]]
    data = b"".join(bytes([k % 251]) * 256 for k in range(1000))
    places = [x[0] for x in quality.drawn(data)]
    assert places == [(2 * k + 1) * 1000 // 64 % 251 for k in range(32)] and quality.drawn(b"short") == []


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fitted(docs, labels.where(~held))
    both = toxicity.scores(docs, model).join(labels.where(held), "doc_id").toPandas()
    assert (both["predicted"] == both["toxic"]).mean() > 0.93
    clean = both[both["toxic"] == 0]
    assert clean["predicted"].mean() < 0.04


def area(score, toxic):
    rank, toxic = score.rank(), toxic == 1
    return (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())


def test_the_chain_ranks_no_worse_than_a_single_model(spark):
    """On held-out rows of three splits, against one linear model over the same features that is fitted from scratch.

    A split has some 97 toxic rows, on which the two models' areas differ by 0.006 either way; the means may differ by half of that.
    """
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    areas = []
    for split in range(3):
        held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == split
        rows = docs.join(labels.where(held), "doc_id").select("doc_id", "text", "toxic").toPandas()
        for categories in (len(toxicity.CATEGORIES), 1):
            score = toxicity.scorer(toxicity.fitted(docs, labels.where(~held), categories=categories))
            areas.append(area(rows["text"].map(lambda t, score=score: score(t)[-1]), rows["toxic"]))
    chain, single = np.mean(areas[::2]), np.mean(areas[1::2])
    assert chain >= single - 0.003 and chain > 0.96, areas


def test_the_chain_by_hand():
    """A restatement of the out-of-fold fit over dense matrices, on rows of three vocabularies."""
    r = np.random.RandomState(8)
    sample = []
    for k in range(240):
        toxic = int(k % 3 == 0)
        own = {100 + 10 * (k // 3 % 3) + int(x) for x in r.choice(4, 3, replace=False)} if toxic else set()
        at = sorted({int(x) for x in r.choice(40, 6, replace=False)} | own)
        sample.append({"doc_id": k, "label": toxic, "words": 8, "features": at, "counts": [int(x) for x in r.randint(1, 3, len(at))]})
    model = toxicity.train(sample, {0: 2.0, 1: 1.0})
    rows = sorted(sample, key=lambda x: zlib.crc32(str(x["doc_id"]).encode()))
    label = np.array([x["label"] for x in rows], float)
    weight = np.where(label == 1, 1.0, 2.0)
    weight /= weight.mean()
    kind = np.array([(min(f for f in x["features"] if f >= 100) - 100) // 10 if x["label"] else -1 for x in rows])

    def dense(chosen):
        out = np.zeros((len(rows), len(chosen)))
        for n, x in enumerate(rows):
            for f, c in zip(x["features"], x["counts"], strict=True):
                if f in chosen:
                    out[n, list(chosen).index(f)] = 4 * np.sqrt(c / x["words"])
        return out

    def fit(a, y, use):
        n = use.sum()
        w, m, v = np.zeros(a.shape[1] + 1), np.zeros(a.shape[1] + 1), np.zeros(a.shape[1] + 1)
        share = (use * y).sum() / n
        w[-1] = np.log((share + 1e-4) / (1 - share + 1e-4))
        for t in range(1, 151):
            e = use * (1 / (1 + np.exp(-(a @ w[:-1] + w[-1]))) - y) / n
            g = np.append(a.T @ e + 1e-3 / n * w[:-1], e.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        return w

    def features(use):
        """Of the rows in use: those in three rows or more, by their excess in toxic rows."""
        all_features = sorted({f for x in rows for f in x["features"]})
        out = []
        for f in all_features:
            has = np.array([f in x["features"] for x in rows]) & use
            total, expected = (weight * has).sum(), (weight * has).sum() * (weight * label * use).sum() / (weight * use).sum()
            if has.sum() >= 3 and total and ((weight * label * has).sum() - expected) ** 2 > 1e-9:
                out.append(f)
        return out

    fold, everything = np.arange(len(rows)) % 5, np.ones(len(rows), bool)
    whole = features(everything)
    assert model["features"].tolist() == whole
    # Which vocabulary each category stands for, as its model weighs the vocabulary's features.
    means = [[np.mean([w[whole.index(100 + 10 * g + i)] for i in range(4)]) for g in range(3)] for w in model["weights"][:3]]
    stands_for = [int(np.argmax(m)) for m in means]
    assert sorted(stands_for) == [0, 1, 2]
    earlier = np.zeros((len(rows), 0))
    for j, g in enumerate([*stands_for, None]):
        target, odds = (label if g is None else (kind == g).astype(float)), np.zeros(len(rows))
        for k in range(5):
            a = np.hstack((dense(features(fold != k)), earlier))
            w = fit(a, target, weight * (fold != k))
            odds = np.where(fold == k, a @ w[:-1] + w[-1], odds)
        assert np.allclose(model["weights"][j], fit(np.hstack((dense(whole), earlier)), target, weight), atol=1e-6)
        earlier = np.column_stack((earlier, np.clip(odds, -12, 12) / 4))


def test_kinds_of_toxicity_are_found():
    r = np.random.RandomState(1)
    rows = [dict.fromkeys((20 * g + int(x) for x in r.choice(5, 3, replace=False)), 3**-0.5) for g in (0, 0, 0, 1, 1, 2) for _ in range(30)] + [{}]
    centres = toxicity.kinds(rows)
    assert [{f // 20 for f in c} for c in centres] == [{0}, {1}, {2}]
    assert toxicity.matched_kinds(centres[::-1], centres) == [2, 1, 0] and toxicity.matched_kinds(centres, centres[1:]) == [-1, 0, 1]
    assert toxicity.kinds([]) == [] and len(toxicity.kinds([{1: 1.0}] * 5)) == 1


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (10, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fitted(odd, labels)
    assert toxicity.scores(odd, model).where("score between 0 and 1").count() == len(odd_rows())
    assert toxicity.without_toxic(odd, model).columns == odd.columns
    assert toxicity.scores(empty, model).count() == 0
    none = toxicity.fitted(odd, labels.where("toxic = 0"))
    assert toxicity.scores(odd, none).where("score = 0 and predicted = 0").count() == len(odd_rows())


def test_toxicity_follows_the_mix_of_all_labels_past_the_cap(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    natural = labels.agg(F.avg("toxic")).first()[0]
    capped = toxicity.fitted(docs, labels, per_class=20)
    assert abs(capped["share"] - natural) < 0.03 and natural < 0.3
    wordless = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "!? .")], "doc_id long, text string")
    assert toxicity.scores(wordless, capped).where("score = 0 and predicted = 0").count() == 4
    assert toxicity.without_toxic(wordless, capped).count() == 4


def test_toxicity_weights_count_as_repeated_rows():
    sample = [{"doc_id": k, "label": int(k % 4 == 0), "words": 4, "features": [k % 4 + 1, 9, k % 7 + 20], "counts": [1, 2, 1]} for k in range(40)]
    assert abs(toxicity.train(sample, {0: 5.0, 1: 1.0})["share"] - 10 / 160) < 1e-9
    even, rare = toxicity.train(sample, {0: 1.0, 1: 3.0}), toxicity.train(sample, {0: 30.0, 1: 1.0})
    assert rare["weights"][-1][-1] < even["weights"][-1][-1]


# SentencePiece


def test_sentencepiece_ids_are_the_librarys(small):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=tokens.place("piece_bpe_32k.model"))
    t = sentencepiece.transducer()
    texts = [r["text"] for r in small.limit(80).collect()] + [r[1] or "" for r in odd_rows()] + ["  two  spaces ", "▁", "a▁b", "\x00", "tab\tnew\nline"]
    r = np.random.RandomState(6)
    texts += ["".join(chr(k) for k in r.choice([32, 97, 98, 101, 116, 233, 0x4E2D, 0x1F600, 0x301], 15)) for _ in range(2000)]
    for text in texts:
        ids = np.frombuffer(t.encode(text), "<u2").tolist()
        assert ids == model.encode(text) and t.decode(np.array(ids, "<u2").tobytes()) == model.decode(ids)


def test_sentencepiece_jobs(spark, odd, empty):
    back = {(r["doc_id"], r["text"]) for r in sentencepiece.decoded(sentencepiece.encoded(odd)).collect()}
    assert back == {(i, t or "") for i, t, *_ in odd_rows()}
    assert sentencepiece.encoded(empty).count() == 0


def unigram_model(path, pieces):
    """A unigram model file of (piece, score, kind)."""
    import struct

    def field(number, data):
        return bytes([number << 3 | 2, len(data)]) + data

    out = b"".join(field(1, field(1, t.encode()) + b"\x15" + struct.pack("<f", x) + bytes([0x18, kind])) for t, x, kind in pieces)
    out += field(2, bytes([0x18, 1])) + field(3, field(1, b"identity") + bytes([0x18, 1, 0x20, 1, 0x28, 1]))
    path.write_bytes(out)
    return str(path)


def test_unigram_paths_are_the_cheapest(tmp_path):
    import sentencepiece as library

    r = np.random.RandomState(11)
    texts = {"a", "b", "c", "\u2581"} | {"".join(r.choice(list("abc\u2581"), n)).lstrip("\u2581") for n in (2, 3, 4) for _ in range(8)} | {"\u2581a", "\u2581ab"}
    texts = {t for t in texts if t and "\u2581" not in t[1:]}
    pieces = [("<unk>", 0.0, 2)] + [(t, -float(r.uniform(1, 9)), 1) for t in sorted(texts)]
    path = unigram_model(tmp_path / "small.model", pieces)
    t, model = sentencepiece.Transducer(path), library.SentencePieceProcessor(model_file=path)
    score = {k: (n, x) for n, (k, x, _) in enumerate(pieces)}

    def cheapest(text):  # all ways to cut
        best = {0: (0.0, ())}
        for j in range(1, len(text) + 1):
            ways = [(best[i][0] - score[text[i:j]][1], (*best[i][1], score[text[i:j]][0])) for i in range(j) if text[i:j] in score]
            best[j] = min(ways)
        return list(best[len(text)][1])

    for _ in range(200):
        text = "".join(r.choice(list("abc "), r.randint(1, 14))).strip(" ")
        ids = np.frombuffer(t.encode(text), "<u2").tolist()
        plain = "\u2581" + re.sub(" +", "\u2581", text) if text else ""
        assert ids == [k for w in re.findall("\u2581[^\u2581]*", plain) for k in cheapest(w)] == model.encode(text)


def test_normaliser_arcs():
    for prefix in (True, False):
        for collapse in (True, False):
            n = sentencepiece.Normaliser(prefix, collapse)
            for text in ("", " ", "a", " a", "a ", "a  b", "  a b  c "):
                plain = re.sub(" +", " ", text.strip(" ")) if collapse else text
                assert n(text) == ("\u2581" if prefix and plain else "") + plain.replace(" ", "\u2581"), (text, prefix, collapse)


def test_new_words_are_made_once_and_memos_stay_small():
    made = []
    memo = common.Memo(lambda key: made.append(key) or key.encode(), 5, 4)
    assert memo.of_all(["a", "b", "a", "c"]) == [b"a", b"b", b"a", b"c"] and made == ["a", "b", "c"]
    assert memo.of_all(["w" * 600, "a"]) == [b"w" * 600, b"a"] and "w" * 600 not in memo and memo.held == 3
    assert memo.of_all([str(k) for k in range(50)]) == [str(k).encode() for k in range(50)] and len(memo) <= 5 and memo.held <= 20
    encode = tokens.word_encoder()
    for text in ("Hat. HAT hat, (hat)", "Éa. éa, ÉA", "a\x1cb", "a\x85b <|x|>", "a\x7f."):
        assert np.frombuffer(encode(text), "<u2").tolist() == library_ids(text)


def test_cuts_lie_where_sentences_lines_and_documents_end():
    dot = int(np.flatnonzero(packing.sentence_ends())[0])
    ids = np.zeros(500, np.int64)
    ids[[9, 19, 499]] = dot
    at, penalty = packing.candidates(ids, np.array([15, 500]), np.array([0, 12, 15]), 128)
    costs = dict(zip(at.tolist(), penalty.tolist(), strict=True))
    wide = {k: packing.WITHIN_SENTENCE for k in range(20 + packing.GRID, 500, packing.GRID)}
    assert costs == {0: packing.WITHIN_SENTENCE, 10: packing.AFTER_SENTENCE, 12: packing.AFTER_SENTENCE, 15: 0, 20: packing.AFTER_SENTENCE, 500: 0} | wide


def test_scratch_tables_are_written_in_batches_of_few_bytes(spark):
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 4000) AS text")
    before = spark.conf.get(common.BATCH_SETTING, None)
    found = [r["n"] for r in common.written(common.arrow(rows, sizes, "n long"), "sizes").collect()]
    assert sum(found) == 4000 and max(found) * 4000 <= 2 * common.BATCH
    assert spark.conf.get(common.BATCH_SETTING, None) == before
    with pytest.raises(Exception), common.small_batches(spark):
        raise ValueError
    assert spark.conf.get(common.BATCH_SETTING, None) == before
