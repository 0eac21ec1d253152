"""Groups of spelling variants: words that differ by one edit, found by pivotal grams.

A word's *grams* are its bigrams with their places; over all words a gram is the rarer, the fewer words have it, and this order is the
same for every word; of equal grams in a word the first comes first. A word's *prefix* are its three rarest grams. They have two
sets of places: equal grams counted from the word's beginning, or from its end. One place of the first set and a later one of the second
that is *disjoint* from it always exist; the two whose grams have the fewest words together, chosen by dynamic programming over the places, are
the word's *pivots*. One edit is behind the first pivot or before the second one (or both). So of two words one edit apart, take the
one whose prefix ends with the rarer gram: one of its pivots stands unchanged in the other word, and there in the prefix.

Pivots are the index, the others' prefixes look it up, with limits on the places: either the edit is behind the first
pivot, so that both words begin alike up to that gram's end, or it is before the second one, so that both end
alike from that gram on. What is left on the other side holds the edit in its first or in its last half; the half that is untouched is part of
the key, and so is the length of the word that looks up (the index has entries for words one shorter, as long and one longer). A key
therefore fixes the gram, its place, one side of it and half of the other, so that a bigram that a third of all words share makes no large
group; what still meets is compared by edit distance within the join, and only pairs one edit apart leave it.

Defined results: null texts have no words; where ``doc_id`` is null no letter is deleted; repeated rows count as often as they
occur; an empty table, or one without frequent words, gives an empty result; other columns, whatever their names, are ignored.
Very long words are compared like all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, table, written

LETTERS, UPPER = "A-Za-zÀ-ÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
POINTS, OCCURRENCES, TIMES, EVERY = 6, 5, 5, 199
GRAM, EDITS = 2, 1
SHORT = 128


def words(docs: DataFrame, points: int = POINTS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n: the frequent words of all texts, as a written table. A run that is too short from the start never enters."""
    if points < GRAM * EDITS + GRAM:
        raise ValueError("words of fewer than four letters have no two disjoint grams")
    found = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{points},}}"), F.lit(0)))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc"), found.alias("run"))
    # lower() changes A-Z alone where all is ASCII.
    ascii_only = F.octet_length("run") == F.char_length("run")
    rows = rows.select("doc", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, UPPER.lower())).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    rows = rows.select(F.when(F.col("h") % EVERY == 0, shorter).otherwise(F.col("run")).alias("word"))
    counts = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return written(counts.where((F.char_length("word") >= points) & (F.col("n") >= occurrences)), "spelling-words")


def gram_order(found: DataFrame) -> dict[str, int]:
    """gram -> its number of words, the rarest first: at most 8,100 grams, as the alphabet has 90 letters."""
    letters = found.select(F.split("word", "").alias("x"))
    grams = F.transform(F.slice("x", 1, F.size("x") - 1), lambda c, k: F.concat(c, F.get("x", k + 1)))
    rows = letters.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").count().collect()
    return {r["gram"]: r["count"] for r in sorted(rows, key=lambda r: (r["count"], r["gram"]))}


def prefix(word: str, rank: dict[str, int]) -> tuple[list[int], list[int], tuple[int, int]]:
    """The places of a word's prefix counted from its beginning and from its end, ascending, and its last gram (rank, how many equal ones are before it)."""
    places: dict[int, list[int]] = {}
    for i in range(len(word) - GRAM + 1):
        places.setdefault(rank[word[i : i + GRAM]], []).append(i)
    ahead, behind, size = [], [], GRAM * EDITS + 1
    for r in sorted(places):
        n = min(len(places[r]), size - len(ahead))
        ahead += places[r][:n]
        behind += places[r][-n:]
        if len(ahead) == size:
            break
    return sorted(ahead), sorted(behind), (r, n - 1)


def pivots(ahead: list[tuple[int, int]], behind: list[tuple[int, int]]) -> tuple[int, int]:
    """The places of the two disjoint grams of least weight, from (place, weight), ascending: ``best`` is the lightest that ends before the one looked at."""
    least, chosen, best, k = None, None, None, 0
    for at, weight in behind:
        while k < len(ahead) and ahead[k][0] + GRAM <= at:
            if best is None or ahead[k][1] < best[1]:
                best = ahead[k]
            k += 1
        if best is not None and (least is None or best[1] + weight < least):
            least, chosen = best[1] + weight, (best[0], at)
    return chosen


def signatures(found: DataFrame, weight: dict[str, int]) -> DataFrame:
    """word, n, last (of the prefix, as a number), first, second (the pivots' places), ahead, behind (the prefix' places)."""
    rank = {gram: k for k, gram in enumerate(weight)}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word in batch.column("word").to_pylist():
                ahead, behind, (r, k) = prefix(word, rank)
                first, second = pivots(*([(i, weight[word[i : i + GRAM]]) for i in places] for places in (ahead, behind)))
                rows.append((4 * r + k, first, second, ahead, behind))
            kinds = [pa.int32()] * 3 + [pa.list_(pa.int32())] * 2
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), *made], ["word", "n", "last", "first", "second", "ahead", "behind"])

    return written(arrow(found, of, "word string, n long, last int, first int, second int, ahead array<int>, behind array<int>"), "spelling-signatures")


def _keys(ahead: bool, at: Column, length: Column) -> list[Column]:
    """The keys of a gram at place ``at`` for a word of ``length`` letters that looks up: one for each untouched half.

    ahead: the edit is behind the gram, and what stands up to the gram's end is untouched; else it is before the gram.
    """
    word = F.col("word")
    own = F.char_length(word)
    # From the end for texts behind the gram, as an edit before it moves them.
    from_end = own - at
    rest = length - (at + GRAM if ahead else from_end)
    half = F.floor(rest / 2).cast("int")
    kept = F.substring(word, F.lit(1), at + GRAM) if ahead else F.substring(word, at + 1, from_end)
    start = at + GRAM if ahead else F.lit(0)
    end = own if ahead else at
    first = F.substring(word, start + 1, half)
    last = F.substring(word, end - (rest - half) + 1, rest - half)
    side = F.lit("<" if ahead else ">")
    # Where this word's side is too short for a half, no pair has that half untouched.
    fits = lambda n: end - start >= n
    return [
        F.when(fits(half), F.xxhash64(side, length, kept, F.lit("first"), first)),
        F.when(fits(rest - half), F.xxhash64(side, length, kept, F.lit("last"), last)),
    ]


def joined(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """A join that never sends a side to the driver: Spark sizes a table by its compressed files, and one with a row for each of many keys like the table
    that it is made of, so that it would broadcast hundreds of megabytes for less than its limit of ten."""
    return left.join(right.hint("merge"), on, how)


def one_edit(a: Column, b: Column) -> Column:
    """Whether two different words are one edit apart. The built-in distance takes the product of the lengths even with a
    threshold, so words of more than ``SHORT`` letters skip what they begin with in common, found by halving, and compare the rest."""
    same = F.aggregate(
        F.sequence(F.lit(30), F.lit(0), F.lit(-1)),
        F.lit(0),
        lambda n, k: F.when(F.substring(a, n + 1, F.pow(F.lit(2), k).cast("int")) == F.substring(b, n + 1, F.pow(F.lit(2), k).cast("int")), F.least(n + F.pow(F.lit(2), k).cast("int"), F.char_length(a), F.char_length(b))).otherwise(n),
    )
    more = F.char_length(a) - F.char_length(b)
    rest = F.substring(a, same + 1 + (more >= 0).cast("int"), F.char_length(a)) == F.substring(b, same + 1 + (more <= 0).cast("int"), F.char_length(b))
    return F.when(F.least(F.char_length(a), F.char_length(b)) <= SHORT, F.levenshtein(a, b, 1) == 1).otherwise((F.abs(more) <= 1) & rest)


def near_pairs(found: DataFrame, weight: dict[str, int]) -> DataFrame:
    """a, n_a, b, n_b: all pairs of words one edit apart, each once."""
    signs = signatures(found, weight)
    own = F.char_length("word")
    index = [k for length in (own - 1, own, own + 1) for ahead, at in ((True, F.col("first")), (False, F.col("second"))) for k in _keys(ahead, at, length)]
    left = signs.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("last").alias("last_a"), F.explode(F.array_compact(F.array(*index))).alias("key"))
    looks = [signs.select("word", "n", "last", F.explode(places).alias("at")).select("word", "n", "last", F.explode(F.array(*_keys(places == "ahead", F.col("at"), own))).alias("key")) for places in ("ahead", "behind")]
    right = looks[0].unionByName(looks[1]).where("key IS NOT NULL").select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("last").alias("last_b"), "key")
    near = (F.col("last_a") <= F.col("last_b")) & (F.col("a") != F.col("b")) & one_edit(F.col("a"), F.col("b"))
    found = joined(left, right, (left["key"] == right["key"]) & near)
    less = F.col("a") < F.col("b")
    pairs = found.select(F.least("a", "b").alias("a"), F.when(less, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.greatest("a", "b").alias("b"), F.when(less, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"))
    return written(pairs.distinct(), "spelling-pairs")


def forms(found: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n: the near word of largest n, where that is ``times`` the word's."""
    both = pairs.select(F.col("a").alias("of"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("near")).alias("f")).unionByName(
        pairs.select(F.col("b").alias("of"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("near")).alias("f"))
    )
    best = both.groupBy("of").agg(F.count(F.lit(1)).alias("n_near"), F.min("f").alias("f"))
    rows = joined(found, best, F.col("word") == F.col("of"), "left")
    enough = -F.col("f.less") >= F.col("n") * times
    return written(
        rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("f.near")).alias("form"), F.when(enough, -F.col("f.less")).alias("form_n")), "spelling-forms"
    )


def rooted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``root``: where the forms lead. A form is more frequent than its word, so they lead to an end.

    Each round replaces a word's goal by its goal's goal, until no goal has a form; the rounds are the logarithm of the longest way.
    """
    goals = rows.where("form IS NOT NULL").select("word", F.col("form").alias("goal"))
    goals = written(goals, "spelling-goals")
    while True:
        onward = goals.select(F.col("word").alias("of"), F.col("goal").alias("next"))
        after = written(joined(goals, onward, F.col("goal") == F.col("of"), "left").select("word", F.coalesce("next", "goal").alias("goal"), F.col("next").isNotNull().alias("moved")), "spelling-goals")
        goals = after.select("word", "goal")
        if after.where("moved").isEmpty():
            break
    return joined(rows, goals.select(F.col("word").alias("of"), "goal"), F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("goal", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, points: int = POINTS, occurrences: int = OCCURRENCES, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word."""
    found = words(docs, points, occurrences)
    return rooted(forms(found, near_pairs(found, gram_order(found)), times))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


_LOWER = f"translate(run, '{UPPER}', '{UPPER.lower()}')"

OP11_SQL = f"""
WITH RECURSIVE crc_table AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, list_transform(range(8), lambda k: 0::BIGINT)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) AS v FROM (SELECT unnest(range(256)) AS i)
    )
),
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, {_LOWER} AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{LETTERS}]+')) AS run FROM documents)) WHERE length(run) >= {POINTS} GROUP BY ALL),
bytes AS (
    SELECT *, list_transform(string_split(doc_id || ':', ''), lambda c: ord(c)::BIGINT) || flatten(list_transform(string_split(run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END)) AS b
    FROM runs
),
hashed AS (
    SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table
),
derived AS (SELECT CASE WHEN h % {EVERY} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM derived WHERE length(word) >= {POINTS} GROUP BY word HAVING sum(k) >= {OCCURRENCES}),
cut AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS key FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN w b ON a.key = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN w b ON a.key = b.word
),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * w.n THEN near END AS form, CASE WHEN near_n >= {TIMES} * w.n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS goal, 0 AS step FROM f UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN f ON f.word = way.goal WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(goal, step) AS root FROM way GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN roots r USING (word)
"""
