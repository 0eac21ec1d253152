"""Audits of a vocabulary's tables: each returns what breaks a rule, as rows of (rule, key); no rows where all is well.

They are grouped counts, anti-joins and outer joins, so a vocabulary may be of any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch

# Fixed value: how a term's id is spelt.
ID_FORMAT = "^[a-z][a-z0-9_]*$"


def broken(df: DataFrame, rule: str, *key: str | Column) -> DataFrame:
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in key]
    return df.select(F.lit(rule).alias("rule"), F.concat_ws("/", *parts).alias("key"))


def together(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found).distinct()


def repeated(df: DataFrame, *columns: str) -> DataFrame:
    """The values that several rows have."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """The values of a column, null aside, that the other table's key doesn't have."""
    values = child.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return values.join(parent.select(F.col(key).alias("value")), "value", "left_anti")


def ids(terms: DataFrame) -> DataFrame:
    return together(
        broken(terms.where(~F.col("term_id").rlike(ID_FORMAT)), "id_format", "dimension", "term_id"),
        broken(repeated(terms, "dimension", "term_id"), "id_repeated", "dimension", "term_id"),
        broken(terms.where(F.trim(F.coalesce("label", F.lit(""))) == ""), "label_missing", "dimension", "term_id"),
    )


def synonym_owners(synonyms: DataFrame) -> DataFrame:
    owners = synonyms.groupBy("dimension", F.lower("synonym").alias("s")).agg(F.count_distinct("term_id").alias("n")).where("n > 1")
    blank = synonyms.where(F.trim(F.coalesce("synonym", F.lit(""))) == "")
    return together(broken(owners, "two_owners", "dimension", "s"), broken(blank, "blank_synonym", "dimension", "term_id"))


def shared_synonyms(synonyms: DataFrame, dimensions: list[str]) -> DataFrame:
    some = synonyms.where(F.col("dimension").isin(*dimensions))
    return broken(some.groupBy(F.lower("synonym").alias("s")).agg(F.count_distinct("dimension").alias("n")).where("n > 1"), "in_several_dimensions", "s")


def foreign_keys(references: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """references: (name, table, column, target table, its key)."""
    return together(*(broken(missing(child, column, parent, key), name, "value") for name, child, column, parent, key in references))


def precedence(terms: DataFrame, listed: DataFrame) -> DataFrame:
    """Lists, where a dimension has one, cover exactly its terms, each once."""
    with_list = listed.select("dimension").distinct()
    have = terms.join(with_list, "dimension").select("dimension", "term_id").distinct().withColumn("term", F.lit(True))
    n = listed.groupBy("dimension", "term_id").agg(F.count(F.lit(1)).alias("n"))
    both = have.join(n, ["dimension", "term_id"], "full")
    rule = F.when(F.col("n").isNull(), "not_listed").when(F.col("term").isNull(), "unknown").when(F.col("n") > 1, "listed_twice")
    return both.withColumn("rule", rule).where("rule is not null").select("rule", F.concat_ws("/", "dimension", "term_id").alias("key"))


def closed_sets(sets: list[tuple[str, DataFrame, str, list[str]]]) -> DataFrame:
    """sets: (rule, table, column, what it may hold besides null)."""
    return together(*(broken(df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)), rule, column) for rule, df, column, allowed in sets))


def unique_precedence(df: DataFrame, column: str = "precedence") -> DataFrame:
    return together(broken(df.where(F.col(column).isNull()), "precedence_missing", "id"), broken(repeated(df.where(F.col(column).isNotNull()), column), "precedence_repeated", column))


#: How many ancestors the pieces have that walks are made of.
PIECE = 16


def ancestors(edges: DataFrame) -> DataFrame:
    """child, ancestor, depth: all pairs, however far apart, the shortest way each; a member of a cycle is its own ancestor.

    edges: child, parent. Where a child has one parent at most, see :func:`_ancestors_of_walks`. Else each round doubles the reach: a way longer than the
    reach starts with one that is exactly as long, so only pairs that far apart meet the others. The rounds end when one finds no new pair.
    """
    steps = _kept(edges.where("child is not null and parent is not null").select("child", "parent").distinct())
    if steps.groupBy("child").count().where("count > 1").isEmpty():
        return _ancestors_of_walks(steps)
    pairs, reach = _kept(steps.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))), 1
    while True:
        onward = pairs.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("further"), F.col("depth").alias("more"))
        longer = pairs.where(F.col("depth") == reach).join(onward, "ancestor").select("child", F.col("further").alias("ancestor"), (F.col("more") + reach).alias("depth"))
        new = _kept(longer.groupBy("child", "ancestor").agg(F.min("depth").alias("depth")).join(pairs, ["child", "ancestor"], "left_anti"))
        if new.isEmpty():
            return pairs
        pairs, reach = pairs.unionByName(new), reach * 2


def _ancestors_of_walks(steps: DataFrame) -> DataFrame:
    """:func:`ancestors` of steps (child, parent) that go one way from each child. The pairs are never stored or moved.

    Each node has a piece: its first ``PIECE`` ancestors, in their order. A walk is a chain of pieces: the child's own, that of its ancestor ``PIECE``
    steps up, and so on. The chains' links, a row for each piece of a walk, are found by jumps that double, and met by the pieces once.
    A walk that comes to a ring ends when it has been once around: ``most`` is how far that is, null for the others.
    """
    pieces, size = _kept(steps.select("child", F.col("parent").alias("to"), F.array("parent").alias("up"))), 1
    while size < PIECE:
        on = pieces.select(F.col("child").alias("to"), F.col("to").alias("further"), F.col("up").alias("more"))
        pieces = _kept(pieces.join(on, "to", "left").select("child", F.col("further").alias("to"), F.concat("up", F.coalesce("more", F.slice("up", 1, 0))).alias("up")))
        size *= 2
    rings = _cycles_of_walks(steps)
    ends = _ways_around(steps, rings)
    jumps = pieces.where("to is not null").select("child", "to")
    links, reach = [_kept(ends.select("child", F.col("child").alias("at"), F.lit(0).alias("n"), "most"))], 1
    while not jumps.isEmpty():
        on = jumps.select(F.col("child").alias("at"), "to")
        further = _all(links).join(on, "at").select("child", F.col("to").alias("at"), (F.col("n") + reach).alias("n"), "most")
        new = _kept(further.where(F.col("most").isNull() | (F.col("n") * PIECE < F.col("most"))))
        if new.isEmpty():
            break
        links.append(new)
        onward = jumps.select(F.col("child").alias("to"), F.col("to").alias("further"))
        jumps, reach = _kept(jumps.join(onward, "to").select("child", F.col("further").alias("to"))), reach * 2
    found = _all(links).join(pieces.select(F.col("child").alias("at"), "up"), "at").select("child", "n", "most", F.posexplode("up").alias("k", "ancestor"))
    found = found.select("child", "ancestor", (F.col("n") * PIECE + F.col("k") + 1).cast("int").alias("depth"), "most")
    return found.where(F.col("most").isNull() | (F.col("depth") <= F.col("most"))).drop("most")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _ways_around(steps: DataFrame, rings: DataFrame) -> DataFrame:
    """child and most: after how many steps a walk has seen all nodes that it comes to; null where it is on no ring and comes to none.

    rings: id, cycle of the members of rings.
    """
    around = _kept(rings.join(rings.groupBy("cycle").agg(F.count(F.lit(1)).alias("members")), "cycle").select("id", "members"))
    off = steps.join(around.select(F.col("id").alias("child")), "child", "left_anti")
    walks, done = off.select("child", F.col("parent").alias("to"), F.lit(1).alias("steps")), []
    while True:  # a walk stops at the first node that is on a ring, and is looked up by the others as it then stands
        done.append(_kept(walks.join(around.select(F.col("id").alias("to")), "to", "left_semi").select("child", "to", "steps")))
        left = _kept(walks.join(around.select(F.col("id").alias("to")), "to", "left_anti").select("child", "to", "steps"))
        if left.isEmpty():
            break
        on = _all([left, *done]).select(F.col("child").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"))
        walks = left.join(on, "to").select("child", F.col("further").alias("to"), (F.col("steps") + F.col("more")).alias("steps"))
    entered = _all(done).join(around.select(F.col("id").alias("to"), "members"), "to").select("child", (F.col("steps") + F.col("members") - 1).alias("most"))
    return steps.select("child").join(around.select(F.col("id").alias("child"), F.col("members").alias("most")).unionByName(entered), "child", "left")


def _kept(pairs: DataFrame) -> DataFrame:
    path = scratch(pairs.sparkSession, "ancestors")
    pairs.write.parquet(path)
    return pairs.sparkSession.read.schema(pairs.schema).parquet(path)


def cycles(edges: DataFrame) -> DataFrame:
    """id, cycle: the members of cycles, with the smallest member of each cycle (or of all cycles that share members).

    Where a child has one parent at most, the members are found by jumps that double each round, one row for each child: after as many steps
    as there are children every walk is on a cycle, and each member is the end of one. Else a node that has itself among
    its ancestors is on a cycle; two such nodes are on the same one where each is the other's ancestor.
    """
    steps = _kept(edges.where("child is not null and parent is not null").distinct())
    if steps.groupBy("child").count().where("count > 1").isEmpty():
        return _cycles_of_walks(steps)
    pairs = ancestors(steps)
    back = pairs.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("child"))
    both = pairs.select("child", "ancestor").join(back, ["child", "ancestor"])
    return both.groupBy(F.col("child").alias("id")).agg(F.min("ancestor").alias("cycle"))


def _cycles_of_walks(steps: DataFrame) -> DataFrame:
    """:func:`cycles` of steps (child, parent) that go one way from each child; walks that end are dropped as soon as they do.

    A round that drops none leaves walks only that never end, and none of these is longer than there are rows before it is on its cycle.
    The least member is that of a window of steps that doubles each round, until a round changes none: the windows then go round.
    """
    far, reach, n = steps, 1, steps.count()
    most = n
    while reach < most:
        on = far.select(F.col("child").alias("parent"), F.col("parent").alias("further"))
        far = _kept(far.join(on, "parent").select("child", F.col("further").alias("parent")))
        before, n, reach = n, far.count(), reach * 2
        most = min(most, n) if n == before or n == 0 else most
    on_cycle = far.select(F.col("parent").alias("child")).distinct()
    least = _kept(steps.join(on_cycle, "child").select("child", "parent", F.least("child", "parent").alias("least"), F.lit(True).alias("less")))
    while not least.where("less").isEmpty():
        on = least.select(F.col("child").alias("parent"), F.col("parent").alias("further"), F.col("least").alias("other"))
        least = _kept(least.join(on, "parent").select("child", F.col("further").alias("parent"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("less")))
    return least.select(F.col("child").alias("id"), F.col("least").alias("cycle"))


def hierarchy(nodes: DataFrame) -> DataFrame:
    """nodes: id, parent_id, kind, precedence. No cycles; a parent exists, is of the same kind and has a higher precedence number."""
    edges = nodes.select(F.col("id").alias("child"), F.col("parent_id").alias("parent"))
    up = nodes.select(F.col("id").alias("parent_id"), F.col("kind").alias("parent_kind"), F.col("precedence").alias("parent_precedence"))
    both = nodes.join(up, "parent_id")
    return together(
        broken(cycles(edges), "cycle", "id"), broken(missing(nodes, "parent_id", nodes, "id"), "parent_unknown", "value"),
        broken(both.where("kind <> parent_kind"), "kind_differs", "id"), broken(both.where("precedence >= parent_precedence"), "not_before_parent", "id"),
    )


def units(scales: DataFrame) -> DataFrame:
    """A canonical unit exists and is its own with factor 1; a factor needs a canonical unit."""
    canonical = scales.where("si_equivalent is not null").select(F.col("si_equivalent").alias("of")).distinct()
    anchors = canonical.join(scales, F.col("id") == F.col("of"))
    return together(
        broken(missing(scales, "si_equivalent", scales, "id"), "canonical_unknown", "value"), broken(anchors.where("not (si_equivalent <=> id) or not (factor_to_si <=> 1.0D)"), "canonical_not_anchored", "id"),
        broken(scales.where("factor_to_si is not null and si_equivalent is null"), "factor_without_unit", "id"),
    )


def concepts(declared: DataFrame, measurements: DataFrame) -> DataFrame:
    return together(broken(missing(measurements, "concept_id", declared, "id"), "undeclared", "value"), broken(missing(declared, "id", measurements, "concept_id"), "unused", "value"))


def mapping_targets(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """rules: layer, key, class_id. Targets exist; 'control' rules aim at control classes and 'branch' rules at pharmacologic ones."""
    kinds = targets.groupBy("id").agg(F.min("kind").alias("kind"))
    both = rules.join(kinds, F.col("class_id") == F.col("id"), "left")
    wrong = both.where("(layer = 'control' and kind <> 'control') or (layer = 'branch' and kind <> 'pharmacologic')")
    return together(broken(both.where("id is null"), "target_unknown", "layer", "key", "class_id"), broken(wrong, "kind_mismatch", "layer", "key", "class_id"))


def cascades(cascade: DataFrame, confidence: DataFrame, fields: list[str]) -> DataFrame:
    """Fields and methods are known, exactly one fallback which is last, and exact matches count more than syntactic ones."""
    steps = cascade.where("fallback is null")
    methods = missing(steps, "match_method", confidence, "match_method")
    shape = cascade.groupBy("dimension").agg(F.count("fallback").alias("n"), F.max("ordinal").alias("last"), F.max(F.when(F.col("fallback").isNotNull(), F.col("ordinal"))).alias("at"))
    floors = confidence.agg(F.max(F.when(F.col("match_method") == "exact", F.col("confidence"))).alias("e"), F.max(F.when(F.col("match_method") == "syntactic_rule", F.col("confidence"))).alias("s"))
    return together(
        broken(steps.where(~F.col("field").isin(*fields)), "field_unknown", "dimension", "field"), broken(methods, "method_unknown", "value"), broken(shape.where("n <> 1"), "not_one_fallback", "dimension"),
        broken(shape.where("n = 1 and at < last"), "fallback_not_last", "dimension"), broken(floors.where("e <= s"), "exact_not_above_syntactic", F.lit("confidence")),
    )


def named_endpoints(named: DataFrame, forms: DataFrame, events: DataFrame, measurements: DataFrame) -> DataFrame:
    """What a definition refers to exists; a time to an event from a reference needs a citation."""
    uncited = named.where("form_id = 'time_to_event' and reference_id is not null and trim(coalesce(citation, '')) = ''")
    found = foreign_keys([("form_unknown", named, "form_id", forms, "id"), ("event_unknown", named, "event_id", events, "id"), ("measurement_unknown", named, "measurement_id", measurements, "id")])
    return together(found, broken(uncited, "citation_missing", "id"))


def templates(parts: DataFrame, forms: DataFrame, fields: list[str]) -> DataFrame:
    """parts: form_id, ordinal, literal, field. Every form has one template, whose fields (a closing '?' aside) are known."""
    field = F.regexp_replace("field", r"\?$", "")
    unknown = parts.where(F.col("field").isNotNull() & ~field.isin(*fields))
    return together(
        broken(missing(forms, "id", parts, "form_id"), "template_missing", "value"), broken(missing(parts, "form_id", forms, "id"), "form_unknown", "value"),
        broken(unknown, "field_unknown", "form_id", "field"), broken(repeated(parts, "form_id", "ordinal"), "part_repeated", "form_id", "ordinal"),
    )


def event_components(events: DataFrame, parts: DataFrame, synonyms: DataFrame, patterns: DataFrame) -> DataFrame:
    """An event has components or words of its own, not both and not neither; a component exists."""
    words = synonyms.where("dimension = 'event'").select("term_id").unionByName(patterns.where("dimension = 'event'").select("term_id")).distinct().withColumn("words", F.lit(True))
    made = parts.select(F.col("event_id").alias("of")).distinct().withColumn("parts", F.lit(True))
    both = events.join(words, F.col("id") == F.col("term_id"), "left").join(made, F.col("id") == F.col("of"), "left")
    return together(
        broken(both.where("words and parts"), "words_and_components", "id"), broken(both.where("words is null and parts is null"), "neither", "id"), broken(missing(parts, "part_id", events, "id"), "component_unknown", "value")
    )
