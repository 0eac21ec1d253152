"""Therapeutic areas and drug classes of studies: layered rules, prefixes, primaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, folded_type, stripped
from .matching import checked_broadcast, matching


def prefixes_of(tree_number: Column) -> Column:
    """'C04.588.180' -> ['C04', 'C04.588', 'C04.588.180']."""
    parts = F.split(tree_number, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def match_longest_prefix(trees: DataFrame, prefixes: DataFrame) -> DataFrame:
    """tree_number, ta_id, prefix: the longest rule that is a prefix up to a dot; an equi-join on own prefixes."""
    own = trees.select("tree_number").distinct().select("tree_number", F.explode(prefixes_of(F.col("tree_number"))).alias("prefix"))
    hits = own.join(checked_broadcast(prefixes), "prefix")
    best = hits.groupBy("tree_number").agg(F.max_by(F.struct("ta_id", "prefix"), F.struct(F.length("prefix"), "ta_id")).alias("b"))
    return best.select("tree_number", "b.*")


def branch_to_prefix(abbreviation: Column) -> Column:
    """'BC04' -> 'C04'."""
    return F.nullif(F.regexp_extract(abbreviation, r"^B([A-Z]\d{2})$", 1), F.lit(""))


def first_hit(hits: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each combination of ``keys``: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def strongest_layer(hits: DataFrame, study: str = "nct_id", member: str = "class_id") -> DataFrame:
    """One row for each study and class: that of the strongest layer, then the smallest item."""
    best = F.min_by(F.struct("layer", "layer_rank", "matched_on"), F.struct("layer_rank", "matched_on"))
    return hits.groupBy(study, member).agg(best.alias("b"), F.count_distinct("matched_on").alias("n_items")).select(study, member, "b.*", "n_items")


def pick_primary(rows: DataFrame, precedence: DataFrame, study: str = "nct_id", member: str = "class_id") -> DataFrame:
    """Adds is_primary: the lowest precedence, then most items, then the id."""
    ranked = rows.join(checked_broadcast(precedence), member, "left")
    w = Window.partitionBy(study).orderBy(F.col("precedence").asc_nulls_last(), F.desc("n_items"), member)
    return ranked.withColumn("is_primary", F.row_number().over(w) == 1)


def disagreements(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two classifiers' answers (keys, answer) side by side where they differ, counted; null is an answer."""
    both = a.select(*keys, F.col("answer").alias("a")).join(b.select(*keys, F.col("answer").alias("b")), keys, "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


# The layers that a class or an area may come from, strongest first.
CLASS_LAYERS = ("control_rule", "term_override", "agent_name", "name_pattern", "ancestor_rule", "branch_rule", "modality_rule", "default")
AREA_LAYERS = ("intervention_rule", "term_override", "tree_prefix", "term_pattern", "default")


def rank_of(layers: tuple[str, ...], column: str = "layer") -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in layers)), F.col(column)).cast("int")


def string_hits(strings: DataFrame, rules: DataFrame, exact: list[str], patterns: list[str]) -> DataFrame:
    """text, layer, class_id, rule_rank: what rules (layer, key, class_id, ordinal) say about distinct texts.

    A rule of an exact layer asks for the whole text, one of a pattern layer is a regular expression in it. Exact rules
    are an equi-join; patterns meet the texts that hold one of their literals.
    """
    texts = strings.where("text is not null and text <> ''").distinct()
    whole = texts.join(checked_broadcast(rules.where(F.col("layer").isin(*exact)).select("layer", F.col("key").alias("text"), "class_id")), "text").select("text", "layer", "class_id", F.lit(0).alias("rule_rank"))
    if not patterns:
        return whole.distinct()
    near = matching(texts, "text", rules.where(F.col("layer").isin(*patterns)).select("layer", "key", "class_id", F.col("ordinal").alias("rule_rank")), "key")
    return whole.unionByName(near.select("text", "layer", "class_id", "rule_rank")).distinct()


def first_by_kind(hits: DataFrame, item: list[str], kinds: DataFrame) -> DataFrame:
    """Of each item and kind the classes of the first rule (by layer, candidate and rule)."""
    ranked = hits.join(checked_broadcast(kinds), "class_id").withColumn("layer_rank", rank_of(CLASS_LAYERS))
    w = Window.partitionBy(*item, "kind").orderBy("layer_rank", "candidate_rank", "rule_rank")
    return ranked.withColumn("_r", F.dense_rank().over(w)).where("_r = 1").drop("_r")


def match_interventions(interventions: DataFrame, other_names: DataFrame, rules: DataFrame, kinds: DataFrame) -> DataFrame:
    """nct_id, ordinal, class_id, kind, layer, layer_rank, matched_on: the classes of each intervention.

    interventions: nct_id, ordinal, name, intervention_type; other_names: nct_id, ordinal, other_name. A control rule that
    its own name meets claims an intervention, by the first such rule; else names come before other names (in their
    order) within a layer, and the type of the intervention decides last.
    """
    plain = lambda c: F.nullif(F.lower(stripped(collapsed(F.col(c)))), F.lit(""))
    own = interventions.select("nct_id", "ordinal", plain("name").alias("text"), F.lit(0).alias("candidate_rank"))
    w = Window.partitionBy("nct_id", "ordinal").orderBy("text")
    others = other_names.select("nct_id", "ordinal", plain("other_name").alias("text")).where("text is not null").distinct().withColumn("candidate_rank", F.row_number().over(w))
    candidates = own.unionByName(others)
    found = string_hits(candidates.select("text"), rules, ["term_override", "agent_name"], ["control_rule", "name_pattern"])
    hits = candidates.join(found, "text").where("layer <> 'control_rule' or candidate_rank = 0")
    types = interventions.select("nct_id", "ordinal", F.col("intervention_type").alias("text"), folded_type(F.col("intervention_type")).alias("key"), F.lit(0).alias("candidate_rank"))
    by_type = types.join(checked_broadcast(rules.where("layer = 'modality_rule'").select("key", "layer", "class_id", F.lit(0).alias("rule_rank"))), "key").drop("key")
    hits = hits.unionByName(by_type.select(hits.columns))
    # A window, and not a join with an aggregate: the hits are made once, and what follows keeps their partitioning.
    rule = F.when(F.col("layer") == "control_rule", F.struct("rule_rank", "class_id"))
    hits = hits.withColumn("control", F.min(rule).over(Window.partitionBy("nct_id", "ordinal"))["class_id"]).where("control is null or (layer = 'control_rule' and class_id = control)")
    won = first_by_kind(hits.drop("control"), ["nct_id", "ordinal"], kinds)
    best = won.groupBy("nct_id", "ordinal", "class_id", "kind").agg(F.min(F.struct("layer_rank", "layer", F.col("text").alias("matched_on"))).alias("b"))
    return best.select("nct_id", "ordinal", "class_id", "kind", "b.layer", "b.layer_rank", "b.matched_on")


def match_terms(terms: DataFrame, rules: DataFrame, kinds: DataFrame) -> DataFrame:
    """nct_id, class_id, kind, layer, layer_rank, matched_on of descriptors (nct_id, mesh_term)."""
    rows = terms.select("nct_id", F.lower(stripped(collapsed(F.col("mesh_term")))).alias("text")).distinct()
    hits = rows.join(string_hits(rows.select("text"), rules, ["term_override", "agent_name"], ["name_pattern"]), "text").withColumn("candidate_rank", F.lit(0))
    won = first_by_kind(hits, ["nct_id", "text"], kinds)
    return won.select("nct_id", "class_id", "kind", "layer", "layer_rank", F.col("text").alias("matched_on")).distinct()


def match_ancestors(ancestors: DataFrame, rules: DataFrame, kinds: DataFrame) -> DataFrame:
    """The same for ancestors of descriptors (nct_id, mesh_term), by their whole text."""
    rows = ancestors.select("nct_id", F.lower(stripped(collapsed(F.col("mesh_term")))).alias("text")).distinct()
    hits = rows.join(string_hits(rows.select("text"), rules, ["ancestor_rule"], []), "text").join(checked_broadcast(kinds), "class_id")
    return hits.select("nct_id", "class_id", "kind", "layer", rank_of(CLASS_LAYERS).alias("layer_rank"), F.col("text").alias("matched_on"))


def match_branches(branches: DataFrame, rules: DataFrame, kinds: DataFrame) -> DataFrame:
    """The same for branches (nct_id, branch_name): the first pattern of each branch."""
    rows = branches.select("nct_id", F.col("branch_name").alias("text")).distinct()
    found = string_hits(rows.select("text"), rules, [], ["branch_rule"])
    first = found.groupBy("text", "layer").agg(F.min_by("class_id", F.struct("rule_rank", "class_id")).alias("class_id"))
    hits = rows.join(first, "text").join(checked_broadcast(kinds), "class_id")
    return hits.select("nct_id", "class_id", "kind", "layer", rank_of(CLASS_LAYERS).alias("layer_rank"), F.col("text").alias("matched_on"))


def resolve_drug_classes(studies: DataFrame, by_intervention: DataFrame, others: list[DataFrame], with_interventions: DataFrame, classes: DataFrame) -> DataFrame:
    """nct_id, class_id, kind, layer, matched_on, is_primary: every class of every study by its strongest layer.

    Of a layer the first match counts: interventions by ordinal, then the other sources in their order, then by text.
    Studies without a match get 'unclassified_agent' where they have interventions, else 'no_interventions_stated'.
    """
    columns = ["nct_id", "class_id", "kind", "layer", "layer_rank", "matched_on"]
    rows = by_intervention.select(*columns, F.lit(0).alias("source"), "ordinal")
    for n, found in enumerate(others, 1):
        rows = rows.unionByName(found.select(*columns, F.lit(n).alias("source"), F.lit(0).alias("ordinal")))
    best = rows.groupBy("nct_id", "class_id", "kind").agg(F.min(F.struct("layer_rank", "source", "ordinal", "matched_on", "layer")).alias("b")).select("nct_id", "class_id", "kind", "b.layer", "b.matched_on")
    default = F.when(F.col("has"), "unclassified_agent").otherwise("no_interventions_stated").alias("class_id")
    have = with_interventions.select("nct_id").distinct().withColumn("has", F.lit(True))
    bare = studies.select("nct_id").distinct().join(best.select("nct_id").distinct(), "nct_id", "left_anti").join(have, "nct_id", "left").select("nct_id", F.when(F.col("has").isNull(), F.lit("no_interventions_stated")).otherwise(default).alias("class_id"))
    all_rows = best.unionByName(bare.select("nct_id", "class_id", F.lit(None).cast("string").alias("kind"), F.lit("default").alias("layer"), F.lit(None).cast("string").alias("matched_on")))
    backing = by_intervention.groupBy("nct_id", "class_id").agg(F.count_distinct("ordinal").alias("n_items"))
    counted = all_rows.join(backing, ["nct_id", "class_id"], "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    return pick_primary(counted, classes.select(F.col("id").alias("class_id"), "precedence")).drop("precedence", "n_items")


def arm_classes(by_intervention: DataFrame, arm_links: DataFrame) -> DataFrame:
    """What interventions are, pushed to their arms (nct_id, group_title, intervention_ordinal, link_method); a study's other signals never reach an arm."""
    links = arm_links.select("nct_id", "group_title", F.col("intervention_ordinal").alias("ordinal"), "link_method").distinct()
    return links.join(by_intervention, ["nct_id", "ordinal"]).select("nct_id", "group_title", "class_id", "kind", "layer", "matched_on", "link_method")


def unclassified(interventions: DataFrame, by_intervention: DataFrame) -> DataFrame:
    return interventions.select("nct_id", "ordinal", "name").join(by_intervention.select("nct_id", "ordinal").distinct(), ["nct_id", "ordinal"], "left_anti")


def curated_against_ancestry(interventions: DataFrame, by_intervention: DataFrame, by_ancestor: DataFrame) -> DataFrame:
    """name, kind, curated, ancestor, n: interventions whose own class of a kind is not the study's first ancestor's of that kind."""
    first = by_ancestor.groupBy("nct_id", "kind").agg(F.min_by("class_id", F.struct("matched_on", "class_id")).alias("ancestor"))
    own = by_intervention.where(F.col("layer").isin("term_override", "agent_name", "name_pattern")).join(interventions.select("nct_id", "ordinal", "name"), ["nct_id", "ordinal"])
    both = own.join(first, ["nct_id", "kind"]).where("class_id <> ancestor")
    return both.groupBy("name", "kind", F.col("class_id").alias("curated"), "ancestor").agg(F.count(F.lit(1)).alias("n"))


def condition_areas(conditions: DataFrame, rules: DataFrame) -> DataFrame:
    """nct_id, text, layer, ta_id: the first answer of each condition (nct_id, mesh_term, tree_number), by the rules that are given.

    An exact override, the longest tree prefix (of several tree numbers' the longest, then the smallest area), the first pattern.
    """
    classed = rules.withColumnRenamed("ta_id", "class_id")
    prefixes = rules.where("layer = 'tree_prefix'").select(F.col("key").alias("prefix"), "ta_id")
    c = conditions.select("nct_id", F.lower(stripped(collapsed(F.col("mesh_term")))).alias("text"), "tree_number").distinct()
    by_text = string_hits(c.select("text"), classed, ["term_override"], ["term_pattern"]).groupBy("text", "layer").agg(F.min_by("class_id", F.struct("rule_rank", "class_id")).alias("ta_id"))
    trees = match_longest_prefix(c.where("tree_number is not null"), prefixes)
    by_tree = c.join(trees, "tree_number").select("nct_id", "text", F.lit("tree_prefix").alias("layer"), "ta_id", (-F.length("prefix")).alias("short"))
    each = c.join(by_text, "text").select("nct_id", "text", "layer", "ta_id", F.lit(0).alias("short")).unionByName(by_tree).withColumn("layer_rank", rank_of(AREA_LAYERS))
    return each.groupBy("nct_id", "text").agg(F.min(F.struct("layer_rank", "short", "ta_id", "layer")).alias("b")).select("nct_id", "text", "b.layer", "b.ta_id")


def branch_areas(branches: DataFrame, rules: DataFrame) -> DataFrame:
    """nct_id, text, layer, ta_id of branches (nct_id, branch_abbrev, branch_name), by the tree prefixes."""
    prefixes = rules.where("layer = 'tree_prefix'").select(F.col("key").alias("prefix"), "ta_id")
    b = branches.select("nct_id", branch_to_prefix(F.col("branch_abbrev")).alias("tree_number"), F.coalesce("branch_name", "branch_abbrev").alias("text")).where("tree_number is not null").distinct()
    return b.join(match_longest_prefix(b, prefixes).select("tree_number", "ta_id"), "tree_number").select("nct_id", "text", F.lit("tree_prefix").alias("layer"), "ta_id")


def tree_against_pattern(conditions: DataFrame, branches: DataFrame, rules: DataFrame) -> DataFrame:
    """part, a, b, n: where two ways of finding areas differ, counted; null is an answer.

    'condition': what the tree says of a condition (a) against the patterns (b), over all conditions. 'study': the areas that a study's
    branches (a) or its conditions (b) alone give it.
    """
    texts = conditions.select("nct_id", F.lower(stripped(collapsed(F.col("mesh_term")))).alias("text")).distinct()
    tree, pattern = (condition_areas(conditions, rules.where(F.col("layer") == layer)) for layer in ("tree_prefix", "term_pattern"))
    answers = [texts.join(found.select("nct_id", "text", F.col("ta_id").alias("answer")), ["nct_id", "text"], "left") for found in (tree, pattern)]
    by_condition = disagreements(*answers, ["nct_id", "text"])
    of = lambda found: found.select("nct_id", "ta_id", F.col("ta_id").alias("answer")).distinct()
    by_study = disagreements(of(branch_areas(branches, rules)), of(condition_areas(conditions, rules)), ["nct_id", "ta_id"])
    return by_condition.select(F.lit("condition").alias("part"), "a", "b", "n").unionByName(by_study.select(F.lit("study").alias("part"), "a", "b", "n"))


def resolve_areas(studies: DataFrame, conditions: DataFrame, interventions: DataFrame, branches: DataFrame, rules: DataFrame, areas: DataFrame) -> DataFrame:
    """nct_id, ta_id, layer, matched_on, is_primary: every area of every study by its strongest layer.

    conditions: nct_id, mesh_term, tree_number (null where unknown); interventions: nct_id, mesh_term; branches: nct_id,
    branch_abbrev, branch_name; rules: layer, key, ta_id, ordinal. Without any match the default tells whether there were conditions.
    """
    plain = lambda c: F.lower(stripped(collapsed(F.col(c))))
    classed = rules.withColumnRenamed("ta_id", "class_id")
    by_condition, by_branch = condition_areas(conditions, rules), branch_areas(branches, rules)
    i = interventions.select("nct_id", plain("mesh_term").alias("text")).distinct()
    drug = string_hits(i.select("text"), classed, [], ["intervention_rule"]).groupBy("text", "layer").agg(F.min_by("class_id", F.struct("rule_rank", "class_id")).alias("ta_id"))
    by_drug = i.join(drug, "text").select("nct_id", "text", "layer", "ta_id")
    backing = by_condition.select("nct_id", "ta_id").unionByName(by_branch.select("nct_id", "ta_id")).groupBy("nct_id", "ta_id").agg(F.count(F.lit(1)).alias("n_items"))
    rows = by_condition.select("nct_id", "text", "layer", "ta_id").unionByName(by_branch).unionByName(by_drug).withColumn("layer_rank", rank_of(AREA_LAYERS))
    best = rows.groupBy("nct_id", "ta_id").agg(F.min(F.struct("layer_rank", "text", "layer")).alias("b")).select("nct_id", "ta_id", "b.layer", F.col("b.text").alias("matched_on"))
    have = conditions.select("nct_id").distinct().withColumn("has", F.lit(True))
    bare = studies.select("nct_id").distinct().join(best.select("nct_id").distinct(), "nct_id", "left_anti").join(have, "nct_id", "left")
    bare = bare.select("nct_id", F.when(F.col("has"), "no_pattern_matched").otherwise("no_mesh_terms").alias("ta_id"), F.lit("default").alias("layer"), F.lit(None).cast("string").alias("matched_on"))
    counted = best.unionByName(bare).join(backing, ["nct_id", "ta_id"], "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    return pick_primary(counted, areas.select(F.col("id").alias("ta_id"), "precedence"), member="ta_id").drop("precedence", "n_items")


def signal_availability(studies: DataFrame, conditions: DataFrame, branches: DataFrame) -> DataFrame:
    """One row: studies, condition rows, those with a tree number, studies with branches."""
    n = conditions.agg(F.count(F.lit(1)).alias("condition_rows"), F.count("tree_number").alias("with_tree"))
    return studies.agg(F.count_distinct("nct_id").alias("studies")).join(n).join(branches.agg(F.count_distinct("nct_id").alias("studies_with_branches")))  # single rows
