"""Expansion over edge tables: whole frontiers per round, written to the shared folder."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F

from prosopo.operators.joins import id_set, of_ids
from prosopo.session import bucket_count, bucketed, bucketed_and_count, cut_lineage


def _id_frame(spark, ids, name: str) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).cast("bigint").alias(name))
    return spark.createDataFrame([(int(i),) for i in ids], f"{name} bigint")


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def closure(edges: DataFrame) -> tuple[DataFrame, int]:
    """((above, below, depth) of all pairs joined by a path of ``edges`` (above, below), depth of the shortest; rounds taken).

    Paths double: once all paths of up to 2^k steps are known, those of up to 2^(k+1) are a path of just 2^k steps and a known one.
    So the rounds are the logarithm of the depth, and only pairs found in the last round are carried on. No node
    is paired with itself; cycles are harmless.
    """
    step = (edges.select(F.col("above").cast("bigint").alias("above"), F.col("below").cast("bigint").alias("below"))
            .where("above is not null and below is not null and above <> below").distinct().withColumn("depth", F.lit(1)))
    def write(pairs: DataFrame, longest: int) -> tuple[DataFrame, int]:
        seen = Observation()
        table = cut_lineage(pairs.observe(seen, F.count_if(F.col("depth") == longest).alias("n")), "paths")
        return table, seen.get["n"]

    step, open_ = write(step, 1)
    known, reach, rounds = [step], 1, 1
    while open_:       # pairs of just 2^k steps may go on
        right = _union(known).select(F.col("above").alias("__mid"), F.col("below").alias("__to"), F.col("depth").alias("__more"))
        longer = (step.where(F.col("depth") == reach).join(right, F.col("below") == F.col("__mid")).where("above <> __to")
                  .groupBy("above", F.col("__to").alias("__below")).agg(F.min(F.col("depth") + F.col("__more")).alias("depth"))
                  .withColumnRenamed("__below", "below")
                  .join(_union(known).select("above", "below"), ["above", "below"], "left_anti").select("above", "below", "depth"))
        rounds, reach = rounds + 1, 2 * reach
        step, open_ = write(longer, reach)
        known.append(step)
    return _union(known), rounds


def descendants(hierarchy: DataFrame, roots, per_root: bool = False,
                child: str = "c_addr_id", parent: str = "c_belongs_to") -> DataFrame:
    """Places below the given ones, the given ones included; cycles are harmless.

    ``per_root=True`` gives (root, id, depth) pairs instead of one id set. The pairs of the whole hierarchy - as
    many as places times their depth - are found first, in a number of rounds that is the logarithm of the depth.
    """
    found = _id_frame(hierarchy.sparkSession, roots, "root").where("root is not null").distinct()
    pairs, _ = closure(hierarchy.select(F.col(parent).alias("above"), F.col(child).alias("below")))
    below = found.join(pairs, F.col("root") == F.col("above"))
    if per_root:
        return found.select("root", F.col("root").alias("id"), F.lit(0).alias("depth")).union(below.select("root", F.col("below").alias("id"), "depth"))
    return found.select(F.col("root").alias("id")).union(below.select(F.col("below").alias("id"))).distinct()


def neighbours(edges: DataFrame, ids: DataFrame, source: str, key: str | None = None) -> DataFrame:
    """Direct edges of the given ids."""
    return of_ids(edges, id_set(ids, key), source)


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Outgoing and incoming edge counts per person."""
    tagged = (edges.select(F.col(source).alias("person_id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
              .union(edges.select(F.col(target).alias("person_id"), F.lit(0), F.lit(1))))
    return (tagged.where("person_id is not null").groupBy("person_id")
            .agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
            .withColumn("degree", F.col("out_degree") + F.col("in_degree")))


@dataclass(frozen=True)
class KinCaps:
    """Step limits of derived relations, and the number of rounds."""
    up: int = 2
    down: int = 2
    marriage: int = 1
    collateral: int = 1
    rounds: int = 10


_STEPS = ["up_step", "down_step", "marriage_step", "collateral_step"]
_STATE = ["seed_id", "kin_person_id", *_STEPS]


def kin_edges(kin: DataFrame, codes: DataFrame, code_key: str = "c_kincode") -> DataFrame:
    """KIN_DATA with the step vector of each code (an unknown code has no steps)."""
    steps = codes.select(
        F.col(code_key).alias("__code"),
        *[F.coalesce(F.col(src), F.lit(0)).cast("int").alias(dst)
          for src, dst in zip(("c_upstep", "c_dwnstep", "c_marstep", "c_colstep"), _STEPS)])
    return (kin.select(F.col("c_personid").cast("bigint").alias("person_id"),
                       F.col("c_kin_id").cast("bigint").alias("kin_person_id"),
                       F.col("c_kin_code").cast("int").alias("kin_code"))
            .join(steps, F.col("kin_code") == F.col("__code"), "left").drop("__code")
            .fillna(0, _STEPS))


def expand_kinship(edges: DataFrame, seeds: DataFrame | None = None, caps: KinCaps = KinCaps(),
                   best_only: bool = True, with_complete: bool = False) -> DataFrame:
    """Breadth-first kinship for all seeds at once.

    Direct edges always stay; only those within the caps are extended. A derived
    state is one (seed, kin, step vector) within the caps, seed itself excluded,
    with the round it was first reached in and the smallest code path. Keeping all
    vectors while looping makes the reached set independent of visit order; the
    caps bound them to (up+1)(down+1)(marriage+1)(collateral+1) per pair. Links and rounds are written bucketed, by person and by
    state, so that a round exchanges its new step alone; of known states only the state's columns are read.

    ``best_only`` keeps one row per (seed, kin): direct first, then fewest steps. The loop ends after
    ``caps.rounds`` rounds as the rule says; ``with_complete`` adds a column that is false for seeds
    that a further round would have taken on.
    """
    direct = edges if seeds is None else neighbours(edges, seeds, "person_id")
    direct = (direct.groupBy(F.col("person_id").alias("seed_id"), "kin_person_id", *_STEPS)
              .agg(F.min(F.array("kin_code")).alias("path"))
              .withColumn("hop", F.lit(1)).withColumn("is_derived", F.lit(False)))
    # parallel edges with one step vector reach the same states: one is enough
    buckets = bucket_count(edges.sparkSession)
    links = bucketed(
        edges.where("kin_person_id is not null")
        .groupBy(F.col("person_id").alias("__from"), F.col("kin_person_id").alias("__to"),
                 *[F.col(s).alias(f"__{s}") for s in _STEPS])
        .agg(F.min("kin_code").alias("__code")).repartition(buckets, "__from"), ["__from"], buckets, "kin-links")
    within = (F.col("up_step") <= caps.up) & (F.col("down_step") <= caps.down) \
        & (F.col("marriage_step") <= caps.marriage) & (F.col("collateral_step") <= caps.collateral)
    rounds = [bucketed(direct, _STATE, buckets, "kin-direct")]
    frontier = rounds[0].where(within & (F.col("kin_person_id") != F.col("seed_id")))

    def next_round(hop: int) -> DataFrame:
        step = (frontier.join(links, F.col("kin_person_id") == F.col("__from"))
                .select("seed_id", F.col("__to").alias("kin_person_id"),
                        *[(F.col(s) + F.col(f"__{s}")).alias(s) for s in _STEPS],
                        F.concat("path", F.array("__code")).alias("path"))
                .where(within & (F.col("kin_person_id") != F.col("seed_id")))
                .groupBy(*_STATE).agg(F.min("path").alias("path")))
        # the grouping deals the step as the rounds were dealt: their buckets are as many as shuffle partitions
        for known in rounds:
            step = step.join(known.select(*_STATE), _STATE, "left_anti")
        return step.withColumn("hop", F.lit(hop)).withColumn("is_derived", F.lit(True))

    for hop in range(2, caps.rounds + 2):
        frontier, found = bucketed_and_count(next_round(hop).select(*rounds[0].columns), _STATE, buckets, "kin-round")
        if not found:
            break
        rounds.append(frontier)
    out = _union(rounds)
    if best_only:
        # the sort key itself is the aggregate, so partial results combine before the shuffle
        total = sum((F.col(s) for s in _STEPS[1:]), F.col(_STEPS[0]))
        best = F.struct("is_derived", total.alias("total"), "hop", *_STEPS, "path")
        out = (out.groupBy("seed_id", "kin_person_id").agg(F.min(best).alias("b"))
               .select("seed_id", "kin_person_id", *[f"b.{s}" for s in _STEPS], "b.hop", "b.is_derived", "b.path"))
    if with_complete:
        open_seeds = cut_lineage(next_round(caps.rounds + 2).select(F.col("seed_id").alias("__seed")).distinct(), "kin-open")
        out = (out.join(open_seeds.withColumn("__open", F.lit(True)), F.col("seed_id") == F.col("__seed"), "left")
               .withColumn("complete", F.col("__open").isNull()).drop("__seed", "__open"))
    return out


MAX_RULES = 10_000      #: rules up to which each task holds them all


def reduce_relation(kin: DataFrame, rules: DataFrame, path: str = "path", most: int = MAX_RULES) -> DataFrame:
    """Compose a code path to one code with a rule table (code1, code2 -> code).

    Rules apply from the left as long as they match; ``reduced_code`` is NULL where
    some step has no rule (the summed step vector then stands for the relation); NULL steps are passed over.

    Up to ``most`` rules, each (code1, code2) once, are an automaton: the code so far is the state, the next code leads to
    another, and each path is folded where it lies, without a join. Larger or ambiguous rule tables are joined once a position; paths are at most as long as
    the number of rounds.
    """
    rules = rules.select(F.col("code1").alias("__c1"), F.col("code2").alias("__c2"), F.col("code").alias("__c"))
    telling = rules.where("__c1 is not null and __c2 is not null")
    some = telling.limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("__c1", "__c2").alias("pairs")).first()
    if some["n"] <= most and some["n"] == some["pairs"]:
        return _fold_path(kin, telling, path)
    longest = kin.agg(F.max(F.size(path))).first()[0] or 0
    out = kin.withColumn("reduced_code", F.get(path, F.lit(0)))
    for i in range(1, longest):
        nxt = F.get(path, F.lit(i))
        out = (out.withColumn("__n", nxt)
               .join(rules, (F.col("reduced_code") == F.col("__c1")) & (F.col("__n") == F.col("__c2")), "left")
               .withColumn("reduced_code", F.when(F.col("__n").isNull(), F.col("reduced_code")).otherwise(F.col("__c")))
               .drop("__n", "__c1", "__c2", "__c"))
    return out


def _fold_path(kin: DataFrame, rules: DataFrame, path: str) -> DataFrame:
    """Each path folded through the rules, which reach it as one value: a map of states, each a map of the codes that lead on."""
    kind = kin.schema[path].dataType.elementType
    rules = rules.select(*[F.col(c).cast(kind).alias(c) for c in ("__c1", "__c2", "__c")])
    states = rules.groupBy("__c1").agg(F.map_from_entries(F.collect_list(F.struct("__c2", "__c"))).alias("__on"))
    automaton = states.agg(F.map_from_entries(F.collect_list(F.struct("__c1", "__on"))).alias("__on"))
    step = lambda state, code: F.when(code.isNull(), state).otherwise(F.try_element_at(F.try_element_at(F.col("__rules"), state), code))
    rest = F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))
    return (kin.withColumn("__rules", automaton.scalar())
            .withColumn("reduced_code", F.aggregate(F.coalesce(rest, F.array().cast(f"array<{kind.simpleString()}>")), F.get(path, F.lit(0)), step))
            .drop("__rules"))


def expand_network(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Persons reached from each seed within ``hops`` edges: (seed_id, person_id, hop).

    ``edges`` is (from_id, to_id), any mix of kin and association edges.
    """
    buckets, pair = bucket_count(edges.sparkSession), ["seed_id", "person_id"]
    links = bucketed(
        edges.select(F.col("from_id").cast("bigint").alias("__from"), F.col("to_id").cast("bigint").alias("__to"))
        .where("__from is not null and __to is not null and __from <> __to").distinct().repartition(buckets, "__from"), ["__from"], buckets, "links")
    start = _id_frame(edges.sparkSession, seeds, "seed_id").where("seed_id is not null").distinct()
    rounds = [bucketed(start.select("seed_id", F.col("seed_id").alias("person_id"), F.lit(0).alias("hop")).repartition(buckets, *pair), pair, buckets, "reach")]
    for hop in range(1, hops + 1):
        step = (rounds[-1].join(links, F.col("person_id") == F.col("__from"))
                .select("seed_id", F.col("__to").alias("person_id")).distinct())
        for known in rounds:
            step = step.join(known.select(*pair), pair, "left_anti")
        step = step.withColumn("hop", F.lit(hop))
        if hop == hops:  # nothing reads the last round twice
            return _union([*rounds, step])
        step, found = bucketed_and_count(step, pair, buckets, "reach")
        if not found:
            break
        rounds.append(step)
    return _union(rounds)


def links_between(edges: DataFrame, set_a: DataFrame, set_b: DataFrame) -> DataFrame:
    """Edges on a path of one or two steps from a person in A to a person in B.

    (from_id, to_id, link_order, middle_id): order 1 is an edge A-B; order 2 is a leg
    of A-X-B, with X as the middle. Legs are found by semi joins, so the result
    grows with the edges, not with the pairs that meet in X.
    """
    e = cut_lineage(edges.select("from_id", "to_id").where("from_id is not null and to_id is not null").distinct(), "links")
    a, b = id_set(set_a), id_set(set_b)
    out_of_a, into_b = of_ids(e, a, "from_id"), of_ids(e, b, "to_id")
    direct = of_ids(out_of_a, b, "to_id").select(
        "from_id", "to_id", F.lit(1).alias("link_order"), F.lit(None).cast("bigint").alias("middle_id"))

    def ends(legs: DataFrame, middle: str, end: str) -> DataFrame:
        return cut_lineage(legs.where("from_id <> to_id").groupBy(F.col(middle).alias("__x"))
                           .agg(F.min(end).alias("__lo"), F.max(end).alias("__hi")), "link-ends")

    # a leg A-X needs some X-B whose B is not the same A, so one other end must exist
    ends_b, ends_a = ends(into_b, "from_id", "to_id"), ends(out_of_a, "to_id", "from_id")

    def other_end(end: str):
        return (F.col("__lo") != F.col(end)) | (F.col("__hi") != F.col(end))

    first = out_of_a.where("from_id <> to_id").join(
        ends_b, (F.col("to_id") == F.col("__x")) & other_end("from_id"), "left_semi").select(
        "from_id", "to_id", F.lit(2).alias("link_order"), F.col("to_id").alias("middle_id"))
    second = into_b.where("from_id <> to_id").join(
        ends_a, (F.col("from_id") == F.col("__x")) & other_end("to_id"), "left_semi").select(
        "from_id", "to_id", F.lit(2).alias("link_order"), F.col("from_id").alias("middle_id"))
    return direct.union(first).union(second).distinct()


def _plain_edges(edges: DataFrame) -> DataFrame:
    return cut_lineage(edges.select("from_id", "to_id")
                       .where("from_id is not null and to_id is not null and from_id <> to_id").distinct(), "links")


def _pair_middles(e: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a_id, b_id, middle_id) of all two-step paths of the wanted pairs.

    Each pair is walked from its end with fewer edges, so a hub paired with many
    persons is not unrolled once per pair.
    """
    out_deg = cut_lineage(e.groupBy(F.col("from_id").alias("a_id")).agg(F.count(F.lit(1)).alias("__out")), "degrees")
    in_deg = cut_lineage(e.groupBy(F.col("to_id").alias("b_id")).agg(F.count(F.lit(1)).alias("__in")), "degrees")
    sized = wanted.join(out_deg, "a_id", "left").join(in_deg, "b_id", "left")
    forward = F.coalesce("__out", F.lit(0)) <= F.coalesce("__in", F.lit(0))
    from_a = (sized.where(forward).join(e.toDF("a_id", "middle_id"), "a_id").select("a_id", "b_id", "middle_id")
              .join(e.toDF("middle_id", "b_id"), ["middle_id", "b_id"], "left_semi"))
    from_b = (sized.where(~forward).join(e.toDF("middle_id", "b_id"), "b_id").select("a_id", "b_id", "middle_id")
              .join(e.toDF("a_id", "middle_id"), ["a_id", "middle_id"], "left_semi"))
    return from_a.unionByName(from_b).where("middle_id <> a_id and middle_id <> b_id")


def paths_of_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The paths that link given pairs: (a_id, middle_id, b_id, link_order), order 1 without and order 2 with a middle."""
    e, wanted = _plain_edges(edges), pairs.select("a_id", "b_id").distinct()
    direct = wanted.join(e.toDF("a_id", "b_id"), ["a_id", "b_id"], "left_semi").select(
        "a_id", F.lit(None).cast("bigint").alias("middle_id"), "b_id", F.lit(1).alias("link_order"))
    return direct.union(_pair_middles(e, wanted).select("a_id", "middle_id", "b_id", F.lit(2).alias("link_order")))


def pair_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """For given pairs (a_id, b_id): is there a direct edge, and how many persons link them."""
    e, wanted = _plain_edges(edges), pairs.select("a_id", "b_id").distinct()
    middle = _pair_middles(e, wanted).groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("middle_count"))
    direct = e.select(F.col("from_id").alias("a_id"), F.col("to_id").alias("b_id"), F.lit(True).alias("direct"))
    return (wanted.join(direct, ["a_id", "b_id"], "left").join(middle, ["a_id", "b_id"], "left")
            .select("a_id", "b_id", F.coalesce("direct", F.lit(False)).alias("direct"),
                    F.coalesce("middle_count", F.lit(0)).alias("middle_count")))
