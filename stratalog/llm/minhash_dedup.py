"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its distinct word shingles, each hashed to 64 bits.
The sketch is the ``k`` smallest hashes. The steps:

1. Documents with one and the same set fall together in a grouped minimum;
   only one representative of each set goes on.
2. Inverted lists of retained values generate overlaps. Two sets at the
   threshold share ``least_shared(k)`` retained values but with a chance of
   ``miss``; then also two of the ``k - least_shared(k) + 2`` of either that
   the fewest sketches retain. Only these are listed, so a common shingle
   makes no list unless a sketch holds little else, and a set whose rare
   values nobody shares takes no further part.
3. Each list's members are paired with two of its members: the one with the
   fewest values of its own, which is as a rule what others were copied from,
   and the smallest id. Of pairs that share two lists the sketch of the union
   estimates the similarity, exact Jaccard on full sets decides, and linked
   sets become components.
4. Lists that are one component by now are done. In the others, members
   outside the list's largest component meet the members of other components.
   A pair is estimated inside the join, in one of the lists that it shares:
   first to find the members that are close to another at all, then by wider
   sketches of these; only likely pairs leave the join, and exact Jaccard
   decides again.

No list is cut short and none is compared in one task: a list goes to as many
tasks as hold ``block`` members each. What grows faster than the input is the
number of estimates within a large group of copies that are not linked to its
largest component; rows written do not.

Defined cases: a null text, or one without words, has an empty set and is
linked with nothing; a text with fewer words than a shingle has its whole word
sequence as its only shingle; repeated rows are copies of one another; rows
with one id and different texts are placed each by its own text; a row without
an id is not kept, takes the component of its copies and links nothing else;
other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, keep_ids, stage, words
from .components import connected_components


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(id, n_shingles, shingles)``, the shingles sorted and distinct."""
    split = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(words(ascii_lower(F.col(text_col))), F.array()).alias("w")
    )
    n = F.size("w")
    inner = F.transform(
        F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(*[F.element_at("w", i + j) for j in range(width)])
    )
    hashed = (
        F.when(n == 0, F.array().cast("array<bigint>"))
        .when(n < width, F.array(F.xxhash64(F.lit(-1), F.concat_ws(" ", "w"))))
        .otherwise(inner)
    )
    sets = split.select("id", F.sort_array(F.array_distinct(hashed)).alias("shingles"))
    return sets.select("id", F.size("shingles").cast("long").alias("n_shingles"), "shingles")


def sketch_table(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """``(id, n_shingles, k1, k2, sketch)``; k1 and k2 identify the set."""
    return shingle_sets(docs, id_col, text_col, width).select(
        "id",
        "n_shingles",
        F.xxhash64("shingles").alias("k1"),
        F.xxhash64(F.lit(1), "shingles").alias("k2"),
        F.slice("shingles", 1, k).alias("sketch"),
    )


def least_shared(k: int, threshold: int, miss: float) -> int:
    """Of ``k`` values of a union's sketch, a pair at the threshold shares fewer with a chance of at most ``miss``."""
    t, below, c = threshold / 100, 0.0, 0
    while c < k:
        below += math.comb(k, c) * t**c * (1 - t) ** (k - c)
        if below > miss:
            break
        c += 1
    return c


def _upper(hashes: Column) -> Column:
    """The upper halves of sorted hashes, in the same order and half the space."""
    return F.transform(hashes, lambda x: F.shiftright(x, 32).cast("int"))


def _fits(na: Column, nb: Column, threshold: int) -> Column:
    """Whether sets of these sizes can be linked."""
    return (na * 100 >= nb * threshold) & (nb * 100 >= na * threshold)


def _likely(sa: Column, sb: Column, na: Column, nb: Column, wide: int, threshold: int, miss: float) -> Column:
    """Whether the sketch of the union lets a pair be linked.

    Sets within ``wide`` values are sketched whole, so that the estimate is
    their similarity, less what two values with one upper half may take away.
    """
    union = F.slice(F.array_sort(F.array_union(sa, sb)), 1, wide)
    shared = F.size(F.array_intersect(F.array_intersect(union, sa), sb))
    whole = (na <= wide) & (nb <= wide)
    both = F.size(F.array_intersect(sa, sb)) + 1
    return F.when(whole, both * 100 >= threshold * (na + nb - both)).otherwise(shared >= least_shared(wide, threshold, miss))


def _lists_shared(n: Column, threshold: int, k: int, miss: float) -> Column:
    """Lists that a set of ``n`` values shares with any that it is linked with: two, or one if it shares no two values."""
    two = least_shared(k, threshold, miss) > 1
    return F.when((n * threshold > 100) & F.lit(two), 2).otherwise(1)


def rare_lists(reps: DataFrame, threshold: int, k: int, miss: float) -> DataFrame:
    """``reps(rep, n, sketch)`` to lists ``(v, rep, n, c, head, head_n, low, low_n)`` of ``c`` > 1 members."""
    values = reps.select("rep", F.col("n").cast("int").alias("n"), F.explode("sketch").alias("v"))
    held = values.groupBy("v").agg(F.count("*").cast("int").alias("f")).where("f > 1")
    ranked = values.join(held, "v").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("all"))
    size = F.least("n", F.lit(k))
    # a set of fewer than threshold * k values is linked with whole sketches only; others share at least what sketches do
    exact = F.ceil(F.col("n") * threshold / 100).cast("int")
    least = F.when(F.col("n") * 100 < threshold * k, exact).otherwise(F.lit(least_shared(k, threshold, miss)))
    own = size - F.size("all")  # values that no other sketch retains are the rarest
    listed = ranked.select("rep", "n", own.alias("own"), (size - least + _lists_shared(F.col("n"), threshold, k, miss) - own).alias("slots"), "all").where("slots > 0")
    listed = listed.select("rep", "n", "own", F.explode(F.slice("all", F.lit(1), F.col("slots"))).alias("one")).select(
        "rep", "n", "own", F.col("one.v").alias("v")
    )
    listed = stage(listed, "listed")
    lengths = (
        listed.groupBy("v")
        .agg(F.count("*").alias("c"), F.min(F.struct("own", "rep", "n")).alias("head"), F.min(F.struct("rep", "n")).alias("low"))
        .where("c > 1")
        .select("v", "c", F.col("head.rep").alias("head"), F.col("head.n").alias("head_n"), F.col("low.rep").alias("low"), F.col("low.n").alias("low_n"))
    )
    lists = stage(listed.select("v", "rep", "n").join(lengths, "v"), "lists")
    discard(listed)
    return lists


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: int = 80,
    k: int = 32,
    wide: int = 256,
    miss: float = 1e-5,
    block: int = 1024,
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Linked: 100 * |intersection| >= threshold * |union| on full shingle sets.
    ``component_id`` is the smallest id reachable by links. ``wide`` values of
    either set estimate a pair. A pair right at the threshold is missed with a
    chance of at most ``miss`` by the lists and as much by the estimate.
    """
    if not 0 < threshold <= 100:
        raise ValueError("threshold must be a percentage above 0")
    sk = stage(sketch_table(docs, id_col, text_col, width, k), "sketches")
    reps = (
        sk.where("n_shingles > 0")
        .groupBy("k1", "k2")
        .agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    )
    reps = stage(reps.where("rep IS NOT NULL"), "sets")
    lists = rare_lists(reps.select("rep", "n", "sketch"), threshold, k, miss)
    brief = reps.select("rep", "n", _upper(F.col("sketch")).alias("s"))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    repeated = not sk.groupBy("id").count().where("count > 1").isEmpty()

    def full_sets(ids: DataFrame, label: str) -> DataFrame:
        """``(rep, n, s, shingles)`` of some ids, ``s`` being the wide sketch."""
        full = shingle_sets(keep_ids(slim, ids.select(F.col("rep").alias("id")), "id"), "id", "text", width)
        full = full.distinct() if repeated else full  # equal rows would multiply pairs
        wider = _upper(F.slice("shingles", 1, wide)).alias("s")
        # filtered once written: pushed below, the filter would split each text once for each of its words
        return stage(full.select(F.col("id").alias("rep"), F.col("n_shingles").alias("n"), wider, "shingles"), label).where("n > 0")

    def ends(pairs: DataFrame, side: DataFrame) -> DataFrame:
        """``pairs(a, b)`` with the columns of ``side`` for both."""
        out = pairs
        for end in ("a", "b"):
            mine = keep_ids(side, pairs.select(F.col(end).alias("rep")).distinct(), "rep")
            out = out.join(mine.select(F.col("rep").alias(end), *[F.col(c).alias(c + end) for c in side.columns if c != "rep"]), end)
        return out

    def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
        found = ends(pairs, full.select("rep", "n", "shingles")).withColumn("both", F.size(F.array_intersect("shinglesa", "shinglesb")))
        return found.where(F.col("both") * 100 >= threshold * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")

    def star(head: str) -> DataFrame:
        near = lists.where((F.col("rep") != F.col(head)) & _fits(F.col("n"), F.col(head + "_n"), threshold))
        return near.select(F.least("rep", head).alias("a"), F.greatest("rep", head).alias("b"))

    # what shares two lists with a head; anything else that is linked is found among the open lists
    stars = stage(star("head").union(star("low")).groupBy("a", "b").count().where("count > 1").select("a", "b"), "stars")
    likely = ends(stars, brief).where(_likely(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), k, threshold, miss))
    likely = stage(likely.select("a", "b").distinct(), "likely")
    some = stage(likely.select(F.col("a").alias("rep")).union(likely.select("b")).distinct(), "some")
    full = full_sets(some, "full")
    linked = stage(verified(likely, full), "linked")
    discard(full, some, likely, stars)  # full sets are the largest table of all
    first = stage(connected_components(linked), "first")

    needed = lists.select("v", "rep", "n", _lists_shared(F.col("n"), threshold, k, miss).alias("need"))
    posted = _open_members(needed, first, brief.select("rep", "s"), block)
    discard(lists)
    left, right, likely = _open_join(posted, k, threshold, miss)
    near = left.join(right, likely, "left_semi").select("rep").union(right.join(left, likely, "left_semi").select("rep"))
    near = stage(near.distinct(), "near")
    full = full_sets(near, "full2")
    left, right, likely = _open_join(posted.drop("s").join(full.select("rep", "n", "s"), ["rep", "n"]), wide, threshold, miss)
    rest = left.join(right, likely).select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b"))
    links = first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(verified(stage(rest, "open"), full))
    labels = connected_components(links)
    discard(posted, near, full)

    named = (
        reps.select("k1", "k2", "rep")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    )
    return (
        sk.select("id", "n_shingles", "k1", "k2")
        .join(named, ["k1", "k2"], "left")
        .select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("id"), F.lit(False)))
        .withColumnRenamed("id", id_col)
    )


def _open_members(lists: DataFrame, labels: DataFrame, sketches: DataFrame, block: int) -> DataFrame:
    """``(rep, n, need, comp, s, at, v, main, blocks)``: the members of lists that are not one component.

    ``at`` has all such lists of a member; ``main`` is the list's largest component.
    """
    placed = lists.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "v", "rep", "n", "need", F.coalesce("component", "rep").alias("comp")
    )
    placed = stage(placed, "placed")
    crowd = placed.groupBy("v", "comp").agg(F.count("*").alias("c"))
    mixed = crowd.groupBy("v").agg(F.sum("c").alias("c"), F.count("*").alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("main"))
    mixed = mixed.where("comps > 1").select("v", "main", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    members = placed.join(mixed, "v").groupBy("rep", "n", "need", "comp").agg(
        F.sort_array(F.collect_list(F.struct("v", "main", "blocks"))).alias("in")
    )
    members = members.where("size(in) >= need").join(sketches, "rep").withColumn("at", F.col("in.v"))
    members = members.select("rep", "n", "need", "comp", "s", "at", F.explode("in").alias("one")).select("rep", "n", "need", "comp", "s", "at", "one.*")
    members = stage(members, "members")
    discard(placed)
    return members


def _open_join(posted: DataFrame, size: int, threshold: int, miss: float) -> tuple[DataFrame, DataFrame, Column]:
    """Members outside a list's largest component (l), all members (r), and when to join them.

    Each pair that shares lists is looked at in one of them, chosen by a hash
    of both ids, which spreads a large group over all its lists. A list is
    dealt to ``blocks`` tasks; only the members outside its largest component
    are sent to each.
    """
    right = posted.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).alias("r")
    left = posted.where("comp <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("l")
    both = F.array_intersect("l.at", "r.at")
    turn = F.pmod(F.xxhash64(F.least("l.rep", "r.rep"), F.greatest("l.rep", "r.rep")), F.size(both)).cast("int")
    return left, right, (
        (F.col("l.v") == F.col("r.v"))
        & (F.col("l.part") == F.col("r.part"))
        & (F.col("l.comp") != F.col("r.comp"))
        & ((F.col("r.comp") == F.col("r.main")) | (F.col("l.rep") < F.col("r.rep")))
        & _fits(F.col("l.n"), F.col("r.n"), threshold)
        & (F.size(both) >= F.least("l.need", "r.need"))
        & (F.element_at(both, turn + 1) == F.col("l.v"))
        & _likely(F.col("l.s"), F.col("r.s"), F.col("l.n"), F.col("r.n"), size, threshold, miss)
    )
