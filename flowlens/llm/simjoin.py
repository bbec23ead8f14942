"""From band keys to verified similarity components, shared by the
near-duplicate operators.

Nodes are distinct shingle sets (64-bit ``set_id``); equal texts have been
merged before, so groups of exact copies never reach a bucket. Buckets are
resolved without enumerating their pairs. Every member is verified against
the bucket's centre, a set that shares buckets with many of its kind, and
components are formed from the verified links. Buckets that still hold several
components go through frames, which find every remaining link between their
members, so no link between sets that share a bucket is lost.

Frame. All sets that met at one centre c have one reference r: c, but for the
elements in which more than half of them differ from c. Jaccard distance d is
a metric, so sets whose distances to r differ by more than 1 - t (t: the
similarity) aren't linked. A frame settles the pairs of sets within
``NEAR`` + 1 - t of r by the difference join; sets beyond ``NEAR`` go on to the
next frame, with a centre from among them. Any pair is thus settled in one of
the frames or is apart; the last one takes all sets.

Difference join. Let D(x) be the symmetric difference of x and r, and
g = (1 - t) / (1 + t); sets are linked if |x diff y| <= g (|x| + |y|). If x is
far from r, |D(x)| > g (|x| + |r|), a link of x and y needs
|D(x) & D(y)| > L(y) = (|D(y)| - g (|y| - |r|)) / 2, so D(x) holds one of the
first |D(y)| - floor(L(y)) elements of D(y), in whatever order. Rarest first,
these are what distinguishes y, and the join on them is small. Sets that are
not far from r are in one component as a rule; those that aren't are paired
with the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.components import connected_components
from flowlens.operators.common import Scratch, materialize


FRAMES = 4
NEAR = 0.3          # distance to a frame's reference from which sets go on to the next frame
_SLACK = 1e-9       # of distances in double precision


BIT_WORDS = 1 << 19     # longs of a table of bits, at most: what a filter sends to every executor


def likely(rows: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
    """The rows of ``rows`` whose ``key`` (a 64-bit hash) is in ``wanted(key)``, and a
    few others, by a broadcast table of bits: a join of large rows with ``wanted``
    then needn't shuffle the rest. The table is bounded; with very many keys
    more rows pass."""
    at, bit = "pmod({0}, %d)" % BIT_WORDS, "shiftleft(1L, cast(shiftrightunsigned({0}, 32) & 63 as int))"
    bits = materialize(wanted.select(F.expr(at.format(key)).alias("_word"), F.expr(bit.format(key)).alias("_bit"))
                       .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), f"{name}-bits")
    return rows.join(F.broadcast(bits), F.expr(at.format(key)) == F.col("_word")) \
        .where(F.expr("_bits & " + bit.format(key) + " <> 0")).select(*rows.columns)


def named_rows(docs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """``docs(doc_id, text, tid)`` joined with the table ``wanted(_doc, _tid, ...)`` that
    names some of its rows; few of the other texts are shuffled."""
    row = docs.withColumn("_row", F.xxhash64("tid", "doc_id"))
    near = likely(row, "_row", wanted.select(F.xxhash64("_tid", "_doc").alias("_row")), name).drop("_row")
    return near.join(wanted, (F.col("tid") == F.col("_tid")) & F.col("doc_id").eqNullSafe(F.col("_doc")))


def jaccard_at_least(percent: int):
    """100 * |A and B| >= percent * |A or B| on columns ``sa``, ``sb`` (arrays of distinct values)."""
    both = F.size(F.array_intersect("sa", "sb"))
    return 100 * both >= percent * (F.size("sa") + F.size("sb") - both)


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` with their full sets ``sa`` and ``sb``. ``sets``: (set_id, items)."""
    a = sets.select(F.col("set_id").alias("a"), F.col("items").alias("sa"))
    b = sets.select(F.col("set_id").alias("b"), F.col("items").alias("sb"))
    return pairs.join(a, "a").join(b, "b")


def differences(members: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """``members(centre, set_id, label)`` with their differences to the reference
    of their centre: items, size, d (Jaccard distance), far; n and n_ref are
    the sizes of both, linked tells the link to the centre itself."""
    more, less = 100 + percent, 100 - percent
    pairs = members.select(F.col("set_id").alias("a"), F.col("centre").alias("b"), "label")
    raw = materialize(with_sets(pairs, sets).select(
        F.col("a").alias("set_id"), F.col("b").alias("centre"), "label", F.size("sa").alias("n"),
        F.size("sb").alias("n_centre"), F.array_except("sa", "sb").alias("more"),
        F.array_except("sb", "sa").alias("less")), f"{name}-differences")
    count = materialize(raw.groupBy("centre").agg(F.count("*").alias("members")), f"{name}-sizes")
    each = raw.select("centre", F.explode(F.concat(
        F.transform("more", lambda e: F.struct(e.alias("item"), F.lit(1).alias("adds"))),
        F.transform("less", lambda e: F.struct(e.alias("item"), F.lit(-1).alias("adds"))))).alias("e"))
    usual = each.groupBy("centre", "e.item", "e.adds").agg(F.count("*").alias("f")).join(count, "centre") \
        .where("2 * f > members").groupBy("centre") \
        .agg(F.collect_list("item").alias("usual"), F.sum("adds").cast("int").alias("adds"))   # at most twice a set's size
    usual = materialize(usual, f"{name}-usual")
    items = F.concat("more", "less")
    referred = raw.join(usual, "centre", "left").select(
        "centre", "set_id", "label", "n", (F.col("n_centre") + F.coalesce("adds", F.lit(0))).alias("n_ref"),
        (more * F.size(items) <= less * (F.col("n") + F.col("n_centre"))).alias("linked"),
        F.when(F.col("usual").isNull(), items)
        .otherwise(F.concat(F.array_except(items, "usual"), F.array_except("usual", items))).alias("items")) \
        .withColumn("size", F.size("items")) \
        .withColumn("far", F.expr(f"{more} * size > {less} * (n + n_ref)")) \
        .withColumn("d", F.expr("2D * size / (n + n_ref + size)"))
    return materialize(referred, f"{name}-referred")


def difference_candidates(referred: DataFrame, percent: int, name: str) -> DataFrame:
    """Pairs ``(a, b)`` of different labels that may be linked: all of them that
    are, among the sets of one centre."""
    more, less = 100 + percent, 100 - percent
    apart = 1 - percent / 100 + _SLACK
    rows = referred.select("centre", "set_id", "label", "n", "n_ref", "size", "far", "d", F.explode("items").alias("item"))
    # an element of one difference only is no meeting point; it comes first in its set's order
    shared = materialize(
        rows.groupBy("centre", "item").agg(F.count("*").alias("f"), F.max("far").alias("any_far"))
        .where("f > 1 and any_far").select("centre", "item", "f"), f"{name}-elements")
    meeting = materialize(rows.join(shared, ["centre", "item"]), f"{name}-meeting")
    of_set = Window.partitionBy("centre", "set_id")
    first = meeting.withColumn("of", F.count("*").over(of_set)) \
        .withColumn("r", F.row_number().over(of_set.orderBy("f", "item"))) \
        .withColumn("needed", F.expr(f"({more} * size - {less} * (n - n_ref)) div {2 * more}")) \
        .where("r <= of - needed")
    def side(table: DataFrame, key: list[str], s: str) -> DataFrame:
        return table.select(*key, F.col("set_id").alias(s), F.col("label").alias(f"l{s}"), F.col("d").alias(f"d{s}"))

    by_item = side(meeting.where("far"), ["centre", "item"], "x").join(side(first, ["centre", "item"], "y"), ["centre", "item"]) \
        .where(f"x <> y and lx <> ly and abs(dx - dy) <= {apart}").select("x", "y")

    near = referred.where("not far").select("centre", "set_id", "label", "d")
    main = near.groupBy("centre", "label").agg(F.count("*").alias("f")).groupBy("centre") \
        .agg(F.max_by("label", F.struct("f", "label")).alias("main"))
    others = near.join(materialize(main, f"{name}-main"), "centre").where("label <> main")
    by_reference = side(others, ["centre"], "x").join(side(near, ["centre"], "y"), "centre") \
        .where("lx <> ly").select("x", "y")
    return by_item.unionByName(by_reference) \
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _best(seen: DataFrame, side: str, name: str) -> DataFrame:
    """``seen(key, set_id, c)`` with the largest ``c`` of each key or set."""
    best = materialize(seen.groupBy(side).agg(F.max("c").alias("best")), name)
    return seen.join(best, side).select("key", "set_id", F.col("best").alias("c"))


def merged(labels: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``labels(node, label)`` after the links ``found(a, b)``: components of the
    labels that they join, most of them being inside one label already."""
    ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
    ends = ends.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "label")
    ends = materialize(ends.toDF("node", "of", "known"), f"{name}-ends")
    across = found.join(ends.select(F.col("node").alias("a"), F.col("of").alias("x")), "a") \
        .join(ends.select(F.col("node").alias("b"), F.col("of").alias("y")), "b").where("x <> y") \
        .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    across = materialize(across, f"{name}-across")
    if across.isEmpty():
        return labels
    roots = connected_components(across, f"{name}-cc").select(F.col("node").alias("label"), F.col("label").alias("root"))
    every = labels.unionByName(ends.where("known is null").select("node", F.col("of").alias("label")))
    return materialize(every.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")),
                       f"{name}-labels")


def similarity_components(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame],
                          percent: int, name: str, frames: int = FRAMES) -> DataFrame:
    """``nodes(set_id, bands array<long>)``, one row per set -> ``(node, label)``
    for every set linked to another one.

    ``sets_of(ids)`` gives ``(set_id, items array<long>)`` for a table of ids.
    """
    keyed = nodes.select("set_id", F.explode("bands").alias("key"))
    shared = materialize(
        keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), f"{name}-shared")   # a row per set and key
    members = materialize(likely(keyed, "key", shared.select("key"), name).join(shared, "key"), f"{name}-members")
    sets = materialize(sets_of(members.select("set_id").distinct()), f"{name}-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        return materialize(with_sets(materialize(pairs.distinct(), f"{name}-pairs"), sets)
                           .where(jaccard_at_least(percent)).select("a", "b"), f"{name}-links")

    def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
        return members.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left") \
            .withColumn("label", F.coalesce("label", "set_id"))

    def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows of ``members(key, set_id)`` in buckets that hold several labels."""
        rows = materialize(labelled(members, labels), f"{name}-labelled")
        mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        return materialize(rows.join(materialize(mixed.select("key"), f"{name}-mixed"), "key", "left_semi")
                           .select("key", "set_id"), f"{name}-unsettled")

    met = members.groupBy("set_id").agg(F.sum("size").alias("met"))
    own = materialize(
        members.select("key", "set_id").join(materialize(met, f"{name}-met"), "set_id")
        .select("key", "set_id", F.struct("met", "set_id").alias("c")), f"{name}-own")
    centred = materialize(_best(own, "key", f"{name}-best"), f"{name}-centred")
    links = verified(centred.select(F.col("set_id").alias("a"), F.col("c.set_id").alias("b")).where("a <> b"))
    labels = connected_components(links, f"{name}-cc")
    rest = unsettled(members.select("key", "set_id"), labels)
    # A set's reference is the best connected centre of all its buckets; in the first frame an unsettled
    # bucket's centre is its members' best connected reference: near copies of one text meet at that text.
    choice = materialize(_best(centred, "set_id", f"{name}-best"), f"{name}-references")
    for frame in range(frames):
        if rest.isEmpty():
            break
        with Scratch(nodes.sparkSession) as run:
            stars = _best(choice.join(rest, ["key", "set_id"], "left_semi"), "key", f"{name}-best")
            stars = materialize(stars.select("key", "set_id", F.col("c.set_id").alias("centre")), f"{name}-frame")
            choice = own
            pairs = stars.where("set_id <> centre").select("centre", "set_id").distinct()
            referred = differences(labelled(pairs, labels), sets, percent, name)
            scope = referred if frame == frames - 1 else referred.where(F.col("d") <= NEAR + 1 - percent / 100 + _SLACK)
            found = verified(difference_candidates(scope, percent, name)).unionByName(
                referred.where("linked").select(F.col("set_id").alias("a"), F.col("centre").alias("b")))
            # the frame's own tables go, its labels and what it leaves unsettled stay
            labels = materialize(merged(labels, found, name), f"{name}-labels")
            run.keep_table(labels)
            if frame < frames - 1:
                beyond = referred.where(F.col("d") > NEAR).select("centre", "set_id")
                rest = unsettled(stars.join(beyond, ["centre", "set_id"], "left_semi").select("key", "set_id"), labels)
                run.keep_table(rest)
    return labels
