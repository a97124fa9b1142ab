"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source gets a target in words. A document's expected copies are its source's target over its
source's words, scaled by an optional preference; the whole part is certain, and the fraction is its
inclusion probability. Documents are ranked by

    random odds / inclusion odds = (u / (1 - u)) / (p / (1 - p)),

and the smallest ranks are taken while they fit into the source's remaining words. The first that does not
fit ends a round; the next one goes on behind it with documents of at most half of the words that are left,
so that a long document at the cut shuts none out, until less than ``NEAR`` of the target is left. At last
one document more is taken, or none, if its size closes that gap. Random numbers come from hashes of the
document, and for rows that repeat it of their ordinal too, so reruns and retried tasks agree.

No source is ever sorted in one task: ranks fall into about sqrt(n) bins a source, running sums over the
bins tell in which one a source's words run out, and only that bin is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop_path, fields_of, materialise, row_of

#: Copies of a document the mix may hold at most.
MOST = 2.0
#: Share of a target that may be left over before another round of drawing.
NEAR = 0.0005
MIX = "__size", "__source_size", "__target", "__taken"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def longer(text: Column) -> Column:
    """A preference for longer documents: the logarithm of 1 + the number of words, 1 where there are none."""
    return F.greatest(F.log1p(word_count(text).cast("double")), F.lit(0.5))


def targets(sizes: DataFrame, weights: list[float], share: float, most: float = MOST) -> DataFrame:
    """``source``, ``source_size``, ``target`` from ``source`` and ``source_size``, one row a source.

    Sources in code-point order (null last) weigh ``weights``, repeating. Together they share ``share``
    times all sizes; a target above ``most`` times its source's size is cut to that, and the excess is
    shared again by weight among the others, until none is above. Sources are few (one row each), so
    this is one window over their sums.
    """
    # Spark orders strings by UTF-8 bytes, which is code-point order.
    one = Window.partitionBy(F.lit(1))
    order = one.orderBy(F.col("source").asc_nulls_last())
    at = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    at = at.withColumn("all", F.sum("source_size").over(one) * F.lit(float(share)))
    # Sharing out stops with every source of size * most / weight below some level at its cap, and the
    # others at weight * level. With sources sorted by that ratio, the first one whose ratio is not
    # reached by the level that the rest would get tells where.
    ratio = F.col("source_size") * most / F.col("weight")
    at = at.withColumn("ratio", ratio)
    sorted_by = one.orderBy("ratio", F.col("source").asc_nulls_last())
    before = sorted_by.rowsBetween(Window.unboundedPreceding, -1)
    onward = sorted_by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    at = at.withColumn("level", (F.col("all") - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    at = at.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(one)["level"])
    return at.select("source", "source_size", F.coalesce(F.least(F.col("source_size") * most, F.col("weight") * F.col("level")), F.col("source_size") * most).alias("target"))


def mix(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    prefer: str | Column | None = None,
    seed: int = 17,
) -> DataFrame:
    """All rows of ``df`` with ``__size``, ``__source_size``, ``__target`` and ``__taken`` (words).

    ``prefer`` is a column of positive preferences: expected copies within a source follow it (1 where it
    is null, not positive or not finite). Copies of a document never exceed ``MOST``. Null texts have no
    words and are taken 0 times; a null source is a source of its own; rows alike in id, text, source and
    preference are drawn one by one, and which of them are taken is open; an empty table gives an empty
    one. Columns of ``df`` may have any name; those with the four names are replaced.

    ``df`` is read twice and must give the same partitions both times, as files do, if rows repeat in it.
    It is never shuffled while its sources' sums are small enough to broadcast by the session's threshold,
    but for rows that repeat; beyond it Spark joins by a shuffle.
    """
    held = [c for c in df.columns if c not in MIX]
    size = word_count(F.col(f"`{text}`")).alias("__size")
    key = F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("__hash")
    liking = (F.col(f"`{prefer}`") if isinstance(prefer, str) else F.lit(1.0) if prefer is None else prefer).cast("double")
    want = F.when((liking > 0) & ~F.isnan(liking) & (liking < float("inf")), liking).otherwise(1.0).alias("__want")
    origin = F.col(f"`{source}`").cast("string").alias("__source")
    rows = df.select(row_of(held), origin, size, key, want, F.spark_partition_id().alias("__part"))
    slim = materialise(rows.drop("row"), "sizes")
    again = slim.groupBy("__source", "__hash", "__want").agg(F.count("*").alias("n")).where("n > 1").select("__source", "__hash", "__want")
    again = materialise(_offsets(slim, again), "repeats")
    repeats = not again.isEmpty()
    if repeats:
        slim = materialise(_told_apart(slim, again), "sizes-apart")
    sums = slim.groupBy("__source").agg(F.sum("__size").alias("__source_size"), F.count("*").alias("__n"), F.sum(F.col("__size") * F.col("__want")).alias("__wanted"))
    sums = materialise(sums, "sources")
    goal = targets(sums.select(F.col("__source").alias("source"), F.col("__source_size").alias("source_size")), list(weights), share)
    goal = materialise(sums.join(goal.select("source", F.col("target").alias("__target")), F.col("__source").eqNullSafe(F.col("source"))).drop("source").withColumn("__factor", F.when(F.col("__wanted") > 0, F.col("__target") / F.col("__wanted")).otherwise(0.0)), "targets")
    if prefer is not None:
        goal = _settled(slim, goal)
    cuts = _drawn(slim, goal)
    out = _ranked(_told_apart(rows, again) if repeats else rows, cuts)
    drawn = F.col("__rank").isNotNull() & (_in(F.col("__cuts")) | F.coalesce(_me() == F.col("__more"), F.lit(False)))
    taken = (F.col("__size") * (F.col("__sure") + F.when(drawn, 1).otherwise(0))).cast("long").alias("__taken")
    return out.select(*fields_of(held), "__size", "__source_size", "__target", taken)


def _me() -> Column:
    """The order of drawing: by rank; the others make it total."""
    return F.struct("__rank", "__hash", "__size")


_ME = "struct<__rank:double,__hash:long,__size:long>"


def _in(cuts: Column) -> Column:
    """Whether a document lies in one of the stretches of ranks drawn."""
    return F.coalesce(F.exists(cuts, lambda c: (c["after"].isNull() | (_me() > c["after"])) & (_me() <= c["upto"]) & (F.col("__size") <= c["most"])), F.lit(False))


def _offsets(slim: DataFrame, again: DataFrame) -> DataFrame:
    """For repeated documents, how many of their rows lie in partitions before each partition."""
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("__source", "__hash", "__want")]
    here = slim.alias("a").join(again.alias("b"), same, "left_semi").groupBy("__source", "__hash", "__want", "__part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__source", "__hash", "__want").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return here.select(F.col("__source").alias("s"), F.col("__hash").alias("h"), F.col("__want").alias("w"), F.col("__part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def _told_apart(rows: DataFrame, again: DataFrame) -> DataFrame:
    """``rows`` with a hash of its own for each of the rows that repeat a document, by its ordinal.

    Ordinals are counted within partitions, so that a row repeated very often is never in one task.
    """
    same = F.col("__source").eqNullSafe(F.col("s")) & (F.col("__hash") == F.col("h")) & (F.col("__want") == F.col("w")) & (F.col("__part") == F.col("p"))
    own = Window.partitionBy("__source", "__hash", "__want", "__part").orderBy("__size")
    once = rows.join(again, same, "left_anti")
    more = rows.join(again, same).withColumn("k", F.col("before") + F.row_number().over(own) - 1)
    more = more.withColumn("__hash", F.when(F.col("k") > 0, F.xxhash64("__hash", "k")).otherwise(F.col("__hash")))
    return once.unionByName(more.select(*rows.columns))


def _settled(slim: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with factors by which preferences, cut at ``MOST`` copies, add up to the target.

    Each round gives what the cut takes from documents at ``MOST`` to the others; a source is done when
    its factor moves by less than a thousandth (drawing fills up to the target in any case), so rounds are few.
    """
    while True:
        at = slim.join(goal.select(F.col("__source").alias("of"), "__factor"), F.col("__source").eqNullSafe(F.col("of")))
        full = F.col("__factor") * F.col("__want") >= MOST
        sums = at.groupBy("of").agg(F.sum(F.when(full, F.col("__size")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("__size") * F.col("__want"))).alias("open"))
        found = goal.join(sums, F.col("__source").eqNullSafe(F.col("of"))).drop("of")
        next_ = F.when(F.col("open") > 0, F.greatest("__factor", (F.col("__target") - MOST * F.col("full")) / F.col("open"))).otherwise(F.col("__factor"))
        found = materialise(found.withColumn("next", next_), "factors")
        moving = not found.where(F.col("next") > F.col("__factor") * (1 + 1e-3)).isEmpty()
        goal = found.withColumn("__factor", F.col("next")).drop("next", "full", "open")
        if not moving:
            return goal


def _ranked(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``rows`` with their source's figures, ``__sure`` copies, and ``__rank`` (null: no further copy)."""
    at = rows.join(goal.withColumnRenamed("__source", "__of"), F.col("__source").eqNullSafe(F.col("__of"))).drop("__of")
    copies = F.least(F.lit(MOST), F.col("__factor") * F.col("__want"))
    at = at.withColumn("__copies", copies).withColumn("__sure", F.floor("__copies")).withColumn("__p", F.col("__copies") - F.col("__sure"))
    u = (F.shiftrightunsigned(F.col("__hash"), 12).cast("double") + 0.5) / float(1 << 52)
    return at.withColumn("__rank", F.when((F.col("__p") > 0) & (F.col("__size") > 0), (u / (1 - u)) * (1 - F.col("__p")) / F.col("__p")))


def _drawn(slim: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with the stretches of ranks drawn of each source, ``__cuts``, and ``__more``: one document more."""
    sure = _ranked(slim, goal).groupBy("__source").agg(F.sum(F.col("__size") * F.col("__sure")).alias("sure"))
    none = F.array().cast(f"array<struct<after:{_ME},upto:{_ME},most:double>>")
    at = goal.join(sure.withColumnRenamed("__source", "of"), F.col("__source").eqNullSafe(F.col("of"))).drop("of")
    at = at.select(*goal.columns, (F.col("__target") - F.col("sure")).alias("__gap"), none.alias("__cuts"), F.lit(False).alias("__done"))
    at = materialise(at, "cuts")
    while True:
        found = _stretch(_ranked(slim, at.where("not __done and __gap > 0")))
        last = F.when(F.size("__cuts") > 0, F.element_at("__cuts", -1)["upto"])
        fresh = F.struct(last.alias("after"), F.col("upto"), _most().alias("most"))
        joined = at.join(found, F.col("__source").eqNullSafe(F.col("of")), "left")
        gap = F.col("__gap") - F.coalesce("words", F.lit(0))
        cuts = F.when(F.col("upto").isNull(), F.col("__cuts")).otherwise(F.concat("__cuts", F.array(fresh)))
        done = F.col("__done") | F.col("upto").isNull() | (gap <= F.col("__target") * NEAR)
        before = at
        at = materialise(joined.select(*goal.columns, gap.alias("__gap"), cuts.alias("__cuts"), done.alias("__done")), "cuts")
        drop_path(slim.sparkSession, before.shared_path)
        if at.where("not __done").isEmpty():
            break
    # one document more, or none, closes the gap that is left: the one whose size fits it best
    rest = _ranked(slim, at.where("__gap > 0"))
    miss = F.abs(F.col("__gap") - F.col("__size"))
    rest = rest.where(F.col("__rank").isNotNull() & ~_in(F.col("__cuts")) & (miss < F.col("__gap")))
    more = rest.groupBy(F.col("__source").alias("of")).agg(F.min_by(_me(), F.struct(miss, _me())).alias("__more"))
    return materialise(at.join(more, F.col("__source").eqNullSafe(F.col("of")), "left").select(*goal.columns, "__cuts", "__more"), "draws")


def _most() -> Column:
    """Sizes that a round looks at: all in the first one, then up to half of the gap."""
    return F.when(F.size("__cuts") == 0, F.lit(float("inf"))).otherwise(F.col("__gap") / 2)


def _stretch(ranked: DataFrame) -> DataFrame:
    """``of`` (source), ``upto`` (the last document drawn in a round) and ``words``; no row where none fits."""
    last = F.when(F.size("__cuts") > 0, F.element_at("__cuts", -1)["upto"])
    at = ranked.where(F.col("__rank").isNotNull() & (last.isNull() | (_me() > last)) & (F.col("__size") <= _most()))
    mean = F.greatest(F.least(F.col("__target") / F.greatest("__source_size", F.lit(1)) % 1, F.lit(1 - 1e-9)), F.lit(1e-9))
    at = at.select(F.col("__source").alias("of"), "__gap", "__size", "__hash", "__rank", F.ceil(F.sqrt("__n")).alias("bins"), mean.alias("mean"))
    # times the source's mean odds, ranks are random odds, and so odds / (1 + odds) spread over (0, 1)
    odds = F.col("__rank") * F.col("mean") / (1 - F.col("mean"))
    at = at.withColumn("bin", F.floor(odds / (1 + odds) * F.col("bins")))
    upto = Window.partitionBy("of").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = at.groupBy("of", "bin").agg(F.sum("__size").alias("size"), F.first("__gap").alias("gap")).withColumn("sum", F.sum("size").over(upto))
    # the bin in which a source's words run out, or its last one
    end = F.struct("bin", "sum", "size")
    ends = bins.groupBy("of").agg(F.min(F.when(F.col("sum") >= F.col("gap"), end)).alias("end"), F.max(end).alias("final"))
    ends = ends.select("of", F.coalesce("end", "final").alias("e")).select(F.col("of").alias("o"), F.col("e.bin").alias("end"), (F.col("e.sum") - F.col("e.size")).alias("before"))
    near = at.join(ends, F.col("of").eqNullSafe(F.col("o")) & (F.col("bin") == F.col("end")))
    ahead = Window.partitionBy("of").orderBy("__rank", "__hash", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("sum", F.col("before") + F.sum("__size").over(ahead))
    fits = F.col("sum") <= F.col("__gap")
    inner = near.groupBy("of").agg(F.max(F.when(fits, _me())).alias("inner"), F.max(F.when(fits, F.col("sum"))).alias("sum"), F.min("__rank").alias("first"), F.first("before").alias("before"))
    # where not even the first of that bin is drawn, all of the bins before it are
    below = F.when(F.col("before") > 0, F.struct(F.col("first").alias("__rank"), F.lit(-(1 << 63)).cast("long").alias("__hash"), F.lit(0).cast("long").alias("__size")))
    return inner.select("of", F.coalesce("inner", below).alias("upto"), F.coalesce("sum", "before").alias("words")).where("upto is not null")


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The documents of a mix, each as often as it was taken."""
    times = F.when(F.col("__size") > 0, (F.col("__taken") / F.col("__size")).cast("int")).otherwise(0)
    copies = mixed.select(row_of(columns), F.array_repeat(F.lit(0), times).alias("copies"))
    return copies.select("row", F.explode("copies")).select(*fields_of(columns))
