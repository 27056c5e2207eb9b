"""Mixing sources to target weights along a curriculum.

Each source has a target number of words and a schedule: its weight as a
function of training time from 0 to 1, linear between knots. The integral of
the schedule, scaled to the target, is the source's cumulative demand. A
source's documents follow each other in a fixed hashed order, several times
over where the target exceeds the source; the words before a document's middle
are the demand that it meets, and inverting the cumulative demand gives its
time. Sorting all documents by time, in ranges, gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import running_sum, saved, word_count

#: Weights of sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Most times that a source is repeated.
MOST = 3
#: Weight over time by a source's place in WEIGHTS: (time, weight) knots. The
#: heavy sources come early, the light ones late.
SCHEDULES = (((0.0, 1.2), (0.6, 1.0), (1.0, 0.7)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.5, 1.0), (1.0, 1.6)))
SEED = 20


def integrate(knots) -> list[tuple[float, float, float, float]]:
    """Per piece: start time, weight there, slope, and integral before it; weights scaled to integral 1."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule runs from time 0 to 1 with weights of at least 0")
    area = sum((b - a) * (v + w) / 2 for (a, v), (b, w) in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (a, v), (b, w) in zip(knots, knots[1:]):
        out.append((a, v / area, (w - v) / area / (b - a), before))
        before += (b - a) * (v + w) / 2 / area
    return out


def time_of(share: Column, knots) -> Column:
    """Inverse of the schedule's integral: the time by which ``share`` is met."""
    out = None
    for at, weight, slope, before in integrate(knots):
        more = F.greatest(share - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(weight * weight) + 2 * slope * more, F.lit(0.0)))
        time = F.lit(at) + F.try_divide(2 * more, weight + root)
        out = time if out is None else F.when(share >= F.lit(before), time).otherwise(out)
    return F.least(F.coalesce(out, F.lit(0.0)), F.lit(1.0))


def share_out(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Sources (``source, source_size``) with ``place``, ``target`` and
    ``source_start``: words of the sources before, in order.

    A target stops at ``most`` times the source's size; the excess goes to the
    others by weight until none is above. Each round is one aggregate to one
    row of whole numbers, so reruns agree to the last bit.
    """
    ordered = running_sum(sources.withColumn("_one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], "_one",
                          "place", "sources-ranked")
    placed = running_sum(ordered.drop("_one"), [F.col("place")], "source_size", "source_start", "sources-placed")
    table = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)),
                                                     (F.col("place") % len(weights)).cast("int") + 1).cast("long"))
    table = saved(table, "sources-weighed")
    cap = most * F.col("source_size")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    unit, capped = 0.0, -1
    while total:
        over = (F.col("weight") * F.lit(unit) > cap) | (cap == 0)
        r = table.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)).alias("full"),
                      F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("w")).first()
        if r["n"] == capped or not r["w"]:
            break
        unit, capped = (total - r["full"]) / r["w"], r["n"]
    return table.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(unit)))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             row_key: Column | None = None, weights=WEIGHTS, most: int = MOST, schedules=SCHEDULES) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target,
    copies, taken, positions`` (words of the whole training run before the
    middle of each copy), sorted by first position.

    Copy e of a document is taken if the words before its middle, over e whole
    rounds of its source and the documents before it, lie below the target. So
    a source's taken words miss its target by half a document at most, and no
    document is taken more than ``most`` times. Documents without words have
    size 0 and no copies; a null source is a source of its own, the last;
    repeated rows are documents of their own; an empty table gives no rows.
    ``row_key`` is carried along as ``row_key``.
    """
    sized = saved(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                              word_count(F.col(f"`{text_col}`")).alias("size"),
                              (row_key if row_key is not None else F.lit(0)).cast("long").alias("row_key"),
                              F.xxhash64(F.col(f"`{id_col}`"), F.lit(SEED)).alias("_key"),
                              F.monotonically_increasing_id().alias("_row")), "mix-sizes")
    sources = share_out(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    placed = running_sum(sized, [F.col("source").asc_nulls_last(), F.col("_key"), F.col("doc_id"), F.col("size"),
                                 F.col("_row")], "size", "_start", "mix-order")
    s = sources.withColumnRenamed("source", "_source")
    joined = placed.join(s, placed["source"].eqNullSafe(s["_source"]))
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    middle = F.col("_start") - F.col("source_start") + F.col("size") / 2
    each = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: e * F.col("source_size") + middle)
    met = F.filter(each, lambda x: (x < F.col("target")) & (F.col("size") > 0))
    place = F.col("place") % len(weights)

    def position(demand: Column) -> Column:
        share = demand / F.col("target")
        time = F.coalesce(*[F.when(place == i, time_of(share, k)) for i, k in enumerate(schedules)])
        return time * F.lit(float(total))

    return (joined.withColumn("positions", F.transform(met, position))
                  .select("doc_id", "source", "size", "source_size", "target",
                          F.size("positions").cast("long").alias("copies"),
                          (F.size("positions") * F.col("size")).cast("long").alias("taken"), "positions", "row_key")
                  .orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents in training order: every column of ``docs``, a row for
    each copy taken. ``docs`` is read from files (its rows are told apart by
    their place in them, so ids may repeat); the join back runs on that unique
    place, and the order is made by a range sort."""
    key = F.monotonically_increasing_id()
    plan = plan_mix(docs, id_col, source_col, text_col, row_key=key, **options).where(F.col("copies") > 0)
    at = plan.select(F.col("row_key").alias("_mix_row"), F.explode("positions").alias("_mix_position"))
    rows = docs.withColumn("_mix_row", key).join(at, "_mix_row")
    order = ["_mix_position", "_mix_row"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*[f"`{c}`" for c in docs.columns])
