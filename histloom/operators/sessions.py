"""Sessions separated by inactivity gaps, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.tables import Scratch


def sessions(events: DataFrame, key: Column, at: Column, gap: int, event_id: Column | None = None, sums: dict[str, Column] | None = None, first: dict[str, Column] | None = None) -> DataFrame:
    """Sessions of each key: successive events at most ``gap`` apart.

    Every event is linked to a predecessor within the gap, and the links are doubled (each pointer is
    replaced by its target's pointer) until the roots are stable; a session is what shares a root.

    Events of one key in the same gap-wide time cell are always within the gap of each other, so a cell
    is one link target: cells are aggregated first, map-side, and only cells take part in the self-joins.
    A key that holds most events thus costs one row per occupied cell, and no task sees a whole key.
    A cell's predecessor can only be the cell before it, any earlier one being over a gap away.

    key: any type; null keys are left out. at: integral time in the gap's unit; null times are left out.
    event_id: events of equal id, key and time count once; without it every row counts.
    sums: further columns added up per session (nulls add nothing; of one event delivered with unlike values the greatest counts); first: columns of each session's first event (the least value
    among events at that instant). Returns key, session_start, session_end, duration, events, then these. An empty input gives an empty result; an
    event exactly ``gap`` after the last belongs to the same session; equal times are one instant. Other
    columns of ``events`` are ignored, whatever their names.
    """
    if gap <= 0:
        raise ValueError("gap must be positive")
    sums, first = sums or {}, first or {}
    extra = [c.alias(f"s_{n}") for n, c in sums.items()] + [c.alias(f"f_{n}") for n, c in first.items()]
    rows = events.select(key.alias("key"), at.cast("long").alias("at"), *([event_id.alias("id")] if event_id is not None else []), *extra)
    rows = rows.filter(F.col("key").isNotNull() & F.col("at").isNotNull())
    if event_id is not None:  # deliveries of one event are one, whatever else they carry
        rows = rows.groupBy("key", "at", "id").agg(*[F.max(f"s_{n}").alias(f"s_{n}") for n in sums], *[F.min(f"f_{n}").alias(f"f_{n}") for n in first]) if sums or first else rows.distinct()
    cell = F.floor(F.col("at") / gap) if gap == 1 else (F.col("at") - F.pmod(F.col("at"), F.lit(gap))) / gap
    kept = [F.coalesce(F.sum(f"s_{n}"), F.lit(0)).alias(f"s_{n}") for n in sums]
    kept += [F.min(F.struct("at", f"f_{n}")).alias(f"f_{n}") for n in first]
    scratch = Scratch(events.sparkSession, "sessions")
    cells = scratch.save(
        rows.groupBy("key", cell.cast("long").alias("cell")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n"), *kept)
    )
    before = cells.select("key", (F.col("cell") + 1).alias("cell"), F.col("hi").alias("last"))
    pointers = scratch.save(
        cells.join(before, ["key", "cell"], "left").select(
            "key", "cell", F.when(F.col("lo") - F.col("last") <= gap, F.col("cell") - 1).otherwise(F.col("cell")).alias("to")
        )
    )
    while True:
        target = pointers.select("key", F.col("cell").alias("to"), F.col("to").alias("next"))
        doubled = scratch.save(
            pointers.join(target, ["key", "to"]).select("key", "cell", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
        )
        scratch.drop(pointers)
        pointers = doubled
        if doubled.filter("moved").isEmpty():
            break
    return (
        cells.join(pointers.select("key", "cell", F.col("to").alias("root")), ["key", "cell"])
        .groupBy("key", "root")
        .agg(F.min("lo").alias("session_start"), F.max("hi").alias("session_end"), F.sum("n").alias("events"), *[F.sum(f"s_{n}").alias(n) for n in sums], *[F.min(f"f_{n}")[f"f_{n}"].alias(n) for n in first])
        .select("key", "session_start", "session_end", (F.col("session_end") - F.col("session_start")).alias("duration"), "events", *sums, *first)
    )
