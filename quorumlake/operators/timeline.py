"""Edit lists and clips: maps between the served and the source clock, windows over both, and trims. Segments are rows: by, served_start, served_end, kind, source_id, source_start, source_end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _swept(points: DataFrame, t: str, segments: DataFrame, at: str, keys: list[str]) -> tuple[DataFrame, list[str], Window]:
    """Points and segments (own_seg) in one frame, ordered within their group by place, at the same one the segments first."""
    held = [c for c in segments.columns if c not in keys]
    own = segments.select(*keys, F.struct(*held).alias("own_seg"), F.col(at).alias("own_at"), F.lit(0).alias("own_side"))
    both = points.withColumns({"own_at": F.col(t), "own_side": F.lit(1)}).unionByName(own, allowMissingColumns=True)
    return both, points.columns, Window.partitionBy(*keys).orderBy("own_at", "own_side", "own_seg")


def to_source(points: DataFrame, segments: DataFrame, by: list[str], t: str) -> DataFrame:
    """points with source_id and source_t, null in an insert or outside. Segments don't overlap; they are open at their ends, but the last one of the timeline is closed. Points and segments are sorted together once, and each point looks at the segment before it."""
    s = segments.select(*by, "served_start", "served_end", "kind", F.col("source_id").alias("id"), "source_start")
    both, columns, w = _swept(points, t, s, "served_start", by)
    seg = F.last("own_seg", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    most = F.max("own_seg.served_start").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = both.withColumns({"own_met": seg, "own_most": most}).where("own_side = 1")
    inside = (F.col("own_met.kind") == "source") & ((F.col(t) < F.col("own_met.served_end")) | ((F.col("own_met.served_start") == F.col("own_most")) & (F.col(t) == F.col("own_met.served_end"))))
    return met.select(*columns, F.when(inside, F.col("own_met.id")).alias("source_id"), F.when(inside, F.col("own_met.source_start") + F.col(t) - F.col("own_met.served_start")).alias("source_t"))


def to_served(points: DataFrame, segments: DataFrame, by: list[str], t: str) -> DataFrame:
    """points (by, source_id, t) with served_t, null where the source was cut, and the boundaries around: before_t, the served end of the last kept segment that begins at or before t, and after_t, the served start of the next one. A source's segments don't overlap; points and segments are sorted together once."""
    keys = [*by, "source_id"]
    s = segments.where("kind = 'source'").select(*keys, "source_start", "source_end", "served_start", "served_end")
    both, columns, w = _swept(points, t, s, "source_start", keys)
    before = F.last("own_seg", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("own_seg", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    most = F.max("own_seg.source_start").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = both.withColumns({"own_met": before, "own_next": after, "own_most": most}).where("own_side = 1")
    inside = (F.col(t) < F.col("own_met.source_end")) | ((F.col("own_met.source_start") == F.col("own_most")) & (F.col(t) == F.col("own_met.source_end")))
    served = F.when(inside, F.col("own_met.served_start") + F.col(t) - F.col("own_met.source_start"))
    return met.select(*columns, served.alias("served_t"), F.col("own_met.served_end").alias("before_t"), F.col("own_next.served_start").alias("after_t"))


def remapped(items: DataFrame, segments: DataFrame, by: list[str], clamp_to: Column | None = None, snap: bool = False) -> DataFrame:
    """items (by, source_id, item, start, end) on the served clock. An item that begins in a cut is dropped or, with snap, begins where the next kept segment does. An end in a cut is null or, with clamp_to, that of the last kept segment before the cut and else clamp_to."""
    keys = [*by, "source_id"]
    at = lambda c: to_served(items.where(F.col(c).isNotNull()).select(*keys, F.col(c).alias("t")).distinct(), segments, by, "t")
    begins, ends = at("start"), at("end")
    start = F.coalesce("served_t", "after_t") if snap else F.col("served_t")
    end = F.col("served_t") if clamp_to is None else F.coalesce("served_t", "before_t", clamp_to)
    made = items.join(begins.select(*keys, F.col("t").alias("start"), start.alias("own_start")), [*keys, "start"]).where("own_start is not null")
    made = made.join(ends.select(*keys, F.col("t").alias("end"), end.alias("own_end")), [*keys, "end"], "left")
    return made.select(*keys, "item", F.col("own_start").alias("start"), F.when(F.col("end").isNotNull(), F.col("own_end")).alias("end"))


def clipped(segments: DataFrame, by: list[str], low: Column, high: Column) -> DataFrame:
    """The segments within a window of the served clock, their source times moved along and their served times packed from 0."""
    cut = segments.withColumns({"own_from": F.greatest(low, F.col("served_start")), "own_to": F.least(high, F.col("served_end"))}).where("own_from < own_to")
    span, shift = F.col("own_to") - F.col("own_from"), F.col("source_start") - F.col("served_start")
    before = F.coalesce(F.sum(span).over(Window.partitionBy(*by).orderBy("served_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    source = lambda c: F.when(F.col("kind") == "source", F.col(c) + shift)
    return cut.select(*by, before.alias("served_start"), (before + span).alias("served_end"), "kind", "source_id", source("own_from").alias("source_start"), source("own_to").alias("source_end"))


def units_within(units: DataFrame, low: Column, high: Column) -> DataFrame:
    """Units that touch a closed window."""
    return units.where((F.col("end") >= low) & (F.col("start") <= high))


def keep_spans(silences: DataFrame, durations: DataFrame, by: list[str], edge_least: float = 1.0, inner_least: float = 10.0) -> DataFrame:
    """What is kept of a recording when long silences go: start, end and the place on the served clock. silences: by, start, end; durations: by, duration. Silences at the ends go from edge_least seconds on, others from inner_least; recordings without such a silence give no row."""
    edge = (F.col("start") <= 0.001) | (F.col("end") >= F.col("duration") - 0.001)
    cuts = silences.join(durations, by).where(F.col("end") - F.col("start") >= F.when(edge, edge_least).otherwise(inner_least))
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    between = cuts.select(*by, reach.alias("from"), F.col("start").alias("to"))
    tail = cuts.groupBy(*by).agg(F.max("end").alias("from"), F.first("duration").alias("to"))
    kept = between.unionByName(tail).where("`to` > `from` + 0.001")
    served = F.coalesce(F.sum(F.col("to") - F.col("from")).over(Window.partitionBy(*by).orderBy("from").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return kept.select(*by, F.col("from").alias("source_start"), F.col("to").alias("source_end"), served.alias("served_start"), (served + F.col("to") - F.col("from")).alias("served_end"))


def without_edges(intervals: DataFrame, duration: Column, edge: float, first_chapter: Column) -> DataFrame:
    """Intervals that begin neither in the leading edge before the first chapter nor in the trailing one."""
    leading = (F.col("start") < edge) & (first_chapter.isNull() | (F.col("start") < first_chapter))
    trailing = F.coalesce(F.col("start") > duration - edge, F.lit(False))
    return intervals.where(~leading & ~trailing)


#: Seconds as logs print them; large numbers may have an exponent.
CLOCK = r"[0-9.]+(?:[eE][+-]?[0-9]+)?"


def marked_intervals(logs: DataFrame, key: str, text: str, begin: str, end: str) -> DataFrame:
    """Intervals of log texts with markers, as ``silence_start: 1.5`` and ``silence_end: 2.5``: each end meets the start before it. key, seq, start, end; the last interval has no end where the log stops in it. Texts are split into marks in place, and only marks are shuffled."""
    found = F.regexp_extract_all(F.col(text), F.lit(rf"(?:{begin}|{end}):\s*{CLOCK}"), F.lit(0))
    marks = logs.select(key, F.posexplode(found).alias("at", "mark")).select(key, "at", F.col("mark").startswith(begin).alias("opens"), F.regexp_extract("mark", rf"({CLOCK})$", 1).try_cast("double").alias("t"))
    order = Window.partitionBy(key).orderBy("at")
    paired = marks.withColumns({"closes": F.lead("opens").over(order) == False, "end": F.lead("t").over(order), "more": F.lead("at").over(order).isNotNull()}).where("opens")  # noqa: E712
    return paired.where(F.col("closes") | ~F.col("more")).select(key, F.row_number().over(order).alias("seq"), F.col("t").alias("start"), F.when(F.col("closes"), F.col("end")).alias("end"))


def freeze_intervals(logs: DataFrame, key: str, text: str, duration: str) -> DataFrame:
    """Still intervals of log texts; an open one ends with the recording, and those without a length go."""
    found = marked_intervals(logs, key, text, "freeze_start", "freeze_end").join(logs.select(key, duration), key)
    return found.select(key, "seq", F.greatest("start", F.lit(0.0)).alias("start"), F.coalesce("end", duration).alias("end")).where("end > start")


def recurring_hashes(df: DataFrame, by: list[str], key: str, hash: str, most_bits: int, least_times: int) -> DataFrame:
    """Pictures with at least so many others of their group within most_bits of their 64-bit hash: key and n. Equal hashes are counted first, so that pairs are made of different hashes alone; these are cut into most_bits + 1 parts, one of which two near ones share, so that only such pairs are compared and each is counted once."""
    width = -(-64 // (most_bits + 1))
    part = lambda i: F.call_function("shiftrightunsigned", F.col(hash), F.lit(i * width)).bitwiseAND(F.lit((1 << min(width, 63)) - 1))
    counted = df.groupBy(*by, hash).agg(F.count("*").alias("own_n"))
    parts = counted.select(*by, hash, "own_n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), part(i).alias("v")) for i in range(-(-64 // width))])).alias("p"))
    other = parts.select(*by, "p", F.col(hash).alias("own_hash"), F.col("own_n").alias("own_times"))
    first = [part(i) == F.call_function("shiftrightunsigned", F.col("own_hash"), F.lit(i * width)).bitwiseAND(F.lit((1 << min(width, 63)) - 1)) for i in range(-(-64 // width))]
    earliest = F.coalesce(*[F.when(same, F.lit(i)) for i, same in enumerate(first)])
    near = parts.join(other, [*by, "p"]).where((F.col(hash) != F.col("own_hash")) & (F.col("p.i") == earliest) & (F.bit_count(F.col(hash).bitwiseXOR(F.col("own_hash"))) <= most_bits))
    others = near.groupBy(*by, hash).agg(F.sum("own_times").alias("own_others"))
    often = counted.join(others, [*by, hash], "left").select(*by, hash, (F.col("own_n") - 1 + F.coalesce("own_others", F.lit(0))).alias("n")).where(F.col("n") >= least_times)
    return df.select(*by, key, hash).join(often, [*by, hash]).select(*by, key, "n")


def runs_of_same(df: DataFrame, by: list[str], order: list[str], hash: str, most_bits: int) -> DataFrame:
    """Rows in order with run: a number that rises where a hash is farther than most_bits from the one before."""
    w = Window.partitionBy(*by).orderBy(*order)
    fresh = F.coalesce(F.bit_count(F.col(hash).bitwiseXOR(F.lag(hash).over(w))) > most_bits, F.lit(True))
    return df.withColumn("own_fresh", fresh.cast("int")).withColumn("run", F.sum("own_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("own_fresh")


def selected_slides(df: DataFrame, by: list[str], source: str, start: str, end: str, hash: str, most_bits: int = 6, gap: float = 30.0, recurring: int = 5, most: int = 60) -> DataFrame:
    """The slides of each group: source, start, end and hash, the first `most` of them in order.

    Pictures that are near at least so many of their group, themselves included, go. Of the rest, one within most_bits of the slide before it, of the same source and at
    most gap seconds after its end, lengthens that slide, which keeps its own hash; any other begins a slide. Where a start lies over gap seconds after every end before
    it a slide surely begins, so only the pictures between two such places are gathered and folded, as three numbers each. Pictures of one group, source and start must
    differ in end or hash; equal rows count once.
    """
    rows = df.select(*by, F.col(source).alias("source"), F.col(start).alias("start"), F.col(end).alias("end"), F.col(hash).alias("hash")).distinct().withColumn("own_key", F.struct("source", "start", "end", "hash"))
    often = recurring_hashes(rows, by, "own_key", "hash", most_bits, recurring - 1).select(*by, "own_key") if recurring > 1 else rows.select(*by, "own_key")
    left = rows.join(often, [*by, "own_key"], "left_anti").drop("own_key")
    w = Window.partitionBy(*by, "source").orderBy("start", "end", "hash")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = left.withColumn("own_cut", F.coalesce(F.col("start") - before > gap, F.lit(True)).cast("int")).withColumn("own_part", F.sum("own_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = cut.groupBy(*by, "source", "own_part").agg(F.array_sort(F.collect_list(F.struct("start", "end", "hash"))).alias("own_rows"))

    def step(kept: Column, x: Column) -> Column:
        top = F.element_at(kept, -1)
        same = (F.size(kept) > 0) & (x["start"] - top["end"] <= gap) & (F.bit_count(top["hash"].bitwiseXOR(x["hash"])) <= most_bits)
        longer = F.struct(top["start"].alias("start"), x["end"].alias("end"), top["hash"].alias("hash"))
        return F.when(same, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(longer))).otherwise(F.concat(kept, F.array(x)))

    slides = parts.select(*by, "source", F.explode(F.aggregate("own_rows", F.slice("own_rows", 1, 0), step)).alias("own_slide")).select(*by, "source", "own_slide.*")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("source", "start", "end", "hash"))
    return slides.withColumn("own_place", place).where(F.col("own_place") <= most).drop("own_place")
