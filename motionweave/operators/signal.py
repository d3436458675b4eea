"""Signals: trimming, gaps, derivatives, rotation, gait cycles, segments and resampling.

Frames are numbered within a trial (``keys``).  All windows of one trial share the same
partitioning, so Spark sorts a trial once.  The recurrences that SQL has no form for (the
zero-phase filter) run as Arrow kernels over the sorted rows, many trials or a part of one at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from motionweave.functions import kernels

#: Curves that the resampling kernel takes at once.
CURVES = 256
#: Rows that the filter takes at once; a trial of more is filtered in parts.
BLOCK_FRAMES = 1 << 16


def ordered(keys: list[str], order: str | list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def number_frames(df: DataFrame, keys: list[str], order: list[str], name: str = "frame") -> DataFrame:
    """Frames 0, 1, ... of every trial."""
    return df.withColumn(name, F.row_number().over(ordered(keys, order)) - 1)


def trim(frames: DataFrame, events: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Frames in [first start, first stop), numbered anew; trials without both go."""
    marks = events.groupBy(*keys).agg(
        F.min(F.when(F.col("event_type") == start, F.col("onset"))).alias("start"), F.min(F.when(F.col("event_type") == stop, F.col("onset"))).alias("stop")
    )
    inside = (F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("stop"))
    return frames.join(marks, keys).filter(inside).withColumn("frame", F.col("frame") - F.col("start")).drop("start", "stop")


def longest_gap(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Length of the longest run of missing values (0 if none), by gaps and islands."""
    island = F.count(value).over(ordered(keys, order))
    runs = df.withColumn("island", island).groupBy(*keys, "island").agg(F.count_if(F.col(value).isNull()).alias("gap"))
    return runs.groupBy(*keys).agg(F.max("gap").alias("longest_gap"))


def fill_gaps(df: DataFrame, keys: list[str], order: str, value: str | list[str], limit: int) -> DataFrame:
    """Linear interpolation of inner gaps of up to ``limit`` samples, of one column or several.

    The next known sample is the last one of the window turned round: a frame that runs to the
    end of a trial would be walked anew from every row.
    """
    columns = [value] if isinstance(value, str) else value
    ahead, back = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col(order).desc(), F.col(order)))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("at"), F.col(c).alias("v"))) for c in columns}
    found = df.withColumns({f"_n_{c}": F.last(k, True).over(ahead) for c, k in known.items()}).withColumns({f"_p_{c}": F.last(k, True).over(back) for c, k in known.items()})

    def line(c: str) -> Column:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        width = n["at"] - p["at"]
        share = (F.col(order) - p["at"]) / F.nullif(width, F.lit(0))
        return F.when(width - 1 <= limit, p["v"] + (n["v"] - p["v"]) * share)

    return found.withColumns({c: F.coalesce(F.col(c), line(c)) for c in columns}).select(df.columns)


def fill_from_cluster(df: DataFrame, keys: list[str], order: str, markers: list[str], last: int = 5) -> DataFrame:
    """Missing markers of a rigid cluster: first visible other marker plus their mean offset.

    The offset is taken over the ``last`` frames in which every marker is visible.
    """
    complete = F.lit(True)
    for m in markers:
        complete = complete & F.col(m).isNotNull()
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    recent = df.filter(complete).withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= last)
    offsets = recent.groupBy(*keys).agg(*[F.avg(F.col(a) - F.col(b)).alias(f"_{a}_{b}") for a in markers for b in markers if a != b])
    filled = {a: F.coalesce(F.col(a), *[F.col(b) + F.col(f"_{a}_{b}") for b in markers if b != a]) for a in markers}
    return df.join(offsets, keys, "left").withColumns(filled).select(df.columns)


def cluster_means(df: DataFrame, keys: list[str], clusters: Column) -> DataFrame:
    """Mean of the visible markers of each cluster (``clusters`` names it; null drops a marker)."""
    return df.withColumn("cluster", clusters).filter("cluster is not null").groupBy(*keys, "cluster").agg(F.avg("value").alias("value"))


def velocity(df: DataFrame, keys: list[str], order: list[str], columns: list[str], fs: float) -> DataFrame:
    """First differences in units of thousands per second; rows with any missing value go."""
    w = ordered(keys, order)
    return df.withColumns({c: (F.col(c) - F.lag(c).over(w)) * fs / 1000 for c in columns}).dropna(subset=columns)


def acceleration(df: DataFrame, keys: list[str], order: list[str], columns: list[str], fs: float) -> DataFrame:
    """Differences of the velocity, again without incomplete rows (unfiltered)."""
    w = ordered(keys, order)
    v = velocity(df, keys, order, columns, fs)
    return v.withColumns({c: (F.col(c) - F.lag(c).over(w)) * fs for c in columns}).dropna(subset=columns)


def rotate(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Turn the plane onto its principal axes (closed form for two variables).

    The angle comes from one aggregation; each axis is signed so that its largest loading
    is positive.  Coordinates are not centred.  Trials with a missing value go.
    """
    angle = df.groupBy(*keys).agg(
        (F.atan2(2 * F.covar_samp(x, y), F.var_samp(x) - F.var_samp(y)) / 2).alias("_t"), (F.count(F.lit(1)) == F.count(F.col(x) + F.col(y))).alias("_whole")
    )
    c, s = F.cos("_t"), F.sin("_t")
    one = F.when(F.abs(c) >= F.abs(s), F.signum(c)).otherwise(F.signum(s))
    two = F.when(F.abs(s) >= F.abs(c), F.signum(-s)).otherwise(F.signum(c))
    turned = df.join(angle.filter("_whole and _t is not null"), keys)
    return turned.withColumns({"axis1": one * (F.col(x) * c + F.col(y) * s), "axis2": two * (F.col(y) * c - F.col(x) * s)}).drop("_t", "_whole")


def cycles_right_left_left(contacts: DataFrame, keys: list[str]) -> DataFrame:
    """Gait cycles from each right contact (but the last) to the second left contact after it.

    One window in each direction replaces the as-of search: a right contact sees the next
    left row, which carries its own successor.  ``contacts`` has frame, side (R or L), n.
    """
    left_next = F.lead("frame").over(Window.partitionBy(*keys, "side").orderBy("frame"))
    ahead = Window.partitionBy(*keys).orderBy("frame", "side").rowsBetween(1, Window.unboundedFollowing)
    marked = contacts.withColumn("next_same", left_next)
    pair = F.when(F.col("side") == "L", F.struct("frame", "next_same"))
    found = marked.withColumn("left", F.first(pair, True).over(ahead))
    ok = (F.col("side") == "R") & F.col("next_same").isNotNull() & F.col("left.next_same").isNotNull() & (F.col("left.next_same") <= F.col("n"))
    return found.filter(ok).select(*keys, F.col("frame").alias("start"), F.col("left.next_same").alias("stop"))


def cycles_same_side(contacts: DataFrame, keys: list[str]) -> DataFrame:
    """Cycles between consecutive contacts of one side."""
    nxt = F.lead("frame").over(Window.partitionBy(*keys, "side").orderBy("frame"))
    return contacts.withColumn("stop", nxt).filter("stop is not null").select(*keys, "side", F.col("frame").alias("start"), "stop")


def segment(frames: DataFrame, cycles: DataFrame, keys: list[str], position: str = "frame", width: int | None = None) -> DataFrame:
    """Frames of every half-open cycle (cycles overlap), joined on (trial, time bin).

    A frame lies in one bin of ``width`` positions; a cycle is dealt to each bin that it touches,
    so it meets its own length and at most two bins of other frames.  By default the width is the
    cycles' mean length, found in one aggregation: over all cycles at most three frames are
    looked at for each position that a cycle covers, and a long trial is many join keys.
    """
    if width is None:
        mean = cycles.agg(F.avg(F.col("stop") - F.col("start"))).first()[0]
        width = max(1, round(mean or 1))
    inside = (F.col(position) >= F.col("start")) & (F.col(position) < F.col("stop"))
    return same_bin(frames, cycles, keys, position, width).filter(inside).drop("_bin")


def same_bin(frames: DataFrame, cycles: DataFrame, keys: list[str], position: str, width: int) -> DataFrame:
    """Frames with the cycles that touch their time bin."""
    bin_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    touched = F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("stop") - 1)))
    dealt = cycles.filter(F.col("start") < F.col("stop")).withColumn("_bin", touched)
    return frames.withColumn("_bin", bin_of(F.col(position))).join(dealt, [*keys, "_bin"])


def resample(segments: DataFrame, keys: list[str], position: str, value: str, points: int) -> DataFrame:
    """Linear resampling of every group to ``points`` samples.

    One aggregation lists a group's samples; an Arrow kernel then resamples all lists of a batch
    at once, straight from their offsets.  A missing sample makes the points beside it missing.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).cast("double").alias("v"))))
    grouped = segments.groupBy(*keys).agg(F.transform(rows, lambda r: r["v"]).alias("_v"))
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CURVES):
                batch = whole.slice(at, CURVES)
                curves = kernels.resample_lists(batch.column("_v"), points)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), points))
                numbers = np.tile(np.arange(points, dtype=np.int32), batch.num_rows)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(rows) for k in keys], pa.array(numbers), pa.array(curves, from_pandas=True)], names=[*keys, "k", value])

    return grouped.mapInArrow(run, f"{head}, k int, {value} double")


def low_pass(df: DataFrame, keys: list[str], order: str, value: str, cutoff: float, fs: float, channel: list[str] | None = None, block: int = BLOCK_FRAMES) -> DataFrame:
    """Zero-phase second-order Butterworth low-pass of every channel of a trial.

    Signals with missing values, and those of up to nine samples, come back unchanged.
    """
    lane = [*keys, *(channel or [])]
    v = F.col(value).cast("double")
    raw = F.max(v.isNull() | F.isnan(v)).over(Window.partitionBy(*lane))
    return _zero_phase(df.withColumn("_raw", raw), lane, order, [value], cutoff, fs, block)


def low_pass_columns(df: DataFrame, keys: list[str], order: str, columns: list[str], cutoff: float, fs: float, block: int = BLOCK_FRAMES) -> DataFrame:
    """The same of every one of ``columns``, whose missing samples are skipped and stay missing."""
    return _zero_phase(df.withColumn("_raw", F.lit(False)), keys, order, columns, cutoff, fs, block)


class _LongTrial:
    """Rows of a trial that arrives in parts; each goes out when all its samples are settled."""

    def __init__(self, f: kernels.LowPass, columns: int) -> None:
        self.streams, self.rows, self.v, self.open = [kernels.Stream(f) for _ in range(columns)], None, np.empty((0, columns)), np.empty((0, columns), bool)

    def push(self, rows: pa.Table, v: np.ndarray, signal: np.ndarray, last: bool) -> tuple[pa.Table, np.ndarray]:
        self.rows = pa.concat_tables([self.rows, rows]) if self.rows else rows
        self.v, self.open = np.concatenate([self.v, v]), np.concatenate([self.open, signal])
        for c, stream in enumerate(self.streams):
            done = stream.push(v[signal[:, c], c])
            if last:
                done = np.concatenate([done, stream.finish()])
            at = np.flatnonzero(self.open[:, c])[: len(done)]
            self.v[at, c], self.open[at, c] = done, False
        wait = self.open.any(1)
        out = self.rows.filter(pa.array(~wait)), self.v[~wait]
        self.rows, self.v, self.open = self.rows.filter(pa.array(wait)).combine_chunks(), self.v[wait], self.open[wait]
        return out


def _whole_trials(f: kernels.LowPass, v: np.ndarray, signal: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Trials that end before ``ends``, all columns of all of them in one call of the kernel."""
    at = [np.flatnonzero(own) for own in signal.T]
    parts = [p for c, own in enumerate(at) for p in np.split(v[own, c], np.searchsorted(own, ends[:-1]))]
    done = f.both_ways(parts)
    for c, own in enumerate(at):
        v[own, c] = np.concatenate(done[c * len(ends) : (c + 1) * len(ends)])
    return v


def _zero_phase(df: DataFrame, keys: list[str], order: str, columns: list[str], cutoff: float, fs: float, block: int) -> DataFrame:
    """Rows with their ``columns`` filtered along ``order``, but for missing samples and rows marked ``_raw``.

    One window sorts the trials and marks the last row of each.  The kernel then takes ``block``
    rows or some more at a time: the trials that end in them are filtered together; one that
    does not is filtered in parts, with the filter's state carried on, so that no task holds
    more of it than a part and what the filter can remember.  The result is that of the whole.
    """
    marked = df.select(*keys, order, *[F.col(c).cast("double").alias(c) for c in columns], "_raw", F.lead(F.lit(True)).over(ordered(keys, order)).isNull().alias("_last"))
    names = [*keys, order]
    schema = ", ".join([*[f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names], *[f"`{c}` double" for c in columns]])

    def out(rows: pa.Table, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(v):
            yield from pa.table([*rows.columns, *[pa.array(x, from_pandas=True) for x in np.ascontiguousarray(v.T)]], [*names, *columns]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, trial = kernels.LowPass(cutoff, fs), None
        for t in _at_least(block, batches):
            v = np.stack([t[c].to_numpy().astype(float) for c in columns], 1)
            signal = ~(np.isnan(v) | t["_raw"].to_numpy()[:, None])
            ends, rows, at = np.flatnonzero(t["_last"].to_numpy()) + 1, t.select(names), 0
            if trial is not None:
                at, closed = (int(ends[0]), True) if len(ends) else (len(v), False)
                yield from out(*trial.push(rows[:at], v[:at], signal[:at], closed))
                trial, ends = None if closed else trial, ends[1:]
            if len(ends):
                z = int(ends[-1])
                yield from out(rows[at:z], _whole_trials(f, v[at:z], signal[at:z], ends - at))
                at = z
            if at < len(v):
                trial = _LongTrial(f, len(columns))
                yield from out(*trial.push(rows[at:], v[at:], signal[at:], False))

    return marked.sortWithinPartitions(*names).mapInArrow(run, schema)


def _at_least(rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of ``rows`` rows or more that end with a trial's last one, unless ``rows`` of the same trial came before it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            ends = np.flatnonzero(t["_last"].to_numpy()) + 1
            z = int(ends[-1]) if len(ends) and len(t) - ends[-1] < rows else len(t)
            yield t[:z]
            held = t[z:].to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()
