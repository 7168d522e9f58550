"""One-to-one matching of events to flows: in log order, each event takes the nearest flow that is still free.

Serving events one after another gives the only matching in which no event prefers a flow whose holder comes later in the log. Such a
matching needs no fixed order of proposals: every event may ask for its nearest flow at once, a flow keeps the earliest event that
asked, and whoever is turned away asks the next. So slices of a hot key are served side by side, and only events that look
beyond their slice move on to the next round.
"""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from hosttrace.operators.ordered import running
from hosttrace.session import materialize

CLUSTER = ["session", "fkey", "cluster"]
SLICE = [*CLUSTER, "slice"]
# `left` and `right` are the slices in which an event looks for its next earlier and later flow, which are no nearer than
# `left_gap` and `right_gap`. Rows of flows carry their neighbouring slices and the nearest times there in the same columns.
STATE = ("session string, fkey string, cluster long, slice long, kind int, id long, t double, reach double, left long, "
         "left_gap double, right long, right_gap double, flow string, dt double")
_NAMES = [f.split()[0] for f in STATE.split(", ")]
_NOWHERE = float("inf")


class _Slice:
    """Flows of one slice in time order; events come in log order and take the nearest free one."""

    def __init__(self, flows):
        self.t, self.uid = flows["t"].to_numpy(float), flows["flow"].to_numpy()
        self.key = tuple(flows[SLICE].iloc[0])
        self.number = self.key[-1]
        side = flows.iloc[0]
        self.earlier, self.later = (side["left"], side["left_gap"]), (side["right"], side["right_gap"])
        self.down, self.up = list(range(len(flows) + 1)), list(range(len(flows) + 1))

    @staticmethod
    def _root(links, i):
        top = i
        while links[top] != top:
            top = links[top]
        while links[i] != top:
            links[i], i = top, links[i]
        return top

    def _before(self, t):
        """The free flow nearest before ``t``, the first one of equal times; -1 if there is none."""
        i = self._root(self.down, int(np.searchsorted(self.t, t, "left"))) - 1
        return i if i < 0 else self._root(self.up, int(np.searchsorted(self.t, self.t[i], "left")))

    def _after(self, t):
        i = self._root(self.up, int(np.searchsorted(self.t, t, "left")))
        return i if i < len(self.t) else -1

    def _look(self, place, gap, find, beyond, t, reach):
        """Where the event finds its next flow on one side: (slice, distance, position or -1)."""
        if gap == _NOWHERE or place != self.number:
            return place, gap, -1
        i = find(t)
        if i >= 0:
            gap = abs(self.t[i] - t)
        else:
            place, gap = (-1, _NOWHERE) if pd.isna(beyond[0]) else (int(beyond[0]), abs(beyond[1] - t))
        return (place, gap, i) if gap <= reach else (-1, _NOWHERE, -1)

    def serve(self, event):
        """The event's row after this slice: with a flow, on the way to another slice, or None if no flow is left for it."""
        t, reach = event.t, event.reach
        left, left_gap, i = self._look(event.left, event.left_gap, self._before, self.earlier, t, reach)
        right, right_gap, j = self._look(event.right, event.right_gap, self._after, self.later, t, reach)
        if left_gap == right_gap == _NOWHERE:
            return None
        place, gap, at = (left, left_gap, i) if left_gap <= right_gap else (right, right_gap, j)
        if at >= 0:
            self.down[at + 1], self.up[at] = at, at + 1
        return (*self.key[:-1], place, 1, event.id, t, reach, left, left_gap, right, right_gap,
                self.uid[at] if at >= 0 else None, gap if at >= 0 else None)


def _serve(batches):
    """Rows come sorted by slice, flows first, then events in log order: a task holds the flows of one slice."""
    key, flows, at = None, [], None
    for pdf in batches:
        out = []
        for found, rows in pdf.groupby(SLICE, sort=False, dropna=False):
            if found != key:
                key, flows, at = found, [], None
            flows.append(rows[rows["kind"] == 0])
            events = rows[rows["kind"] == 1]
            if len(events):
                at = at or _Slice(pd.concat(flows, ignore_index=True))
                out += [row for e in events.itertuples(index=False) if (row := at.serve(e)) is not None]
        yield pd.DataFrame(out, columns=_NAMES).astype(
            {"cluster": "int64", "slice": "int64", "kind": "int32", "id": "int64", "t": "float64", "reach": "float64",
             "left": "int64", "left_gap": "float64", "right": "int64", "right_gap": "float64", "dt": "float64"})


def _slices(flows, slice_rows):
    """Flows in slices of about ``slice_rows`` along time; flows of one time stay together. Adds each slice's neighbours."""
    runs = flows.groupBy(*CLUSTER, "t").agg(F.count(F.lit(1)).alias("n"))
    runs = running(runs, CLUSTER, ["t"], sums={"upto": "n"}).select(
        *CLUSTER, "t", F.floor((F.col("upto") - F.col("n")) / slice_rows).alias("slice"))
    runs = materialize(runs, "runs")
    w = Window.partitionBy(*CLUSTER).orderBy("slice")  # one row a slice
    sides = runs.groupBy(*SLICE).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select(
        *SLICE, F.lag("slice").over(w).alias("left"), F.lag("hi").over(w).alias("left_gap"),
        F.lead("slice").over(w).alias("right"), F.lead("lo").over(w).alias("right_gap"))
    sliced = flows.join(runs, [*CLUSTER, "t"]).join(sides, SLICE).select(
        *SLICE, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), "t", F.lit(0.0).alias("reach"),
        "left", "left_gap", "right", "right_gap", F.col("id").alias("flow"), F.lit(None).cast("double").alias("dt"))
    return runs, sliced


def _place(events, runs):
    """Events in the slice of the last flow before them, or in the first slice. Those without a time go through all flows in order."""
    timed = events.where("t IS NOT NULL").withColumn("_query", F.lit(1))
    merged = runs.withColumnsRenamed({"slice": "_slice"}).withColumn("_query", F.lit(0)).unionByName(
        timed, allowMissingColumns=True)
    placed = running(merged, CLUSTER, ["t", "_query"], maxes={"slice": "_slice"}).where("_query = 1").select(
        *CLUSTER, F.coalesce("slice", F.lit(0)).cast("long").alias("slice"), "id", "t", "reach")
    start = runs.groupBy(*CLUSTER).agg(F.min("t").alias("t"))
    untimed = events.where("t IS NULL").drop("t").join(start, CLUSTER).select(
        *CLUSTER, F.lit(0).cast("long").alias("slice"), "id", "t", F.lit(_NOWHERE).alias("reach"))
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    return placed.unionByName(untimed).select(
        *SLICE, F.lit(1).alias("kind"), "id", "t", "reach", F.col("slice").alias("left"), zero.alias("left_gap"),
        F.col("slice").alias("right"), zero.alias("right_gap"), F.lit(None).cast("string").alias("flow"), none.alias("dt"))


def contested(events, flows, slice_rows):
    """Pairs (CLUSTER, id, flow, dt) of ``events`` (CLUSTER, id, t, reach) and ``flows`` (CLUSTER, id, t).

    ``id`` is the events' log order. A round serves the slices that events have moved to, all at once. Chains of displaced events
    end within a slice; one that runs through k slices takes k rounds.
    """
    runs, sliced = _slices(flows, slice_rows)
    sliced = materialize(sliced, "slices")
    newcomers, asked, resting, settled = _place(events, runs), sliced, None, []
    while True:
        rows = newcomers.unionByName(asked).repartition(*SLICE).sortWithinPartitions(*SLICE, "kind", "id", "t", "flow")
        served = rows.mapInPandas(_serve, STATE)
        served = materialize(served if resting is None else served.unionByName(resting), "served")
        moving = served.where("flow IS NULL")
        if moving.isEmpty():
            found = reduce(lambda a, b: a.unionByName(b), [*settled, served])
            return found.select(*CLUSTER, "id", "flow", F.when(F.col("reach") != _NOWHERE, F.col("dt")).alias("dt"))
        # Clusters at rest are done; of the others, only slices with newcomers are served again, with those they hold.
        open_clusters, open_slices = moving.select(*CLUSTER).distinct(), moving.select(*SLICE).distinct()
        settled.append(served.join(open_clusters, CLUSTER, "left_anti"))
        going = served.join(open_clusters, CLUSTER, "left_semi")
        newcomers, resting = going.join(open_slices, SLICE, "left_semi"), going.join(open_slices, SLICE, "left_anti")
        asked = sliced.join(open_slices, SLICE, "left_semi")
