"""Detection on the log's own clock: scans at multiples of a few seconds of event time.

Three stateful operators in a row, all driven by the watermark, so results do not depend on how the log is cut into micro-batches:

* ``timed_features``, by process: events wait for the end of their cell of ``CHECK_S`` seconds; then a timer applies the cell
  in log order and, if the process is dirty, emits its features so far.
* ``with_siblings``, by parent: the rows of a parent's children meet; each row learns what the parent had spawned by its scan.
* ``scan_alerts``, by host: a process tree, first flags and the window rule. At a scan the tree takes in what is new, then flags
  are described with up to ``LINEAGE`` levels of ancestors, then the rule is asked once: an alert at N flags in W seconds, unless one was raised within W.
  Evidence found in a parent's command line does not count if the parent is part of the test harness.

A scan happens once the watermark has passed it, ``lateness`` after the newest event; what lies behind that is emitted as
soon as later events arrive. State of a process untouched for ``ttl_s`` seconds of event time is dropped. State lies in
RocksDB, keyed so that no value grows with a key's history: distinct values, tree entries, children and flags are map
entries, sibling starts are lists of an hour each.
"""

import json
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from hosttrace.functions.rules import TIER_RANK, harness_mask, severity, severity_rank
from hosttrace.functions.text import basename, command_structure, unwrap_command
from hosttrace.streaming.live import (_FEATURE_ROW, MIN_PROCESSES, SETTINGS, THRESHOLDS, TOP_PROCESSES, WINDOW_S,
                                      ProcessState, Shelf, at_micros, in_log_order, packed)

CHECK_S = 5
LINEAGE = 6
TTL_S = 6 * 3600
HOUR_MS = 3_600_000
PIECE = 100  # events of one cell in an entry of those that wait
# Timers of the last scans need a batch of their own once the log falls silent.
TIMED_SETTINGS = SETTINGS | {"spark.sql.streaming.noDataMicroBatches.enabled": "true"}
SIBLING_FEATURES = ["b_sib_spawned", "b_sib_same_image", "b_sib_images", "b_sib_period_cv", "b_sib_period_s"]
_CALM = "calm_technique string, calm_evidence string, calm_tier string"
_SCAN_ROW = _FEATURE_ROW + ", start long, parent string, " + _CALM


class ScanState(ProcessState):
    """Features of one process at the ends of the cells that touch it.

    One timer is set, for the earliest cell that waits: when it expires, all cells behind the watermark are applied in order.
    """

    def __init__(self, every_s=CHECK_S, ttl_s=TTL_S):
        self.every_ms, self.ttl_ms = every_s * 1000, ttl_s * 1000

    def init(self, handle):
        self.handle = handle
        self.summary = handle.getValueState("summary", "payload string")
        self.seen = handle.getMapState("seen", "item string", "payload string")
        self.waiting = handle.getMapState("waiting", "cell long, n long", "payload string")

    def _wake(self, held, at):
        """Let the key's one timer expire at ``at``."""
        if held.get("timer") != at:
            if "timer" in held:
                self.handle.deleteTimer(held["timer"])
            if at is not None:
                self.handle.registerTimer(at)
                held["timer"] = at

    def _put_off(self, held):
        """Beyond the room, events that wait move to the map, each cell's in lists of ``PIECE`` events."""
        if len(held["wait"]) <= 8 or len(json.dumps(held["wait"])) <= Shelf.ROOM:
            return
        cells = {}
        for cell, r in held["wait"]:
            cells.setdefault(cell, []).append(r)
        for cell, events in cells.items():
            for k in range(0, len(events), PIECE):
                held["pieces"] = held.get("pieces", 0) + 1
                self.waiting.updateValue((cell, held["pieces"]), (json.dumps(events[k:k + PIECE]),))
        held["wait"], held["later"] = [], 1

    def handleInputRows(self, key, rows, timerValues):
        held = self._load()
        wait, first = held.setdefault("wait", []), None
        for n, row in enumerate(rows, 1):
            r = json.loads(row.payload)
            cell = (r["us"] // (self.every_ms * 1000) + 1) * self.every_ms
            held["wait"].append([cell, r])
            first = cell if first is None else min(first, cell)
            if n % 500 == 0:
                self._put_off(held)
        self._put_off(held)
        if not held.get("waits") or first < held["timer"]:
            self._wake(held, first)
        held["waits"] = True
        self.summary.update((json.dumps(held),))
        return iter(())

    def _due(self, held, passed):
        """Cells up to the watermark with their pieces in the map, and the earliest cell after it."""
        due, after = {}, []
        for cell, _ in held["wait"]:
            if cell <= passed:
                due.setdefault(cell, [])
            else:
                after.append(cell)
        if held.get("later"):
            for cell, n in list(self.waiting.keys()):
                if cell <= passed:
                    due.setdefault(cell, []).append(n)
                else:
                    after.append(cell)
                    held["later"] = 2
            held["later"] -= 1  # 1 if something stays in the map
        return due, min(after, default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = self._load()
        held.pop("timer", None)
        due, after = self._due(held, passed)
        near = {}
        for cell, r in held["wait"]:
            near.setdefault(cell, []).append(r)
        held["wait"] = [w for w in held["wait"] if w[0] > passed]
        s = held.setdefault("s", {})
        for cell, pieces in sorted(due.items()):
            if s.get("until", cell) < cell:
                s = held["s"] = self._forgotten(s)
            events = near.get(cell, [])
            for n in pieces:
                events += json.loads(self.waiting.getValue((cell, n))[0])
                self.waiting.removeKey((cell, n))
            self._cell(s, events)
            if self.ttl_ms:
                # Between two scans, so that it is nobody's cell.
                s["until"] = cell + self.ttl_ms + 1
            if s.get("own"):
                tier, technique, evidence = s.get("calm", ["none", "", ""])
                row = self._row(key, s) | {"start": s["o0"], "parent": s.get("parent"), "calm_tier": tier, "calm_technique": technique,
                                           "calm_evidence": evidence}
                yield Row(payload=json.dumps(row), at=at_micros(cell * 1000))
        if after is None and s.get("until", passed + 1) <= passed:
            self._forgotten(s)
            self.summary.clear()
            return
        held["waits"] = after is not None
        self._wake(held, after if after is not None else s.get("until"))
        self.summary.update((json.dumps(held),))

    def _forgotten(self, s):
        Shelf(self.seen, s).clear()
        return {}

    def _cell(self, s, events):
        self.shelf = Shelf(self.seen, s)
        for r in in_log_order(events):
            self._event(s, r)
            if r["own"]:
                if "ParentProcessGuid" in r:
                    s.setdefault("parent", r["ParentProcessGuid"])
                if r["tier"] != "PARENT" and TIER_RANK[r["tier"]] > TIER_RANK[s.get("calm", ["none"])[0]]:
                    s["calm"] = [r["tier"], r["technique"], r["evidence"]]
        self.shelf.settle()


def timed_features(events, every_s=CHECK_S, ttl_s=TTL_S):
    """Features so far of every process at the end of each cell that touches it; ``at`` is the scan's time."""
    found = packed(events, ["ParentProcessGuid"]).groupBy("platform", "run_id", "ProcessGuid").transformWithState(
        ScanState(every_s, ttl_s), "payload string, at timestamp", "Append", "EventTime", eventTimeColumnName="at")
    rows = found.select(F.from_json("payload", _SCAN_ROW).alias("f"), "at").select("f.*", "at")
    structure = command_structure(F.col("payload"), F.col("Image"))
    return rows.withColumn("payload", unwrap_command(F.col("CommandLine"))).withColumns(
        {n: c.cast("double") for n, c in structure.items()}).drop("payload")


class SiblingState(StatefulProcessor):
    """What one parent has spawned: starts of its children by image, an hour to a list, and their gaps as sums."""

    def __init__(self, ttl_s=TTL_S):
        self.ttl_ms = ttl_s * 1000

    def init(self, handle):
        self.handle = handle
        self.total = handle.getValueState("total", "payload string")
        self.entries = handle.getMapState("entries", "item string", "payload string")

    def _born(self, guid, image, start):
        known = f"i\t{image}" in self.shelf
        s = self.shelf[f"i\t{image}"] if known else {"n": 0, "sum": 0, "squares": 0, "hours": []}
        hour, hours = start // (HOUR_MS * 1000), s["hours"]
        starts = lambda hour: self.shelf[f"s\t{hour}\t{image}"]
        at = bisect_left(hours, hour)
        here = starts(hour) if at < len(hours) and hours[at] == hour else []
        k = bisect_left(here, start)
        before = here[k - 1] if k else starts(hours[at - 1])[-1] if at else None
        after = here[k] if k < len(here) else None
        if after is None:
            following = at + (1 if here else 0)
            after = starts(hours[following])[0] if following < len(hours) else None
        gaps = [(before, after, -1), (before, start, 1), (start, after, 1)]
        for a, b, sign in gaps:
            if a is not None and b is not None:
                gap = (b - a) // 1000
                s["sum"] += sign * gap
                s["squares"] += sign * gap * gap
        if not here:
            hours.insert(at, hour)
        here.insert(k, start)
        s["n"] += 1
        self.shelf[f"s\t{hour}\t{image}"] = here
        self.shelf[f"i\t{image}"] = s
        self.shelf[f"c\t{guid}"] = image
        self.held["n"] = self.held.get("n", 0) + 1
        self.held["images"] = self.held.get("images", 0) + (not known)

    def _siblings(self, image):
        n, images, s = self.held["n"], self.held["images"], self.shelf[f"i\t{image}"]
        if s["n"] < 3:
            return float(n), float(s["n"]), float(images), -1.0, -1.0
        m = s["n"] - 1
        # Whole numbers up to the root, so equal gaps have no spread at all.
        spread = (m * s["squares"] - s["sum"] ** 2) ** 0.5 / m
        mean = s["sum"] / m
        return float(n), float(s["n"]), float(images), spread / mean if mean > 0 else 0.0, mean / 1000

    def handleInputRows(self, key, rows, timerValues):
        held = self.total.get()
        self.held = json.loads(held[0]) if held else {}
        self.shelf = Shelf(self.entries, self.held)
        scans, out = {}, []
        for r in rows:
            scans.setdefault(r.at_ms, []).append(r)
        for now, part in sorted(scans.items()):
            for r in part:
                if r.known and f"c\t{r.guid}" not in self.shelf:
                    self._born(r.guid, _base(r.image), r.start)
            for r in part:
                values = self._siblings(self.shelf[f"c\t{r.guid}"]) if r.known else (0.0, 0.0, 0.0, -1.0, -1.0)
                out.append(Row(body=r.body, at=at_micros(now * 1000), **dict(zip(SIBLING_FEATURES, values))))
        if self.held.get("n"):
            if self.ttl_ms:
                until, new = self.held.get("until", 0), max(scans) + self.ttl_ms
                if new > until:
                    if until:
                        self.handle.deleteTimer(until)
                    self.handle.registerTimer(new)
                    self.held["until"] = new
            self.shelf.settle()
            self.total.update((json.dumps(self.held),))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for state in (self.total, self.entries):
            state.clear()
        return iter(())

    def close(self):
        pass


def _base(image):
    return image.replace("\\", "/").rsplit("/", 1)[-1].lower() if isinstance(image, str) else ""


def with_siblings(rows, ttl_s=TTL_S):
    """The five sibling features at each scan. A process without a parent is a group of its own."""
    keyed = rows.withColumn("_parent", F.coalesce("parent", F.concat(F.lit("self:"), "ProcessGuid")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "at")
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    body = F.to_json(F.struct(*[c for c in rows.columns if c != "at"]), exact)
    out = keyed.select("platform", "run_id", "_parent", "at", F.unix_millis("at").alias("at_ms"), F.col("ProcessGuid").alias("guid"),
                       F.col("Image").alias("image"), "start", F.col("parent").isNotNull().alias("known"), body.alias("body"))
    out = out.groupBy("platform", "run_id", "_parent").transformWithState(
        SiblingState(ttl_s), "body string, at timestamp, " + ", ".join(f"{c} double" for c in SIBLING_FEATURES), "Append", "EventTime",
        eventTimeColumnName="at")
    return out.select(F.from_json("body", kinds, exact).alias("f"), "at", *SIBLING_FEATURES).select("f.*", "at", *SIBLING_FEATURES)


_HOST_ROW = ["platform", "run_id", "at", "ProcessGuid", "base", "parent", "harness", "hot", "score", "Image", "command", "ParentImage", "technique", "evidence",
             "severity", "rank", "calm_technique", "calm_evidence", "calm_severity", "calm_rank"]


def described(scored, thresholds=None):
    """What a host needs of each scored row: its place in the tree, whether it is flagged, and both readings of its evidence."""
    thresholds = thresholds or THRESHOLDS
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col("platform"))

    def reading(prefix):
        technique = F.when(F.col(f"{prefix}tier").isin("DIRECT", "PARENT"), F.col(f"{prefix}technique")).otherwise("")
        text = F.when(F.col(f"{prefix}evidence") != "", F.concat_ws(": ", f"{prefix}technique", f"{prefix}evidence")).otherwise("")
        level = severity(technique)
        return {f"{prefix}technique": technique, f"{prefix}evidence": text, f"{prefix}severity": level, f"{prefix}rank": severity_rank(level)}

    harness = harness_mask(F.col("Image"), F.col("CommandLine"), F.col("ParentCommandLine"))
    both = {**reading(""), **reading("calm_")}
    rows = scored.withColumns({"hot": F.col("score") >= limit, "harness": harness, "base": F.coalesce(basename(F.col("Image")), F.lit("")),
                               "command": F.substring("CommandLine", 1, 200), "score": F.round("score", 3)})
    return rows.select(*[both[c].alias(c) if c in both else F.col(c) for c in _HOST_ROW])


class HostScans(StatefulProcessor):
    """The tree, the first flags and the window rule of one host, scan by scan."""

    def __init__(self, window_s=WINDOW_S, least=MIN_PROCESSES):
        self.window_ms, self.window_s, self.least = int(window_s * 1000), window_s, least

    def init(self, handle):
        self.tree = handle.getMapState("tree", "guid string", "base string, parent string, harness boolean")
        self.known = handle.getMapState("known", "guid string", "at long")
        self.flags = handle.getMapState("flags", "at long, n long", "payload string")
        self.rule = handle.getValueState("rule", "payload string")

    def _node(self, guid):
        """A process in the tree as (base, parent, harness). What a call has read or put there is at hand until it ends."""
        if guid not in self.near:
            self.near[guid] = tuple(self.tree.getValue((guid,))) if self.tree.containsKey((guid,)) else None
        return self.near[guid]

    def _lineage(self, guid):
        out = []
        while guid and len(out) < LINEAGE and self._node(guid):
            base, guid, _ = self._node(guid)
            out.append(base or "?")
        return " < ".join(out)

    def _payload(self, r, now):
        parent = r.parent if isinstance(r.parent, str) else ""
        calm = "calm_" if parent and self._node(parent) and self._node(parent)[2] else ""
        get = lambda name: getattr(r, calm + name)
        text = lambda v: v if isinstance(v, str) else ""
        return {"time": now, "ProcessGuid": r.ProcessGuid, "score": float(r.score), "image": text(r.Image), "command": text(r.command), "parent": text(r.ParentImage),
                "lineage": self._lineage(r.ProcessGuid), "technique": get("technique"), "evidence": get("evidence"), "severity": get("severity"), "rank": int(get("rank"))}

    def handleInputRows(self, key, rows, timerValues):
        scans = {}
        for frame in rows:
            for r in frame.itertuples(index=False):
                scans.setdefault(int(r.at.value // 1_000_000), []).append(r)
        rule = json.loads(self.rule.get()[0]) if self.rule.exists() else {"recent": [], "last": None, "alerts": 0}
        out, known = [], {}
        self.near, grown = {}, set()
        for now in sorted(scans):
            for r in scans[now]:
                self.near[r.ProcessGuid] = (r.base, r.parent if isinstance(r.parent, str) else "", bool(r.harness))
                grown.add(r.ProcessGuid)
                if r.ProcessGuid not in known:
                    known[r.ProcessGuid] = self.known.containsKey((r.ProcessGuid,))
            asked = [r for r in scans[now] if not r.harness and not known[r.ProcessGuid]]
            if not asked:
                continue
            n = 0
            for r in sorted((r for r in asked if r.hot), key=lambda r: r.ProcessGuid):
                self.known.updateValue((r.ProcessGuid,), (now,))
                known[r.ProcessGuid] = True
                self.flags.updateValue((now, n), (json.dumps(self._payload(r, now)),))
                n += 1
            if n:
                rule["recent"].append([now, n])
            while rule["recent"] and rule["recent"][0][0] <= now - self.window_ms:
                at, m = rule["recent"].pop(0)  # one entry for each scan with flags: W / CHECK_S at most
                for k in range(m):
                    self.flags.removeKey((at, k))
            total = sum(m for _, m in rule["recent"])
            if total >= self.least and (rule["last"] is None or now - rule["last"] >= self.window_ms):
                rule["last"], rule["alerts"] = now, rule["alerts"] + 1
                out.append(self._alert(key, now, rule, total))
        for guid in grown:
            self.tree.updateValue((guid,), self.near[guid])
        self.rule.update((json.dumps(rule),))
        if out:
            yield pd.DataFrame(out)

    def _alert(self, key, now, rule, total):
        techniques, top, shown = set(), 0, []
        for at, m in rule["recent"]:
            for k in range(m):
                p = json.loads(self.flags.getValue((at, k))[0])
                techniques.add(p["technique"])
                top = max(top, p["rank"])
                shown = sorted([*shown, p], key=lambda p: (-p["rank"], -p["score"], p["ProcessGuid"]))[:TOP_PROCESSES]
        techniques = sorted(techniques - {""})
        chain = len({t.split()[0] for t in techniques}) >= 3
        return {"platform": key[0], "run_id": key[1], "alert": rule["alerts"], "time": pd.Timestamp(now, unit="ms"),
                "rule": f"{self.least}+ processes flagged within {self.window_s}s", "severity": "high" if chain else ("low", "medium", "high")[top],
                "techniques": techniques, "n_flagged": total, "processes": [json.dumps(p, sort_keys=True) for p in shown]}

    def close(self):
        pass


_ALERT = ("platform string, run_id string, alert int, time timestamp, rule string, severity string, "
          "techniques array<string>, n_flagged int, processes array<string>")


def scan_alerts(rows, window_s=WINDOW_S, least=MIN_PROCESSES):
    """Alerts from the rows of ``described``."""
    return rows.groupBy("platform", "run_id").transformWithStateInPandas(
        HostScans(window_s, least), _ALERT, "Append", "EventTime", eventTimeColumnName="time")


def detect(events, score, window_s=WINDOW_S, least=MIN_PROCESSES, thresholds=None, every_s=CHECK_S):
    """Events to alerts on the log's clock. ``score`` adds a column ``score`` to feature rows, by a model or a rule."""
    for name, value in TIMED_SETTINGS.items():
        events.sparkSession.conf.set(name, value)
    return scan_alerts(described(score(with_siblings(timed_features(events, every_s))), thresholds), window_s, least)

