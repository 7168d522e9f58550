"""Per-process state: few calls to the store, no value that grows, the same rows whatever the cut."""

import json
import random

import pytest
from pyspark.sql import Row

from hosttrace.streaming.live import ProcessState, Shelf
from hosttrace.streaming.scans import HostScans, ScanState, SiblingState


class Store:
    """A key's state in plain dictionaries; counts what is asked of it."""

    def __init__(self):
        self.calls, self.timers, self.maps, self.largest = 0, set(), {}, 0

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, _Map(self))

    def getValueState(self, *_):
        return _Value(self)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class _Map:
    def __init__(self, store):
        self.store, self.held = store, {}

    def __getattr__(self, name):
        self.store.calls += 1
        return {"containsKey": self.held.__contains__, "getValue": self.held.__getitem__, "updateValue": self.held.__setitem__,
                "removeKey": self.held.pop, "clear": self.held.clear, "keys": lambda: list(self.held)}[name]


class _Value:
    def __init__(self, store):
        self.store, self.held = store, None

    def exists(self):
        self.store.calls += 1
        return self.held is not None

    def get(self):
        self.store.calls += 1
        return self.held

    def update(self, value):
        self.store.calls += 1
        self.held, self.store.largest = value, max(self.store.largest, len(value[0]))

    def clear(self):
        self.held = None


class _Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def _rows(events):
    return iter([Row(payload=json.dumps({"own": True, "EventID": 11, "tier": "none", "sens": 0, "ext_conn": 0, **e})) for e in events])


def _event(n, us, name):
    return {"record_id": n, "us": us, "TargetFilename": name, "path": name}


def test_few_calls_for_a_plain_process():
    store, state = Store(), ProcessState()
    state.init(store)
    list(state.handleInputRows(("linux", "r", "g"), _rows([_event(k, k * 1_000_000, f"/tmp/{k % 20}") for k in range(60)]), None))
    assert store.calls <= 3
    (row,) = state.handleInputRows(("linux", "r", "g"), _rows([_event(99, 99_000_000, "/tmp/new")]), None)
    assert json.loads(row.payload)["n_files"] == 21 and json.loads(row.payload)["n_events"] == 61


def test_many_distinct_values_do_not_grow_a_value():
    store, state = Store(), ProcessState()
    state.init(store)
    for b in range(6):
        (row,) = state.handleInputRows(("linux", "r", "g"), _rows([_event(k, k * 1_000, f"/tmp/{k % 2500}") for k in range(b * 800, b * 800 + 800)]), None)
    assert json.loads(row.payload)["n_files"] == 2500 and store.largest < 2 * Shelf.ROOM


def _scanned(events, cuts, ttl_s):
    """Rows of a log cut into ``cuts`` micro-batches, the watermark a minute behind."""
    store, state, out, newest = Store(), ScanState(5, ttl_s), [], 0
    state.init(store)
    for k in range(cuts):
        part = events[len(events) * k // cuts:len(events) * (k + 1) // cuts]
        if part:
            list(state.handleInputRows(("linux", "r", "g"), _rows(part), None))
            newest = max(newest, *[e["us"] // 1000 for e in part])
        passed = newest - 60_000 if k < cuts - 1 else newest + 10_000
        while store.timers and min(store.timers) <= passed:
            at = min(store.timers)
            clock = _Clock(passed)
            info = _Clock(at)
            out += [(r.at, json.loads(r.payload)["n_events"], json.loads(r.payload)["n_files"]) for r in state.handleExpiredTimer(("linux", "r", "g"), clock, info)]
            store.timers.discard(at)
    return out, store


@pytest.mark.parametrize("ttl_s", [0, 300, 10**7])
def test_scans_do_not_depend_on_the_cut(ttl_s):
    rng, at, events = random.Random(3), 0, []
    for k in range(900):
        at += rng.choice([200_000, 1_000_000, 3_000_000, 90_000_000, 700_000_000 if k % 90 == 0 else 1_000])
        events.append(_event(k, at, f"/tmp/{rng.randrange(400)}"))
    want, seen, last = {}, [], None
    for e in events:
        cell = (e["us"] // 5_000_000 + 1) * 5_000
        if ttl_s and last is not None and last + ttl_s * 1000 + 1 < cell:
            seen = []
        seen, last = [*seen, e["path"]], cell
        want[cell] = (len(seen), len(set(seen)))
    for cuts in (1, 4, 40):
        got, store = _scanned(events, cuts, ttl_s)
        assert [(int(a.timestamp() * 1000), n, f) for a, n, f in got] == [(c, *v) for c, v in want.items()]
        assert store.largest < 3 * Shelf.ROOM


def test_calls_of_a_scan():
    events = [_event(k, k * 20_000_000, "/tmp/a") for k in range(12)]
    got, store = _scanned(events, 1, 10**7)
    assert len(got) == 12 and store.calls <= 12  # before: about a dozen for each event


def test_siblings_ask_the_store_once():
    store, state = Store(), SiblingState()
    state.init(store)
    rows = [Row(guid=f"g{k}", image="/bin/rm", start=k * 10_000_000, at_ms=5_000 * (k + 1), known=True, body=str(k)) for k in range(30)]
    out = list(state.handleInputRows(("linux", "r", "p"), iter(rows), None))
    assert [r.b_sib_spawned for r in out] == [k + 1.0 for k in range(30)] and out[-1].b_sib_period_s == 10.0 and out[-1].b_sib_period_cv == 0.0
    assert store.calls <= 4


def test_a_host_reads_a_process_once():
    import pandas as pd
    store, state = Store(), HostScans()
    state.init(store)
    frame = pd.DataFrame([{"at": pd.Timestamp(5 * (k + 1), unit="s"), "ProcessGuid": f"g{k % 3}", "base": "sh", "parent": None, "harness": False, "hot": False}
                          for k in range(300)])
    assert not list(state.handleInputRows(("linux", "r"), iter([frame]), None))
    assert store.calls <= 12  # before: two for each row
