"""Flows as a stream: dedupe within the watermark, keyed state per token with a time to live, gap sessions, the session log as a sink, and audit counters."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from tidewake.operators.machine import DDL, RECENT, TRANSITIONS, Token, Wallet, fold
from tidewake.workers import importable

FLOW_DDL = "wallet string, token string, bt long, direction string, lamports long, signature string, seq long"


def landed(spark: SparkSession, path: str, delay: str = "10 minutes", files_a_batch: int = 100) -> DataFrame:
    """SRC-1, ST-1, ST-16: flows from a landing folder of JSON lines, with event time and watermark; a signature counts once within it."""
    raw = spark.readStream.schema(FLOW_DDL).option("maxFilesPerTrigger", files_a_batch).json(path)
    x = raw.withColumn("event_ts", F.timestamp_seconds("bt")).withWatermark("event_ts", delay)
    return x.dropDuplicatesWithinWatermark(["signature"])


def sessions(flows: DataFrame, gap: str = "600 seconds") -> DataFrame:
    """ST-3: gap sessions of a token's flows."""
    w = F.session_window("event_ts", gap)
    return flows.groupBy("token", w).agg(F.count("*").alias("n_flows"), F.sum("lamports").alias("lamports")).select("token", F.unix_seconds("session_window.start").alias("start_bt"), F.unix_seconds("session_window.end").alias("end_bt"), "n_flows", "lamports")


def minute_totals(flows: DataFrame) -> DataFrame:
    """Flows and lamports of each token and side in tumbling minutes."""
    w = F.window("event_ts", "60 seconds")
    return flows.groupBy("token", "direction", w).agg(F.count("*").alias("n"), F.sum("lamports").alias("lamports")).select("token", "direction", F.unix_seconds("window.start").alias("minute"), "n", "lamports")


#: Whale thresholds: seconds looked back on (none: the flow alone) and lamports.
LIMITS = ((None, 10_000_000_000), (300, 25_000_000_000), (900, 50_000_000_000))
LONGEST = 900
#: Seconds of event time after which a token without flows, or a wallet of a token, is dropped from the state.
IDLE = 30 * 86_400


def crosses(flows: list[tuple[int, int]], crossed: int, t: int, lamports: int) -> tuple[list[tuple[int, int]], int]:
    """(the flows of the last 15 minutes of a wallet with this one, a bit for each threshold it has reached so far)."""
    flows = [x for x in flows if x[0] >= t - LONGEST] + [(t, lamports)]
    for k, (back, limit) in enumerate(LIMITS):
        if not crossed >> k & 1 and (lamports if back is None else sum(x for at, x in flows if at >= t - back)) >= limit:
            crossed |= 1 << k
    return flows, crossed


WALLET = "first long, last long, minute long, minutes long, checked long, silent long, early boolean, cohort long, crossed int, flows array<struct<bt:long,lamports:long>>"
ROW = "bt long, seq long, wallet string, direction string, lamports long"


class Kept:
    """The wallets of a token in map states, behind the methods of machine.Wallets.

    What is read or changed is held until the end of a call; then only what changed is written. Which wallets were active lately
    is found by minute, so no call looks at all wallets.
    """

    def __init__(self, records, by_minute, live: list[int], token_idle: int):
        self.records, self.by_minute, self.live, self.idle = records, by_minute, set(live), token_idle
        self.held: dict[str, Wallet | None] = {}
        self.more: dict[str, tuple[list, int]] = {}  # flows and crossings
        self.minutes: dict[int, list[str]] = {}
        self.dirty: set[str] = set()
        self.dirty_minutes: set[int] = set()

    def get(self, name: str) -> Wallet | None:
        if name not in self.held:
            found = self.records.getValue((name,))
            self.held[name] = Wallet(*found[:8]) if found is not None else None
            self.more[name] = ([tuple(x) for x in found[9]], found[8]) if found is not None else ([], 0)
        return self.held[name]

    def __getitem__(self, name: str) -> Wallet:
        return self.get(name)

    def drop(self, name: str) -> None:
        self.held[name], self.more[name] = None, ([], 0)
        self.dirty.add(name)

    def whale(self, name: str, t: int, lamports: int) -> bool:
        self.get(name)
        flows, crossed = self.more[name]
        self.more[name] = crosses(flows, crossed, t, lamports)
        return self.more[name][1] != crossed

    def _names(self, minute: int) -> list[str]:
        if minute not in self.minutes:
            found = self.by_minute.getValue((minute,)) if minute in self.live else None
            self.minutes[minute] = list(found[0]) if found is not None else []
        return self.minutes[minute]

    def touch(self, name: str, w: Wallet, new_minute: bool) -> None:
        self.held[name] = w
        self.dirty.add(name)
        if new_minute:
            self._names(w.minute).append(name)
            self.dirty_minutes.add(w.minute)
            self.live.add(w.minute)

    def active(self, t: int, within: int) -> Iterator[Wallet]:
        for minute in sorted((m for m in self.live if m >= (t - within) // 60), reverse=True):
            for name in self._names(minute):
                w = self.get(name)
                if w is not None and w.minute == minute and t - w.last < within:
                    yield w

    def write(self, last: int) -> None:
        """Changes to the state; minutes that no rule looks back on any more go."""
        for name in self.dirty:
            w = self.held[name]
            if w is None:
                self.records.removeKey((name,))
            else:
                self.records.updateValue((name,), (*[getattr(w, f) for f in Wallet.FIELDS], self.more[name][1], self.more[name][0]))
        old = {m for m in self.live if m < (last - RECENT) // 60 - 1}
        for m in self.dirty_minutes - old:
            self.by_minute.updateValue((m,), (self.minutes[m],))
        for m in old:
            self.by_minute.removeKey((m,))
        self.live -= old


class Cohort(list):
    """Names in a list state, read once they are asked for; appended names are appended to the state, and only a new cohort is written whole."""

    def __init__(self, state):
        super().__init__()
        self.state, self.read, self.added, self.new = state, False, [], False

    def _load(self):
        if not self.read:
            self.read = True
            super().extend([x[0] for x in self.state.get()] if self.state.exists() else [])
            super().extend(self.added)

    def append(self, name):
        self.added.append(name)
        if self.read:
            super().append(name)

    def __iter__(self):
        self._load()
        return super().__iter__()

    def __setitem__(self, at, names):
        names = list(names)
        self._load()
        super().__setitem__(at, names)
        self.new = True

    def write(self):
        if self.new:
            self.state.clear()
            if len(self):
                self.state.put([(x,) for x in self])
        elif self.added:
            self.state.appendList([(x,) for x in self.added])


class Machine(StatefulProcessor):
    """The state machine of a token as a stateful processor.

    State of a token: a small head; its wallets in a map; for each of the last minutes who was active in it; the cohort's names;
    and, where rows wait for the watermark, those of each minute. A batch touches the wallets and minutes of its rows, not
    the rest. Timers by event time bring up waiting rows, clear a token after idle seconds without flows, and sweep wallets
    that were idle so long, about once in that time.
    """

    def __init__(self, idle: int, ordered: bool):
        self.idle, self.ordered = idle, ordered

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "json string")
        self.records = handle.getMapState("wallets", "wallet string", WALLET)
        self.by_minute = handle.getMapState("minutes", "minute long", "names array<string>")
        self.names = handle.getListState("cohort", "wallet string")
        self.waiting = handle.getMapState("waiting", "minute long", f"rows array<struct<{ROW.replace(' ', ':').replace(',:', ',')}>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.bt), int(r.seq), r.wallet, r.direction, int(r.lamports)) for frame in rows for r in frame.itertuples()]
        yield from self._take(key, new, timerValues.getCurrentWatermarkInMs() // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._take(key, [], timerValues.getCurrentWatermarkInMs() // 1000)

    def close(self) -> None:
        pass

    def _take(self, key, new: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        saved = json.loads(self.head.get()[0]) if self.head.exists() else {"token": None, "live": [], "waits": [], "timers": [], "swept": mark}
        waits = set(saved["waits"])
        if not new and not waits and (saved["token"] is None or saved["token"]["last_bt"] + self.idle <= mark):
            self._clear(saved)
            return
        ready = self._ready(new, mark, waits) if self.ordered else sorted(new, key=lambda r: r[:2])
        kept, cohort, token = self._token(saved)
        out: list[tuple] = []
        for bt, seq, wallet, direction, lamports in ready:
            if token.last_bt is not None and bt - token.last_bt > self.idle:  # the token begins anew, however rows fall into batches
                kept.write(token.last_bt)
                self._clear(saved | {"live": sorted(kept.live)}, timers=False)
                kept, cohort, token = self._token(saved | {"token": None, "live": []})
            w = kept.get(wallet)
            if w is not None and bt - w.last > self.idle and not token.lasting(w):
                token.persistent -= w.minutes >= 2
                kept.drop(wallet)
            row = (bt, seq, wallet, direction == "buy", kept.whale(wallet, bt, lamports))
            out += [(key[0], *x) for x in fold(iter([row]), token)]
        last = token.last_bt
        if last is not None:
            if mark - saved["swept"] > self.idle:
                self._sweep(kept, token, mark)
                saved["swept"] = mark
            kept.write(last)
            cohort.write()
        timers = self._timers(saved["timers"], waits, last, mark)
        self.head.update((json.dumps({"token": token.head() if last is not None else None, "live": sorted(kept.live), "waits": sorted(waits), "timers": timers, "swept": saved["swept"]}),))
        if out:
            yield pd.DataFrame(out, columns=TRANSITIONS.names)

    def _token(self, saved: dict) -> tuple[Kept, Cohort, Token]:
        kept, cohort = Kept(self.records, self.by_minute, saved["live"], self.idle), Cohort(self.names)
        token = Token(wallets=kept, cohort=cohort)
        token.__dict__.update(saved["token"] or {})
        return kept, cohort, token

    def _ready(self, new: list[tuple], mark: int, waits: set[int]) -> list[tuple]:
        """Rows that the watermark has passed, in order; the others wait by minute."""
        by: dict[int, list[tuple]] = {}
        for r in new:
            by.setdefault(r[0] // 60, []).append(r)
        ready: list[tuple] = []
        for minute in sorted({*by, *(m for m in waits if m * 60 <= mark)}):
            rows = by.get(minute, [])
            if minute in waits:
                rows = rows + [tuple(r) for r in self.waiting.getValue((minute,))[0]]
            rest = [r for r in rows if r[0] > mark]
            ready += [r for r in rows if r[0] <= mark]
            if rest:
                self.waiting.updateValue((minute,), (rest,))
                waits.add(minute)
            elif minute in waits:
                self.waiting.removeKey((minute,))
                waits.discard(minute)
        return sorted(ready, key=lambda r: r[:2])

    def _timers(self, old: list[int], waits: set[int], last: int | None, mark: int) -> list[int]:
        """A timer for the end of the first waiting minute, and one for the end of the token."""
        at = ([(min(waits) + 1) * 60] if waits else []) + ([last + self.idle] if last is not None else [])
        new = sorted({max(x, mark + 1) * 1000 for x in at})
        for x in set(old) - set(new):
            self.handle.deleteTimer(x)
        for x in set(new) - set(old):
            self.handle.registerTimer(x)
        return new

    def _sweep(self, kept: Kept, token: Token, mark: int) -> None:
        for (name,), found in list(self.records.iterator()):
            w = kept.get(name)
            if w is not None and mark - w.last > self.idle and not token.lasting(w):
                token.persistent -= w.minutes >= 2
                kept.drop(name)

    def _clear(self, saved: dict, timers: bool = True) -> None:
        for state in (self.records, self.by_minute, self.names):
            state.clear()
        if timers:
            for x in saved["timers"]:
                self.handle.deleteTimer(x)
            self.head.clear()


def transitions(flows: DataFrame, ordered: bool = False, idle: int = IDLE) -> DataFrame:
    """ST-2, ST-4, ST-15: state transitions of each token, with keyed state that survives restarts (Machine). Needs the RocksDB state store.

    Rows of a micro-batch are taken in time order. ordered: a row waits until the watermark has passed it, so that time runs
    forward across micro-batches as well; the rows of the last delay come out when later ones move the watermark. idle: after
    so many seconds of event time without flows a token's state ends, and a wallet counts as new, but for early and cohort wallets.
    """
    importable(flows.sparkSession)
    return flows.groupBy("token").transformWithStateInPandas(Machine(idle, ordered), DDL, "Append", "EventTime")


def audited(flows: DataFrame, name: str = "session") -> DataFrame:
    """ST-18: flows with counters of each micro-batch: rows, rows without a wallet or signature, buys, and the time they span. Read them with audit()."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return flows.observe(name, F.count("*").alias("rows"), F.count_if(blank("wallet")).alias("no_wallet"), F.count_if(blank("signature")).alias("no_signature"), F.count_if(F.col("direction") == "buy").alias("buys"), F.min("bt").alias("first_bt"), F.max("bt").alias("last_bt"))


#: Counters that are no sums: how two values of each become one.
MERGED = {"first_bt": min, "last_bt": max}


def counted(so_far: dict, progress, name: str = "session") -> dict:
    """so_far with the counters of one micro-batch's progress: batches, rows read, rows later than the watermark that were set aside, rows of state, and those of audited()."""
    own = {"batches": 1, "read": progress.numInputRows, "late": sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)}
    row = (progress.observedMetrics or {}).get(name)
    own |= {k: v for k, v in (row.asDict() if row is not None else {}).items() if v is not None}
    out = so_far | {k: MERGED.get(k, lambda a, b: a + b)(so_far[k], v) if k in so_far else v for k, v in own.items()}
    return out | {"state_rows": sum(s.numRowsTotal for s in progress.stateOperators)}


def audit(query, name: str = "session") -> dict[str, int]:
    """ST-18: counters over the progress that a streaming query keeps, which is that of its last batches only; Audit counts all of them."""
    out = {"batches": 0, "read": 0, "late": 0, "state_rows": 0}
    for p in query.recentProgress:
        out = counted(out, p, name)
    return out


class Audit(StreamingQueryListener):
    """ST-18: lasting counters of every streaming query of a session that has audited() rows.

    Each query, known by the id in its checkpoint, has a file of counters in a shared folder, renewed after each micro-batch, and
    read again by the listener of a restarted driver. A batch that is reported twice counts once.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str = "session"):
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), name
        self.known: dict[str, dict] = {}

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _load(self, query: str) -> dict:
        """The newest whole file: the one in place, or the one before if a driver was lost while it was renewed."""
        for name in (f"{query}.json", f"{query}.new"):
            at = self._path(name)
            if self._fs().exists(at):
                stream = self._fs().open(at)
                try:
                    return json.loads(bytes(stream.readAllBytes()).decode())
                finally:
                    stream.close()
        return {"batch": -1, "counters": {}}

    def _store(self, query: str, state: dict) -> None:
        fs, new, at = self._fs(), self._path(f"{query}.new"), self._path(f"{query}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        fs.delete(at, False)
        fs.rename(new, at)

    def onQueryStarted(self, event) -> None:
        self.known[str(event.id)] = self._load(str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        query = str(p.id)
        state = self.known.get(query) or self._load(query)
        if p.batchId > state["batch"]:
            state = {"batch": p.batchId, "counters": counted(state["counters"], p, self.name)}
            self._store(query, state)
        self.known[query] = state

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def counters(self, query, wait: float = 30.0) -> dict:
        """What is counted of a query, once its last finished batch is; events come a little after the batch."""
        until, last = time.time() + wait, (query.lastProgress or {"batchId": -1})["batchId"]
        while self.known.get(str(query.id), {"batch": -1})["batch"] < last and time.time() < until:
            time.sleep(0.05)
        return self.known.get(str(query.id), self._load(str(query.id)))["counters"]


def log_sink(events: DataFrame, path: str, checkpoint: str):
    """SRC-10: append a stream of events to a JSON log, by batch."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
