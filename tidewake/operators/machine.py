"""Life cycle of a token: a fold over its flows in time order (ST-2 to ST-8).

Everything that does not depend on the state (whale crossings) is a column computed before; the fold sees one row at a
time, so its memory is the token's wallets, not its rows. The same fold runs in batch over sorted partitions and in a stream
with keyed state. One transition at most for each flow.

A token ignites only on a whale in the flow at hand, and an episode ends 600 seconds after the whale before it. With
strict=False a token ignites on any flow once it has seen a whale, the boundary goes by the whale before the last one, and
whales leave the density window only when a new one comes. TokenV2 has the second generation's rules (ST-5).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.scalar import severity
from tidewake.operators.windows import whale_crossings
from tidewake.workers import importable

EPISODE_END, EARLY, SILENT, RECENT, BURST, PEAK_WINDOW = 600, 300, 120, 300, 60, 120
TRANSITIONS = pa.schema([("token", pa.string()), ("bt", pa.int64()), ("seq", pa.int64()), ("episode", pa.int64()), ("wave", pa.int64()), ("from_state", pa.string()), ("to_state", pa.string()), ("trigger", pa.string()), ("n", pa.int64()), ("share", pa.float64()), ("n_early", pa.int64()), ("seconds", pa.int64())])
DDL = "token string, bt long, seq long, episode long, wave long, from_state string, to_state string, trigger string, n long, share double, n_early long, seconds long"


class Wallet:
    """A wallet of a token: first and last seen, its last minute and how many; the epoch it was checked in and found silent in (0: not), whether it came early, and the cohort it is of."""

    __slots__ = FIELDS = ("first", "last", "minute", "minutes", "checked", "silent", "early", "cohort")

    def __init__(self, first: int, last: int, minute: int, minutes: int = 1, checked: int = 0, silent: int = 0, early: bool = False, cohort: int = 0):
        self.first, self.last, self.minute, self.minutes = first, last, minute, minutes
        self.checked, self.silent, self.early, self.cohort = checked, silent, early, cohort


class Wallets(dict):
    """The wallets of a token in memory, in order of their last flow. A stream keeps them elsewhere, behind the same four methods."""

    def touch(self, name: str, w: Wallet, new_minute: bool) -> None:
        """name has had a flow."""
        self[name] = self.pop(name, w)

    def active(self, t: int, within: int) -> Iterator[Wallet]:
        """Those with a flow in the last so many seconds; they stand at the end, so only these are looked at."""
        for w in reversed(self.values()):
            if t - w.last >= within:
                return
            yield w


class Token:
    """State of one token: where it stands, and its wallets. cohort: the names of the wave's early whales."""

    #: What is kept besides wallets and cohort.
    HEAD = ("strict", "whale_before", "state", "since", "episode", "wave", "wave_start", "last_bt", "last_whale", "max_density", "persistent", "whales", "n_early", "epoch", "generation")

    def __init__(self, saved: str | None = None, strict: bool = True, wallets: Wallets | None = None, cohort: list[str] | None = None):
        self.strict, self.whale_before = strict, None
        self.state, self.since, self.episode, self.wave, self.wave_start = "QUIET", None, 0, 1, None
        self.last_bt, self.last_whale, self.max_density, self.persistent = None, None, 0, 0
        self.wallets = Wallets() if wallets is None else wallets
        self.cohort = [] if cohort is None else cohort
        self.whales: list[list] = []
        self.n_early, self.epoch, self.generation = 0, 1, 1
        if saved:
            x = json.loads(saved)
            self.cohort[:] = x.pop("cohort")
            self.wallets.update((a, Wallet(*w)) for a, w in x.pop("wallets").items())
            self.__dict__.update(x)

    def head(self) -> dict:
        return {k: getattr(self, k) for k in self.HEAD}

    def saved(self) -> str:
        """All of it as text, wallets in their order."""
        return json.dumps(self.head() | {"cohort": list(self.cohort), "wallets": {a: [getattr(w, f) for f in Wallet.FIELDS] for a, w in self.wallets.items()}})

    @property
    def early(self) -> list[str]:
        return [a for a, w in self.wallets.items() if w.early]

    def silent_share(self, t: int) -> float:
        own = [self.wallets[a] for a in self.cohort]
        return sum(w.silent == self.epoch or t - w.last > SILENT for w in own) / len(own) if own else 0.0

    def step(self, wallet: str, t: int, buy: bool, whale: bool) -> tuple | None:
        """Take one flow; (from, to, trigger, count, share, seconds in the old state) if the state changes."""
        w, minute = self.wallets.get(wallet), t // 60
        new_minute = w is None or minute != w.minute
        if w is None:
            w = Wallet(t, t, minute)
        else:
            silent = (w.silent == self.epoch or (self.last_bt is not None and self.last_bt - w.last > SILENT)) and not buy
            w.silent = self.epoch if silent else 0
            if new_minute:
                w.minute, w.minutes = minute, w.minutes + 1
                self.persistent += w.minutes == 2
            w.last = t
        if self.wave_start is None:
            self.wave_start = t
        previous = self.last_whale
        if whale:
            if w.checked != self.epoch:
                w.checked = self.epoch
                if 0 <= w.first - self.wave_start <= EARLY:
                    self.n_early += not w.early
                    w.early = True
                    if w.cohort != self.generation:
                        w.cohort = self.generation
                        self.cohort.append(wallet)
            self.whales.append([t, wallet, buy])
            self.whale_before, self.last_whale = self.last_whale, t
        self.wallets.touch(wallet, w, new_minute)
        if whale or self.strict:
            self.whales = [x for x in self.whales if x[0] >= t - PEAK_WINDOW]
        if not self.strict:
            previous = self.whale_before if self.whale_before is not None else self.last_whale
        change = self._next(t, whale, previous)
        self.last_bt = t
        if change is None:
            return None
        old, seconds = self.state, t - self.since if self.since is not None else 0
        self.state, self.since = change[0], t
        return (old, *change, seconds)

    def _begin(self, names: list[str]) -> None:
        """A new cohort of these wallets."""
        self.generation += 1
        self.cohort[:] = names
        for a in names:
            w = self.wallets[a]
            w.cohort = self.generation
            self.wallets.touch(a, w, False)

    def _next(self, t: int, whale: bool, previous: int | None) -> tuple | None:
        """(to, trigger, count, share) or None."""
        s = self.state
        if s != "QUIET" and previous is not None and t - previous >= EPISODE_END:
            return "QUIET", "episode_end", 0, 0.0
        if s == "QUIET":
            if not (whale if self.strict else self.last_whale is not None):
                return None
            new = self.episode == 0 or previous is None or t - previous >= EPISODE_END
            if new:
                self.episode += 1
                self.wave, self.wave_start, self.max_density = 1, t, 0
                self._begin([x for x in self.cohort if self.wallets[x].first >= t])
            return "IGNITION", "new_episode" if new else "reignition", 1, 0.0
        if s == "IGNITION" and self.n_early >= 3:
            return "COORDINATION_SPIKE", "early_wallets", self.n_early, 0.0
        if s == "COORDINATION_SPIKE" and t - self.since >= 120:
            return "EARLY_PHASE", "sustained", self.n_early, 0.0
        if s == "EARLY_PHASE" and self.persistent >= 2:
            return "PERSISTENCE_CONFIRMED", "persistent_wallets", self.persistent, 0.0
        if s == "PERSISTENCE_CONFIRMED":
            n = sum(not w.early for w in self.wallets.active(t, RECENT))
            return ("PARTICIPATION_EXPANSION", "new_wallets", n, 0.0) if n else None
        if s == "PARTICIPATION_EXPANSION":
            n, density = sum(x[2] for x in self.whales), len({x[1] for x in self.whales})
            best, self.max_density = density > self.max_density, max(density, self.max_density)
            return ("PRESSURE_PEAKING", "density_maximum", n, 0.0) if n >= 5 and best else None
        if s == "PRESSURE_PEAKING":
            share = self.silent_share(t)
            return ("EXHAUSTION_DETECTED", "cohort_silent", len(self.cohort), share) if share >= 0.6 else None
        if s == "EXHAUSTION_DETECTED":
            n = sum(w.cohort != self.generation for w in self.wallets.active(t, BURST))
            if n >= 3:
                self.wave, self.wave_start, self.max_density = self.wave + 1, t, 0
                self.epoch += 1  # nobody is checked or silent any more
                self._begin([])
                return "PARTICIPATION_EXPANSION", "new_whale_burst_reversal", n, 0.0
            return ("DISSIPATION", "no_activity", 0, 0.0) if not any(True for _ in self.wallets.active(t, RECENT)) else None
        if s == "DISSIPATION" and (n := sum(1 for _ in self.wallets.active(t, BURST))):
            return "IGNITION", "revival", n, 0.0
        return None

    def lasting(self, w: Wallet) -> bool:
        """Early wallets and those of the cohort stay, however long they are idle."""
        return w.early or w.cohort == self.generation

    def forget(self, t: int, idle: int) -> None:
        """ST-15: drop wallets without a flow in idle seconds, but for those that stay."""
        for a in [a for a, w in self.wallets.items() if t - w.last > idle and not self.lasting(w)]:
            self.persistent -= self.wallets.pop(a).minutes >= 2


class TokenV2:
    """ST-5, the second generation: coordination by distinct whales of a minute, exhaustion without replacement, no way back from exhaustion."""

    def __init__(self):
        self.state, self.since, self.episode, self.wave, self.t0 = "QUIET", None, 0, 1, None
        self.last_whale, self.most, self.persistent = None, 0, set()
        self.wallets: dict[str, list] = {}  # last seen, minutes of the last five minutes
        self.early: set[str] = set()
        self.whales: list[tuple[int, str]] = []

    @property
    def n_early(self) -> int:
        return len(self.early)

    def recent(self, t: int, within: int) -> set[str]:
        return {w for at, w in self.whales if at >= t - within}

    def step(self, wallet: str, t: int, buy: bool, whale: bool) -> tuple | None:
        self.t0 = t if self.t0 is None else self.t0
        last, minutes = self.wallets.get(wallet, (None, []))
        if last is None and t - self.t0 <= EARLY:
            self.early.add(wallet)
        minutes = sorted({*(m for m in minutes if m >= (t - 300) // 60), t // 60})
        if len(minutes) >= 2:
            self.persistent.add(wallet)
        self.wallets[wallet] = [t, minutes]
        new = False
        if whale:
            new = self.last_whale is None or t - self.last_whale >= EPISODE_END
            if new:
                self.episode, self.most = self.episode + 1, 0
            self.last_whale = t
            self.whales.append((t, wallet))
        self.whales = [x for x in self.whales if x[0] >= t - 300]
        change = self._next(t, whale, new)
        if change is None:
            return None
        old, seconds = self.state, t - self.since if self.since is not None else 0
        self.state, self.since = change[0], t
        return (old, *change, seconds)

    def _next(self, t: int, whale: bool, new: bool) -> tuple | None:
        s = self.state
        if whale and s in ("QUIET", "DISSIPATION"):
            return "IGNITION", "new_episode" if new else "reignition", 1, 0.0
        if s != "QUIET" and self.last_whale is not None and t - self.last_whale >= EPISODE_END:
            return "QUIET", "episode_end", 0, 0.0
        if s == "IGNITION" and (n := len(self.recent(t, BURST))) >= 3:
            return "COORDINATION_SPIKE", "whales_of_a_minute", n, 0.0
        if s == "COORDINATION_SPIKE" and t - self.since >= 120:
            return "EARLY_PHASE", "sustained", len(self.early), 0.0
        if s == "EARLY_PHASE" and len(self.persistent) >= 2:
            return "PERSISTENCE_CONFIRMED", "persistent_wallets", len(self.persistent), 0.0
        fresh = len(self.recent(t, RECENT) - self.early)
        if s == "PERSISTENCE_CONFIRMED" and fresh:
            return "PARTICIPATION_EXPANSION", "new_whales", fresh, 0.0
        if s == "PARTICIPATION_EXPANSION":
            n = sum(at >= t - PEAK_WINDOW for at, _ in self.whales)
            best, self.most = n > self.most, max(n, self.most)
            return ("PRESSURE_PEAKING", "density_maximum", n, 0.0) if n >= 5 and best else None
        if s == "PRESSURE_PEAKING" and self.early:
            share = sum(t - self.wallets[w][0] > 180 for w in self.early) / len(self.early)
            return ("EXHAUSTION_DETECTED", "early_gone_without_replacement", len(self.early), share) if share >= 0.6 and not fresh else None
        if s == "EXHAUSTION_DETECTED" and not self.recent(t, RECENT):
            return "DISSIPATION", "no_whales", 0, 0.0
        return None


def fold(rows: Iterator[tuple], token: Token) -> Iterator[tuple]:
    """Transitions of one token's rows (bt, seq, wallet, buy, whale) in order."""
    for bt, seq, wallet, buy, whale in rows:
        change = token.step(wallet, bt, buy, whale)
        if change:
            old, new, trigger, n, share, seconds = change
            yield bt, seq, token.episode, token.wave, old, new, trigger, n, share, token.n_early, seconds


def _run(batches: Iterator[pa.RecordBatch], make=Token) -> Iterator[pa.RecordBatch]:
    name, token = None, make()
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(6)]
        out = []
        for tok, *row in zip(*cols, strict=True):
            if tok != name:
                name, token = tok, make()
            out += [(tok, *x) for x in fold(iter([tuple(row)]), token)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), TRANSITIONS, strict=True)], schema=TRANSITIONS)


def with_whales(flows: DataFrame, quiet: int | None = None) -> DataFrame:
    """Flows with whale: the flow crosses a threshold for the first time, with quiet for the first time since its token's last pause of more than so many seconds."""
    from tidewake.operators.episodes import token_episodes

    hits = (whale_crossings(flows) if quiet is None else whale_crossings(token_episodes(flows, quiet), scope=("episode",))).select("token", "seq").distinct().withColumn("whale", F.lit(True))
    x = flows.join(hits.hint("merge"), ["token", "seq"], "left")
    return x.select("token", "bt", "seq", "wallet", (F.col("direction") == "buy").alias("buy"), F.coalesce("whale", F.lit(False)).alias("whale"))


def transitions(flows: DataFrame, partitions: int | None = None, strict: bool = True, second: bool = False) -> DataFrame:
    """ST-4: all state transitions, with severity (FN-15). strict: see above; second: by the second generation's rules (ST-5), whose whales count anew after 600 quiet seconds."""
    importable(flows.sparkSession)
    n = partitions or int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_whales(flows.where("token IS NOT NULL AND wallet IS NOT NULL AND bt IS NOT NULL"), EPISODE_END if second else None)
    make = TokenV2 if second else (lambda: Token(strict=strict))
    return graded(rows.repartition(n, "token").sortWithinPartitions("token", "bt", "seq").mapInArrow(lambda batches: _run(batches, make), DDL))


def graded(changes: DataFrame) -> DataFrame:
    """Transitions with severity; dissipation goes by the severity before it in the episode."""
    w = Window.partitionBy("token", "episode").orderBy("bt", "seq")
    grade = lambda last: severity(F.col("to_state"), F.col("trigger"), F.col("n"), F.col("share"), F.col("seconds"), F.col("n_early"), last)
    x = changes.withColumn("_own", grade(F.lit(None).cast("string")))
    return x.withColumn("severity", grade(F.lag("_own").over(w))).drop("_own")


def waves(changes: DataFrame) -> DataFrame:
    """ST-7: for each episode's wave: when it began and ended, its early wallets and largest silent share."""
    return changes.groupBy("token", "episode", "wave").agg(F.min("bt").alias("start_bt"), F.max("bt").alias("end_bt"), F.max("n_early").alias("n_early"), F.max("share").alias("peak_silent"))


def wave_trend(waves_: DataFrame, cohort: str = "n") -> DataFrame:
    """WIN-26, WIN-27: trend of each wave's cohort against the one before, peak wave and fall from it, cliffs (a fall of 60 % or more) and ghosts.

    waves_: token, wave, and the cohort's size.
    """
    w = Window.partitionBy("token").orderBy("wave")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = waves_.withColumn("_last", F.lag(cohort).over(w)).withColumn("peak", F.max(cohort).over(run))
    x = x.withColumn("peak_wave", -F.max(F.struct(cohort, (-F.col("wave")).alias("k"))).over(run)["k"])
    n, last = F.col(cohort), F.col("_last")
    trend = F.when(last.isNull(), F.when(n >= 3, "BUILDING").otherwise("INSUFFICIENT_DATA")).when((n == 0) | ((last > 0) & (n < last * 0.25)), "COLLAPSING").when(n < last, "FADING").when(n == last, "STABLE").otherwise("BUILDING")
    x = x.withColumn("trend", trend).withColumn("cliff", F.coalesce((last > 0) & ((last - n) / last >= 0.60), F.lit(False)))
    fallen = F.coalesce(F.max("cliff").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    x = x.withColumn("ghost", fallen & (n < F.col("peak") * 0.30) & (F.col("trend") == "BUILDING"))
    return x.withColumn("trend", F.when(F.col("cliff"), "COLLAPSING").when(F.col("ghost"), "GHOST").otherwise(F.col("trend"))).drop("_last")


def entry_signals(changes: DataFrame) -> DataFrame:
    """ST-10: the first peak of each episode."""
    w = Window.partitionBy("token", "episode").orderBy("bt", "seq")
    return changes.where("to_state = 'PRESSURE_PEAKING'").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_ignition(flows: DataFrame, within: int = 300) -> DataFrame:
    """ST-6: the first early wallet of each token, which takes it from QUIET to IGNITION."""
    start = flows.groupBy("token").agg(F.min("bt").alias("t0"))
    x = flows.join(start.hint("merge"), "token").where(F.col("bt") - F.col("t0") <= within)
    return x.groupBy("token", "t0").agg(F.min(F.struct("bt", "seq", "wallet")).alias("x")).select("token", "t0", F.col("x.bt").alias("bt"), F.col("x.wallet").alias("wallet"))
