"""Structured Streaming forms of the tape operators. Each agrees with its batch form on the same rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """One row for each key; keys are forgotten once the watermark has passed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def minute_vwap(stream: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Size-weighted mean price of each asset and minute."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, "1 minute"), "asset_id")
    return grouped.agg((F.sum(F.col("pc") * F.col("size")) / F.sum("size")).alias("vwap"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("minute"), "asset_id", "vwap", "n")


def pressure(stream: DataFrame, width: str = "1 hour", slide: str | None = None, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Signed and gross notional of a market by tumbling or sliding window."""
    toward = (F.col("side") == "BUY") == (F.col("outcome_index") == 0)
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width, slide or width), "condition_id")
    out = grouped.agg(F.sum(F.when(toward, F.col("notional")).otherwise(-F.col("notional"))).alias("net"), F.sum("notional").alias("gross"))
    return out.select(F.col("window.start").alias("start"), "condition_id", "net", "gross")


def sessions(stream: DataFrame, gap: str = "10 minutes", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Bursts of a wallet's activity separated by at least a gap."""
    grouped = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), "wallet")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("notional").alias("notional")).select("wallet", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "notional")


def sprt_alerts(stream: DataFrame, p0: float = 0.5, p1: float = 0.65, alpha: float = 0.01, beta: float = 0.05) -> DataFrame:
    """Sequential test of each market's share of trades towards outcome 0: p0 against p1.

    State is the running log-likelihood ratio and count; crossing a bound gives an alert and starts over.
    Needs columns condition_id, seq (a total order), toward (0 or 1).
    """
    up, down = math.log((1 - beta) / alpha), math.log(beta / (1 - alpha))
    win, lose = math.log(p1 / p0), math.log((1 - p1) / (1 - p0))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        llr, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, toward in zip(rows["seq"], rows["toward"], strict=True):
            llr, n = llr + (win if toward else lose), n + 1
            if llr >= up or llr <= down:
                out.append((key[0], int(seq), "pressure" if llr >= up else "clear", n))
                llr, n = 0.0, 0
        state.update((llr, n))
        yield pd.DataFrame(out, columns=["condition_id", "seq", "verdict", "n"])

    grouped = stream.select("condition_id", "seq", "toward").groupBy("condition_id")
    return grouped.applyInPandasWithState(step, "condition_id bigint, seq bigint, verdict string, n bigint", "llr double, n bigint", "append", GroupStateTimeout.NoTimeout)


def interval_pairs(buys: DataFrame, sells: DataFrame, within: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Buys and sells of one wallet in one asset at most `within` apart, as a join of two streams.

    buys: wallet, asset_id, buy_id, buy_ts; sells: wallet, asset_id, sell_id, sell_ts. Both are forgotten after the watermark.
    """
    b, s = buys.withWatermark("buy_ts", late).alias("b"), sells.withWatermark("sell_ts", late).alias("s")
    near = F.expr(f"b.wallet = s.wallet and b.asset_id = s.asset_id and s.sell_ts between b.buy_ts - interval {within} and b.buy_ts + interval {within}")
    return b.join(s, near).select("b.wallet", "b.asset_id", "buy_id", "sell_id")


class _PriceSum:
    """A family's last prices and its open episode, as operators.families.episodes defines them.

    The sum of the prices and the oldest of them are kept up to date, so a trade costs a step; all prices are only looked at when the
    oldest one is renewed.
    """

    def __init__(self, last: dict[int, tuple[int, int]], episode: tuple[int, int] | None, gains: dict[int, int], stale_s: int, opens: int, closes: int) -> None:
        self.last, self.episode, self.gains = last, episode, gains
        self.stale_s, self.opens, self.closes = stale_s, opens, closes
        self.total, self.changed = sum(p for p, _ in last.values()), set()
        self._find_oldest()

    def _find_oldest(self) -> None:
        self.oldest = min(((at, c) for c, (_, at) in self.last.items()), default=None)

    def _off(self, members: int, sec: int) -> int | None:
        if len(self.last) < members or sec - self.oldest[0] > self.stale_s:
            return None
        return abs(self.total - 100)

    def _price(self, condition: int, sec: int, pc: int) -> None:
        self.total += pc - self.last.get(condition, (0, 0))[0]
        self.last[condition] = (pc, sec)
        self.changed.add(condition)
        if self.oldest is None or self.oldest[1] == condition:
            self._find_oldest()

    def trade(self, members: int, condition: int, sec: int, pc: int, wallet: int) -> tuple | None:
        """Take a trade in; (start, peak, correctors, closer, corrective) of the episode that it ends, if any."""
        before = self._off(members, sec)
        self._price(condition, sec, pc)
        after = self._off(members, sec)
        if after is None:
            return None
        if self.episode is None and after > self.opens:
            self.episode, self.gains = (sec, after), {}
        if before is None or self.episode is None:
            return None
        start, peak = self.episode
        self.episode = start, max(peak, before, after)
        if before > after:
            self.gains[wallet] = self.gains.get(wallet, 0) + before - after
        if after >= self.closes:
            return None
        closer = max(self.gains, key=self.gains.get, default=None)
        done = (*self.episode, len(self.gains), closer, self.gains.get(closer, 0))
        self.episode, self.gains = None, {}
        return done


_EPISODE = ["family", "start", "peak", "correctors", "closer", "corrective"]


class _Episodes(StatefulProcessor):
    """Typed state of a family: a map of last prices, a map of the open episode's gains, the episode, and one timer.

    The timer stands where the oldest price goes stale. Once the watermark has passed it, stale prices are removed: a missing
    price and a stale one leave the sum undefined alike, so nothing changes but the state's size.
    """

    def __init__(self, stale_s: int, opens: int, closes: int) -> None:
        self.rules = stale_s, opens, closes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "condition bigint", "pc bigint, sec bigint")
        self.gains = handle.getMapState("gains", "wallet bigint", "gain bigint, place bigint")
        self.episode = handle.getValueState("episode", "start bigint, peak bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def _held(self) -> _PriceSum:
        last = {k[0]: (v[0], v[1]) for k, v in self.last.iterator()} if self.last.exists() else {}
        gains = sorted(((v[1], k[0], v[0]) for k, v in self.gains.iterator()) if self.gains.exists() else ())  # in order of first gains
        found = self.episode.get() if self.episode.exists() else None
        return _PriceSum(last, (found[0], found[1]) if found else None, {w: g for _, w, g in gains}, *self.rules)

    def _wake(self, held: _PriceSum) -> None:
        """One timer: where the oldest price goes stale."""
        at = (held.oldest[0] + self.rules[0] + 1) * 1000 if held.oldest else None
        before = self.timer.get()[0] if self.timer.exists() else None
        if at != before:
            if before is not None and before in set(self.handle.listTimers()):
                self.handle.deleteTimer(before)
            if at is None:
                self.timer.clear()
            else:
                self.handle.registerTimer(at)
                self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        given = pd.concat(list(rows)).sort_values("seq")[["members", "condition_id", "sec", "pc", "wallet"]]
        done = [(key[0], *out) for row in given.itertuples(index=False) if (out := held.trade(*map(int, row)))]
        for c in held.changed:
            self.last.updateValue((c,), held.last[c])
        self.gains.clear()
        for place, (w, g) in enumerate(held.gains.items()):
            self.gains.updateValue((w,), (g, place))
        if held.episode:
            self.episode.update(held.episode)
        else:
            self.episode.clear()
        self._wake(held)
        if done:
            yield pd.DataFrame(done, columns=_EPISODE).astype({"closer": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        held = self._held()
        for c in [c for c, (_, at) in held.last.items() if at + self.rules[0] < now]:
            self.last.removeKey((c,))
            del held.last[c]
        self.timer.clear()
        held._find_oldest()
        self._wake(held)
        yield from ()


def episodes(stream: DataFrame, stale_s: int = 172_800, opens: int = 5, closes: int = 2, late: str = "1 hour") -> DataFrame:
    """Price-sum episodes of families as a stream; state is a family's last prices and its open episode (_Episodes).

    Needs family, members (how many candidates the family has), condition_id, seq (a total order), sec, pc, wallet. Rows more than
    `late` behind the watermark of sec may find their prices gone. Sets the RocksDB state store, which typed state needs.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select("family", "members", "condition_id", "seq", "sec", "pc", "wallet", F.timestamp_seconds("sec").alias("at")).withWatermark("at", late)
    schema = ", ".join(f"{n} bigint" for n in _EPISODE)
    return rows.groupBy("family").transformWithStateInPandas(_Episodes(stale_s, opens, closes), schema, "Append", "EventTime")
