"""Stateful steps of the live path: cutting arrivals into flushes, and gaps to the leader as laps come in."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

FLUSH = T.StructType([T.StructField("flush", T.LongType()), T.StructField("opened_at", T.TimestampType())])


KEY_GROUPS = 64  # groups that keys are dealt to; the open flushes of a group are one state


def cut_flushes(
    stream: DataFrame,
    keys: Sequence[str],
    arrival: str,
    rows: int = 50,
    seconds: float = 2.0,
    idle: str | None = None,
) -> DataFrame:
    """Add `flush` and `opened_at` to a stream: a flush of a key is full at `rows` rows and over
    `seconds` after its first one, whichever comes first.

    The state of a key is the open flush only (its number, rows and opening time); rows are not
    held back, they leave with the micro-batch that brings them, so nothing waits for a buffer to
    fill and nothing is lost with one. Keys are dealt to `KEY_GROUPS` groups and a group's keys are cut
    by one call, which takes longer to start than to cut the few rows that a key has in a micro-batch.
    With `idle`, a key without arrivals for so long gives up its
    state; its flushes go on from the microseconds of its next arrival, so numbers stay ascending.
    Such a query looks at the clock in every trigger and does not end by itself.
    Rows of a micro-batch are taken in order of arrival; a row that arrives after later ones falls
    into the flush that is open then. Rows with a null key or arrival get no flush and are left out.
    """
    keys, whole = list(keys), round(seconds * 1_000_000)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    schema = T.StructType([*stream.schema.fields, *FLUSH.fields])
    columns = [f.name for f in schema.fields]
    longs = T.ArrayType(T.LongType())
    state_schema = T.StructType(
        [T.StructField(f"key_{i}", T.ArrayType(stream.schema[k].dataType)) for i, k in enumerate(keys)]
        + [T.StructField(name, longs) for name in ("flush", "held", "opened", "seen")]
    )

    def keep(state: GroupState, known: dict[tuple, tuple], now: int) -> None:
        if idle_ms is not None:
            known = {k: v for k, v in known.items() if now - v[3] < idle_ms}
        if not known:
            if state.exists:
                state.remove()
            return
        state.update((*(list(k) for k in zip(*known, strict=True)), *(list(v) for v in zip(*known.values(), strict=True))))
        if idle_ms is not None:
            state.setTimeoutDuration(max(1, min(v[3] for v in known.values()) + idle_ms - now))

    def cut(_: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if idle_ms is not None else 0
        known: dict[tuple, tuple] = {}
        if state.exists:
            parts = state.get
            known = dict(zip(zip(*parts[: len(keys)], strict=True), zip(*parts[len(keys) :], strict=True), strict=True))
        if state.hasTimedOut:
            keep(state, known, now)
            return
        page = pd.concat(list(pages), ignore_index=True)
        at = page[arrival].to_numpy().astype("datetime64[us]").astype(np.int64)
        codes = [pd.factorize(page[k])[0] for k in keys]
        order = np.lexsort((at, *codes))
        page, at = page.take(order), at[order]
        new = np.any([np.diff(c[order], prepend=-2) != 0 for c in codes], axis=0)
        starts = np.flatnonzero(new)
        # NaN differs from itself, None does not.
        names = zip(*([None if v != v else v for v in page[k].to_numpy()[starts].tolist()] for k in keys), strict=True)
        numbers, openings = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for key, done, stop in zip(names, starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
            flush, held, opened, _seen = known.get(key, (-1, rows, 0, 0))
            while done < stop:
                if held >= rows or at[done] - opened >= whole:
                    # The first flush of a key is numbered by its time, so that a forgotten key goes on upwards.
                    flush, held, opened = (flush + 1 if flush >= 0 else int(at[done])), 0, int(at[done])
                end = min(done + rows - held, done + int(np.searchsorted(at[done:stop], opened + whole, "left")))
                end = max(end, done + 1)
                numbers[done:end], openings[done:end] = flush, opened
                held, done = held + end - done, end
            known[key] = (int(flush), int(held), int(opened), now)
        keep(state, known, now)
        page["flush"], page["opened_at"] = numbers, openings.astype("datetime64[us]")
        yield page[columns]

    present = stream.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, arrival]))
    dealt = present.withColumn("__group", F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS)).cast("int"))
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return dealt.groupBy("__group").applyInPandasWithState(cut, schema, state_schema, "append", timeout)


def flush_log(flushed: DataFrame, keys: Sequence[str], arrival: str, rows: int = 50) -> DataFrame:
    """One row per flush: its number in its key from 1, rows, first and last arrival, and why it
    ended: 'rows' when full, 'seconds' when time ran out, 'open' for the last of a key."""
    keys = list(keys)
    listed = flushed.groupBy(*keys, "flush").agg(
        F.count(F.lit(1)).alias("rows"), F.min(arrival).alias("first_arrival"), F.max(arrival).alias("last_arrival")
    )
    order = Window.partitionBy(*keys).orderBy("flush")
    last = F.lead("flush").over(order).isNull()
    reason = F.when(F.col("rows") >= rows, "rows").when(last, "open").otherwise("seconds")
    return listed.withColumn("reason", reason).withColumn("flush", F.row_number().over(order))


GAP = T.StructType(
    [T.StructField("race_time", T.DoubleType()), T.StructField("gap_to_leader", T.DoubleType()), T.StructField("version", T.LongType())]
)


NO_LAP = 2**31 - 1  # stands for a null lap, after all others


def race_gaps(race: np.ndarray, driver: np.ndarray, lap: np.ndarray, time: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Race times and gaps to the leader of rows in order of race, driver and lap, all given as numbers."""
    run = np.cumsum((np.diff(race, prepend=-1) != 0) | (np.diff(driver, prepend=-2) != 0))
    race_time = pd.Series(time).groupby(run, sort=False).cumsum()
    leader = race_time.groupby(race << 32 | lap & 0xFFFFFFFF, sort=False).transform("min")
    return race_time.to_numpy(), (race_time - leader).to_numpy()


def live_gaps(
    stream: DataFrame,
    race: Sequence[str],
    driver: str = "driver_code",
    lap: str = "lap_number",
    time: str = "lap_time_seconds",
    arrival: str = "published_at",
    delay: str = "1 hour",
) -> DataFrame:
    """Gaps to the leader as an update stream: (race, driver, lap, race_time, gap_to_leader, version).

    The state of a race is what came in of it, every driver's laps; the gaps last sent follow from them.
    Races are dealt to `KEY_GROUPS` groups, and a group's races are brought up to date by one call.
    Laps may arrive in any order. A lap that arrives late moves the race time of its driver's later
    laps, and a new leader of a lap moves everybody's gap on it; every row whose gap changed is sent
    again with a higher version, so the latest versions (`latest_gaps`) equal the gaps of the whole
    race. A lap sent twice counts once, with its latest time. Laps without a time, and rows later than
    the watermark, are left out; a race's state goes once the watermark has passed its last arrival.
    """
    race = list(race)
    # Races go through as text, which null numbers and large ones survive.
    sent_as = T.StructType([*(T.StructField(c, T.StringType()) for c in race), stream.schema[driver], stream.schema[lap], *GAP.fields])
    texts, longs, packed = T.ArrayType(T.StringType()), T.ArrayType(T.LongType()), T.BinaryType()
    state_schema = T.StructType(
        [T.StructField(f"race_{i}", texts) for i in range(len(race))]
        + [T.StructField("version", longs), T.StructField("last", longs)]
        # Rows in order of race, driver and lap; a run is a driver's rows of a race.
        + [T.StructField("run_driver", T.ArrayType(stream.schema[driver].dataType))]
        + [T.StructField(name, packed) for name in ("run_race", "run_rows", "laps", "times")]
    )

    def keep(
        state: GroupState, names: list[tuple], version: np.ndarray, last: np.ndarray, runs: tuple, laps: np.ndarray, times: np.ndarray, live: np.ndarray
    ) -> None:
        """Store what is known of the `live` races."""
        if not live.any():
            if state.exists:
                state.remove()
            return
        run_driver, run_race, run_rows = runs
        stay = live[run_race]
        rows = np.repeat(stay, run_rows)
        number = np.cumsum(live) - 1
        alive = [n for n, on in zip(names, live.tolist(), strict=True) if on]
        state.update(
            (
                *(list(c) for c in zip(*alive, strict=True)),
                version[live].tolist(),
                last[live].tolist(),
                [d for d, on in zip(run_driver, stay.tolist(), strict=True) if on],
                number[run_race[stay]].astype(np.int32).tobytes(),
                run_rows[stay].astype(np.int32).tobytes(),
                laps[rows].astype(np.int32).tobytes(),
                times[rows].astype(np.float64).tobytes(),
            )
        )
        state.setTimeoutTimestamp(max(int(last[live].min()), state.getCurrentWatermarkMs() + 1))

    def update(_: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names: list[tuple] = []
        version, last, run_driver = np.empty(0, np.int64), np.empty(0, np.int64), []
        run_race, run_rows, laps, times = (np.empty(0, np.int64) for _ in range(4))
        if state.exists:
            parts = state.get
            names = list(zip(*parts[: len(race)], strict=True))
            version, last = (np.array(x, np.int64) for x in parts[len(race) : len(race) + 2])
            run_driver = list(parts[len(race) + 2])
            run_race, run_rows, laps = (np.frombuffer(x, np.int32).astype(np.int64) for x in parts[len(race) + 3 : len(race) + 6])
            times = np.frombuffer(parts[-1], np.float64)
        if state.hasTimedOut:
            keep(state, names, version, last, (run_driver, run_race, run_rows), laps, times, last >= state.getCurrentWatermarkMs())
            return
        page = pd.concat(list(pages)).sort_values(arrival, kind="stable", ignore_index=True)
        came = page[arrival].to_numpy().astype("datetime64[ms]").astype(np.int64)
        code = np.zeros(len(page), np.int64)
        for c in race:
            part = pd.factorize(page[c])[0]
            code = pd.factorize(code * (part.max() + 2) + part + 1)[0]
        first = np.unique(code, return_index=True)[1]
        number = {name: i for i, name in enumerate(names)}
        called = [number.setdefault(name, len(number)) for name in zip(*(page[c].to_numpy()[first].tolist() for c in race), strict=True)]
        names, called = list(number), np.array(called, np.int64)
        version, last = (np.r_[x, np.zeros(len(names) - len(x), np.int64)] for x in (version, last))
        version[called] += 1
        np.maximum.at(last, called[code], came)
        drivers, by = pd.factorize(pd.Series([*run_driver, *page[driver].tolist()], dtype=object))
        old_race, old_driver = np.repeat(run_race, run_rows), np.repeat(drivers[: len(run_driver)], run_rows)
        old_gap = race_gaps(old_race, old_driver, laps, times)[1] if len(laps) else times
        # Known rows, then those of the page: of rows of one lap the last counts.
        all_race = np.r_[old_race, called[code]]
        all_driver = np.r_[old_driver, drivers[len(run_driver) :]]
        all_lap = np.r_[laps, page[lap].fillna(NO_LAP).to_numpy().astype(np.int64)]
        order = np.lexsort((all_lap, all_driver, all_race))
        r, d, n = all_race[order], all_driver[order], all_lap[order]
        new = (np.diff(r, prepend=-1) != 0) | (np.diff(d, prepend=-2) != 0) | (np.diff(n, prepend=NO_LAP + 1) != 0)
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(order)] - 1
        oldest = order[starts]
        r, d, n, t = r[starts], d[starts], n[starts], np.r_[times, page[time].to_numpy().astype(np.float64)][order[ends]]
        sent = np.full(len(starts), np.nan)
        known = oldest < len(laps)
        sent[known] = old_gap[oldest[known]]
        race_time, gap = race_gaps(r, d, n, t)
        opens = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(d, prepend=-2) != 0))
        by = np.append(np.array(by, dtype=object), None)  # a driver of -1 is null
        live = last >= state.getCurrentWatermarkMs()
        live[called] = True
        keep(state, names, version, last, (by[d[opens]].tolist(), r[opens], np.diff(opens, append=len(r))), n, t, live)
        moved = np.flatnonzero(~(sent == gap))
        out = pd.DataFrame({c: np.array(x, dtype=object)[r[moved]] for c, x in zip(race, zip(*names, strict=True), strict=True)})
        out[driver], out[lap] = by[d[moved]], pd.Series(n[moved])
        if (n[moved] == NO_LAP).any():
            out[lap] = out[lap].where(out[lap] != NO_LAP)
        out["race_time"], out["gap_to_leader"], out["version"] = race_time[moved], gap[moved], version[r[moved]]
        yield out[[f.name for f in sent_as.fields]]

    timed = stream.filter(F.col(time).isNotNull()).withWatermark(arrival, delay)
    group = F.pmod(F.xxhash64(*race), F.lit(KEY_GROUPS)).cast("int").alias("__group")
    dealt = timed.select(group, *(F.col(c).cast("string").alias(c) for c in race), driver, lap, time, arrival)
    sent = dealt.groupBy("__group").applyInPandasWithState(
        update, sent_as, state_schema, "update", GroupStateTimeout.EventTimeTimeout
    )
    return sent.withColumns({c: F.col(c).cast(stream.schema[c].dataType) for c in race})


def latest_gaps(sent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest version of every row of a `live_gaps` sink."""
    # A column each: unlike those of a struct, their aggregates are hashed and no rows are sorted.
    values = [c for c in ("race_time", "gap_to_leader") if c in sent.columns]
    return sent.groupBy(*keys).agg(*[F.max_by(c, "version").alias(c) for c in values])
