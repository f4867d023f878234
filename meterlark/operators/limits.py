"""Rate limiters over a log of requests: which ones would have passed.

The limiters are sequential within a key. A key's requests fall into runs parted by pauses after
which the limiter is as good as new; runs are independent of each other and are what tasks work on,
so that a hot key is spread over many tasks. Pauses are found without sorting a key's requests:
within a span of a pause's length there is none, so it is enough to look at the first and last
request of each such span, of which a key has no more than its time holds. A task reads its rows in
order and holds one run's state (at most ``most`` times, or some numbers), never the rows.

A null key is a key of its own; a request without a time has no result.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F


def _runs(requests: DataFrame, key: str, at: str, pause: int) -> DataFrame:
    """With run: the start of the run of requests that no pause of that length parts."""
    span = F.floor(F.col(at) / F.lit(pause)).alias("_span")
    ends = requests.filter(F.col(at).isNotNull()).groupBy(F.col(key).alias("_key"), span).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    w = W.partitionBy("_key").orderBy("_span")
    before = F.lag("_last").over(w)
    starts = F.when(before.isNull() | (F.col("_first") - before >= pause), F.col("_first"))
    runs = ends.select("_key", "_span", F.max(starts).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("run"))
    return requests.join(runs, requests[key].eqNullSafe(F.col("_key")) & (F.floor(requests[at] / F.lit(pause)) == F.col("_span")), "left").drop("_key", "_span")


def _walk(runs: DataFrame, key: str, at: str, order: str, fresh: Callable[[], Callable[[int, bool], bool]], ok: str | None = None) -> DataFrame:
    good = F.coalesce(F.col(ok), F.lit(False)) if ok else F.lit(True)
    rows = runs.select(F.col(key).alias("k"), F.col(at).cast("long").alias("t"), F.col(order).alias("o"), "run", good.alias("good")).repartition("k", "run").sortWithinPartitions("k", "run", "t", "o")
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, allow = None, fresh()
        for batch in batches:
            out = []
            for k, r, t, g in zip(*(batch.column(c).to_pylist() for c in (0, 3, 1, 4))):
                if (k, r) != current:
                    current, allow = (k, r), fresh()
                out.append(None if t is None else allow(t, g))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.bool_())], ["k", "t", "o", "allowed"])

    return rows.mapInArrow(run, f"k {kinds['k']}, t long, o {kinds['o']}, allowed boolean").toDF(key, at, order, "allowed")


def sliding(requests: DataFrame, key: str, at: str, order: str, most: int, seconds: int) -> DataFrame:
    """(key, at, order, allowed): at most ``most`` requests within ``seconds``; a denied request leaves no trace."""

    def fresh() -> Callable[[int, bool], bool]:
        times: deque[int] = deque()

        def allow(t: int, good: bool) -> bool:
            if len(times) >= most:
                if t - times[0] < seconds:
                    return False
                times.popleft()
            times.append(t)
            return True

        return allow

    return _walk(_runs(requests, key, at, seconds), key, at, order, fresh)


def token_bucket(requests: DataFrame, key: str, at: str, order: str, rate: float, capacity: float, cost: float = 1.0) -> DataFrame:
    """(key, at, order, allowed): a bucket that fills by ``rate`` a second up to ``capacity``; each request takes ``cost``."""

    def fresh() -> Callable[[int, bool], bool]:
        state = [capacity, None]

        def allow(t: int, good: bool) -> bool:
            if state[1] is not None:
                state[0] = min(capacity, state[0] + (t - state[1]) * rate)
            state[1] = t
            if state[0] < cost:
                return False
            state[0] -= cost
            return True

        return allow

    return _walk(_runs(requests, key, at, math.ceil(capacity / rate)), key, at, order, fresh)


def dual(requests: DataFrame, key: str, at: str, order: str, ok: str, total: int, success: int, seconds: int) -> DataFrame:
    """(key, at, order, allowed): at most ``success`` successful requests within ``seconds``, and a bucket of ``total`` requests that fills up within ``seconds``.

    Of the two ways in use, the one with shared state. Successes are looked at first: a request is
    denied where as many as ``success`` were recorded and the oldest of the last of them is younger
    than ``seconds``. Then it must find a token. Allowed requests that succeed are recorded. 0 switches
    a limit off.
    """

    def fresh() -> Callable[[int, bool], bool]:
        done: deque[int] = deque(maxlen=success or None)
        state = [total * seconds, None]

        def allow(t: int, good: bool) -> bool:
            if success and len(done) >= success and t - done[0] < seconds:
                return False
            if total:
                if state[1] is not None:
                    state[0] = min(total * seconds, state[0] + (t - state[1]) * total)
                state[1] = t
                if state[0] < seconds:
                    return False
                state[0] -= seconds
            if success and good:
                done.append(t)
            return True

        return allow

    return _walk(_runs(requests, key, at, seconds), key, at, order, fresh, ok)
