"""A protocol for models that learn row by row, and its runner on tables.

A model holds its state of one key as a list of doubles, so that the same state
lives in a task's memory (``fold``) and in a stream's state store
(``streaming.keyed.keyed``), and gives the same values in both.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from panelweave.core import ship

State = list[float]
Values = tuple[float | None, ...]


class Model(ABC):
    """``predict`` says what the next row's first input will be, ``update`` takes the row in."""

    inputs: tuple[str, ...]
    outputs: tuple[str, ...]

    def start(self) -> State:
        """The state before a key's first row."""
        return []

    @abstractmethod
    def predict(self, state: State) -> float | None: ...

    @abstractmethod
    def update(self, state: State, values: Values) -> State: ...

    @abstractmethod
    def said(self, state: State) -> tuple[float | None, ...]:
        """The outputs of the row that was taken in last."""

    def fit(self, history: Iterable[Values]) -> State:
        """The state after all rows of a history."""
        state = self.start()
        for values in history:
            state = self.update(state, values)
        return state


class LocalLevel(Model):
    """The filter of a wandering level seen with noise; starts at the first value with the variance of one observation."""

    inputs, outputs = ("value",), ("level", "variance")

    def __init__(self, steps: float = 0.01, noise: float = 0.1) -> None:
        self.steps, self.noise = steps, noise

    def predict(self, state):
        return state[0] if state else None

    def update(self, state, values):
        z = values[0]
        if not state and z is None:
            return state
        level, p = state or (z, self.noise)
        p += self.steps
        if z is None:
            return [level, p]
        gain = p / (p + self.noise)
        return [level + gain * (z - level), (1 - gain) * p]

    def said(self, state):
        return tuple(state) if state else (None, None)


class ChangeScore(Model):
    """How badly a discounted autoregression of order one foresaw the row, smoothed, and the same once more on the smoothed losses.

    Both stages start at their first value; the variance starts at the square
    of the first change and is at least ``least``. The score is 0 until the
    windows are full; a null value leaves everything as it is.
    """

    inputs, outputs, least = ("value",), ("score",), 1e-12

    def __init__(self, discount: float = 0.01, smooth: int = 7) -> None:
        self.discount, self.windows = discount, (smooth, max(1, round(smooth / 2)))

    def start(self):
        return [0.0] * 12 + [0.0, 0.0]

    def _stage(self, s: State, x: float) -> tuple[State, float | None]:
        n, mean, c0, c1, var, last = s
        if not n:
            return [1.0, x, 0.0, 0.0, 0.0, x], None
        r, keep = self.discount, 1 - self.discount
        mean = keep * mean + r * x
        c1 = keep * c1 + r * (x - mean) * (last - mean)
        c0 = keep * c0 + r * (x - mean) ** 2
        error = x - (mean + (c1 / c0 if c0 > 0 else 0.0) * (last - mean))
        var = max((x - last) ** 2 if n == 1 else keep * var + r * error * error, self.least)
        return [n + 1, mean, c0, c1, var, x], 0.5 * (math.log(2 * math.pi * var) + error * error / var)

    def update(self, state, values):
        x = values[0]
        if x is None:
            return state
        a, b = int(state[12]), int(state[13])
        first, second, one, two = state[:6], state[6:12], state[14 : 14 + a], state[14 + a : 14 + a + b]
        first, loss = self._stage(first, x)
        if loss is not None:
            one = [*one, loss][-self.windows[0] :]
            if len(one) == self.windows[0]:
                second, loss = self._stage(second, sum(one) / len(one))
                if loss is not None:
                    two = [*two, loss][-self.windows[1] :]
        return [*first, *second, float(len(one)), float(len(two)), *one, *two]

    def predict(self, state):
        return state[1] if state[0] else None

    def said(self, state):
        two = state[14 + int(state[12]) :]
        return (sum(two) / len(two) if len(two) == self.windows[1] else 0.0,)


class PidInterval(Model):
    """Intervals round the last value whose miss rate is steered by a controller, with errors kept apart by mode.

    The second input is the mode: 0 normal, 1 to 5 kinds of crisis, null as 0. A bucket with
    fewer than ``least`` errors gives way to that of all crises, that to the
    one of all rows; with too few there as well the interval is a tenth of the
    value wide on either side. Each interval given is judged by the next row.
    """

    inputs, outputs = ("value", "mode"), ("alpha", "lower", "upper", "covered")
    MODES, CRISIS, ALL = 6, 6, 7
    # fixed values: target miss rate, gains, bound of the integral, bounds of alpha
    ALPHA, GAINS, WINDUP, LOW, HIGH = 0.1, (0.05, 0.005, 0.01), 3.0, 0.01, 0.5

    def __init__(self, least: int = 20, most: int = 300) -> None:
        self.least, self.most = least, most

    def start(self):
        return [self.ALPHA, 0.0, 0.0, math.nan, math.nan, math.nan, math.nan, *[0.0] * 8]

    def _buckets(self, state: State) -> list[State]:
        out, at = [], 15
        for n in map(int, state[7:15]):
            out.append(state[at : at + n])
            at += n
        return out

    def _width(self, buckets: list[State], mode: int, alpha: float, value: float) -> float:
        chain = [mode, self.CRISIS, self.ALL] if mode else [mode, self.ALL]
        scores = next((buckets[b] for b in chain if len(buckets[b]) >= self.least), None)
        if scores is None:
            return abs(value) * 0.1
        n = len(scores)
        level = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)
        return sorted(scores)[min(int(level * n), n - 1)]

    def predict(self, state):
        return None if math.isnan(state[3]) else state[3]

    def update(self, state, values):
        value, mode = values[0], int(values[1] or 0)
        if value is None:
            return state
        alpha, integral, last_error, last = state[:4]
        buckets, lower, upper, covered = self._buckets(state), math.nan, math.nan, math.nan
        if not math.isnan(last):
            width = self._width(buckets, mode, alpha, last)
            lower, upper = last - width, last + width
            covered = float(lower <= value <= upper)
            error = 1 - covered - self.ALPHA
            integral = max(-self.WINDUP, min(self.WINDUP, integral + error))
            kp, ki, kd = self.GAINS
            alpha = max(self.LOW, min(self.HIGH, alpha + kp * error + ki * integral + kd * (error - last_error)))
            last_error = error
            for b in {mode, self.ALL} | ({self.CRISIS} if mode else set()):
                buckets[b] = [*buckets[b], abs(value - last)][-self.most :]
        return [alpha, integral, last_error, value, lower, upper, covered, *[float(len(b)) for b in buckets], *[s for b in buckets for s in b]]

    def said(self, state):
        alpha, _, _, _, lower, upper, covered = state[:7]
        return (alpha, *[None if math.isnan(v) else v for v in (lower, upper, covered)])


def step(model: Model, state: State, values: Values) -> tuple[State, tuple[float | None, ...]]:
    """The state after a row, and the row's outputs, the prediction made before it first."""
    predicted = model.predict(state)
    state = model.update(state, values)
    return state, (predicted, *model.said(state))


def _fold(batches: Iterator[pa.RecordBatch], model: Model, key: str) -> Iterator[pa.RecordBatch]:
    now, state = (), model.start()
    for batch in batches:
        if not batch.num_rows:
            continue
        get = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()
        rows = []
        for k, *values in zip(get(key), *map(get, model.inputs)):
            if (k,) != now:
                now, state = (k,), model.start()
            state, out = step(model, state, tuple(values))
            rows.append(out)
        columns = [pa.array(c, pa.float64()) for c in zip(*rows)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "predicted", *model.outputs])


def fold(df: DataFrame, key: str, order: Sequence[str], model: Model) -> DataFrame:
    """``df`` with ``predicted`` and the model's outputs, each key's rows taken in order.

    A key's rows pass through one task, as a model's update need not compose;
    they come in batches and are never held whole. Nulls go to the model; an
    empty frame gives no rows.
    """
    ship(df.sparkSession)
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "predicted double", *[f"{o} double" for o in model.outputs]])
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(partial(_fold, model=model, key=key), ddl)
