"""Random values from a seed.

Sequences are those of a 128-bit XorShift generator: a state of two longs, whose next is made
of shifts and exclusive ors alone. Such a step is linear over bits, so the step for any number
of values at once is a matrix of bits, a power of the first one's: the n-th value of the one
sequence is found without those before it, and each task starts at its own places. Columns
without an order (rand, shuffle of arrays) are Spark's own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from millrace.frame import OrderedFrame

#: Shifts of the generator (fixed values): of the older half to the left and right, and of the newer half to the right.
LEFT, RIGHT_OLD, RIGHT_NEW = 23, 17, 26
MASK = (1 << 64) - 1
#: Values that are made at once, each lane from its own place on.
LANES = 256
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _step(older, newer):
    """The next state of arrays (or numbers) of unsigned longs; shifts to the right keep the sign."""
    import numpy as np

    x = older ^ (older << np.uint64(LEFT))
    signed = lambda v, by: (v.view(np.int64) >> by).view(np.uint64)
    return newer, x ^ newer ^ signed(x, RIGHT_OLD) ^ signed(newer, RIGHT_NEW)


@functools.cache
def _jump(power: int) -> tuple[int, ...]:
    """The matrix of 2**power steps: what each of the 128 bits of a state (older half lowest) becomes."""
    import numpy as np

    if power == 0:
        out = []
        for bit in range(128):
            state = 1 << bit
            a, b = _step(np.array([state & MASK], np.uint64), np.array([state >> 64], np.uint64))
            out.append(int(a[0]) | int(b[0]) << 64)
        return tuple(out)
    half = _jump(power - 1)
    return tuple(_times(half, half[bit]) for bit in range(128))


def _times(matrix: tuple[int, ...], state: int) -> int:
    out = 0
    while state:
        low = state & -state
        out ^= matrix[low.bit_length() - 1]
        state ^= low
    return out


def jumped(state: int, steps: int) -> int:
    """state after so many steps."""
    power = 0
    while steps:
        if steps & 1:
            state = _times(_jump(power), state)
        steps, power = steps >> 1, power + 1
    return state


def longs_from(seed0: int, seed1: int, start: int, n: int):
    """n values of the sequence, from the one numbered start (0: the first) on, as longs."""
    import numpy as np

    if seed0 == seed1 == 0:
        raise ValueError("one half of the seed isn't 0")
    lanes = max(1, min(LANES, n))
    each = -(-n // lanes)
    states, at = [], jumped((seed0 & MASK) | (seed1 & MASK) << 64, start)
    for _ in range(lanes):
        states.append(at)
        at = jumped(at, each)
    a, b = (np.array([s >> shift & MASK for s in states], np.uint64) for shift in (0, 64))
    out = np.empty((lanes, each), np.uint64)
    for i in range(each):
        before = b
        a, b = _step(a, b)
        out[:, i] = b + before
    return out.ravel()[:n].view(np.int64)


def _at(places, seed0: int, seed1: int, per_row: int):
    """The values (row, draw) of rows at places, each run of neighbouring places at once."""
    import numpy as np

    order = np.argsort(places, kind="stable")
    ranked = places[order]
    out = np.empty((len(places), per_row), np.int64)
    cuts = np.flatnonzero(np.diff(ranked) != 1) + 1
    for run in np.split(np.arange(len(ranked)), cuts):
        if len(run):
            own = longs_from(seed0, seed1, int(ranked[run[0]]) * per_row, len(run) * per_row)
            out[order[run]] = own.reshape(len(run), per_row)
    return out


def drawn(frame: OrderedFrame, seed0: int, seed1: int, name: str = "random", per_row: int = 1) -> OrderedFrame:
    """frame with an array of the per_row values of the sequence that are its turn, row by row in order (each key from the sequence's first on)."""
    from millrace import positions

    df = positions.with_positions(frame)
    positions.fresh(df, name)

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            found = _at(batch.column(positions.POS).to_numpy(), seed0, seed1, per_row)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), per_row).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, name])

    schema = ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [f"`{name}` array<long>"])
    return frame.with_df(df.mapInArrow(draw, schema).drop(positions.POS))


def next_long(value: Column, bound: Column | int | None = None) -> Column:
    """A value as it is, or from 0 to below bound: its lowest bits for a power of two, else the rest of its upper 63."""
    if bound is None:
        return value
    most = F.lit(bound) if isinstance(bound, int) else bound
    fails = F.when(most <= 0, F.raise_error(F.lit("a bound is above 0")).cast("long"))
    return fails.otherwise(F.when(most.bitwiseAND(most - 1) == 0, value.bitwiseAND(most - 1)).otherwise(F.shiftrightunsigned(value, 1) % most)).cast("long")


def next_int(value: Column, bound: Column | int | None = None) -> Column:
    """The lowest 32 bits of a value, or from 0 to below bound, as next_long()."""
    low = F.shiftright(F.shiftleft(value, 32), 32).cast("int")
    if bound is None:
        return low
    most = (F.lit(bound) if isinstance(bound, int) else bound).cast("int")
    fails = F.when(most <= 0, F.raise_error(F.lit("a bound is above 0")).cast("int"))
    return fails.otherwise(F.when(most.bitwiseAND(most - 1) == 0, low.bitwiseAND(most - 1)).otherwise(F.shiftrightunsigned(low, 1) % most)).cast("int")


def next_double(value: Column) -> Column:
    """From 0 to below 1, of the lowest 53 bits."""
    return value.bitwiseAND(F.lit((1 << 53) - 1)) * F.lit(2.0**-53)


def next_float(value: Column) -> Column:
    """From 0 to below 1, of the lowest 24 bits."""
    return (value.bitwiseAND(F.lit((1 << 24) - 1)) * F.lit(2.0**-24)).cast("float")


def next_boolean(value: Column) -> Column:
    return value.bitwiseAND(F.lit(1)) != 0


def decide(value: Column, probability: float) -> Column:
    """True with a probability."""
    return next_double(value) < probability


def decide_pow2(value: Column, power: int = 1) -> Column:
    """True with a probability of 1 / 2**power."""
    return value.bitwiseAND(F.lit((1 << (power & 31)) - 1)) == 0


def next_bytes(values: Column, n: int) -> Column:
    """n bytes of ceil(n / 8) values: each value's lowest byte is the last of its eight, and the first value's eight are the last bytes."""
    text = F.aggregate(F.slice(values, 1, -(-n // 8)), F.lit(""), lambda acc, v: F.concat(F.lpad(F.hex(v), 16, "0"), acc))
    return F.unhex(F.right(text, F.lit(2 * n)))


def pick(elements: Column, value: Column) -> Column:
    """An element of an array that isn't empty."""
    return F.get(elements, next_int(value, F.size(elements)))


def shuffled(elements: Column, values: Column) -> Column:
    """The elements of an array in another order: from the last on, each changes places with one that isn't after it, by the next of values."""
    n = F.size(elements)
    steps = F.when(n > 1, F.sequence(n, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    def change(acc: Column, i: Column) -> Column:
        j = next_int(F.get(values, n - i), i) + 1
        a, b = F.element_at(acc, i), F.element_at(acc, j)
        return F.transform(acc, lambda x, at: F.when(at == i - 1, b).when(at == j - 1, a).otherwise(x))

    return F.aggregate(steps, elements, change)


def in_random_order(frame: OrderedFrame, seed0: int, seed1: int, name: str = "turn") -> OrderedFrame:
    """frame in the order of the sequence's values beside its rows: a permutation, made by the shuffle that sorts it."""
    out = drawn(frame, seed0, seed1, name)
    return frame.within(out.df.withColumn(name, F.col(name)[0]), (name, *frame.order))


def alphanumeric(values: Column) -> Column:
    """A character of each value."""
    at: Callable[[Column], Column] = lambda v: F.substring(F.lit(CHARACTERS), next_int(v, len(CHARACTERS)) + 1, F.lit(1))
    return F.array_join(F.transform(values, at), "")
