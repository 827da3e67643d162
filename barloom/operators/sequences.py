"""Per-symbol sliding windows of feature rows, and their augmentation.

Feature matrices are arrays, so project to the wanted columns first: a window
repeats each row ``length`` times by nature of the operator.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.schema import HORIZONS, KEY, TIME
from barloom.operators.splits import with_rank


def _vector(features: list[str]) -> Column:
    return F.array(*[F.col(f).cast("float") for f in features])


def sequences(panel: DataFrame, features: list[str], target: str, length: int = 30) -> DataFrame:
    """``sequence`` of the ``length`` rows before each row, and that row's ``label``."""
    return _windows(panel, features, length, F.col(target).cast("float").alias("label"))


def multi_target_sequences(panel: DataFrame, features: list[str], length: int = 30) -> DataFrame:
    """Like ``sequences`` with one label per horizon in a map."""
    entries = []
    for h in HORIZONS:
        if f"Target_Direction_{h}d" in panel.columns:
            entries += [F.lit(f"h{h}"), F.col(f"Target_Direction_{h}d").cast("float")]
    return _windows(panel, features, length, F.create_map(*entries).alias("labels"))


def _windows(panel, features, length, label):
    rows = panel.select(KEY, TIME, label, _vector(features).alias("_v"))
    name = [c for c in rows.columns if c not in (KEY, TIME, "_v")][0]
    before = F.collect_list("_v").over(W.preceding(length))
    out = rows.select(KEY, TIME, before.alias("sequence"), name)
    return out.filter(F.size("sequence") == length)


_WORD = 1 << 32


def sample_state(seed: int, use: str) -> Column:
    """A 32-bit number for each sample and use: one hash, the same in every engine."""
    key = F.concat_ws("|", F.lit(f"{seed}|{use}"), F.col(KEY), F.date_format(TIME, "yyyy-MM-dd"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def draw(state: Column, counter: Column) -> Column:
    """Number ``counter`` of a sample, in (0, 1]: steps of a fixed stride from its state, mixed twice."""
    x = (state + counter.cast("bigint") * 2654435769) % _WORD
    x = (x * 747796405 + 2891336453) % _WORD
    x = x.bitwiseXOR(F.shiftright(x, 16)) * 668265263 % _WORD
    return (x.bitwiseXOR(F.shiftright(x, 15)) + 1) / float(_WORD)


def gauss(state: Column, counter: Column) -> Column:
    """A normal number from two draws."""
    u, v = draw(state, counter * 2), draw(state, counter * 2 + 1)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def _opened(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Bounds of the lists from 0, and what they hold."""
    if not len(lists):  # bounds of no list need not be written
        return np.zeros(1, np.int32), lists.values.slice(0, 0)
    bounds = lists.offsets.to_numpy()
    return bounds - bounds[0], lists.values.slice(bounds[0], bounds[-1] - bounds[0])


def _elements(nested: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Sample, step, width and channel of every element of lists of lists; unknown lists hold none."""
    rows, inner = _opened(nested)
    cells, _ = _opened(inner)
    length, width = np.diff(rows), np.diff(cells)
    sample = np.repeat(np.arange(len(nested)), length)
    step = np.arange(rows[-1]) - np.repeat(rows[:-1], length)
    channel = np.arange(cells[-1]) - np.repeat(cells[:-1], width)
    return np.repeat(sample, width), np.repeat(step, width), np.repeat(width, width), channel


def _refilled(nested: pa.ListArray, work: Callable[[np.ndarray], np.ndarray], kept: np.ndarray | bool = True) -> pa.ListArray:
    """``nested`` with other elements; what is unknown stays so, elements where ``kept``."""
    rows, inner = _opened(nested)
    cells, held = _opened(inner)
    unknown = lambda x: x.is_null() if x.null_count else None
    made = work(held.to_numpy(zero_copy_only=False))
    made = pa.array(made, held.type, mask=held.is_null().to_numpy(zero_copy_only=False) & kept, from_pandas=False)
    lists = pa.ListArray.from_arrays(pa.array(cells, pa.int32()), made, mask=unknown(inner))
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), lists, mask=unknown(nested))


def _drawn(state: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """``draw`` of many samples at once."""
    low = _WORD - 1
    x = (state + counter * 2654435769) & low
    x = (x * 747796405 + 2891336453) & low
    x = ((x ^ (x >> 16)) * 668265263) & low
    return ((x ^ (x >> 15)) + 1) / float(_WORD)


def add_noise(seqs: DataFrame, std: float = 0.02, seed: int = 42) -> DataFrame:
    """Gaussian noise on every element, a function of seed, key and place.

    The elements of an Arrow batch are drawn together: as lambdas over the arrays they would be interpreted one by one.
    """
    if std <= 0:
        return seqs

    @F.arrow_udf("array<array<float>>")
    def noisy(nested: pa.Array, state: pa.Array) -> pa.Array:
        sample, step, width, channel = _elements(nested)
        place = (step * width + channel).astype(np.int64) * 2
        own = state.to_numpy()[sample]
        bell = np.sqrt(-2 * np.log(_drawn(own, place))) * np.cos(2 * math.pi * _drawn(own, place + 1))
        return _refilled(nested, lambda x: (x + std * bell).astype(np.float32))

    floats = F.col("sequence").cast("array<array<float>>")
    return seqs.withColumn("sequence", noisy(floats, sample_state(seed, "noise")))


def mask_features(seqs: DataFrame, prob: float = 0.05, seed: int = 42) -> DataFrame:
    """Zero whole feature channels of a sample with probability ``prob``."""
    if prob <= 0:
        return seqs

    # Whether a channel stays is drawn once for the sample, not for every step.
    @F.arrow_udf(seqs.schema["sequence"].dataType)
    def masked(nested: pa.Array, state: pa.Array) -> pa.Array:
        sample, step, width, channel = _elements(nested)
        drawn = np.zeros(len(nested), np.int64)  # channels are those of a sample's first step
        drawn[sample[step == 0]] = width[step == 0]
        stays = (channel < drawn[sample]) & (_drawn(state.to_numpy()[sample], channel.astype(np.int64)) > prob)
        return _refilled(nested, lambda x: np.where(stays, x, x.dtype.type(0)), stays)

    return seqs.withColumn("sequence", masked("sequence", sample_state(seed, "mask")))


def with_batches(rows: DataFrame, batch_size: int = 64, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """``batch_id`` of ``batch_size`` rows each, in (Date, Symbol) order.

    ``shuffle`` takes the rows in the order of a seeded hash instead.
    """
    ranked = rows
    if shuffle:
        ranked = ranked.withColumn("_h", F.xxhash64(F.lit(seed), F.col(KEY), F.col(TIME)))
        ranked = with_rank(ranked, F.shiftright("_h", 48), ["_h", KEY, TIME], name="_rank")
    else:
        ranked = with_rank(ranked, name="_rank")
    return ranked.select(*rows.columns, F.floor(F.col("_rank") / batch_size).alias("batch_id"))
