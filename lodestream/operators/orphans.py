"""References to records that don't exist at the moment of the reference.

Keys become integers in the order in which they stand, within hash partitions; for each range
of 65,536 of them and each day a compressed bitmap tells which keys are referenced, and two
more which keys of the parent table change on that day and which change an odd number of
times. The running XOR of the latter is the set of keys that exist as the day begins.
Referenced AND NOT (existing throughout) leaves the suspects: those that exist at no moment
of the day are orphans, and only the few that come or go within the day need the exact lookup
by time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.asof import as_of
from lodestream.session import cut_lineage

DAY = 86_400_000_000
#: Days that stand in one integer while the rows of a key are brought together.
BLOCK = 64
#: Keys of one range, and keys up to which a set is kept as a list.
RANGE, SPARSE = 1 << 16, 1 << 12


class Bitmap:
    """A set of numbers below RANGE: a sorted list while it is small (two bytes each), else a bit for each number."""

    __slots__ = ("values",)

    def __init__(self, values: np.ndarray):
        if values.dtype == np.uint8:
            self.values = values if int(np.bitwise_count(values).sum()) > SPARSE else np.flatnonzero(np.unpackbits(values, bitorder="little")).astype(np.uint16)
        else:
            self.values = values.astype(np.uint16) if len(values) <= SPARSE else Bitmap.bits_of(values)

    @staticmethod
    def bits_of(values: np.ndarray) -> np.ndarray:
        if values.dtype == np.uint8:
            return values
        flags = np.zeros(RANGE, bool)
        flags[values] = True
        return np.packbits(flags, bitorder="little")

    def numbers(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.values, bitorder="little")) if self.values.dtype == np.uint8 else self.values.astype(np.int64)

    def _with(self, other: Bitmap, lists, bits) -> Bitmap:
        if self.values.dtype == other.values.dtype == np.uint16:
            return Bitmap(lists(self.values, other.values).astype(np.uint32))
        return Bitmap(bits(Bitmap.bits_of(self.values), Bitmap.bits_of(other.values)))

    def and_not(self, other: Bitmap) -> Bitmap:
        if self.values.dtype == np.uint16 and other.values.dtype == np.uint8:
            own = self.values
            return Bitmap(own[other.values[own >> 3] >> (own & 7) & 1 == 0].astype(np.uint32))
        return self._with(other, lambda a, b: np.setdiff1d(a, b, assume_unique=True), lambda a, b: a & ~b)

    def either(self, other: Bitmap) -> Bitmap:
        return self._with(other, np.union1d, np.bitwise_or)

    def one_of(self, other: Bitmap) -> Bitmap:
        return self._with(other, lambda a, b: np.setxor1d(a, b, assume_unique=True), np.bitwise_xor)


def suspects_of_range(code: np.ndarray, block: np.ndarray, sets: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, day, sure) of one range of keys, from rows (code, block of days, a bit per day in each of asked, moved, odd)."""
    maps: dict[int, dict[str, Bitmap]] = {}
    for name, bits in sets.items():
        some = np.flatnonzero(bits)
        row, bit = np.nonzero(np.unpackbits(bits[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        day, own = block[some][row] * BLOCK + bit, code[some][row]
        order = np.lexsort((own, day))
        day, own = day[order], own[order]
        for d, members in zip(*np.unique(day, return_index=True), strict=True) if len(day) else ():
            stop = np.searchsorted(day, d, "right")
            maps.setdefault(int(d), {})[name] = Bitmap(own[members:stop].astype(np.uint32))
    none = Bitmap(np.zeros(0, np.uint32))
    exists, found = none, []
    for day in sorted(maps):
        asked, moved, odd = (maps[day].get(n, none) for n in ("asked", "moved", "odd"))
        left = asked.and_not(exists.and_not(moved))
        unsure = left.and_not(left.and_not(exists.either(moved)))
        codes = left.numbers()
        if len(codes):
            found.append((codes, np.full(len(codes), day), ~np.isin(codes, unsure.numbers())))
        exists = exists.one_of(odd)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def unaccounted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, day, sure) from rows (key, block, asked, moved, odd) that are ordered by key and block.

    Keys get their numbers as they come; only one range's keys and bits are held at a time.
    """
    names, codes, rest = [], [], []  # the range's dictionary and rows

    def flush() -> pa.RecordBatch:
        whole = pa.Table.from_batches(rest)
        columns = {n: whole.column(n).to_numpy() for n in ("block", "asked", "moved", "odd")}
        code, day, sure = suspects_of_range(np.concatenate(codes), columns.pop("block").astype(np.int64), columns)
        keys = pa.concat_arrays(names).take(pa.array(code))
        return pa.RecordBatch.from_arrays([keys, pa.array(day.astype(np.int32)), pa.array(sure)], names=["key", "day", "sure"])

    last, known = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column("key").dictionary_encode()  # keys stand together, so that they get numbers in their order
        number, keys = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        goes_on = keys[0].as_py() == last
        first = known - 1 if goes_on else known
        begin = 0
        while begin < batch.num_rows:
            room = RANGE - first  # numbers from 0 to room - 1 belong to this range
            stop = int(np.searchsorted(number, room, "left"))
            if stop > begin:
                low, high = int(number[begin]), int(number[stop - 1])
                fresh = low + (goes_on and low == 0)
                names.append(keys.slice(fresh, high + 1 - fresh))
                codes.append(number[begin:stop] + first)
                rest.append(batch.slice(begin, stop - begin))
            if stop < batch.num_rows:
                yield flush()
                names, codes, rest = [], [], []
                first = -int(number[stop])
            begin = stop
        known, last = int(number[-1]) + first + 1, keys[-1].as_py()
    if rest:
        yield flush()


def suspects(references: DataFrame, flips: DataFrame) -> DataFrame:
    """Rows (key, day, sure): keys referenced on a day on which they don't exist throughout.

    references: (key, day). flips: (key, at): microseconds at which a key begins or ceases to
    exist, alternately, beginning with the former. sure: it exists at no moment of the day.
    A key's days are brought together as bits before anything is shuffled, so that a key that
    is referenced very often is one row for every 64 days.
    """
    bit = F.expr(f"shiftleft(1L, cast(pmod(day, {BLOCK}) as int))")
    zero = F.lit(0).cast("bigint")
    asked = references.filter("key is not null and day is not null").select("key", "day", bit.alias("asked"), zero.alias("moved"), zero.alias("odd"))
    moved = flips.select("key", F.floor(F.col("at") / DAY).cast("int").alias("day")).select("key", "day", zero.alias("asked"), bit.alias("moved"), bit.alias("odd"))
    rows = asked.unionByName(moved).groupBy("key", F.expr(f"cast(floor(day / {BLOCK}) as int)").alias("block"))
    rows = rows.agg(F.bit_or("asked").alias("asked"), F.bit_or("moved").alias("moved"), F.bit_xor("odd").alias("odd"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "block")

    return ordered.mapInArrow(unaccounted, "key string, day int, sure boolean")


def orphan_references(references: DataFrame, versions: DataFrame, *, exists: str, slice_seconds: int = 86_400, max_group: int = 200_000) -> DataFrame:
    """The reference rows whose key names no record that exists at that moment.

    references: (key, at, ...) with `at` in microseconds; rows with a null key or time refer
    to nothing and don't come out. versions: as from current_state_versions; exists: an SQL
    condition on a column `state`. All columns of references come out, repeated rows too.
    """
    alive = lambda c: F.col(c).isNotNull() & F.coalesce(F.expr(exists.replace("state.", f"{c}.")), F.lit(False))
    flips = versions.withColumn("alive", alive("state")).filter(F.col("alive") != alive("previous")).select("key", "slice", "at", F.struct("alive").alias("state"))
    flips = cut_lineage(flips, "flips")
    # the other columns travel under names of their own, so that none can clash
    passed = [c for c in references.columns if c not in ("key", "at")]
    inner = ["key", "at", *[f"e{i}" for i in range(len(passed))]]
    rows = references.select("key", "at", *[F.col(f"`{c}`").alias(f"e{i}") for i, c in enumerate(passed)])
    rows = rows.filter("key is not null and at is not null").withColumn("day", F.floor(F.col("at") / DAY).cast("int"))
    left = cut_lineage(rows.join(suspects(rows.select("key", "day"), flips), ["key", "day"]), "suspects")
    unsure = as_of(left.filter("not sure").select(*inner), flips, slice_seconds=slice_seconds, max_group=max_group)
    found = left.filter("sure").select(*inner).unionByName(unsure.filter("state is null or not state.alive").select(*inner))
    back = {"key": "key", "at": "at"} | {c: f"e{i}" for i, c in enumerate(passed)}
    return found.select(*[F.col(back[c]).alias(c) for c in references.columns])
