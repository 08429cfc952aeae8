"""Mixing sources to target weights by balanced sampling (the cube method).

Every document of a source is to be used e times on average: its source's target tokens over
the tokens it has. Each is used floor(e) times, and once more with the fraction as inclusion
probability. The flight phase takes three undecided documents at a time and moves their
probabilities along the null space of the two constraints (tokens, documents), so that both
totals stay as they are, until one of the three is decided. It runs in each partition on its
own and then over the two documents per source that each partition leaves; the last two of a
source are the landing problem, where the rounding that misses the totals least is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.session import bounded_rows, cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that goes with the vocabulary and splits text before merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EPS = 1e-9
UNIT = "doc_id {id}, source string, tokens bigint, whole int, pick int, chance double"


def token_counts(documents: DataFrame, *, doc_id: str, text: str, keep: dict[str, F.Column], vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, keep..., tokens): tokens of each text under a public tokenizer; null texts have none."""
    source = documents.select(F.col(doc_id).alias("doc_id"), *[c.alias(n) for n, c in keep.items()], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    fields = source.drop("__text").schema
    names = [*fields.names, "tokens"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            n = pa.array([len(encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=names)

    return source.mapInArrow(count, fields.add("tokens", "long"))


_encoders: dict = {}


def encoder(vocabulary: str):
    """The tokenizer of a rank file, made once per process."""
    if vocabulary not in _encoders:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[vocabulary] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def draw(seed: int, key: object, step: int) -> float:
    """A number in [0, 1) of the unit alone."""
    import xxhash

    return xxhash.xxh64_intdigest(f"{key}:{step}", seed=seed) / 2.0**64


class Flight:
    """Undecided units of one source, never more than two between calls."""

    def __init__(self, seed: int):
        self.seed, self.pool, self.steps = seed, [], 0

    def add(self, unit: tuple, tokens: int, chance: float) -> list[tuple]:
        """Takes a unit in; returns the units that got decided, each with 0 or 1."""
        self.pool.append([unit, tokens, chance])
        decided = []
        while len(self.pool) > 2:
            self._move(unit)
            decided += [(u, int(p > 0.5)) for u, _, p in self.pool if p <= EPS or p >= 1 - EPS]
            self.pool = [x for x in self.pool if EPS < x[2] < 1 - EPS]
        return decided

    def _move(self, key: tuple) -> None:
        a, b, c = (float(x[1]) for x in self.pool[:3])
        along = np.array([b - c, c - a, a - b]) if not a == b == c else np.array([1.0, -1.0, 0.0])
        p = np.array([x[2] for x in self.pool[:3]])
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(along > 0, (1 - p) / along, np.where(along < 0, -p / along, np.inf)).min()
            down = np.where(along > 0, p / along, np.where(along < 0, (p - 1) / along, np.inf)).min()
        self.steps += 1
        forward = draw(self.seed, key[0], self.steps) * (up + down) < down
        for x, q in zip(self.pool[:3], p + (up if forward else -down) * along, strict=True):
            x[2] = float(q)

    def land(self) -> list[tuple]:
        """Decides what is left, missing the expected tokens, then the expected number, least."""
        best = None
        expected = sum(t * p for _, t, p in self.pool)
        number = sum(p for _, _, p in self.pool)
        for choice in range(1 << len(self.pool)):
            bits = [choice >> i & 1 for i in range(len(self.pool))]
            miss = (abs(sum(t * b for (_, t, _), b in zip(self.pool, bits, strict=True)) - expected), abs(sum(bits) - number))
            if best is None or miss < best[0]:
                best = (miss, bits)
        return [(u, b) for (u, _, _), b in zip(self.pool, best[1], strict=True)]


def plan(targets: list[tuple[str, float, int]], available: dict[str, int], total_tokens: float | None = None) -> tuple[float, dict[str, float]]:
    """The total, and how often a document of each source is used on average.

    Shares are taken relative to the sources that have tokens. Without total_tokens the
    total is the largest at which all of them reach their share; with it, a source that
    would need more than its repeats allow is used max_repeats times throughout.
    """
    usable = [(s, share, cap) for s, share, cap in targets if available.get(s, 0) > 0 and share > 0 and cap > 0]
    weight = sum(share for _, share, _ in usable)
    if not usable:
        return 0.0, {}
    if total_tokens is None:
        total_tokens = min(cap * available[s] * weight / share for s, share, cap in usable)
    return float(total_tokens), {s: min(float(cap), total_tokens * share / weight / available[s]) for s, share, cap in usable}


def mix_sources(
    documents: DataFrame, targets: DataFrame, *, doc_id: str, text: str, source: str, total_tokens: float | None = None, seed: int = 1, vocabulary: str = VOCABULARY, max_targets: int = 10_000
) -> DataFrame:
    """Rows (doc_id, source, tokens, copies): how often each document is used, those used at least once.

    Sources are compared without case and outer blanks. targets: (source, target_share,
    max_repeats). A document counts once however often its row is repeated (under the first
    of its sources); documents without tokens, source or target are not used. Every
    source's tokens and documents are met up to the rounding of at most two documents.
    """
    name = F.lower(F.trim(F.col(source)))
    wanted = bounded_rows(targets.groupBy(name.alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).filter("source is not null"), max_targets, "the list of targets")
    wanted = [(r.source, float(r.share or 0), int(r.cap or 0)) for r in wanted]
    counted = token_counts(documents, doc_id=doc_id, text=text, keep={"source": name}, vocabulary=vocabulary)
    units = counted.filter("source is not null and tokens > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("u"))
    units = units.select("doc_id", "u.*").filter(F.col("source").isin([s for s, _, _ in wanted])).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    units = cut_lineage(units, "units")
    available = {r.source: r.tokens for r in units.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    _, uses = plan(wanted, available, total_tokens)
    id_type = documents.schema[doc_id].dataType.simpleString()
    schema = UNIT.format(id=id_type)
    arrow = pa.schema([("source", pa.string()), ("tokens", pa.int64()), ("whole", pa.int32()), ("pick", pa.int32()), ("chance", pa.float64())])

    def table(rows: list[tuple], type_of_id: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(columns[0], type_of_id), *(pa.array(c, f.type) for c, f in zip(columns[1:], arrow, strict=True))], names=["doc_id", *arrow.names])

    def fly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flights: dict[str, Flight] = {}
        id_of = pa.int64()
        for batch in batches:
            id_of, out = batch.schema.field(0).type, []
            for doc, name, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole, chance = divmod(uses.get(name, 0.0), 1.0)
                if chance <= EPS or chance >= 1 - EPS:
                    out.append((doc, name, tokens, int(whole), int(chance > 0.5), None))
                else:
                    flight = flights.setdefault(name, Flight(seed))
                    out += [(*unit, pick, None) for unit, pick in flight.add((doc, name, tokens, int(whole)), tokens, chance)]
            yield table(out, id_of)
        yield table([(*unit, None, chance) for f in flights.values() for unit, _, chance in f.pool], id_of)

    flown = cut_lineage(units.mapInArrow(fly, schema), "flown")

    def finish(group: pa.Table) -> pa.Table:
        flight, out = Flight(seed + 1), []
        for doc, name, tokens, whole, _, chance in sorted(zip(*(c.to_pylist() for c in group.columns), strict=True)):
            out += flight.add((doc, name, tokens, whole), tokens, chance)
        out += flight.land()
        return pa.Table.from_batches([table([(*unit, pick, None) for unit, pick in out], group.schema.field(0).type)])

    landed = flown.filter("pick is null").groupBy("source").applyInArrow(finish, schema)
    decided = flown.filter("pick is not null").unionByName(landed)
    return decided.select("doc_id", "source", "tokens", (F.col("whole") + F.col("pick")).alias("copies")).filter("copies > 0")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: its share, and the documents, copies, tokens and share that were reached."""
    name = F.lower(F.trim(F.col("source")))
    used = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_repeats"))
    wanted = targets.groupBy(name.alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    # one row per target, so that a window over all of them is small
    reached = wanted.join(used, "source", "left").withColumn("total", F.sum("tokens").over(Window.partitionBy()))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "copies", "tokens", "most_repeats")]
    return reached.select("source", "target_share", "max_repeats", *filled, F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"))
