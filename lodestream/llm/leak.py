"""Evaluation passages inside training documents.

Size-partitioned MinHash containment search. Documents are cut into pieces, pieces are
partitioned by size, and each size class has a sketch size: the pieces keep their least
hashes of q letters in a row (bottom-k MinHash), so many that a passage at the limit of the
definition leaves at least three of its shingles in the sketch, up to a stated chance of a miss.
The items keep all their shingles with their places, so that shingles which agree lie on a
diagonal; a diagonal with three of them is a candidate, verified by exact shingle containment
and then letter by letter.

The documents are read once, whatever the number of items. An index of the items up to a
stated size travels to the documents; a larger one meets their sketches in a shuffled join on
the hash.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestream.llm.texts import TAG, code_points, portions
from lodestream.session import cut_lineage

SIGN = re.compile(r"[\W_]+")
#: Agreeing shingles that make a diagonal a candidate.
HITS = 3
#: Ratio of the sizes of neighbouring size classes.
CLASS = 2**0.25
#: Letters that are searched at a time.
TOGETHER = 1 << 18
SHINGLES = "q int, hash bigint, item bigint, place int, always boolean"


def letters(text: str | None) -> str:
    """Only letters, digits and ideographs, in lower case and plain width, 臺 as 台, without markup."""
    if not text:
        return ""
    bare = html.unescape(TAG.sub("", text)) if "<" in text or "&" in text else text
    return SIGN.sub("", unicodedata.normalize("NFKC", bare).lower().replace("臺", "台"))


def shingles(codes: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each of the ascending sizes, a 64-bit hash of every so many letters in a row; a longer one continues a shorter."""
    out, h, done = {}, np.zeros(len(codes), np.uint64), 0
    for q in sizes:
        n = max(0, len(codes) - q + 1)
        with np.errstate(over="ignore"):
            h = h[:n].copy()
            for j in range(done, q if n else done):
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += codes[j : j + n]
                h += np.uint64(1)
            x = h ^ (h >> np.uint64(30))
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(27)
            x *= np.uint64(0x94D049BB133111EB)
            out[q] = x ^ (x >> np.uint64(31))
        done = q
    return out


@cache
def surviving(least: int, share: int, q: int) -> int:
    """Shingles of a passage that are left at least, if at most one letter in `share` is replaced.

    A passage of twice the least length or more holds a shorter one that qualifies (one of its
    halves), so lengths up to that are looked at.
    """
    return min(n - n // share - (n // share + 1) * (q - 1) for n in range(least, 2 * least))


def shingle_size(least: int, share: int, survivors: int) -> int:
    """The longest shingles of which so many survive: the longer, the fewer agree by chance."""
    return max((q for q in range(1, least) if surviving(least, share, q) >= survivors), default=1)


def sampling_share(survivors: int, miss: float) -> float:
    """Share of a piece's shingles in its sketch, so that fewer than HITS of the survivors are in it with probability `miss`."""
    low, high = 0.0, 1.0
    for _ in range(50):
        p = (low + high) / 2
        tail = sum(comb(survivors, k) * p**k * (1 - p) ** (survivors - k) for k in range(HITS))
        low, high = (p, high) if tail > miss else (low, p)
    return high


def sketch_sizes(distinct: np.ndarray, share: float) -> np.ndarray:
    """How many hashes pieces with so many different ones keep: their size class's number."""
    return np.ceil(share * CLASS ** np.ceil(np.log(np.maximum(1, distinct)) / log(CLASS) - 1e-9)).astype(np.int64)


def sketches(hashes: np.ndarray, piece: np.ndarray, share: float) -> np.ndarray:
    """Which shingles are in their piece's sketch: those whose hash is one of the least. piece: numbers, ascending."""
    order = np.lexsort((hashes, piece))
    ordered, own = hashes[order], piece[order]
    begins = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
    new = begins.copy()
    new[1:] |= ordered[1:] != ordered[:-1]
    rank = np.cumsum(new)
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(own))[: len(first)] - 1
    kept = sketch_sizes(rank[last] - rank[first] + 1, share)
    out = np.zeros(len(hashes), bool)
    out[order] = rank - np.repeat(rank[first], last + 1 - first) < np.repeat(kept, last + 1 - first)
    return out


def repetitive(hashes: np.ndarray, width: int) -> np.ndarray:
    """Which shingles lie within `width` of an equal one: passages with them leave fewer distinct ones in a sketch."""
    order = np.lexsort((np.arange(len(hashes)), hashes))
    near = (hashes[order][1:] == hashes[order][:-1]) & (np.diff(order) < width)
    out, twice = np.zeros(len(hashes) + 1, np.int64), order[1:][near]
    np.add.at(out, np.maximum(0, twice - width), 1)
    np.add.at(out, np.minimum(len(hashes), twice + width), -1)
    return np.cumsum(out)[:-1] > 0


def holds_stretch(document: np.ndarray, item: np.ndarray, least: int, share: int) -> bool:
    """Whether the two, laid side by side, agree on a stretch of at least `least` letters but for one in `share`."""
    n = len(document)
    if n < least:
        return False
    wrong = np.concatenate([[0], np.cumsum(document != item)])
    f = np.arange(n + 1) - share * wrong
    lowest = np.minimum.accumulate(f)
    return bool((f[least:] >= lowest[: n + 1 - least]).any())


def verified(piece: np.ndarray, item: np.ndarray, diagonal: int, least: int, share: int, q: int) -> bool:
    """Whether the item, laid beside the piece from place `diagonal` on, has a stretch in it."""
    a, b = max(0, diagonal), min(len(piece), len(item) + diagonal)
    if b - a < least:
        return False
    here, there = piece[a:b], item[a - diagonal : b - diagonal]
    wrong = np.zeros(b - a + 1, np.int64)
    np.cumsum(here != there, out=wrong[1:])
    if np.count_nonzero(wrong[q:] == wrong[:-q]) < surviving(least, share, q):  # exact shingle containment
        return False
    return holds_stretch(here, there, least, share)


def pieces(codes: np.ndarray, size: int, overlap: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, piece) of a document; a passage up to `overlap` long lies whole in one of them."""
    for start in range(0, max(1, len(codes) - overlap), size - overlap):
        yield start, codes[start : start + size]


class Index:
    """The items' shingles with their places, looked up by hash."""

    def __init__(self, table: pa.Table, items: dict[int, tuple]):
        q, hashes, item, place, always = (table.column(c).to_numpy() for c in ("q", "hash", "item", "place", "always"))
        own, item = np.unique(item, return_inverse=True)
        self.items, self.by_size = [items[i] for i in own.tolist()], {}
        for size in np.unique(q).tolist():
            own = np.flatnonzero(q == size)
            own = own[np.argsort(hashes[own].view(np.uint64), kind="stable")]
            known, first = np.unique(hashes[own].view(np.uint64), return_index=True)
            self.by_size[size] = known, np.append(first, len(own)), item[own], place[own].astype(np.int64), np.logical_or.reduceat(always[own], first)

    def candidates(self, several: Sequence[np.ndarray], share: float) -> list[tuple[int, int, int]]:
        """(number of the piece, item, diagonal) on which HITS shingles of the piece's sketch agree."""
        sizes = np.fromiter(map(len, several), np.int64, len(several))
        codes, first = np.concatenate([*several, np.zeros(0, np.uint32)]).astype(np.uint32), np.cumsum(sizes) - sizes
        piece = np.repeat(np.arange(len(several)), sizes)
        found: list[tuple[int, int, int]] = []
        for q, hashes in shingles(codes, list(self.by_size)).items():
            known, bounds, item, place, always = self.by_size[q]
            inside = np.flatnonzero(piece[: len(hashes)] == piece[q - 1 :]) if len(hashes) else np.zeros(0, np.int64)
            if not len(inside):
                continue
            hashes = hashes[inside]
            slot = np.searchsorted(known, hashes)
            slot[slot == len(known)] = 0
            at = np.flatnonzero(known[slot] == hashes)
            own = piece[inside]
            some = np.bincount(own[at], minlength=len(several)) >= HITS  # only their sketches matter
            among = np.flatnonzero(some[own])
            if not len(among):
                continue
            chosen = np.zeros(len(hashes), bool)
            chosen[among] = sketches(hashes[among], own[among], share)
            at = at[chosen[at] | always[slot[at]]]
            slot, at = slot[at], inside[at]
            times = bounds[slot + 1] - bounds[slot]
            which = np.repeat(bounds[slot] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            at = np.repeat(at, times)
            middle = int(place.max()) + 1
            span = middle + int(sizes.max()) + 1
            key, n = np.unique((piece[at] * len(self.items) + item[which]) * span + (at - first[piece[at]] - place[which] + middle), return_counts=True)
            key = key[n >= HITS]
            pair, diagonal = key // span, key % span - middle
            found += zip((pair // len(self.items)).tolist(), (pair % len(self.items)).tolist(), diagonal.tolist(), strict=True)
        return found


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str,
    text: str,
    item_id: str,
    item_text: str,
    least: F.Column,
    share: int = 12,
    survivors: int = 18,
    miss: float = 1e-3,
    piece: int = 4096,
    index_bound: int = 1_000_000,
) -> DataFrame:
    """Rows (doc_id, item_id): the document holds a stretch of the item.

    A stretch is of at least `least` letters, digits and ideographs in a row (a column of
    items), at most one in `share` of them replaced by another; other signs, markup, case,
    width and 臺/台 don't matter. Texts are read whole; documents longer than `piece` letters
    are searched piece by piece, pieces overlapping by more than twice the least length: a
    passage that is longer than the overlap holds a shorter one that qualifies. miss: the
    chance that the sketch misses a passage at the very limit of the definition; shingles of
    passages that repeat themselves are looked up whether they are in a sketch or not. Null
    and blank texts hold nothing, items shorter than `least` are in no document; repeated rows
    give one. index_bound: shingles of items up to which their index is broadcast (about 30
    bytes each); a larger index is joined by a shuffle, with the same result.
    """
    spark = documents.sparkSession
    arrow_item = to_arrow_type(items.schema[item_id].dataType)
    doc_type, item_type = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").rlike(r"(?U)\S"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, body, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folded = letters(body)
                if 0 < n <= len(folded):
                    q = shingle_size(n, share, survivors)
                    yield pa.RecordBatch.from_arrays([pa.array([own], batch.schema.field(0).type), pa.array([folded]), *(pa.array([x], pa.int32()) for x in (n, q))], names=["item_id", "letters", "least", "q"])

    wanted = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"), least.cast("int").alias("least")).filter("item_id is not null and text is not null and least is not null").distinct()
    wanted = cut_lineage(wanted.mapInArrow(prepare, f"item_id {item_type}, letters string, least int, q int").withColumn("item", F.monotonically_increasing_id()), "test-items")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, folded, n, q in zip(*(batch.column(c).to_pylist() for c in ("item", "letters", "least", "q")), strict=True):
                hashes = shingles(code_points(folded), [q])[q]
                rows = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, q, np.int32)), pa.array(hashes.view(np.int64)), pa.array(np.full(rows, own, np.int64)), pa.array(np.arange(rows, dtype=np.int32)), pa.array(repetitive(hashes, 2 * n))],
                    names=["q", "hash", "item", "place", "always"],
                )

    index = cut_lineage(wanted.select("item", "letters", "least", "q").mapInArrow(spread, SHINGLES), "test-shingles")
    kinds = [(r.q, r.least) for r in wanted.select("q", "least").distinct().collect()]  # one row per kind of item
    sizes = sorted({q for q, _ in kinds})
    sampled = sampling_share(min((surviving(n, share, q) for q, n in kinds), default=survivors), miss)
    overlap = max((2 * n + q for q, n in kinds), default=1)
    size = max(piece, 4 * overlap)
    few = index.limit(index_bound + 1).count() <= index_bound

    if few:
        table = index.toArrow()
        names = spark.sparkContext.broadcast((table, {r.item: (r.item_id, r.least, r.q, code_points(r.letters)) for r in wanted.collect()}))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Index(*names.value)
            for batch in batches:
                docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for begin, end in portions(texts, TOGETHER):
                    holder, several = [], []
                    for doc, body in zip(docs[begin:end], texts[begin:end], strict=True):
                        for _, codes in pieces(code_points(letters(body)), size, overlap):
                            holder.append(doc)
                            several.append(codes)
                    hits = {}
                    for no, own, diagonal in known.candidates(several, sampled):
                        name, n, q, item = known.items[own]
                        if (holder[no], name) not in hits and verified(several[no], item, diagonal, n, share, q):
                            hits[holder[no], name] = True
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in hits], batch.schema.field(0).type), pa.array([i for _, i in hits], arrow_item)], names=["doc_id", "item_id"])

        return source.mapInArrow(search, f"doc_id {doc_type}, item_id {item_type}").distinct()

    always = index.filter("always").select("q", "hash").distinct()
    repeated = [(r.q, r.hash) for r in always.limit(index_bound + 1).collect()]
    every = len(repeated) > index_bound  # then all shingles are looked up
    kept = spark.sparkContext.broadcast({q: np.sort(np.array([h for k, h in repeated if k == q], np.int64).view(np.uint64)) for q in sizes})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for start, codes in pieces(code_points(letters(body)), size, overlap):
                    yield pa.RecordBatch.from_arrays([pa.array([doc], batch.schema.field(0).type), pa.array([start], pa.int64()), pa.array([codes.tobytes().decode("utf-32-le", "surrogatepass")])], names=["doc_id", "start", "piece"])

    cut_pieces = source.mapInArrow(cut, f"doc_id {doc_type}, start bigint, piece string").distinct()
    cut_pieces = cut_lineage(cut_pieces.withColumn("no", F.monotonically_increasing_id()), "pieces")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for q, hashes in shingles(code_points(body), sizes).items():
                    at = np.arange(len(hashes)) if every else np.flatnonzero(sketches(hashes, np.zeros(len(hashes), np.int64), sampled) | np.isin(hashes, kept.value[q]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), no, np.int64)), pa.array(np.full(len(at), q, np.int32)), pa.array(hashes[at].view(np.int64)), pa.array(at.astype(np.int32))], names=["no", "q", "hash", "at"])

    met = cut_pieces.select("no", "piece").mapInArrow(sketched, "no bigint, q int, hash bigint, at int").join(index, ["q", "hash"])
    diagonals = met.groupBy("no", "item", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HITS)
    pairs = diagonals.join(cut_pieces, "no").join(wanted, "item").select("doc_id", "item_id", "piece", "letters", "diagonal", "least", "q")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("piece", "letters", "diagonal", "least", "q")), strict=True)
            good = [verified(code_points(a), code_points(b), d, n, share, q) for a, b, d, n, q in rows]
            yield batch.select(["doc_id", "item_id"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(check, f"doc_id {doc_type}, item_id {item_type}").distinct()
