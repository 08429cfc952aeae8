"""Items that appear together: support of every pair, and how far it exceeds chance.

Heavy-light decomposition. Frequent items are rows of a bit matrix, pairs of them are counted
by AND and popcount. Rare items have short lists, pairs of them are counted by hashing. A
mixed pair is counted by probing the matrix at the places of the rare item's list.

Baskets come in blocks, by owner (company), so that a block can also count in how many
owners' baskets a pair occurs. Only owners that have more than one block can hold, or a
basket that has to be split, are carried along with their pairs by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import bounded_rows, broadcast_if_small, cut_lineage

WORD = 64
#: What hashing one pair costs, in words of 64 bits that are ANDed and counted: measured.
HASHED = 150
#: Bytes of matrix rows that are probed at a time.
PROBED = 1 << 24


def distinct_baskets(df: DataFrame, *, basket: str, owner: str, items: str) -> DataFrame:
    """One row (basket, owners, items) per basket: all its deliveries' items and owners, once each.

    Baskets without items stay, with an empty array; rows with a null basket don't. Sets are
    formed before the shuffle, so that a basket delivered very often is no hot key.
    """
    wanted = F.filter(F.col(f"`{items}`"), lambda x: x.isNotNull() & (F.trim(x) != ""))
    rows = df.filter(F.col(f"`{basket}`").isNotNull()).select(F.col(f"`{basket}`").alias("basket"), F.col(f"`{owner}`").alias("owner"), F.explode_outer(wanted).alias("item"))
    return rows.groupBy("basket").agg(F.sort_array(F.collect_set("owner")).alias("owners"), F.collect_set("item").alias("items"))


class Places:
    """Where baskets stand in the bit matrix.

    A basket of nobody and one that is its owner's only one take a bit each; an owner with
    up to 64 baskets a field of 2, 4, ... or 64 bits; an owner with more, and one carried by
    name, words of its own. So whether an owner has any basket in a set of bits is seen by a
    few shifts of whole words, and the matrix is at most twice as wide as there are baskets.
    """

    def __init__(self, owner: np.ndarray, named: np.ndarray):
        order = np.argsort(owner, kind="stable")
        own = owner[order]
        begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        size = np.diff(np.append(begins, len(own)))
        if len(own) and own[0] < 0:  # those of nobody stand for themselves
            begins = np.concatenate([np.arange(size[0]), begins[1:]])
            size = np.concatenate([np.ones(size[0], np.int64), size[1:]])
        holder = own[begins]
        field = np.where(size <= 1, 1, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        field = np.where(field > WORD, -(-size // WORD) * WORD, field)
        kind = np.where(holder < 0, 0, np.where(field > WORD, 2 * WORD, field))
        if len(begins):
            by_name = named[order][begins] & (holder >= 0)
            field, kind = np.where(by_name, -(-size // WORD) * WORD, field), np.where(by_name, 4 * WORD, kind)
        start = np.zeros(len(begins), np.int64)
        self.regions: list[tuple[int, int, int]] = []  # kind, first word, last word
        self.starts: dict[int, np.ndarray] = {}  # first words of the owners in the regions of whole words
        self.holders: dict[int, np.ndarray] = {}
        at = 0
        for k in np.unique(kind).tolist():
            here = np.flatnonzero(kind == k)
            start[here] = at * WORD + np.cumsum(field[here]) - field[here]
            stop = at + int(-(-field[here].sum() // WORD))
            self.regions.append((k, at, stop))
            self.starts[k], self.holders[k] = start[here] // WORD - at, holder[here]
            at = stop
        self.words = at
        self.of = np.zeros(len(owner), np.int64)
        self.of[order] = np.repeat(start - begins, size) + np.arange(len(own))

    def owners(self, both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of words: how many counted owners have a bit; and (row, owner) of those carried by name."""
        count = np.zeros(len(both), np.int64)
        row = name = np.zeros(0, np.int64)
        for kind, first, last in self.regions:
            x = both[:, first:last]
            if kind == 1:
                count += np.bitwise_count(x).sum(axis=1, dtype=np.int64)
            elif 1 < kind <= WORD:
                shift = 1
                while shift < kind:
                    x = x | x >> np.uint64(shift)
                    shift *= 2
                lowest = np.uint64(sum(1 << i for i in range(0, WORD, kind)))
                count += np.bitwise_count(x & lowest).sum(axis=1, dtype=np.int64)
            elif kind > WORD:
                some = np.bitwise_or.reduceat(x, self.starts[kind], axis=1) != 0
                if kind == 2 * WORD:
                    count += some.sum(axis=1)
                else:
                    row, name = np.nonzero(some)
                    name = self.holders[kind][name]
        return count, row, name


def bit_rows(row: np.ndarray, place: np.ndarray, rows: int, words: int) -> np.ndarray:
    """A matrix of rows x words with a bit at every (row, place); the pairs are distinct."""
    out = np.zeros((rows, words), np.uint64)
    order = np.lexsort((place, row))
    key = row[order] * words + place[order] // WORD
    if len(key):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        bits = np.uint64(1) << (place[order] % WORD).astype(np.uint64)
        out.reshape(-1)[key[first]] = np.bitwise_or.reduceat(bits, first)
    return out


class Counted:
    """Pairs with their counts, as they are found; an owner of -1 is none."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, a: np.ndarray, b: np.ndarray, jobs: np.ndarray | int, owners: np.ndarray | int, owner: np.ndarray | int = -1) -> None:
        if len(a):
            full = lambda x: x if isinstance(x, np.ndarray) else np.full(len(a), x, np.int64)
            self.parts.append((np.minimum(a, b), np.maximum(a, b), full(jobs), full(owners), full(owner)))

    def columns(self) -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*self.parts, strict=True)] if self.parts else [np.zeros(0, np.int64)] * 5


def count_heavy(bits: np.ndarray, codes: np.ndarray, places: Places, here: np.ndarray | None, out: Counted) -> None:
    """Pairs of heavy items: rows of the matrix ANDed. here: the bits of the baskets that count as such."""
    for i in range(len(codes) - 1):
        both = bits[i] & bits[i + 1 :]
        jobs = np.bitwise_count(both if here is None else both & here).sum(axis=1, dtype=np.int64)
        owners, row, name = places.owners(both)
        some = np.flatnonzero((jobs > 0) | (owners > 0))
        out.add(np.full(len(some), codes[i]), codes[i + 1 + some], jobs[some], owners[some])
        out.add(np.full(len(row), codes[i]), codes[i + 1 + row], 0, 0, name)


def count_mixed(bits: np.ndarray, codes: np.ndarray, light: np.ndarray, row: np.ndarray, primary: np.ndarray, owner: np.ndarray, named: np.ndarray, out: Counted) -> None:
    """Pairs of a heavy and a rare item: the matrix, a row of heavy items per basket, probed at the places of the rare item's list."""
    order = np.lexsort((row, owner[row], light))
    light, row = light[order], row[order]
    step = max(1, PROBED // max(1, 8 * bits.shape[1] * WORD))
    begin = 0
    while begin < len(light):
        stop = min(begin + step, len(light))
        if stop < len(light):  # a list isn't cut
            stop = int(np.searchsorted(light, light[stop], "left"))
            stop = stop if stop > begin else int(np.searchsorted(light, light[begin], "right"))
        item, at = light[begin:stop], row[begin:stop]
        begin = stop
        probed = bits[at]
        lists = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        wide = lambda words: np.unpackbits(words.view(np.uint8), axis=1, bitorder="little", count=len(codes))
        jobs = np.add.reduceat(wide(np.where(primary[at, None], probed, np.uint64(0))), lists, axis=0, dtype=np.int64)
        # an owner's baskets in one list: any of them is enough
        own = owner[at]
        runs = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (own[1:] != own[:-1]) | (own[1:] < 0)]))
        anyone = np.bitwise_or.reduceat(probed, runs, axis=0)
        told = own[runs] >= 0
        by_name = told & named[at[runs]]
        counted = wide(np.where((told & ~by_name)[:, None], anyone, np.uint64(0)))
        owners = np.add.reduceat(counted, np.searchsorted(runs, lists), axis=0, dtype=np.int64)
        k, h = np.nonzero((jobs > 0) | (owners > 0))
        out.add(codes[h], item[lists][k], jobs[k, h], owners[k, h])
        which = np.flatnonzero(by_name)
        k, h = np.nonzero(wide(anyone[which]))
        out.add(codes[h], item[runs[which]][k], 0, 0, own[runs[which]][k])


def pairs_within(code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, row) of all pairs of items that stand in one row; row is ascending."""
    parts, d, a = [], 1, np.arange(len(code))
    while len(a := a[a + d < len(code)]) and len(a := a[row[a] == row[a + d]]):
        parts.append((code[a], code[a + d], row[a]))
        d += 1
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3


def count_hashed(a: np.ndarray, b: np.ndarray, row: np.ndarray, n: int, primary: np.ndarray, owner: np.ndarray, named: np.ndarray, out: Counted) -> None:
    """Pairs counted by their hash, here by their number."""
    pair = np.minimum(a, b) * n + np.maximum(a, b)
    distinct, jobs = np.unique(pair[primary[row]], return_counts=True)
    out.add(distinct // n, distinct % n, jobs, 0)
    for by_name in (False, True):
        told = (owner[row] >= 0) & (named[row] == by_name)
        m = int(owner.max(initial=0)) + 1
        each = np.unique(pair[told] * m + owner[row[told]])
        if by_name:
            out.add(each // m // n, each // m % n, 0, 0, each % m)
        else:
            distinct, owners = np.unique(each // m, return_counts=True)
            out.add(distinct // n, distinct % n, 0, owners)


def lists_of(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists and their values in a row; a null is an empty list."""
    whole = column.combine_chunks()
    return pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False).astype(np.int64), whole.flatten()


def count_block(table: pa.Table, heavy: pa.Array) -> pa.Table:
    """Pairs within one block of rows (owner, named, primary, items, others).

    owner: null for nobody. named: the owner is carried along with its pairs, not counted
    here. primary: the basket counts as one (it's a copy for a further owner otherwise).
    others: null, or a further part of a split basket: then pairs of an item and one of the
    others are meant, else all pairs of items.
    """
    named, primary = (table.column(c).to_numpy().astype(bool) for c in ("named", "primary"))
    owner_names = table.column("owner").combine_chunks().dictionary_encode()
    owner = pc.fill_null(owner_names.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes, items = lists_of(table.column("items"))
    other_sizes, others = lists_of(table.column("others"))
    coded = pa.concat_arrays([items, others]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    names = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))  # codes in the order of the names
    code = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    code, other = code[: len(items)], code[len(items) :]
    out = Counted()

    # baskets in one piece
    whole = other_sizes == 0
    seat = np.cumsum(whole) - 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    kept = whole[row]
    row_here, code_here = seat[row[kept]], code[kept]
    owner_here, named_here, primary_here = owner[whole], named[whole], primary[whole]
    is_heavy = pc.is_in(names, value_set=heavy).to_numpy(zero_copy_only=False) if len(names) else np.zeros(0, bool)
    heavy_codes = np.flatnonzero(is_heavy)
    slot = np.cumsum(is_heavy) - 1
    frequent = is_heavy[code_here]
    if len(heavy_codes):
        places = Places(owner_here, named_here)
        at, which = row_here[frequent], slot[code_here[frequent]]
        if len(heavy_codes) > 1:
            here = None if primary_here.all() else bit_rows(np.zeros(int(primary_here.sum()), np.int64), places.of[primary_here], 1, places.words)[0]
            count_heavy(bit_rows(which, places.of[at], len(heavy_codes), places.words), heavy_codes, places, here, out)
        if not frequent.all():
            by_basket = bit_rows(at, which, len(owner_here), -(-len(heavy_codes) // WORD))
            count_mixed(by_basket, heavy_codes, code_here[~frequent], row_here[~frequent], primary_here, owner_here, named_here, out)
    count_hashed(*pairs_within(code_here[~frequent], row_here[~frequent]), len(names), primary_here, owner_here, named_here, out)

    # parts of split baskets, each against another part
    if not whole.all():
        first, second = np.cumsum(sizes) - sizes, np.cumsum(other_sizes) - other_sizes
        for r in np.flatnonzero(~whole).tolist():
            x, y = code[first[r] : first[r] + sizes[r]], other[second[r] : second[r] + other_sizes[r]]
            count_hashed(np.repeat(x, len(y)), np.tile(y, len(x)), np.full(len(x) * len(y), r), len(names), primary, owner, named, out)

    a, b, jobs, owners, own = out.columns()
    pick = lambda values, index: values.take(pa.array(index, mask=index < 0))
    return pa.table({"a": pick(names, a), "b": pick(names, b), "jobs": jobs, "owners": owners, "owner": pick(owner_names.dictionary, own)})


def heavy_items(counts: DataFrame, total: int, max_heavy: int) -> list[str]:
    """Items whose row of the matrix costs less than hashing their pairs with more frequent ones.

    The h-th item's row is ANDed with those of the h before it, a word for every 64 baskets;
    hashing would meet it in n baskets, each time beside as many frequent items as a basket
    holds on average. Beyond max_heavy the rest counts as rare.
    """
    top = bounded_rows(counts.orderBy(F.desc("n"), "item").limit(max_heavy), max_heavy, "the heavy items")
    n = np.array([r.n for r in top], float)
    beside = np.concatenate([[0.0], np.cumsum(n)[:-1]]) / max(1, total)
    worth = np.flatnonzero(n * beside * HASHED >= np.arange(len(n)) * total / WORD)
    return [r.item for r in top[: int(worth[-1]) + 1]] if len(worth) > 1 else []


def pair_supports(
    df: DataFrame, *, basket: str, owner: str, items: str, min_support: int = 1, heavy: int | None = None, max_heavy: int = 2048, block_weight: int = 32_768, part: int = 512
) -> DataFrame:
    """Rows (source_id, target_id, support_jobs, support_companies, lift, npmi), source_id < target_id.

    df: one row per delivered basket, items an array of text. An item counts once per
    basket; null and blank items not at all; null owners are no owners; an owner counts for a
    pair if one of its baskets holds both items. lift = N n_xy / (n_x n_y) and npmi =
    ln(lift) / -ln(n_xy / N) (1 where every basket holds the pair), rounded to 6 decimals;
    N counts baskets without items too. Only pairs with at least min_support baskets come
    out; items in fewer baskets are left out before pairs are formed, which changes nothing.
    Which items are heavy is decided by cost (heavy_items); heavy sets their number instead.
    Baskets and owners of any size are counted in full: a basket of more than `part` items
    is split into pairs of parts, and an owner whose baskets weigh more than block_weight
    (a basket weighs its items and pairs) is spread over blocks. An empty table gives no rows.
    """
    baskets = cut_lineage(distinct_baskets(df, basket=basket, owner=owner, items=items), "baskets")
    total = baskets.count()
    incidence = baskets.select("basket", F.explode("items").alias("item"))
    counts = cut_lineage(incidence.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_support), "items")
    frequent = heavy_items(counts, total, max_heavy) if heavy is None else [r.item for r in counts.orderBy(F.desc("n"), "item").limit(min(heavy, max_heavy)).collect()]
    kept = incidence.join(counts, "item", "left_semi").groupBy("basket").agg(F.collect_list("item").alias("items")) if min_support > 1 else baskets.select("basket", "items")

    n = F.size("items")
    parts = F.ceil(n / part).cast("int")
    pieces = F.when(parts == 1, F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))).otherwise(
        F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.transform(F.sequence(p, parts - 1), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    )
    small = F.least(n, F.lit(part)).cast("double")
    rows = baskets.select("basket", F.posexplode_outer("owners").alias("k", "owner")).join(kept, "basket").filter(n > 1).withColumn("weight", 1 + small / 16 + small * small / 128)
    rows = cut_lineage(rows.withColumn("split", parts > 1).withColumn("weight", F.col("weight") * parts * (parts + 1) / 2), "rows")
    weights = rows.groupBy("owner").agg(F.sum("weight").alias("all"), F.bool_or("split").alias("split"))
    blocks = int((rows.agg(F.sum("weight")).first()[0] or 0) // block_weight) + 1
    large = weights.filter(F.col("owner").isNotNull() & ((F.col("all") > block_weight) | F.col("split"))).select("owner", F.ceil(F.col("all") / block_weight).alias("salts"))
    rows = rows.drop("split").join(broadcast_if_small(large), "owner", "left").select("basket", "owner", "k", "salts", "items", F.explode(pieces).alias("piece"))
    mixed = F.xxhash64("basket", "piece")
    salt = F.when(F.col("owner").isNull(), mixed).when(F.col("salts").isNotNull(), F.pmod(mixed, F.col("salts"))).otherwise(F.lit(0))
    of = lambda at: F.slice("items", F.col("piece")[at] * part + 1, F.lit(part))
    rows = rows.select(
        F.pmod(F.xxhash64("owner", salt), F.lit(blocks)).alias("block"),
        "owner", F.col("salts").isNotNull().alias("named"), (F.coalesce(F.col("k"), F.lit(0)) == 0).alias("primary"),
        of("p").alias("items"), F.when(F.col("piece")["p"] < F.col("piece")["q"], of("q")).alias("others"),
    )
    known = pa.array(frequent, pa.string())

    def block(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from count_block(pa.Table.from_batches(list(batches)), known).to_batches(max_chunksize=1 << 16)

    partial = rows.groupBy("block").applyInArrow(block, "a string, b string, jobs bigint, owners bigint, owner string")
    # owners carried by name are counted once each, in two steps, so that none has to be collected
    each = partial.groupBy("a", "b", "owner").agg(F.sum("jobs").alias("jobs"), F.sum("owners").alias("owners"))
    pairs = each.groupBy("a", "b").agg(F.sum("jobs").alias("jobs"), (F.sum("owners") + F.count("owner")).alias("owners")).filter(F.col("jobs") >= min_support)
    scored = pairs.join(counts.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
    n, lift = F.lit(float(total)), F.lit(float(total)) * F.col("jobs") / (F.col("na").cast("double") * F.col("nb"))
    npmi = F.when(F.col("jobs") == total, 1.0).otherwise(F.ln(lift) / -F.ln(F.col("jobs") / n))
    return scored.select(
        F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.col("jobs").alias("support_jobs"), F.col("owners").alias("support_companies"), F.round(lift, 6).alias("lift"), F.round(npmi, 6).alias("npmi")
    )
