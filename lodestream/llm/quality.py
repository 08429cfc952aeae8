"""Statistics of a document's text that tell running prose from lists, tables and junk.

Each statistic is ranked exactly among the documents of the same language: the distinct
values are range-partitioned and sorted, every partition counts within itself, and the
partitions' offsets make those counts global. The empirical tail probabilities to the left
and to the right of a value, as negative logarithms, add up to an outlier score.

Texts are measured many at a time: their characters stand in one array, and what a character
is (a letter, a blank, the end of a line, ...) is read from one table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.texts import TAG, portions
from lodestream.session import bounded_rows, cut_lineage, partitions

# Signs that end a sentence or a line of prose, that end a sentence wherever they
# stand, that separate pieces, and that stand for what couldn't be read.
ENDS = "。．.!！?？…」』”\"’）)】~～"
STOPS = "。！？!?"
SEPARATORS = "\n\r。！？!?；;，,、：:|¦\t"
UNREADABLE = "�□"
BREAK = re.compile(r"<br\s*/?>", re.I)

STATISTICS = ("words", "mean_word", "symbols", "digits", "line_ends", "common", "mean_line", "distinct", "broken", "drawn", "markup", "piece", "long_pieces", "common_pieces", "sentences")
#: Statistics that are lengths or numbers; they are ranked by their logarithm, all others are shares.
LENGTHS = ("words", "mean_word", "mean_line", "piece")
LANGUAGES = ("zh", "ja", "en", "und")
#: The tails that speak against prose before any label is seen, and the score that takes no side.
SUSPICIOUS = {"left": ("words", "line_ends", "common", "mean_line", "distinct", "piece", "long_pieces", "common_pieces", "sentences"), "right": ("symbols", "digits", "broken", "drawn", "markup", "mean_word")}
PRIOR_WEIGHT, PRIOR_BIAS = 0.5, {"zh": -8.0, "ja": -8.0, "en": -8.0, "und": 2.0}
#: Characters measured at a time.
TOGETHER = 1 << 20
#: What a character may be.
HAN, KANA, ALPHABET, LETTER, DIGIT, WORD, SPACE, NEWLINE, SEPARATOR, END, STOP, BAD, DRAWN, HIGH, CONTROL = (1 << i for i in range(15))


@cache
def kinds() -> np.ndarray:
    """What every character is, as a set of the bits above."""
    code = np.arange(0x110000, dtype=np.uint32)
    letter = code.view("<U1")
    within = lambda *ranges: np.logical_or.reduce([(code >= lo) & (code <= hi) for lo, hi in ranges])
    among = lambda signs: np.isin(code, [ord(c) for c in signs])
    han, kana = within((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)), within((ord("ぁ"), ord("ヺ")))
    alpha, decimal, digit, space = np.strings.isalpha(letter), np.strings.isdecimal(letter), np.strings.isdigit(letter), np.strings.isspace(letter)
    word = np.strings.isalnum(letter) | (code == ord("_"))
    one_word = {HAN: han, KANA: kana | (code == ord("ー")), DIGIT: digit, LETTER: alpha, WORD: word & ~decimal, SPACE: space, NEWLINE: among("\r\n"), SEPARATOR: among(SEPARATORS), END: among(ENDS), STOP: among(STOPS)}
    one_word |= {
        BAD: among(UNREADABLE), DRAWN: within((0x2500, 0x25FF)) | among("¦|"), HIGH: within((0x80, 0xFF)),
        CONTROL: within((0, 8), (11, 12), (14, 31), (0x80, 0xFF)), ALPHABET: within((ord("A"), ord("Z")), (ord("a"), ord("z")), (0xC0, 0x24F)),
    }
    out = np.zeros(len(code), np.uint16)
    for bit, which in one_word.items():
        out[which] |= bit
    # the runs that words are made of: numbers, and letters that are neither Han nor kana
    out[decimal] |= np.uint16(1 << 15)
    return out


NUMBER = 1 << 15


class Batch:
    """Texts in one array: their characters, what those are, and which text they belong to."""

    def __init__(self, texts: Sequence[str]):
        self.n = len(texts)
        self.size = np.fromiter(map(len, texts), np.int64, self.n)
        self.first = np.cumsum(self.size) - self.size
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.kind = kinds()[self.codes]
        self.text = np.repeat(np.arange(self.n), self.size)
        self.begins = np.zeros(len(self.codes), bool)
        self.begins[self.first[self.size > 0]] = True

    def has(self, bits: int) -> np.ndarray:
        return (self.kind & bits) != 0

    def per_text(self, which: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """How many of the characters there are in each text."""
        return np.bincount(self.text[which], weights=weights, minlength=self.n)

    def before(self, flags: np.ndarray) -> np.ndarray:
        """The flag of the character before, False at a text's beginning."""
        out = np.zeros(len(flags), bool)
        out[1:] = flags[:-1]
        return out & ~self.begins

    def after(self, flags: np.ndarray, at_end: bool = False) -> np.ndarray:
        out = np.full(len(flags), at_end)
        out[:-1] = np.where(self.begins[1:], at_end, flags[1:])
        return out

    def runs(self, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first, last) of the stretches between characters of a kind, without blanks around them; blank ones don't count."""
        cut = self.has(ends)
        number = np.cumsum(cut | self.begins)
        visible = np.flatnonzero(~cut & ~self.has(SPACE))
        own = number[visible]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        return self.text[visible[first]], visible[first], visible[np.append(first[1:], len(own)) - 1] if len(own) else visible

    def distinct_pairs(self) -> np.ndarray:
        """How many different pairs of neighbouring characters each text has."""
        inside = np.flatnonzero(~self.begins[1:])
        pair = self.text[inside].astype(np.uint64) << np.uint64(42) | self.codes[inside].astype(np.uint64) << np.uint64(21) | self.codes[inside + 1]
        ordered = np.sort(pair)
        new = ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered
        return np.bincount((new >> np.uint64(42)).astype(np.int64), minlength=self.n)


class CommonWords:
    """The frequent words of each language, searched for by an automaton."""

    def __init__(self, words: Sequence[tuple[str, str]]):
        import ahocorasick

        self.of = {}
        for lang, word in words:
            if word:
                self.of.setdefault(lang, ahocorasick.Automaton()).add_word(word.lower(), len(word))
        for automaton in self.of.values():
            automaton.make_automaton()

    def found(self, batch: Batch, texts: Sequence[str], languages: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) places of the words; of languages that are written with blanks only whole words."""
        hits, texts_with, counts = [], [], []
        for i, (text, lang) in enumerate(zip(texts, languages, strict=True)):
            if (automaton := self.of.get(lang)) is not None:
                low = text.lower()
                if len(low) != len(text):
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                before = len(hits)
                hits += automaton.iter(low)
                texts_with.append(i)
                counts.append(len(hits) - before)
        own = np.repeat(np.array(texts_with, np.int64), counts)
        stop, n = np.array(hits, np.int64).reshape(-1, 2).T
        last = batch.first[own] + stop
        first = last + 1 - n
        spaced = np.array([x not in ("zh", "ja") for x in languages], bool)[own]
        letter = batch.has(WORD | NUMBER)
        keep = ~spaced | ~(batch.before(letter)[first] | batch.after(letter)[last])
        return first[keep], last[keep]


def languages_of(batch: Batch) -> list[str]:
    """zh, ja, en (any alphabet) or und, by the characters themselves."""
    han, kana, other = (batch.per_text(batch.has(k)) for k in (HAN, KANA, ALPHABET))
    return np.select([kana * 8 > han + kana, (han > 0) & (han * 3 >= other), other > 0], ["ja", "zh", "en"], "und").tolist()


def measure(texts: Sequence[str], common: CommonWords) -> tuple[list[str], np.ndarray]:
    """The language and the values of STATISTICS of each text."""
    batch = Batch(texts)
    marked = [i for i, t in enumerate(texts) if "<" in t]
    lined = {i: BREAK.sub("\n", texts[i]) for i in marked}
    bare = {i: TAG.sub("", texts[i]) for i in marked}
    markup = np.zeros(batch.n)
    markup[marked] = [len(texts[i]) - len(bare[i]) for i in marked]
    other = lambda changed: batch if all(texts[i] == t for i, t in changed.items()) else Batch([changed.get(i, t) for i, t in enumerate(texts)])
    share = lambda part, whole: part / np.maximum(1, whole)
    plain = other(bare)
    languages = languages_of(plain)

    letter, digit, number, han, kana = (batch.has(k) for k in (LETTER, DIGIT, NUMBER, HAN, KANA))
    spelled = letter & ~han & ~kana
    starts = han | (kana & ~batch.before(kana)) | (spelled & ~batch.before(spelled)) | (number & ~batch.before(number))
    words, in_words = batch.per_text(starts), batch.per_text(han | kana | spelled | number)
    visible, letters = batch.per_text(~batch.has(SPACE)), batch.per_text(letter)
    first, last = common.found(batch, texts, languages)
    spaced = np.array([x not in ("zh", "ja") for x in languages])
    used = np.where(spaced, share(np.bincount(batch.text[first], minlength=batch.n), words), share(np.bincount(batch.text[first], last + 1 - first, batch.n), letters))
    asked = (batch.codes == ord("?")) & batch.before(batch.has(WORD | NUMBER)) & batch.after(batch.has(WORD | NUMBER))
    broken = batch.has(BAD) | asked | (batch.has(CONTROL) & batch.after(batch.has(HIGH)))
    full_stop = (batch.codes == ord(".")) & batch.before(batch.has(WORD)) & batch.after(batch.has(SPACE), True)

    by_line = other(lined)
    line, a, b = by_line.runs(NEWLINE)
    lines = np.bincount(line, minlength=batch.n)
    ended = np.bincount(line[by_line.has(END)[b]], minlength=batch.n)

    piece, c, d = plain.runs(SEPARATOR)
    length = d + 1 - c
    pieces, in_pieces = np.bincount(piece, minlength=batch.n), np.bincount(piece, length, batch.n)
    long = length >= np.where(spaced, 30, 9)[piece]
    if plain is not batch:
        first, last = common.found(plain, [bare.get(i, t) for i, t in enumerate(texts)], languages)
    holder = np.searchsorted(c, first, "right") - 1
    holder = holder[(holder >= 0) & (last <= d[holder])] if len(c) else holder[:0]
    spoken = np.bincount(piece[np.unique(holder)], minlength=batch.n)

    values = {
        "words": words, "mean_word": share(in_words, words), "symbols": share(visible - letters - batch.per_text(digit & ~letter), visible), "digits": share(batch.per_text(digit), visible),
        "line_ends": share(ended, lines), "common": np.minimum(1, used), "mean_line": share(np.bincount(line, b + 1 - a, batch.n), lines), "distinct": share(batch.distinct_pairs(), batch.size - 1),
        "broken": share(batch.per_text(broken), visible), "drawn": share(batch.per_text(batch.has(DRAWN)), visible), "markup": share(markup, batch.size),
        "piece": share(in_pieces, pieces), "long_pieces": share(np.bincount(piece[long], length[long], batch.n), in_pieces), "common_pieces": share(spoken, pieces),
        "sentences": np.minimum(1, share(batch.per_text(batch.has(STOP) | full_stop), words)),
    }
    return languages, np.stack([values[s] for s in STATISTICS], axis=1).astype(float)


def document_statistics(documents: DataFrame, common: DataFrame, *, doc_id: str, text: str, max_words: int = 1_000_000) -> DataFrame:
    """Rows (doc_id, language, one column per statistic, to 4 decimals); null and blank texts have none.

    Texts are read whole. common: (lang, word), counted to be at most max_words.
    """
    known = [(r.lang, r.word) for r in bounded_rows(common.select("lang", "word").filter("word is not null").distinct(), max_words, "the list of common words")]
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").rlike(r"(?U)\S"))
    id_type = documents.schema[doc_id].dataType.simpleString()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = CommonWords(known)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in portions(texts, TOGETHER):
                languages, values = measure(texts[begin:end], words)
                columns = [pa.array(np.round(v, 4)) for v in values.T]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(languages), *columns], names=["doc_id", "language", *STATISTICS])

    return source.mapInArrow(measured, f"doc_id {id_type}, language string, " + ", ".join(f"{s} double" for s in STATISTICS))


def ranked_value(statistic: str, values: np.ndarray) -> np.ndarray:
    """The value by which a statistic is ranked: shares to 4 decimals, lengths as logarithms to 3.

    So a share has at most 10,001 values and a length (below e^22) 22,000: the table of ranks
    has at most 800,000 rows for all statistics and languages, whatever the number of documents.
    """
    return np.round(np.log1p(values), 3) if statistic in LENGTHS else np.round(values, 4)


def value_counts(measured: DataFrame) -> DataFrame:
    """Rows (statistic, language, value, n): how many documents have a value; counted in each batch before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = np.array(batch.column("language").to_pylist())
            for k, s in enumerate(STATISTICS):
                value = ranked_value(s, batch.column(s).to_numpy())
                for lang in LANGUAGES:
                    distinct, n = np.unique(value[languages == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), pa.array([lang] * len(n), pa.string()), pa.array(distinct), pa.array(n.astype(np.int64))], names=["statistic", "language", "value", "n"])

    return measured.mapInArrow(count, "statistic int, language string, value double, n bigint").groupBy("statistic", "language", "value").agg(F.sum("n").alias("n"))


def tail_probabilities(counts: DataFrame) -> DataFrame:
    """Rows (statistic, language, value, left, right) from rows (statistic, language, value, n).

    left and right are -ln of the exact shares of the language's rows with a value not above
    and not below it. Values are range-partitioned and sorted once; every partition counts
    within itself as it is written, and only the partitions' sums are put together.
    """

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, upto = None, 0
        for batch in batches:
            inside = []
            for key, n in zip(zip(batch.column("statistic").to_pylist(), batch.column("language").to_pylist(), strict=True), batch.column("n").to_pylist(), strict=True):
                upto = n if key != group else upto + n
                group = key
                inside.append(upto)
            yield batch.append_column("inside", pa.array(inside, pa.int64()))

    placed = counts.repartitionByRange(partitions(counts.sparkSession), "statistic", "language", "value").sortWithinPartitions("statistic", "language", "value")
    placed = placed.withColumn("part", F.spark_partition_id()).mapInArrow(within, "statistic int, language string, value double, n bigint, part int, inside bigint")
    placed = cut_lineage(placed, "ranks")
    group = Window.partitionBy("statistic", "language")
    sizes = placed.groupBy("statistic", "language", "part").agg(F.sum("n").alias("size"))  # at most one row per statistic, language and partition
    offsets = sizes.select(
        "statistic", "language", "part", F.coalesce(F.sum("size").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("size").over(group).alias("total")
    )
    ranked = placed.join(F.broadcast(offsets), ["statistic", "language", "part"])
    upto = F.col("offset") + F.col("inside")
    return ranked.select("statistic", "language", "value", (-F.ln(upto / F.col("total"))).alias("left"), (-F.ln((F.col("total") - upto + F.col("n")) / F.col("total"))).alias("right"))


class Ranks:
    """The tail probabilities of every value, looked up by binary search."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("statistic", "ascending"), ("language", "ascending"), ("value", "ascending")])
        statistic, language = table.column("statistic").to_numpy(), np.array(table.column("language").to_pylist())
        value, left, right = (table.column(c).to_numpy() for c in ("value", "left", "right"))
        self.of = {}
        for k in range(len(STATISTICS)):
            for lang in LANGUAGES:
                own = (statistic == k) & (language == lang) if len(table) else np.zeros(0, bool)
                self.of[k, lang] = value[own], left[own], right[own]

    def tails(self, languages: Sequence[str], values: np.ndarray) -> np.ndarray:
        """For each document left and right of every statistic, and which of LANGUAGES it is in."""
        names, n = np.array(languages), len(STATISTICS)
        out = np.zeros((len(names), 2 * n + len(LANGUAGES)))
        for j, lang in enumerate(LANGUAGES):
            rows = np.flatnonzero(names == lang)
            out[rows, 2 * n + j] = 1.0
            for k, s in enumerate(STATISTICS):
                value, left, right = self.of[k, lang]
                if len(rows) and len(value):
                    at = np.minimum(np.searchsorted(value, ranked_value(s, values[rows, k])), len(value) - 1)
                    out[rows, 2 * k], out[rows, 2 * k + 1] = left[at], right[at]
        return out


def fit(tails: np.ndarray, labels: np.ndarray, prior: np.ndarray, *, strength: float = 1.0, rounds: int = 4, margin: float = 2.0) -> np.ndarray:
    """Weights of the columns of tails, by logistic regression drawn towards prior.

    After each round, labels that the fit contradicts by more than margin are left out: a few
    labels are wrong. Without labels the prior is the result.
    """
    a = tails
    keep, w = np.ones(len(a), bool), prior.copy()
    pull = np.full(len(prior), strength)
    for _ in range(rounds if len(a) else 0):
        x, y = a[keep], labels[keep]
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * (w - prior))
            size = float(np.linalg.norm(step))
            w = w - step * min(1.0, 2.0 / max(size, 1e-12))
            if size < 1e-8:
                break
        z = a @ w
        keep = ~(((z > margin) & (labels == 0)) | ((z < -margin) & (labels == 1)))
    return w


def outlier_scores(documents: DataFrame, common: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, prose: str = "prose", sample_rows: int = 20_000) -> DataFrame:
    """Rows (doc_id, language, score): above 0, the text is no running prose.

    The score is the weighted sum of all tail probabilities. Weights are fitted to labelled
    documents, at most sample_rows of them, those with the least hash of their id; ranks,
    candidates and scores are over all documents. Documents with null or blank texts don't
    come out; a repeated row comes out repeatedly and counts as often in the ranks.
    """
    spark = documents.sparkSession
    measured = cut_lineage(document_statistics(documents, common, doc_id=doc_id, text=text), "statistics")
    table = spark.sparkContext.broadcast(tail_probabilities(value_counts(measured)).toArrow())  # bounded: see ranked_value

    sampled = labels.filter(F.col(label).isNotNull()).select(F.col(doc_id).alias("doc_id"), (F.col(label) != prose).cast("int").alias("label"))
    sampled = sampled.join(measured.select("doc_id"), "doc_id", "left_semi").distinct().orderBy(F.xxhash64("doc_id"), "label").limit(sample_rows)
    rows = measured.join(sampled, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("language", *STATISTICS)).alias("m")).orderBy("doc_id", "label").collect()  # at most sample_rows
    prior = np.array([PRIOR_WEIGHT * (s in SUSPICIOUS[side]) for s in STATISTICS for side in ("left", "right")] + [PRIOR_BIAS[x] for x in LANGUAGES])
    values = np.array([[r.m[s] for s in STATISTICS] for r in rows]).reshape(len(rows), len(STATISTICS))
    weights = fit(Ranks(table.value).tails([r.m.language for r in rows], values), np.array([r.label for r in rows], float), prior)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(table.value)
        for batch in batches:
            tails = ranks.tails(batch.column("language").to_pylist(), np.stack([batch.column(s).to_numpy() for s in STATISTICS], axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("language"), pa.array(np.round(tails @ weights, 6))], names=["doc_id", "language", "score"])

    return measured.mapInArrow(score, f"doc_id {documents.schema[doc_id].dataType.simpleString()}, language string, score double")
