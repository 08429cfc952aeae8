"""Several values packed in one field: one row per value, with its position.

Known whole values (a reference list) are found by a multi-pattern automaton; dynamic
programming over the field then picks the cover that explains most of it by known and by
quoted values, so that a delimiter inside a legitimate value doesn't cut it. Only what no
known or quoted value explains is cut at delimiters.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import bounded_rows

# What separates values, opens and closes quotes, and fields that say nothing.
DELIMITERS = ",，、;；|｜/／\n\r\t"
QUOTES = {'"': '"', "“": "”", "「": "」", "『": "』", "＂": "＂"}
NOTHING = ("", "無", "NULL", "N/A", "NA", "NONE", "不拘", "未填寫", "無要求")

BREAK = re.compile(r"<\s*/?\s*br\s*/?\s*>", re.I)
MARK = re.compile(r"[ 　 ]*(?:[(（]\d{1,3}[)）]|\d{1,3}[)）]|\d{1,3}\.(?!\d)|\d{1,3}、|[-•‧·※●○◆■▪*](?=[ 　]*\S))[ 　]*")
BLANK = " 　 "


def fold(text: str) -> str:
    """Lower case and plain width, each character staying in its place."""
    return "".join(f if len(f := unicodedata.normalize("NFKC", c).lower()) == 1 else c for c in text)


class Segmenter:
    """values(field) -> the values of one packed field, in order."""

    def __init__(self, known: Iterable[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for name in known:
            if name and name.strip():
                self.automaton.add_word(fold(name.strip()), len(name.strip()))
        self.empty = len(self.automaton) == 0
        if not self.empty:
            self.automaton.make_automaton()

    def values(self, field: str | None) -> list[str]:
        if field is None or field.strip().upper() in NOTHING:
            return []
        text = field.strip()
        if text[:1] == "[" and text[-1:] == "]":
            try:
                return [v.strip() for v in json.loads(text) if isinstance(v, str) and v.strip()]
            except ValueError:
                text = text[1:-1]
        return self._cover(BREAK.sub("\n", text))

    def _cover(self, text: str) -> list[str]:
        n = len(text)
        starts = self._starts(text)
        edges: dict[int, list[tuple[int, str]]] = {}
        for place, start in starts.items():
            edges.setdefault(place, [])
            if (quoted := self._quoted(text, start)) is not None:
                edges[place].append(quoted)
        if not self.empty:
            by_start = {}
            for place, start in starts.items():
                by_start.setdefault(start, []).append(place)
            for end, length in self.automaton.iter(fold(text)):
                for place in by_start.get(end + 1 - length, ()):
                    if (after := self._ends(text, end + 1)) is not None:
                        edges[place].append((after, text[end + 1 - length : end + 1]))
        # From the last place backwards: the least unexplained characters, then the fewest
        # values, and the step that leads there.
        best: dict[int, tuple[int, int]] = {}
        step: dict[int, tuple[int, str]] = {}
        for place in sorted(starts, reverse=True):
            start = starts[place]
            stop = next((i for i in range(start, n) if text[i] in DELIMITERS), n)
            plain = text[start:stop].strip()
            for cost, (after, value) in [*((0, e) for e in edges[place]), (len(plain), (stop + 1, plain))]:
                rest = best.get(after, (0, 0))
                total = (cost + rest[0], rest[1] + 1)
                if place not in best or total < best[place]:
                    best[place], step[place] = total, (after, value)
        values, place = [], 0
        while place in step:
            place, value = step[place]
            if value:
                values.append(value)
        return values

    @staticmethod
    def _starts(text: str) -> dict[int, int]:
        """Every place where a piece may begin, and where its value begins after blanks and list marks."""
        places = {}
        for p in [0, *(i + 1 for i, c in enumerate(text) if c in DELIMITERS)]:
            i = p
            while i < len(text) and text[i] in BLANK:
                i += 1
            if mark := MARK.match(text, i):
                i = mark.end()
            places[p] = i
        return places

    @staticmethod
    def _ends(text: str, i: int) -> int | None:
        """The place after the delimiter, if only blanks stand between i and it."""
        while i < len(text) and text[i] in BLANK:
            i += 1
        return len(text) + 1 if i >= len(text) else i + 1 if text[i] in DELIMITERS else None

    def _quoted(self, text: str, start: int) -> tuple[int, str] | None:
        """A quoted value at start: the place after it and its text."""
        close = QUOTES.get(text[start : start + 1])
        if close is None or text.find(close, start + 1) < 0:
            return None
        i, out = start + 1, []
        while i < len(text):
            if text[i] == "\\" and text[i + 1 : i + 2] in (close, "\\"):
                out.append(text[i + 1])
                i += 2
            elif text[i] == close:
                if text[i + 1 : i + 2] == close:
                    out.append(close)
                    i += 2
                    continue
                after = self._ends(text, i + 1)
                return None if after is None else (after, "".join(out).strip())
            else:
                out.append(text[i])
                i += 1
        return None


def known_values(nodes: DataFrame, label: str, aliases: str, bound: int = 200_000) -> list[str]:
    """Labels and aliases of a reference list that is counted to be small enough for every worker.

    A list beyond the bound raises TooLarge: only names holding a delimiter can change a
    result, so the caller passes those alone by filtering the list first.
    """
    names = nodes.select(F.explode(F.concat(F.array(label), F.coalesce(F.col(aliases), F.array().cast("array<string>")))).alias("name"))
    return sorted(r.name for r in bounded_rows(names.filter("trim(name) <> ''").distinct(), bound, "the list of known values"))


def split_packed(df: DataFrame, fields: Sequence[str], known: Sequence[str], *, row_id: str, id_type: str = "bigint") -> DataFrame:
    """One row (row_id, field_name, pos, item) per value in the fields of every row.

    pos counts from 1. item is as written, without blanks around it, list marks or enclosing
    quotes, a doubled quote standing for one; a repeated value counts each time. Null and
    empty fields and those that only say that there is nothing (NOTHING) give no row; nor do
    empty pieces. Fields of any length are read whole. Other columns are ignored.
    """
    columns = [f"f{i}" for i in range(len(fields))]
    source = df.select(F.col(f"`{row_id}`").cast(id_type).alias("row_id"), *[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(fields, columns, strict=True)])
    source = source.filter(" or ".join(f"trim({n}) <> ''" for n in columns))
    segmenter_of = list(known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(segmenter_of)
        for batch in batches:
            ids, names, pos, items = [], [], [], []
            row_ids = batch.column(0).to_pylist()
            for k, field in enumerate(fields):
                for row, text in zip(row_ids, batch.column(k + 1).to_pylist(), strict=True):
                    if text is not None and (values := segmenter.values(text)):
                        ids += [row] * len(values)
                        names += [field] * len(values)
                        pos += range(1, len(values) + 1)
                        items += values
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(pos, pa.int32()), pa.array(items, pa.string())],
                names=["row_id", "field_name", "pos", "item"],
            )

    cut_rows = source.mapInArrow(cut, f"row_id {id_type}, field_name string, pos int, item string")
    return cut_rows.select(F.col("row_id").alias(row_id), "field_name", "pos", "item")
