"""Freely typed names mapped to the entries of a reference list. Built-in SQL functions only.

Partition-based pigeonhole join: a reference string within k edits of a typed one, cut into
k + 1 segments, has at least one segment left unharmed, at most k places from where it was.
So segments are joined by equality with positional substrings of the typed strings, and the
candidates are verified with the built-in levenshtein.

What people write around names is learnt from the typed texts themselves, and the two Chinese
orthographies are brought together by the rules of the engine's own Unicode library: nothing
is listed here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.session import broadcast_if_small, cut_lineage

# Signs that writers put into names or leave out of them.
SIGNS = " 　\t\r\n_・·‧•-/\\.,'`~|"
#: Stands between the parts of a text that is taken apart.
CUT = "\u0001"


def wide_forms() -> tuple[str, str]:
    """Characters of full width and their plain forms, by the rule of their code points."""
    return "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　", "".join(map(chr, range(0x21, 0x7F))) + " "


def orthography(spark: SparkSession) -> tuple[str, str]:
    """Traditional characters and their simplified forms, by the transliteration rules of the Unicode library that the engine brings along."""
    every = [chr(c) for block in (range(0x3400, 0x4DC0), range(0x4E00, 0xA000), range(0xF900, 0xFB00)) for c in block]
    rules = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    changed = [(a, b) for a, b in zip(every, rules.transliterate(CUT.join(every)).split(CUT), strict=True) if a != b and len(b) == 1]
    return "".join(a for a, _ in changed), "".join(b for _, b in changed)


def plain(text: Column, characters: tuple[str, str]) -> Column:
    """Lower case, plain width, one orthography, without blanks and the signs of SIGNS."""
    folded = F.translate(F.lower(F.translate(text, *wide_forms())), *characters)
    return F.regexp_replace(F.translate(folded, SIGNS, ""), r"(?U)\s+", "")


def written_around(forms: DataFrame, names: DataFrame, *, longest: int, least_names: int, least_share: float, longest_affix: int) -> DataFrame:
    """What is written before and after names: (side, rest), digits as 0, all of it.

    forms: (form), names: (name), both plain and distinct. A text of any length counts if it is
    found beside at least least_names different names that stand at the other end of a form
    (and at least least_share of those that anything of up to longest_affix letters is found
    beside, so that slips of the pen, which are many where texts are many, don't count), and
    isn't a name itself.
    """
    other = forms.join(names.select(F.col("name").alias("form")), "form", "left_anti")
    n = F.length("form")
    cut = F.transform(F.sequence(F.lit(2), F.least(n - 1, F.lit(longest))), lambda i: F.array(F.struct(F.lit("after").alias("side"), F.substring("form", F.lit(1), i).alias("name")), F.struct(F.lit("before").alias("side"), F.substring("form", n - i + 1, i).alias("name"))))
    parts = other.filter(F.least(n - 1, F.lit(longest)) >= 2).select("form", F.inline(F.flatten(cut)))
    size = F.length("name")
    rest = F.when(F.col("side") == "after", F.substring("form", size + 1, n - size)).otherwise(F.substring("form", F.lit(1), n - size))
    beside = parts.join(broadcast_if_small(names), "name").select("side", rest.alias("rest"), "name").join(names.select(F.col("name").alias("rest")), "rest", "left_anti")
    beside = cut_lineage(beside.select("side", F.regexp_replace("rest", r"\d+", "0").alias("rest"), "name").distinct(), "beside")
    least = max(least_names, least_share * beside.filter(F.length("rest") <= longest_affix).select("name").distinct().count())
    return beside.groupBy("side", "rest").agg(F.count(F.lit(1)).alias("names")).filter(F.col("names") >= least).select("side", "rest")


def offsets(text: Column, is_one: Callable[[Column], Column], longest: Column, backwards: bool) -> Column:
    """Every number of letters that can be taken off a text's beginning (or end) as one of the texts after another: 0, 2, ...

    is_one tells whether letters (with digits as 0; from the end on if backwards) are one of the texts, of up to longest letters.
    """
    pieces = F.regexp_extract_all(F.reverse(text) if backwards else text, F.lit(r"(?s)(\d+|.)"), F.lit(1))

    def step(done: Column, piece: Column) -> Column:
        no, at = done["no"] + 1, done["at"] + F.length(piece)
        recent = F.substring(F.concat(done["recent"], F.substring(F.translate(piece, "123456789", "000000000"), 1, 1)), -longest, longest)
        begun = F.filter(done["begun"], lambda b: no - b < longest)
        state = lambda begun, reached: F.struct(no.alias("no"), at.alias("at"), recent.alias("recent"), begun.alias("begun"), reached.alias("reached"))
        ends = F.exists(done["begun"], lambda b: is_one(F.substring(recent, b - no, no - b)))
        return F.when(ends, state(F.concat(begun, F.array(no)), F.concat(done["reached"], F.array(at)))).otherwise(state(begun, done["reached"]))

    nothing = F.array(F.lit(0))
    return F.aggregate(pieces, F.struct(F.lit(0).alias("no"), F.lit(0).alias("at"), F.lit("").alias("recent"), nothing.alias("begun"), nothing.alias("reached")), step, lambda done: done["reached"])


def texts_within(typed: DataFrame, around: DataFrame) -> DataFrame:
    """typed (text, plain) with the texts from around that occur in it: heads, tails (backwards) and the length of the longest.

    A join, so that around may have any number of rows; a row carries a stretch of a text, never a long text.
    """
    around = cut_lineage(around, "around")
    longest = around.agg(F.coalesce(F.max(F.length("rest")), F.lit(1))).first()[0]
    typed = cut_lineage(typed.select("text", "plain", F.monotonically_increasing_id().alias("id")), "numbered")
    step = max(longest, 64)
    digits = typed.select("id", F.regexp_replace("plain", r"\d+", "0").alias("digits")).filter("digits <> ''")
    stretches = digits.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("digits"), F.lit(step)), lambda i: F.substring("digits", i, F.lit(step + longest - 1)))).alias("stretch"))
    places = stretches.select("id", "stretch", F.explode(F.sequence(F.lit(1), F.least(F.length("stretch"), F.lit(step)))).alias("place"))
    sizes = around.select(F.length("rest").alias("size")).distinct()
    pieces = places.join(broadcast_if_small(sizes), F.col("place") + F.col("size") - 1 <= F.length("stretch")).select("id", F.substring("stretch", F.col("place"), F.col("size")).alias("rest"))
    found = pieces.join(broadcast_if_small(around), "rest").select("id", "side", "rest").distinct()
    heads, tails = F.when(F.col("side") == "before", F.col("rest")), F.when(F.col("side") == "after", F.reverse("rest"))
    sets = found.groupBy("id").agg(F.collect_set(heads).alias("heads"), F.collect_set(tails).alias("tails"), F.max(F.length("rest")).alias("longest"))
    none = F.array().cast("array<string>")
    return typed.join(sets, "id", "left").select("text", "plain", F.coalesce("heads", none).alias("heads"), F.coalesce("tails", none).alias("tails"), F.coalesce("longest", F.lit(1)).alias("longest"))


def left_over(typed: DataFrame, around: DataFrame, longest: int, *, most: int, longest_affix: int) -> DataFrame:
    """Rows (text, form) from rows (text, plain): the plain text, and what is left of it as texts from around are taken off both ends, as far as it is no longer than longest.

    At most `most` texts of up to longest_affix letters are looked up within an expression; if
    there are more or longer ones, all of them are met in a join, with the same rows.
    """
    rows = around.select("side", F.substring("rest", 1, longest_affix + 1).alias("rest")).limit(most + 1).collect()
    if len(rows) <= most and all(len(r.rest) <= longest_affix for r in rows):
        before, after = [r.rest for r in rows if r.side == "before"], [r.rest[::-1] for r in rows if r.side == "after"]

        def taken(texts: list[str], backwards: bool) -> Column:
            return offsets(F.col("plain"), lambda x: x.isin(texts), F.lit(max(map(len, texts))), backwards) if texts else F.array(F.lit(0))

        cut = typed.select("text", "plain", taken(before, False).alias("heads"), taken(after, True).alias("tails"))
    else:
        heads, tails = (offsets(F.col("plain"), lambda x, side=side: F.array_contains(side, x), F.col("longest"), side == "tails") for side in ("heads", "tails"))
        cut = texts_within(typed, around).select("text", "plain", heads.alias("heads"), tails.alias("tails"))

    def between(tail: Column) -> Column:
        stop = F.length("plain") - tail
        return F.transform(F.filter("heads", lambda h: (stop - h).between(1, longest)), lambda h: F.substring("plain", h + 1, stop - h))

    return cut.select("text", F.explode(F.array_distinct(F.flatten(F.transform("tails", between)))).alias("form"))


def allowed(length: Column) -> Column:
    """Edits that a name of that length is searched with, so that its segments have two letters or more."""
    return F.when(length >= 8, 2).when(length >= 4, 1).otherwise(0)


def bounds(length: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """Where segment i of k + 1 begins, and its size."""
    start = F.floor(i * length / (k + 1)).cast("int")
    return start, F.floor((i + 1) * length / (k + 1)).cast("int") - start


def without_one(text: Column) -> Column:
    """The text with each of its letters left out."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def keys(length: Column, no: Column | int, segment: Column) -> Column:
    return F.struct(length.cast("int").alias("length"), (F.lit(no) if isinstance(no, int) else no).cast("int").alias("no"), segment.alias("segment"))


def segments(name: Column) -> Column:
    """What a reference string is found by: (length, no, segment).

    Three letters are too few for two segments; they are found by any two of them.
    """
    n = F.length(name)

    def part(i: Column) -> Column:
        start, size = bounds(n, allowed(n), i)
        return keys(n, i, F.substring(name, start + 1, size))

    cut = F.transform(F.sequence(F.lit(0), allowed(n)), part)
    return F.when(n == 3, F.concat(F.transform(without_one(name), lambda x: keys(n, 1, x)), F.array(keys(n, 0, name)))).otherwise(cut)


def probes(form: Column) -> Column:
    """What a typed string may be found by, for reference strings of every length that may be meant: (length, no, segment).

    Where one edit is allowed, two neighbouring letters that were swapped harm both segments
    only at their border, so that the string is looked up with these two swapped back, too.
    """
    n = F.length(form)

    def of_length(length: Column) -> Column:
        k = allowed(length)

        def of_part(i: Column) -> Column:
            start, size = bounds(length, k, i)
            first = F.greatest(start - k, F.lit(0))
            places = F.sequence(first, F.greatest(F.least(start + k, n - size), first))
            return F.transform(places, lambda p: keys(length, i, F.substring(form, p + 1, size)))

        border = F.floor(length / 2).cast("int")
        back = F.concat(F.substring(form, F.lit(1), border - 1), F.substring(form, border + 1, F.lit(1)))
        swapped = F.when((k == 1) & (n == length), F.array(keys(length, 0, back)))
        return F.concat(F.flatten(F.transform(F.sequence(F.lit(0), k), of_part)), F.coalesce(swapped, F.array().cast("array<struct<length:int,no:int,segment:string>>")))

    lengths = F.filter(F.sequence(F.greatest(n - 2, F.lit(1)), n + 2), lambda m: (m != 3) & (F.abs(m - n) <= allowed(m)))
    three = F.when(n == 3, F.concat(F.transform(without_one(form), lambda x: keys(F.lit(3), 1, x)), F.array(keys(F.lit(3), 0, form))))
    three = three.when(n == 2, F.array(keys(F.lit(3), 1, form))).when(n == 4, F.transform(without_one(form), lambda x: keys(F.lit(3), 0, x)))
    return F.array_distinct(F.concat(F.flatten(F.transform(lengths, of_length)), F.coalesce(three, F.array().cast("array<struct<length:int,no:int,segment:string>>"))))


def closest_entries(
    surfaces: DataFrame, nodes: DataFrame, *, text: str, node_id: str, label: str, aliases: str, least_names: int = 2, least_share: float = 0.02, longest_affix: int = 16, most_affixes: int = 5_000
) -> DataFrame:
    """Distinct values of `text` with the entry they mean: (text, node_id, distance).

    Compared are lower-cased texts of plain width in one orthography, without signs, with and
    without what others write around names (written_around: all such texts, whatever their
    number and length), taken off one after the other in every way. Beyond most_affixes texts
    or longest_affix letters they are looked up in another way (left_over) with the same rows;
    longest_affix is also part of the bar that least_share sets. An entry is meant if its label
    or an alias is at most one edit away, or two that are the swap of neighbouring letters
    (from eight letters on, any two); names of one or two letters must be met exactly. Of
    several the nearest is meant, then the longest name; entries that tie are ambiguous and
    none is meant. Nulls, blanks and values that mean nothing don't come out: see unmatched.
    """
    characters = orthography(surfaces.sparkSession)
    names = nodes.select(F.col(node_id).alias("node_id"), F.explode(F.concat(F.array(label), F.coalesce(F.col(aliases), F.array().cast("array<string>")))).alias("name"))
    names = cut_lineage(names.select("node_id", plain(F.col("name"), characters).alias("name")).filter("name <> ''").distinct(), "names")
    known = names.select("name").distinct()
    longest = known.agg(F.coalesce(F.max(F.length("name")), F.lit(0))).first()[0]

    values = surfaces.select(F.col(text).alias("text")).filter("trim(text) <> ''").distinct().withColumn("plain", plain(F.col("text"), characters))
    values = cut_lineage(values, "typed")
    around = written_around(values.select(F.col("plain").alias("form")).distinct(), known, longest=longest, least_names=least_names, least_share=least_share, longest_affix=longest_affix)
    forms = left_over(values, around, longest + 2, most=most_affixes, longest_affix=longest_affix)

    cut = known.select("name", F.inline(segments(F.col("name"))))
    probed = forms.select("form").distinct().select("form", F.inline(probes(F.col("form"))))
    candidates = probed.join(broadcast_if_small(cut), ["length", "no", "segment"]).select("form", "name").distinct()
    n = F.length("form")
    swap = (n == F.length("name")) & (n > 1) & F.exists(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.substring("form", F.lit(1), i - 1), F.substring("form", i + 1, F.lit(1)), F.substring("form", i, F.lit(1)), F.substring("form", i + 2, n)) == F.col("name"))
    verified = candidates.withColumn("d", F.levenshtein("form", "name")).filter((F.col("d") == 0) | ((F.col("d") <= 2) & (F.length("name") > 2)))
    verified = verified.withColumn("swap", (F.col("d") == 2) & swap).filter((F.col("d") <= 1) | F.col("swap") | (F.length("name") >= 8))
    verified = verified.withColumn("distance", F.when(F.col("swap"), 1).otherwise(F.col("d")))

    best = forms.join(verified, "form").join(names, "name").groupBy("text", "distance", F.length("name").alias("length")).agg(F.min("node_id").alias("low"), F.max("node_id").alias("high"))
    top = best.groupBy("text").agg(F.min(F.struct("distance", (-F.col("length")).alias("length"), "low", "high")).alias("b"))
    return top.filter("b.low = b.high").select("text", F.col("b.low").alias("node_id"), F.col("b.distance").alias("distance"))


def unmatched(surfaces: DataFrame, matched: DataFrame, *, text: str) -> DataFrame:
    """Rows of surfaces whose text means no entry; null texts too."""
    return surfaces.join(matched.select(F.col("text").alias(text)), text, "left_anti")
