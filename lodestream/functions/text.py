"""Text normalization and small string operators, as column functions.

Only compatibility folding (NFKC, casefold) has no built-in form; it is one Arrow function,
which callers can leave out where texts are known to be folded already.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Spellings that are brought together, in this order; what separates packed
# values; punctuation that separates lexical units; values that say nothing.
SPELLINGS = (("react.js", "reactjs"), ("react js", "reactjs"), ("node js", "node.js"), ("nodejs", "node.js"), ("c sharp", "c#"), ("cplusplus", "c++"))
SEPARATORS = r"(?i)(?:<br\s*/?>|[\r\n,，、;；|｜/／]+)"
NULL_WORDS = ("", "null", "none", "n/a", "na", "無", "不拘", "未填寫", "無要求")
HAN_RUN = r"([\x{4e00}-\x{9fff}]+)"
ASCII_UNIT = r"([a-z0-9][a-z0-9.+#/-]*)"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition of each text; null stays null."""
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def nfkc_casefold(texts: pd.Series) -> pd.Series:
    """Compatibility composition and full case folding, which lower() isn't (ß)."""
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def collapse(text: Column) -> Column:
    """Runs of any white space as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def index_normalize(text: Column, fold: bool = True) -> Column:
    """Lower case, plain width, 臺 as 台, single blanks; null becomes ''."""
    text = F.coalesce(text, F.lit(""))
    return collapse(F.replace(F.lower(nfkc(text) if fold else text), F.lit("臺"), F.lit("台")))


def rank_normalize(text: Column, fold: bool = True) -> Column:
    """As index_normalize, and the spellings of SPELLINGS brought together before blanks are collapsed."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.replace(F.regexp_replace(F.lower(nfkc(text) if fold else text), r"(?U)^\s+|\s+$", ""), F.lit("臺"), F.lit("台"))
    joined = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, lowered)
    return collapse(joined)


def surface_normalize(text: Column, fold: bool = True) -> Column:
    """Case folded, and no blanks around the signs . + # / - ; null becomes ''."""
    text = F.coalesce(text, F.lit(""))
    folded = F.replace(nfkc_casefold(text) if fold else F.lower(text), F.lit("臺"), F.lit("台"))
    return F.regexp_replace(collapse(folded), r"\s*([.+#/-])\s*", "$1")


def plain_query(text: Column, fold: bool = True) -> Column:
    """The user's words as they are, folded in width only, single blanks."""
    text = F.coalesce(text, F.lit(""))
    return collapse(nfkc(text) if fold else text)


def ngrams(run: Column, n: int) -> Column:
    """All substrings of n letters."""
    return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, n))).otherwise(F.array().cast("array<string>"))


def lexical_units(normalized: Column) -> Column:
    """The distinct units a text is matched by: ASCII tokens, Han runs, and their 2- and 3-grams."""
    ascii_units = F.regexp_extract_all(normalized, F.lit(ASCII_UNIT), F.lit(1))
    runs = F.regexp_extract_all(normalized, F.lit(HAN_RUN), F.lit(1))
    grams = F.flatten(F.transform(runs, lambda r: F.concat(F.array(r), ngrams(r, 2), ngrams(r, 3))))
    return F.array_distinct(F.concat(ascii_units, grams))


def naming_units(text: Column) -> Column:
    """The units of a lower-cased text by which names meet it: ASCII words as surface_in_text bounds them, other letters and pairs of them."""
    words = F.regexp_extract_all(text, F.lit("([a-z0-9.+#]+)"), F.lit(1))
    runs = F.regexp_extract_all(text, F.lit(r"([^\x00-\x7f]+)"), F.lit(1))
    grams = F.flatten(F.transform(runs, lambda r: F.concat(ngrams(r, 2), ngrams(r, 1))))
    return F.array_distinct(F.concat(words, grams))


def naming_unit(surface: Column) -> Column:
    """A unit that every text has in which surface_in_text finds the lower-cased surface; null if it has no letters.

    An ASCII surface is bounded, so its words are whole words of the text; of any other
    surface only what lies between ASCII letters is sure to be a unit.
    """
    units = naming_units(surface)
    other = F.filter(units, lambda u: ~u.rlike(r"^\p{ASCII}+$"))
    pairs = F.filter(other, lambda u: F.length(u) == 2)
    return F.coalesce(F.array_min(pairs), F.array_min(other), F.array_min(units))


def overlap(wanted: Column, held: Column) -> Column:
    """Share of wanted units that are held; 0 where nothing is wanted."""
    return F.size(F.array_intersect(wanted, held)) / F.greatest(F.lit(1), F.size(wanted))


def surface_in_text(text: Column, surface: Column) -> Column:
    """Whether text names the surface: an ASCII surface only between characters that aren't ASCII letters, digits, . + or #."""
    ascii_only = surface.rlike(r"^\p{ASCII}+$")
    quoted = F.concat(F.lit("(?<![a-z0-9.+#])"), F.regexp_replace(surface, r"([^A-Za-z0-9\s])", r"\\$1"), F.lit("(?![a-z0-9.+#])"))
    return (surface != "") & F.when(ascii_only, F.rlike(text, quoted)).otherwise(text.contains(surface))


def split_values(text: Column) -> Column:
    """Trimmed, non-empty pieces between any of the separators; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def is_nothing(text: Column) -> Column:
    """Whether a value only says that there is none."""
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin(*NULL_WORDS)


def codes(text: Column) -> Column:
    """Comma-separated codes as an array, blanks and empties gone."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,，]"), lambda x: F.trim(x)), lambda x: x != "")


def strip_tags(text: Column) -> Column:
    return collapse(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "))


def bounded_aliases(aliases: Column, shortest: int = 2, longest: int = 60, first: int = 30) -> Column:
    """Aliases of admissible length, the first so many."""
    return F.slice(F.filter(aliases, lambda a: F.length(a).between(shortest, longest)), 1, first)


def join_terms(terms: Column, fallback: Column, longest: int = 480) -> Column:
    """Distinct terms joined by blanks, cut at a term's end before longest; fallback if none fits."""
    distinct = F.array_distinct(F.filter(F.transform(terms, lambda x: F.trim(x)), lambda x: x != ""))
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def add(acc: Column, term: Column) -> Column:
        used = acc["used"] + F.length(term) + 1
        full = acc["full"] | (used > longest)
        return F.struct(F.when(full, acc["used"]).otherwise(used).alias("used"), full.alias("full"), F.when(full, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(term))).alias("kept"))

    joined = F.aggregate(distinct, start, add, lambda acc: F.array_join(acc["kept"], " "))
    return F.when(joined != "", joined).otherwise(F.substring(fallback, 1, longest))


def query_expansion(query: Column, company: Column, kept_terms: Column, longest: int = 480) -> Column:
    """The user's words, the company, and kept terms that the user typed or that are ASCII."""
    typed = F.filter(kept_terms, lambda t: F.lower(query).contains(F.lower(t)) | t.rlike(r"^\p{ASCII}*$"))
    return join_terms(F.concat(F.array(query, F.coalesce(company, F.lit(""))), typed), query, longest)


def recall_expansion(query: Column, categories: Column, longest: int = 480) -> Column:
    """Category labels before the user's words; empty where there is no category."""
    return F.when(F.size(categories) > 0, join_terms(F.concat(categories, F.array(query)), query, longest)).otherwise(F.lit(""))


def embedding_text(title: Column, categories: Column, description: Column, longest: int = 200) -> Column:
    """What a posting is embedded by: title, categories, and the description's beginning."""
    parts = F.concat(F.array(F.coalesce(title, F.lit(""))), F.coalesce(categories, F.array().cast("array<string>")), F.array(F.substring(F.coalesce(description, F.lit("")), 1, longest)))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def first_rule(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule whose condition holds, '' if none does."""
    chain = None
    for name, condition in rules:
        chain = F.when(condition, name) if chain is None else chain.when(condition, name)
    return F.lit("") if chain is None else chain.otherwise("")


def explanation(phrases: Sequence[tuple[Column, Column | str]], default: str, most: int = 3) -> Column:
    """The first phrases whose condition holds, joined; default if none does."""
    said = F.array_compact(F.array(*[F.when(c, F.lit(p) if isinstance(p, str) else p) for c, p in phrases]))
    return F.when(F.size(said) > 0, F.array_join(F.slice(said, 1, most), "；")).otherwise(F.lit(default))


def safe_cell(text: Column) -> Column:
    """A spreadsheet cell that can't be taken for a formula."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def bigram_terms(normalized: Column) -> Column:
    """Terms for keyword search, repeated ones included: ASCII tokens, and pairs of neighbouring Han characters."""
    runs = F.regexp_extract_all(normalized, F.lit(HAN_RUN), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(ngrams(r, 2))))
    return F.concat(F.regexp_extract_all(normalized, F.lit(ASCII_UNIT), F.lit(1)), pairs)


def suppressed(query: Column, blocked: Column) -> Column:
    """Whether one of a name's blocked phrases stands anywhere in the query."""
    return F.coalesce(F.exists(blocked, lambda p: (p != "") & query.contains(p)), F.lit(False))
