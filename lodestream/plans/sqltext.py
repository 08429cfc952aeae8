"""Normal forms and name matching as DuckDB SQL, for the twins of queries on text.

The engine knows no compatibility forms; the characters of the tables that have one are those
of full width, which follow a rule.
"""

from __future__ import annotations

WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "\u3000"
PLAIN = ("".join(map(chr, range(0x21, 0x7F))) + " ").replace("'", "''")
WORD = "[a-z0-9.+#]"


def plain_width(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{WIDE}', '{PLAIN}')"


def collapsed(expression: str) -> str:
    return f"regexp_replace(regexp_replace({expression}, '[\\s\u3000\u00a0\u0085\u2028\u2029]+', ' ', 'g'), '^ | $', '', 'g')"


def indexed(column: str) -> str:
    return collapsed(f"replace(lower({plain_width(column)}), '臺', '台')")


def surface(column: str) -> str:
    return f"regexp_replace({indexed(column)}, '\\s*([.+#/-])\\s*', '\\1', 'g')"


def named_in(text: str, name: str) -> str:
    """Whether a text has a name, an ASCII name only between characters that aren't of its word."""
    bounded = f"regexp_matches({text}, concat('(^|[^a-z0-9.+#])', regexp_escape({name}), '($|[^a-z0-9.+#])'))"
    return f"case when {ascii_only(name)} then {bounded} else contains({text}, {name}) end"


def ascii_only(name: str) -> str:
    return f"length({name}) = strlen({name})"


def marked(text: str) -> str:
    """Each run of word characters between two marks: they take the place of looking around, which the engine can't."""
    return f"regexp_replace({text}, '{WORD}+', concat(chr(1), '\\0', chr(1)), 'g')"


def alternation(table: str, name: str, bounded: bool) -> str:
    """An expression for marked texts that finds any name of a table, the longest first.

    bounded: names of ASCII words are found only between marks; else marks are taken along
    where there are any, and tell afterwards whether the name stood alone.
    """
    mark = lambda at: f"case when {at}({marked(name)}, chr(1)) then " + (f"case when {ascii_only(name)} then chr(1) else concat(chr(1), '?') end" if bounded else "concat(chr(1), '?')") + " else '' end"
    one = f"concat({mark('starts_with')}, regexp_escape(trim({marked(name)}, chr(1))), {mark('ends_with')})"
    return f"(select string_agg({one}, '|' order by length({name}) desc, {name}) from (select distinct {name} from {table}))"
