"""Expressions over source text: comments, names, lines and words.

Word characters are spelled out as letters, digits and underscore of any script, so that
the result does not depend on how a Java version reads ``\\w`` and ``\\b``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{N}_]"
OTHER = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def _word(keyword: str) -> str:
    """A whole word. The look at the character before it comes after the keyword, so that
    a scan compares letters first and looks back only where the keyword stands."""
    return rf"{keyword}(?<!{WORD}{keyword})"


# The clause patterns and the words that never name a table.
NAME = rf"`?([A-Za-z_]{WORD}*(?:`?\.`?[A-Za-z_]{WORD}*){{0,2}})`?"
READ_CLAUSES = (
    rf"(?i){_word('FROM')}{SPACE}+{NAME}",
    rf"(?i){_word('JOIN')}{SPACE}+{NAME}",
)
WRITE_CLAUSES = (
    rf"(?i){_word('CREATE')}{SPACE}+(?:OR{SPACE}+REPLACE{SPACE}+)?(?:TABLE|VIEW){SPACE}+"
    rf"(?:IF{SPACE}+NOT{SPACE}+EXISTS{SPACE}+)?{NAME}",
    rf"(?i){_word('INSERT')}{SPACE}+(?:INTO|OVERWRITE){SPACE}+(?:TABLE{SPACE}+)?{NAME}",
    rf"(?i){_word('MERGE')}{SPACE}+INTO{SPACE}+{NAME}",
    rf"(?i){_word('UPDATE')}{SPACE}+{NAME}",
)
CTE_CLAUSE = (
    rf"(?i)(?:{_word('WITH')}{SPACE}+(?:RECURSIVE{SPACE}+)?|,{SPACE}*)"
    rf"`?({WORD}+)`?(?:{SPACE}*\([^)]*\))?{SPACE}+AS{SPACE}*\("
)
NOT_A_TABLE = ("select", "values", "lateral", "unnest", "table", "set")

# One left-to-right pass, so that '--' inside a literal and a quote inside a comment are
# both read as what they are. A doubled quote is two literals side by side, which strips
# the same characters without a repeated group (those overflow Java's stack on long text).
NOISE = r"'[^']*'|--[^\n]*|(?s:/\*.*?\*/)"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
OTHER_BREAK = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip_noise(text: Column) -> Column:
    """Replace comments and string literals by a space."""
    return F.regexp_replace(text, NOISE, " ")


def names_after(text: Column, *clauses: str) -> Column:
    """Every name that follows one of the clauses, without backticks, repeats kept.

    A name holds no blank, so joining, replacing and splitting clean the whole array with
    compiled string functions. Without any match the array holds one empty string.
    """
    found = [F.regexp_extract_all(text, F.lit(c), F.lit(1)) for c in clauses]
    return F.split(F.replace(F.array_join(F.concat(*found), " "), F.lit("`"), F.lit("")), " ")


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def line_of(text: Column, needle: Column) -> Column:
    """1-based line of the first occurrence of ``needle``; 1 when it does not occur."""
    before = F.substr(text, F.lit(1), F.position(needle, text) - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def words(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}+"), F.lit(0)))


def name_shapes(name: Column) -> Column:
    """struct<size, before, after>: how many words a name has and whether other characters stand before the first
    and after the last one. A name without a word has size 0."""
    parts = F.split(name, f"{WORD}+")
    other = lambda part: (F.size(parts) > 1) & (part != "")
    return F.struct(
        (F.size(parts) - 1).alias("size"),
        other(F.element_at(parts, 1)).alias("before"),
        other(F.element_at(parts, -1)).alias("after"),
    )


def runs(words: str, gaps: str, size: int, before: bool, after: bool) -> Column:
    """All pieces of a text of one shape, from its words and what stands between them (one more).

    A piece lies between word boundaries, as :func:`mentions` asks for: what stands before its first
    word is all that is there up to another word, and so is what stands after its last one.
    """
    first = 1 if before or not size else 0
    last = F.size(words) - size - (1 if after or not size else 0)

    def piece(i: Column) -> Column:
        if not size:
            return F.get(gaps, i)
        own = [F.get(words, i)]
        for k in range(1, size):
            own += [F.get(gaps, i + k), F.get(words, i + k)]
        return F.concat(*([F.get(gaps, i)] if before else []), *own, *([F.get(gaps, i + size)] if after else []))

    return F.when(last >= first, F.transform(F.sequence(F.lit(first), last), piece)).otherwise(F.array().cast("array<string>"))


def is_word(name: Column) -> Column:
    return name.rlike(rf"^{WORD}+$")


def mentions(text: Column, name: Column) -> Column:
    """Whether ``name`` occurs between word boundaries, in any case; for names with other
    characters than word characters, which :func:`words` would take apart."""
    escaped = F.regexp_replace(name, rf"({OTHER})", r"\\$1")
    return F.rlike(text, F.concat(F.lit(r"(?iuU)\b"), escaped, F.lit(r"\b")))


def lines(text: Column) -> Column:
    """The lines of a text. Where newlines are the only breaks, as in most texts, it is cut without a pattern."""
    return F.when(text.rlike(OTHER_BREAK), F.split(text, LINE_BREAK)).otherwise(F.split(text, "\n"))
