"""Column functions on text: normalising, tokenising, section and block extraction, chunking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the characters that count as white space at the ends of a text
WHITESPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# fixed values: the words that mark a message as a rate-limit error
RATE_WORDS = ["429", "quota", "rate", "limit"]

# fixed value: a word of letters, digits and underscores, or one other visible character; white space is
# what it is at the ends of a text, no-break spaces included
SPACES = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
MARK = rf"[^\p{{L}}\p{{N}}_{SPACES}]"
TOKEN = r"[\p{L}\p{N}_]+|" + MARK

# fixed value: the part of a line before a '#' that stands outside quotes. A quote after a backslash
# is an ordinary character. Each alternative starts with a different character, so the possessive
# loop never has to go back and long lines need no deep stack.
BEFORE_COMMENT = (
    r"""^((?:[^#"'\\]+|\\+[^#\\]|"(?:[^"\\]+|\\+[^\\])*+"|'(?:[^'\\]+|\\+[^\\])*+')*+\\*+)#.*$"""
)

# fixed value: the first line that opens a definition, with the blank, indented or further opening
# lines right after it
DEFINITION = r"(?m)^([ \t]*def [^\n]*(?:\n(?:[ \t\r][^\n]*|def [^\n]*)?(?=\n|\z))*+)"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def cut_comment(line: Column) -> Column:
    return F.when(line.contains("#"), F.regexp_replace(line, BEFORE_COMMENT, "$1")).otherwise(line)


def normalise(text: Column) -> Column:
    """Comments cut, every line stripped, empty lines dropped."""
    kept = F.filter(F.transform(lines(text), lambda x: strip(cut_comment(x))), lambda x: x != "")
    return F.array_join(kept, "\n")


def characters(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def line_units(text: Column) -> Column:
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def punctuation(text: Column) -> Column:
    """The sequence of non-word marks, as a stand-in for a prose text's structure."""
    return F.regexp_extract_all(text, F.lit(MARK), F.lit(0))


def tags(html: Column) -> Column:
    """Opening and closing tag names in order, as a markup page's structure."""
    return F.regexp_extract_all(html, F.lit(r"</?[A-Za-z][A-Za-z0-9]*"), F.lit(0))


def is_rate_limited(message: Column, whole_words: bool = False) -> Column:
    """Does the message name a rate limit? The plain form also matches inside longer words."""
    pattern = "|".join(RATE_WORDS)
    alone = rf"(^|[^\p{{L}}\p{{N}}_])({pattern})([^\p{{L}}\p{{N}}_]|$)"
    return F.lower(message).rlike(alone if whole_words else pattern)


def longest(items: Column) -> Column:
    """The longest string of an array, the first one on ties; NULL for an empty array."""
    return F.reduce(
        items, F.lit(None).cast("string"),
        lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best),
    )


def code_block(text: Column, tag: str = "python") -> Column:
    """The code in a response.

    The first fence tagged ``tag``; else the longest fenced part; else the first definition with its
    indented body; else the whole text. Always stripped.
    """
    fence = "```"
    parts = F.split(text, fence, -1)
    inner = F.filter(parts, lambda _, i: i % 2 == 1)
    tagged = F.split(F.get(F.split(text, fence + tag, -1), F.lit(1)), fence, -1)[0]
    body = F.regexp_extract(text, DEFINITION, 1)
    return (
        F.when(text.contains(fence + tag), strip(tagged))
        .when(text.contains(fence) & (F.size(parts) >= 3), strip(longest(inner)))
        .when(body != "", strip(body)).otherwise(strip(text))
    )


def bare_code(text: Column) -> Column:
    """A response that starts with a fence, without its fences: the short way to get at the code.

    After a tagged fence all fence marks go; after a plain one the first and the last line.
    """
    fence = "```"
    whole = strip(text)
    rows = F.split(whole, "\n", -1)
    unfenced = strip(F.replace(whole, F.lit(fence)))
    return (
        F.when(whole.startswith(fence + "python"), strip(F.replace(F.replace(whole, F.lit(fence + "python")), F.lit(fence))))
        .when(whole.startswith(fence) & (F.size(rows) > 2), F.array_join(F.slice(rows, 2, F.size(rows) - 2), "\n"))
        .when(whole.startswith(fence), unfenced).otherwise(whole)
    )


def page_block(html: Column) -> Column:
    """The same preference order on markup: title, else the longest paragraph, else all visible text."""
    title = F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)
    paragraphs = F.regexp_extract_all(html, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    plain = strip(F.regexp_replace(html, r"<[^>]*>", " "))
    return F.coalesce(F.nullif(strip(title), F.lit("")), strip(longest(paragraphs)), plain)


def section(text: Column, label: str) -> Column:
    """What follows the first ``label`` up to the next one, stripped; NULL if there is no label."""
    return F.when(text.contains(label), strip(F.get(F.split(text, label, -1), F.lit(1))))


def verdict_parts(text: Column, fallback: Column) -> dict[str, Column]:
    """Passed flag, corrected text and whether that text was given but empty.

    An empty correction keeps ``fallback`` and sets the flag instead of wiping the text.
    """
    given = section(text, "CORRECTED_CODE:")
    cleaned = F.nullif(code_block(given), F.lit(""))
    return {
        "passed": text.contains("VALIDATION: PASSED"),
        "final_text": F.coalesce(cleaned, fallback),
        "empty_correction": F.coalesce(given.isNotNull() & cleaned.isNull(), F.lit(False)),
    }


def request_text(template: str, context_label: str, fields: dict[str, Column], context: Column) -> Column:
    """Fill ``{name}`` slots of a template; the context paragraph is left out where context is missing."""
    slots = {**fields, "context": F.when(
        context.isNotNull() & (context != ""), F.concat(F.lit(f"\n{context_label}\n"), context)
    ).otherwise("")}
    pieces, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            pieces.append(F.lit(head))
        if brace:
            name, _, tail = tail.partition("}")
            pieces.append(slots[name].cast("string"))
        rest = tail
    return F.concat(*pieces)


def wrap(text: Column, cols: int) -> Column:
    """Cut a text into pieces of at most ``cols`` characters that concatenate back to it.

    A piece ends before the last space that still fits; the space opens the next piece. Where no
    space fits beyond the first character, the piece is cut at ``cols``.
    """
    pieces = F.regexp_extract_all(
        text, F.lit(rf"(?s).{{1,{cols}}}(?= |\z)|.{{1,{cols}}}"), F.lit(0)
    )
    return F.when(text == "", F.array(F.lit(""))).otherwise(pieces)
