"""Text functions as columns. Regular expressions use Unicode classes, as white space and word characters do in markup tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of tags, list markers, page references and sentence ends that texts are read by.
#: A tag: slash, name, attributes, trailing slash.
TAG = r"(?U)<\s*(/?)\s*([A-Za-z][\w.-]*)([^<>]*?)(/?)\s*>"
#: A tag of TAG without blanks, attributes and letters beyond ASCII: its name.
PLAIN_TAG = r"\A</?([A-Za-z][A-Za-z0-9_.-]*)/?>\z"
#: A list marker: a bullet, or an ordinal of up to four characters.
MARKER = r"(?:[•\-\*◦▪‣]|\(?[a-zA-Z0-9]{1,4}(?:\.\)|[.)]))"
ORDINAL = r"\(?[a-zA-Z0-9]{1,4}(?:\.\)|[.)])"
PAGE_REF = r"(?iU)\(\s*(?:see\s+)?(?:pages?|pgs?\.?|pp?\.?)\s*\d+(?:\s*[-–—]\s*\d+)?[^)]*\)"
SENTENCE_END = r"""(?U)[.!?:;)"']\s*\z"""


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def has_text(text: Column) -> Column:
    """Whether anything but white space is in it."""
    return text.rlike(r"(?U)\S")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def squash(text: Column) -> Column:
    """Without white space between two tags."""
    return strip(F.regexp_replace(text, r"(?U)>\s+<", "><"))


def strip_envelope(text: Column) -> Column:
    """Without code fences at either end, XML declarations and doctypes."""
    text = F.regexp_replace(strip(text), r"(?U)\A```[A-Za-z]*\s*|\s*```\z", "")
    return strip(F.regexp_replace(text, r"(?s)<\?xml.*?\?>|(?i:<!doctype[^>]*>)", ""))


def count_of(text: Column, part: str) -> Column:
    """How often a single character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def line_of(text: Column, at: Column) -> Column:
    """The line, from 1, of a 0-based offset."""
    return count_of(F.substring(text, 1, at), "\n") + 1


def attr_int(attrs: Column, name: str, default: int = 1) -> Column:
    """The first number after an attribute's equals sign, 1 at least."""
    found = F.regexp_extract(attrs, rf"""(?iU)\b{name}\s*=\s*["']?\s*(\d+)""", 1)
    return F.when(found == "", F.lit(default)).otherwise(F.greatest(F.lit(1), found.try_cast("int")))


def attr_text(attrs: Column, name: str) -> Column:
    """A quoted attribute's value, null without one."""
    found = F.regexp_extract(attrs, rf"""(?iU)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 0)
    return F.when(found != "", F.regexp_replace(found, r"""(?isU)\A\w+\s*=\s*["']|["']\z""", ""))


def escape_html(text: Column) -> Column:
    """The five characters of markup as references, ampersands first."""
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(ref))
    return text


def flag_page_refs(text: Column) -> Column:
    """Page references inside a flag span."""
    return F.regexp_replace(text, f"({PAGE_REF})", '<span class="page-ref-flag">$1</span>')


def shape(text: Column) -> Column:
    """A cell's pattern: digits as 9, letters as A, no spaces."""
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), r"(?U)\d", "9"), "[A-Za-z]", "A")


def comma_repair(text: Column) -> Column:
    """A period between a letter and a space before more text becomes a comma."""
    return F.regexp_replace(text, r"(?U)([A-Za-z])\. (?=\S)", "$1, ")


def compared(text: Column) -> Column:
    """The form in which two readings are compared."""
    return F.upper(collapse(comma_repair(text)))


def case_suspect(text: Column) -> Column:
    """Lower case in a token that a digit leads."""
    return text.rlike(r"(?U)\d[A-Z]*[a-z]")


def plain_words(text: Column) -> Column:
    """A markup text's words, tags apart."""
    return F.filter(F.split(F.regexp_replace(text, "<[^>]*>", " "), r"(?U)\s+"), lambda w: w != "")


def first_line_label(text: Column, default: str = "Untitled") -> Column:
    """The heading on the first line, or the default."""
    first = F.substring_index(text, "\n", 1)
    return F.when(first.startswith("# "), strip(F.substring(first, 3, 1 << 30))).otherwise(F.lit(default))


def join_lines(lines: Column) -> Column:
    """Lines joined by spaces, leading empty ones left out; a hyphen at a line's end between lower-case letters goes. Each seam is decided by the two lines that meet there."""
    first = F.array_position(F.transform(lines, lambda t: t != ""), True).cast("int")
    rest = lambda k: F.slice(lines, first + k, F.greatest(F.size(lines) - first + 1 - k, F.lit(0)))

    def seam(line: Column, following: Column) -> Column:
        wraps = line.rlike(r"[a-z]-\z") & following.rlike(r"\A\p{Ll}")
        return F.when(following.isNull(), line).when(wraps, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(F.concat(line, F.lit(" ")))

    return F.when(F.size(lines) == 1, F.coalesce(F.get(lines, F.lit(0)), F.lit(""))).when(first > 0, F.array_join(F.zip_with(rest(0), rest(1), seam), "")).otherwise("")


def ascii_only(text: Column) -> Column:
    """Without characters beyond ASCII, and without white space at the ends."""
    return strip(F.regexp_replace(text, r"[^\x00-\x7F]", ""))


def indent_of(text: Column, at: Column) -> Column:
    """The blanks that the line of a 0-based offset begins with."""
    before = F.substring_index(F.substring(text, F.lit(1), at.cast("int")), "\n", -1)
    line = F.concat(before, F.substring_index(F.substring(text, at.cast("int") + 1, F.length(text)), "\n", 1))
    return F.regexp_extract(line, r"\A[ \t]*", 0)


def bare_paragraph(text: Column) -> Column:
    """Plain text as a paragraph, white space collapsed; null for blank text."""
    return F.when(collapse(text) != "", F.concat(F.lit("<para>"), escape_html(collapse(text)), F.lit("</para>")))


def download_name(name: Column, default: str = "cropped") -> Column:
    """A file name without its extension and without characters that file systems refuse; the default where nothing is left."""
    base = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*\z", ""), r'[\\/:*?"<>|\x00-\x1f]', "")
    return F.coalesce(F.nullif(F.trim(base), F.lit("")), F.lit(default))


def pdf_string_bytes(operand: Column) -> Column:
    """The bytes of a string operand: <hex> without white space, or (literal) with escaped brackets and backslashes; null for hex of odd length."""
    inner = F.substring(operand, F.lit(2), F.length(operand) - 2)
    digits = F.regexp_replace(inner, r"\s", "")
    literal = F.encode(F.regexp_replace(inner, r"\\([\\()])", "$1"), "ISO-8859-1")
    return F.when(operand.startswith("<"), F.when(F.length(digits) % 2 == 0, F.unhex(digits))).otherwise(literal)
