"""Text as Column to Column functions; all run in the JVM.

Lengths count code points. White space is what ECMAScript calls so, a wider class than Java's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import STOPWORDS

#: White space beyond Java's ``\s``; line and paragraph separators end a line.
WIDE = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\ufeff"
ENDS = "\u2028\u2029\r"
SPACE = f"[\\s\x0b{WIDE}\u2028\u2029]"
HASH_CHARS, LEAST_HASHED = 400, 40


def plain_spaces(c: Column) -> Column:
    """Wide white space as plain, so that what follows needs plain patterns only."""
    return F.translate(c, WIDE + ENDS, " " * len(WIDE) + "\n" * len(ENDS))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\x0c" + WIDE + ENDS))


def squeeze(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(plain_spaces(c), r"\s+", " "))


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_for_hash(c: Column) -> Column:
    """The text that exact duplicates share: lower case without code fences, URLs, list and heading marks and directories, 400 characters at most."""
    c = plain_spaces(F.lower(c))
    c = F.regexp_replace(c, r"```[\s\S]*?```", " ")
    c = F.regexp_replace(c, r"https?://\S+", " ")
    c = F.regexp_replace(c, r"(?md)^[ \t]*[#\-*+]+\s+", "")
    c = F.regexp_replace(c, r"(^|\s)(?:[\w.-]++/)+([\w.-]+\.\w+)", "$1$2")
    return F.left(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(HASH_CHARS))


def content_hash(normalized: Column) -> Column:
    return F.sha2(normalized, 256)


def truncate(c: Column, limit: int) -> Column:
    return F.left(squeeze(c), F.lit(limit))


def preview(c: Column, limit: int = 200) -> Column:
    """A squeezed, cut text; null if blank."""
    return none_if_empty(truncate(c, limit))


def clip(c: Column, cap: int) -> Column:
    """A squeezed text that says how much was cut."""
    flat = squeeze(c)
    over = F.char_length(flat) - cap
    return F.when(over <= 0, flat).otherwise(F.concat(F.left(flat, F.lit(cap)), F.lit("…(+"), over.cast("string"), F.lit(" chars)")))


def ellipsis(c: Column, limit: int) -> Column:
    return F.when(F.char_length(c) <= limit, c).otherwise(F.concat(F.left(c, F.lit(limit - 1)), F.lit("…")))


def cut_title(c: Column, limit: int = 48) -> Column:
    """A cut at the last space if that keeps two thirds, else mid-word; with an ellipsis."""
    raw = trim(c)
    room = limit - 1
    head = F.left(raw, F.lit(room))
    space = room - F.instr(F.reverse(F.rpad(head, room, "\u0000")), " ")  # 0-based place of the last space; room if none
    keep = F.when((space < room) & (space >= int(room * 0.66)), space).otherwise(F.lit(room))
    return F.when(F.char_length(raw) <= limit, raw).otherwise(F.concat(F.regexp_replace(F.left(head, keep), f"{SPACE}+$", ""), F.lit("…")))


def tokens(c: Column, stopwords=STOPWORDS) -> Column:
    """Distinct words of three letters or more, in the order in which they appear."""
    runs = F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: F.octet_length(w) > 2)
    return F.array_except(runs, F.array(*[F.lit(w) for w in stopwords])) if stopwords else F.array_distinct(runs)


def basename(c: Column) -> Column:
    """The last part of a path with either separator; null if there is none."""
    whole = F.regexp_replace(trim(c), r"[\\/]+$", "")
    return none_if_empty(F.regexp_extract(whole, r"([^\\/]*)$", 1))


def strip_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"[#*`>]", "")


def escape_html(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def format_bytes(c: Column) -> Column:
    kb, mb = c / 1024.0, c / (1024.0 * 1024.0)
    return F.when(c < 1024, F.format_string("%d B", c.cast("long"))).when(kb < 1024, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.1f MB", mb))


def format_usd(c: Column) -> Column:
    """Two decimals; from a thousand on in thousands with one."""
    return F.when(c >= 1000, F.concat(F.lit("$"), F.format_string("%.1f", c / 1000), F.lit("k"))).otherwise(F.concat(F.lit("$"), F.format_string("%.2f", c)))


def format_count(c: Column) -> Column:
    """Thousands and millions with one decimal."""
    v = c.cast("double")
    return F.when(c >= 1_000_000, F.format_string("%.1fM", v / 1_000_000)).when(c >= 1000, F.format_string("%.1fk", v / 1000)).otherwise(c.cast("string"))


def format_average(c: Column) -> Column:
    """One decimal below ten, none above."""
    return F.when(c < 10, F.format_string("%.1f", c)).otherwise(F.round(c).cast("long").cast("string"))


def inline_html(c: Column) -> Column:
    """Inline Markdown as HTML: everything is escaped first, then code, bold, italics and web links become elements."""
    c = escape_html(c)
    for pattern, markup in ((r"`([^`\n]+)`", "<code>$1</code>"), (r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>"), (r"(?<![*\w])\*([^*\n]+)\*(?![*\w])", "<em>$1</em>"), (r"\[([^\]\n]+)\]\((https?://[^\s)]+)\)", '<a href="$2">$1</a>')):
        c = F.regexp_replace(c, pattern, markup)
    return c


def word_pattern(name: str) -> str:
    """A case-insensitive pattern for a literal name between ASCII word boundaries."""
    import re

    word = "[A-Za-z0-9_]"
    lead = f"(?<!{word})" if re.match(word, name) else f"(?<={word})"
    tail = f"(?!{word})" if re.search(word + r"\Z", name) else f"(?={word})"
    return f"(?iu){lead}{re.escape(name)}{tail}"
