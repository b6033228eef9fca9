"""Text of HTML in column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions.text import SPACE

BLOCKS = "p|div|br|li|ul|ol|tr|table|h[1-6]|pre|blockquote|section|article|hr"


def _sign(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def decoded(t: Column) -> Column:
    """Character references replaced, once: decimal, hexadecimal and named ones (the 252 names of HTML 4 and apos)."""
    names = F.create_map(*(x for k, v in {**name2codepoint, "apos": 39}.items() for x in (F.lit(k), F.lit(v))))
    parts = F.split(t, "&")

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7)).cast("int")
        code = F.coalesce(number, F.try_element_at(names, name))
        ok = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(ok, F.concat(_sign(code), F.substr(p, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), p))

    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    return F.when(t.contains("&"), F.concat(F.get(parts, 0), F.array_join(rest, ""))).otherwise(t)


def text_of(html: Column) -> Column:
    """Block tags become line ends, other tags go, scripts and styles go whole, white space is folded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    t = F.regexp_replace(t, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    t = decoded(F.regexp_replace(t, r"<[^>]*>", ""))
    t = F.regexp_replace(F.regexp_replace(t, rf"[{SPACE}&&[^\n]]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def markdown_of(html: Column) -> Column:
    """Headings, list items, bold, italics, code and links as Markdown, the rest as text."""
    t = html
    for n in range(1, 7):
        t = F.regexp_replace(t, rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}\s*>", "\n" + "#" * n + " $1\n")
    for pattern, put in ((r"(?is)<li\b[^>]*>\s*", "\n- "), (r"(?is)</?(?:b|strong)\b[^>]*>", "**"), (r"(?is)</?(?:i|em)\b[^>]*>", "*"), (r"(?is)</?pre\b[^>]*>", "\n```\n"), (r"(?is)</?code\b[^>]*>", "`"), (r"(?is)<a\b[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a\s*>", "[$2]($1)")):
        t = F.regexp_replace(t, pattern, put)
    return text_of(t)
