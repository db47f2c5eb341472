"""Text helpers as Column expressions, with the white space, case and length rules of browsers' script language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of browsers' scripts, as a regex class body. Java's \s is ASCII only.
WS_CHARS = "\t\n\x0b\x0c\r    -     　﻿"
WS = f"[{WS_CHARS}]"
#: An ASCII word boundary after a name; Java's \b knows all letters.
END = "(?![A-Za-z0-9_])"


def rx(s: str) -> Column:
    return F.lit(s)


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), where c is computed once however often f uses it; keeps expression trees from growing with each use."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def quoted(s: str) -> str:
    """s as a SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(c: Column, sql: str) -> Column:
    """let() with the function as SQL text, a lambda of one argument. Text that many columns share is parsed in one call
    each, where building it call by call would cost most of the time that a small audit takes."""
    return F.get(F.call_function("transform", F.array(c), F.expr(sql)), F.lit(0))


def sql_let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse_ws(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, f"{WS}+", " "))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def _numeric(x: str, digits: str, base: int, mark: str = "") -> str:
    """Numeric entities to characters; a number beyond the last code point becomes the replacement character."""
    pattern = f"&#{mark}({digits}+);"
    number = f"if(length(n) <= 8, cast(conv(n, {base}, 10) AS BIGINT), NULL)"
    char = sql_let(number, "v", "CASE WHEN v <= 1114111 AND NOT v BETWEEN 55296 AND 57343 THEN decode(unhex(lpad(hex(v), 8, '0')), 'UTF-32') ELSE '\ufffd' END")
    parts = f"split({x}, {quoted(pattern.replace('(', '(?:'))}, -1)"
    joined = f"array_join(zip_with({parts}, regexp_extract_all({x}, {quoted(pattern)}, 1), (p, n) -> concat(p, if(n IS NULL, '', {char}))), '')"
    return f"if({x} RLIKE {quoted(pattern)}, {joined}, {x})"


def decoded(x: str) -> str:
    """SQL of a text without entities: six named ones in a fixed order, then decimal and hexadecimal ones; what the first
    makes, later ones see."""
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        x = f"replace({x}, {quoted(name)}, {quoted(char)})"
    numeric = sql_let(_numeric("y", "[0-9]", 10), "z", _numeric("z", "[0-9a-fA-F]", 16, "[xX]"))
    return sql_let(x, "y", f"if(contains(y, '&#'), {numeric}, y)")


def decode_entities(c: Column) -> Column:
    return bind(c, f"x -> {decoded('x')}")


def strip_tags(c: Column) -> Column:
    return collapse_ws(decode_entities(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")))


def visible_text(c: Column) -> Column:
    for tag in ("script", "style", "noscript", "template"):
        c = F.regexp_replace(c, f"(?is)<{tag}.*?</{tag}>", " ")
    return strip_tags(c)


def body_only(html: Column) -> Column:
    """From the first <body> to the last </body>; the whole document if either is missing."""
    pattern = f"(?is)<body{END}[^>]*>(.*)</body>"
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1)).otherwise(html)


def attribute(attrs: Column, name: str) -> Column:
    """An attribute's decoded, trimmed value; null if it is absent or has no value."""
    pattern = rf"(?i){WS}{name}{WS}*={WS}*(\"[^\"]*\"|'[^']*'|[^{WS_CHARS}>]+)"
    in_quotes = "(?s)^\".*\"$|^'.*'$"
    inner = f"if(x RLIKE {quoted(in_quotes)}, substring(x, 2, length(x) - 2), x)"
    trimmed = f"regexp_replace({decoded(inner)}, {quoted(f'^{WS}+|{WS}+$')}, '')"
    return bind(attrs, "t -> " + sql_let(f"regexp_extract(t, {quoted(pattern)}, 1)", "x", f"if(x <> '', {trimmed}, NULL)"))


def find_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, rx(pattern), F.lit(0))


def tag_attrs(tag: Column) -> Column:
    """What stands between the name of a tag and its first >."""
    return F.regexp_extract(tag, "(?s)^<[A-Za-z0-9]+([^>]*)>", 1)


def inner_html(element: Column) -> Column:
    """What stands between an element's start and end tags."""
    return F.regexp_extract(element, "(?s)^<[^>]*>(.*)</[^<]*$", 1)


def sentence_count(text: Column) -> Column:
    """Pieces between sentence ends, of a text whose white space is collapsed."""
    return F.when(trim_ws(text) == "", 0).otherwise(1 + F.regexp_count(text, rx(f"(?<=[.!?]){WS}+(?=[A-ZА-ЯЁ])"))).cast("int")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, rx(f"[^{WS_CHARS}]+")).cast("long")


def round_half_up(c: Column) -> Column:
    """floor(x + 0.5) in doubles, which decimal rounding is not."""
    return F.floor(c + F.lit(0.5))
