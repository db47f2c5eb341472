"""URL helpers as Column expressions, after the rules browsers follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import WS, bind, let, quoted, sql_let, trim_ws

ABSOLUTE = r"(?is)^(https?)://(?:[^/?#]*@)?([^/?#:@]+)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
#: A host that is more than plain lower-case names: other characters, escapes, or a number as its last part.
ODD_HOST = r"[^a-z0-9._-]|(^|\.)(0[xX][0-9a-fA-F]*|[0-9]+)\.?$"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 host, 3 port, 4 path, 5 query with its mark, 6 fragment with its mark."""
    return F.regexp_extract(trim_ws(url), ABSOLUTE, n)


def is_absolute(url: Column) -> Column:
    return F.coalesce(trim_ws(url).rlike(ABSOLUTE), F.lit(False))


def _parts(u: str) -> str:
    """SQL of all parts as a struct: scheme and host in lower case, user with its mark, port, path, query, fragment. The host is as it stands."""
    part_ = lambda n: f"regexp_extract(u, {quoted(ABSOLUTE)}, {n})"
    user = f"if(contains(u, '@'), regexp_replace(regexp_extract(u, {quoted(r'(?is)^https?://([^/?#]*@)')}, 1), ':?@$', '@'), '')"
    parts = f"struct(lower({part_(1)}) AS scheme, lower({part_(2)}) AS host, if({user} = '@', '', {user}) AS user, {part_(3)} AS port, {part_(4)} AS path, {part_(5)} AS query, {part_(6)} AS fragment)"
    return sql_let(_slashed(_trimmed(u)), "u", parts)


def _slashed(u: str) -> str:
    """Backslashes before the query are slashes, as browsers read them."""
    turned = "concat(translate(regexp_extract(w, '(?s)^[^?#]*', 0), '\\\\', '/'), regexp_extract(w, '(?s)[?#].*$', 0))"
    return sql_let(u, "w", f"if(contains(w, '\\\\'), {turned}, w)")


def _punycode(l: str) -> str:
    """SQL of a label in ASCII, by the Bootstring coding of internationalised names (RFC 3492, whose parameters are fixed values).

    A state machine over (code point to insert, code point of the label), in order: the delta so far, the bias, how
    many points are coded, and the digits.
    """
    digit = "substr('abcdefghijklmnopqrstuvwxyz0123456789', cast({} AS INT) + 1, 1)"
    rest = "(z.q - t) div (36 - t)"
    number = f"if(z.q < t, struct(0L AS q, concat(z.o, {digit.format('z.q')}) AS o, true AS done), struct({rest} AS q, concat(z.o, {digit.format('t + (z.q - t) % (36 - t)')}) AS o, false AS done))"
    digits = f"aggregate(sequence(1, 9), struct(d AS q, '' AS o, false AS done), (z, i) -> if(z.done, z, {sql_let('cast(greatest(1, least(26, 36 * i - a.bias)) AS BIGINT)', 't', number)}), z -> z.o)"
    halved = sql_let("d div if(a.h = b, 700, 2)", "w", "w + w div (a.h + 1)")
    bias = f"aggregate(sequence(1, 6), struct({halved} AS v, 0L AS k), (z, i) -> if(z.v > 455, struct(z.v div 35 AS v, z.k + 36 AS k), z), z -> z.k + 36 * z.v div (z.v + 38))"
    further = "CASE WHEN NOT e.first THEN a.delta WHEN a.n = 0 THEN (e.m - 128) * (a.h + 1) ELSE a.delta + 1 + (e.m - a.n - 1) * (a.h + 1) END + if(e.c < e.m, 1, 0)"
    coded = f"struct(e.m AS n, 0L AS delta, {bias} AS bias, a.h + 1 AS h, concat(a.o, {digits}) AS o)"
    step = sql_let(further, "d", f"if(e.c = e.m, {coded}, struct(e.m AS n, d AS delta, a.bias AS bias, a.h AS h, a.o AS o))")
    events = "flatten(transform(array_sort(array_distinct(filter(cs, c -> c >= 128))), m -> transform(cs, (c, i) -> struct(m AS m, c AS c, i = 0 AS first))))"
    whole = f"aggregate({events}, struct(0L AS n, 0L AS delta, 72L AS bias, b AS h, '' AS o), (a, e) -> {step}, a -> a.o)"
    basic = f"array_join(filter(split({l}, ''), x -> ascii(x) < 128), '')"
    points = f"transform(split({l}, ''), x -> cast(ascii(x) AS BIGINT))"
    count = "cast(size(filter(cs, c -> c < 128)) AS BIGINT)"
    return sql_let(points, "cs", sql_let(count, "b", f"concat('xn--', {basic}, if(b = 0L, '', '-'), {whole})"))


def _host(h: str) -> str:
    """SQL of a host as browsers write it: escapes decoded, names in ASCII by IDNA, numbers as a dotted address; '' if it is none.

    Names are mapped to lower case, with the full stops of East Asian scripts as dots and without soft hyphens and other
    ignored marks; compatibility forms of letters are left as they are.
    """
    unescaped = "lower(if(contains(h, '%'), coalesce(try_url_decode(h), ''), h))"
    mapped = "translate(k, '\u3002\uFF0E\uFF61\u00AD\u200B\u2060\uFEFF', '...')"
    label = f"if(l RLIKE {quoted(r'[^\x00-\x7F]')}, {_punycode('l')}, l)"
    ascii_ = f"if(k RLIKE {quoted(r'[^\x00-\x7F]')}, array_join(transform(split({mapped}, {quoted(r'\.')}), l -> {label}), '.'), k)"
    number = f"CASE WHEN x RLIKE '^0x[0-9a-f]{{1,12}}$' THEN cast(conv(substr(x, 3), 16, 10) AS BIGINT) WHEN x = '0x' THEN 0L WHEN x RLIKE '^0[0-7]{{1,15}}$' THEN cast(conv(x, 8, 10) AS BIGINT) WHEN x RLIKE '^(0|[1-9][0-9]{{0,11}})$' THEN cast(x AS BIGINT) END"
    sound = "size(n) <= 4 AND NOT exists(n, x -> x IS NULL) AND NOT exists(slice(n, 1, size(n) - 1), x -> x > 255) AND element_at(n, -1) < shiftleft(1L, 8 * (5 - size(n)))"
    whole = "aggregate(slice(n, 1, size(n) - 1), struct(0L AS v, 24 AS s), (a, x) -> struct(a.v + shiftleft(x, a.s) AS v, a.s - 8 AS s), a -> a.v) + element_at(n, -1)"
    dotted = sql_let(whole, "v", "concat_ws('.', transform(array(24, 16, 8, 0), s -> cast(shiftright(v, s) & 255 AS STRING)))")
    address = sql_let(f"transform(split(regexp_replace(m, {quoted(r'\.$')}, ''), {quoted(r'\.')}), x -> {number})", "n", f"if({sound}, {dotted}, '')")
    numeric = f"if(m RLIKE {quoted(r'(^|\.)(0x[0-9a-f]*|[0-9]+)\.?$')}, {address}, m)"
    bad = f"if(m RLIKE {quoted(r'[\x00-\x20#%/:<>?@\[\\\]^|\x7F]')}, '', {numeric})"
    odd = sql_let(unescaped, "k", sql_let(ascii_, "m", bad))
    return sql_let(h, "g", f"if(g RLIKE {quoted(ODD_HOST)}, {sql_let('g', 'h', odd)}, lower(g))")


def _trimmed(x: str) -> str:
    return f"regexp_replace({x}, {quoted(f'^{WS}+|{WS}+$')}, '')"


def _percent_encode(x: str) -> str:
    """Characters outside visible ASCII, and quotes and angle brackets, as UTF-8 percent escapes."""
    one = "if(ch RLIKE '^[!#-;=?-~]$', ch, regexp_replace(hex(encode(ch, 'UTF-8')), '(..)', '%$1'))"
    return sql_let(x, "x", f"if(x RLIKE '[^!#-;=?-~]', array_join(transform(split(x, ''), ch -> {one}), ''), x)")


def percent_encode(c: Column) -> Column:
    return bind(c, f"c -> {_percent_encode('c')}")


def _dots(path: str) -> str:
    """A path without . and .. segments."""
    step = "(acc, s) -> CASE WHEN s = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 1)) WHEN s = '.' THEN acc ELSE array_append(acc, s) END"
    fold = f"array_join(aggregate(split(p, '/', -1), CAST(array() AS ARRAY<STRING>), {step}), '/')"
    dot_end, dot_part = quoted(r"/\.\.?$"), quoted(r"/\.\.?(/|$)")
    ended = sql_let(fold, "f", f"if(p RLIKE {dot_end} AND NOT endswith(f, '/'), concat(f, '/'), f)")
    return sql_let(path, "p", f"if(p RLIKE {dot_part}, {ended}, p)")


def _origin(p: str, host: str | None = None) -> str:
    default = f"{p}.port = '' OR ({p}.scheme = 'http' AND {p}.port = '80') OR ({p}.scheme = 'https' AND {p}.port = '443')"
    return f"concat({p}.scheme, '://', {p}.user, {host or p + '.host'}, if({default}, '', concat(':', {p}.port)))"


def _canonical(u: str, fragment: bool = True, host: Callable[[str], str] = _host) -> str:
    path = _percent_encode(_dots("if(q.path = '', '/', q.path)"))
    tail = _percent_encode("q.fragment") if fragment else "''"
    whole = f"concat({_origin('q', 'y')}, {path}, {_percent_encode('q.query')}, {tail})"
    return "coalesce(" + sql_let(_parts(u), "q", sql_let(host("q.host"), "y", f"if(y <> '', {whole}, '')")) + ", '')"


def canonical_url(url: Column, fragment: bool = True) -> Column:
    """An absolute URL as browsers write it; empty if it is none."""
    return bind(url, f"c -> {_canonical('c', fragment)}")


def normalize_url(url: Column) -> Column:
    """Without fragment, host in lower case; query and trailing slash stay; empty if invalid."""
    return canonical_url(url, fragment=False)


def resolve_url(href: Column, base: Column) -> Column:
    """href against base: absolute, scheme-relative, root-relative, query, fragment, or relative to the base's folder."""
    folder = sql_let("regexp_extract(b.path, '(?s)^(.*/)', 1)", "f", "if(f = '', '/', f)")
    origin = _origin("b")
    full = (
        "CASE WHEN h RLIKE '(?i)^https?://' THEN h WHEN b.host = '' THEN '' WHEN startswith(h, '//') THEN concat(b.scheme, ':', h)"
        f" WHEN startswith(h, '/') THEN concat({origin}, h) WHEN startswith(h, '?') THEN concat({origin}, b.path, h)"
        f" WHEN startswith(h, '#') OR h = '' THEN concat({origin}, b.path, b.query, h) ELSE concat({origin}, {folder}, h) END"
    )
    # hosts stay as they are written but for case: whoever compares links normalises them, and this keeps plans small
    whole = _canonical(sql_let(_parts("r.base"), "b", full), host=lambda h: h)
    other_scheme = "h RLIKE '(?i)^[a-z][a-z0-9+.-]*:' AND NOT h RLIKE '(?i)^https?:'"
    return bind(F.struct(href.alias("href"), base.alias("base")), "r -> " + sql_let(_trimmed("r.href"), "h", f"if({other_scheme}, h, {whole})"))


def site_of(url: Column) -> Column:
    """The host in lower case without one leading www.; a scheme is assumed where there is none."""
    u = trim_ws(url)
    full = F.when(u.rlike(r"(?i)^[a-z][a-z0-9+.-]*:[/\\]{2}"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.regexp_replace(host_of(full), r"^www\.", "")


def host_of(url: Column) -> Column:
    """The host as browsers write it; empty if there is none. A null URL has none either, but null."""
    turned = _slashed(_trimmed("c"))
    return bind(url, "c -> " + sql_let(turned, "u", _host(f"regexp_extract(u, {quoted(ABSOLUTE)}, 2)")))


def url_path(url: Column) -> Column:
    """The path; / for a bare origin or an invalid URL."""
    return let(part(url, 4), lambda p: F.when(p == "", "/").otherwise(p))


def url_depth(url: Column) -> Column:
    return F.when(is_absolute(url), F.size(F.filter(F.split(part(url, 4), "/"), lambda x: x != ""))).otherwise(0)


def url_hash(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


def filename_of(src: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.coalesce(src, F.lit("")), r"(?s)[?#].*$", ""), "/", -1), -1)


def strip_www(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def is_www_alias(a: Column, b: Column) -> Column:
    """Whether two hosts differ by a leading www. alone."""
    return (F.lower(a) != F.lower(b)) & (strip_www(a) == strip_www(b))


def host_aliases(requested: Column, canonical: Column) -> Column:
    """Hosts that a crawl of `requested` may follow."""
    both = F.array(F.lower(requested), F.lower(canonical))
    return F.when(canonical.isNull() | (canonical == "") | ~is_www_alias(requested, canonical), F.array(F.lower(requested))).otherwise(both)
