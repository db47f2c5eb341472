"""Raw pages to page snapshots: one row in, one row out, built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.functions.text import END, WS, WS_CHARS, attribute, bind, body_only, find_all, inner_html, let, sentence_count, sql_let, strip_tags, tag_attrs, trim_ws, utf16_length, visible_text, word_count

HEADING = rf"(?is)<h([1-6]){END}[^>]*>.*?</h\1>"
ANCHOR = f"(?is)<a{END}[^>]*>.*?</a>"
CHROME = rf"(?is)<(nav|header|footer){END}[^>]*>.*?</\1>"
IMAGE = f"(?i)<img{END}[^>]*>"
LIST = rf"(?is)<(ul|ol){END}[^>]*>.*?</\1>"
OVERLAY_WORDS = "(?i)(cookie|gdpr|consent|interstitial|paywall|subscribe-modal|newsletter-modal)"
OVERLAY_PLACE = rf"(?i)position{WS}*:{WS}*fixed|class=[\"'][^\"']*(modal|overlay|interstitial|consent)"
BREADCRUMB = rf"(?i)aria-label{WS}*={WS}*[\"'][^\"']*breadcrumb|<nav[^>]*class=[\"'][^\"']*breadcrumb"
LD_JSON = rf"(?is)<script{END}[^>]*type=[\"']application/ld\+json[\"'][^>]*>.*?</script>"


def _metas(html: Column) -> Column:
    return F.transform(find_all(html, f"(?i)<meta{END}[^>]*>"), tag_attrs)


def _link_tags(html: Column) -> Column:
    return F.transform(find_all(html, f"(?i)<link{END}[^>]*>"), tag_attrs)


def page_title(html: Column) -> Column:
    return strip_tags(F.regexp_extract(html, f"(?is)<title{END}[^>]*>(.*?)</title>", 1))


def page_lang(html: Column) -> Column:
    return F.lower(F.coalesce(attribute(F.regexp_extract(html, f"(?i)<html{END}([^>]*)>", 1), "lang"), F.lit("")))


def headings(body: Column) -> Column:
    """Every non-empty heading, in order: level and text."""
    each = F.transform(find_all(body, HEADING), lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), strip_tags(inner_html(h)).alias("text")))
    return F.filter(each, lambda h: h["text"] != "")


def of_level(all_headings: Column, level: int) -> Column:
    return F.transform(F.filter(all_headings, lambda h: h["level"] == level), lambda h: h["text"])


def links(body: Column, base: Column | None = None) -> Column:
    """Anchors with an href, in order: href, resolved (empty without a base), text, rel, nofollow."""

    def one(a: Column) -> Column:
        raw = let(tag_attrs(a), lambda t: F.struct(attribute(t, "href").alias("href"), F.coalesce(attribute(t, "rel"), F.lit("")).alias("rel")))

        def row(r: Column) -> Column:
            resolved = urls.resolve_url(r["href"], base) if base is not None else F.lit("")
            return F.struct(r["href"].alias("href"), resolved.alias("resolved"), strip_tags(inner_html(a)).alias("text"), r["rel"].alias("rel"), r["rel"].rlike(r"(?i)(?<![A-Za-z0-9_])nofollow(?![A-Za-z0-9_])").alias("nofollow"))

        return let(raw, row)

    return F.filter(F.transform(find_all(body, ANCHOR), one), lambda x: x["href"].isNotNull() & (x["href"] != ""))


def segments(body: Column) -> Column:
    """The body cut at navigation, header and footer elements, in order: html and in_chrome."""
    outside, inside = F.split(body, CHROME, -1), find_all(body, CHROME)
    pair = F.zip_with(outside, inside, lambda o, i: F.array(F.struct(o.alias("html"), F.lit(False).alias("in_chrome")), F.struct(i.alias("html"), F.lit(True).alias("in_chrome"))))
    return F.filter(F.flatten(pair), lambda s: s["html"].isNotNull())


def inline_source(src: Column) -> Column:
    return let(trim_ws(src), lambda t: (t == "") | t.startswith("data:") | t.rlike(r"^https?://.{0,5}$"))


def images(body: Column, base: Column | None = None) -> Column:
    """Images in order, with what their attributes say and whether they stand in navigation, header or footer."""
    number = lambda a: F.when(F.coalesce(a, F.lit("")) == "", 0.0).otherwise(a.try_cast("double"))

    def one(tag: Column, in_chrome: Column) -> Column:
        attrs = F.regexp_extract(tag, "(?s)^<[A-Za-z]+(.*)>$", 1)
        src = F.coalesce(F.nullif(attribute(attrs, "src"), F.lit("")), attribute(attrs, "data-src"), F.lit(""))
        raw = F.struct(src.alias("src"), *(attribute(attrs, a).alias(n) for a, n in (("alt", "alt"), ("aria-hidden", "hidden"), ("role", "role"), ("width", "w"), ("height", "h"))))

        def row(r: Column) -> Column:
            decorative = F.coalesce(r["alt"] == "", F.lit(False)) | F.coalesce(r["hidden"] == "true", F.lit(False)) | F.coalesce(r["role"] == "presentation", F.lit(False))
            resolved = urls.resolve_url(r["src"], base) if base is not None else F.lit("")
            return F.struct(
                r["src"].alias("src"), resolved.alias("resolved"), F.coalesce(r["alt"], F.lit("")).alias("alt"), r["alt"].isNull().alias("alt_missing"), decorative.alias("decorative"), urls.filename_of(r["src"]).alias("filename"),
                inline_source(r["src"]).alias("src_empty"), number(r["w"]).alias("width"), number(r["h"]).alias("height"), in_chrome.alias("in_chrome"),
            )

        return let(raw, row)

    return F.flatten(F.transform(segments(body), lambda s: F.transform(find_all(s["html"], IMAGE), lambda t: one(t, s["in_chrome"]))))


def json_ld(html: Column) -> Column:
    """Blocks of structured data, as variants: the items of an array or of a top-level @graph, or the one object.

    Blocks that are no JSON, and items that are no objects, are skipped.
    """
    parsed = F.filter(F.transform(find_all(html, LD_JSON), lambda s: F.try_parse_json(trim_ws(inner_html(s)))), lambda v: v.isNotNull())
    as_list = lambda v, p: F.try_variant_get(v, p, "array<variant>")

    def items(v: Column) -> Column:
        return F.when(F.schema_of_variant(v).startswith("ARRAY"), as_list(v, "$")).otherwise(F.coalesce(as_list(v, "$['@graph']"), F.array(v)))

    return F.filter(F.flatten(F.transform(parsed, items)), lambda v: v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"))


def field(block: Column, name: str) -> Column:
    return F.try_variant_get(block, f"$['{name}']", "variant")


def truthy(v: Column) -> Column:
    """What scripts take for true: not null, false, 0 or the empty string."""
    zero = "coalesce(try_cast(s.text AS DOUBLE) = 0.0, false)"
    false_ = f"s.kind = 'VOID' OR (s.kind = 'BOOLEAN' AND s.text = 'false') OR (s.kind = 'STRING' AND s.text = '') OR (s.kind RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' AND {zero})"
    test = sql_let("struct(schema_of_variant(x) AS kind, try_cast(x AS STRING) AS text)", "s", f"NOT ({false_})")
    return F.coalesce(bind(v, f"x -> if(x IS NOT NULL, {test}, NULL)"), F.lit(False))


def ld_types(blocks: Column) -> Column:
    def of(b: Column) -> Column:
        t = field(b, "@type")
        kind = F.schema_of_variant(t)
        return F.when(kind == "STRING", F.array(t.try_cast("string"))).when(kind.startswith("ARRAY"), F.try_variant_get(b, "$['@type']", "array<string>")).otherwise(F.array().cast("array<string>"))

    return F.filter(F.flatten(F.transform(blocks, lambda b: F.coalesce(of(b), F.array().cast("array<string>")))), lambda t: t.isNotNull())


def ld_dates(blocks: Column) -> Column:
    def of(b: Column) -> Column:
        return F.array_compact(F.array(*(F.when(truthy(field(b, n)), F.concat(F.lit(f"{n}="), field(b, n).try_cast("string"))) for n in ("datePublished", "dateModified"))))

    return F.flatten(F.transform(blocks, of))


def forms(body: Column) -> Column:
    """forms, buttons, unlabeled and controls. A control is labelled by a label's for, or by an aria attribute."""
    label_for = F.filter(F.transform(find_all(body, f"(?is)<label{END}[^>]*>.*?</label>"), lambda x: attribute(tag_attrs(x), "for")), lambda x: x.isNotNull() & (x != ""))
    empty = lambda t, n: F.coalesce(attribute(t, n), F.lit(""))
    control = lambda t: F.struct(F.lower(F.regexp_extract(t, "^<([A-Za-z]+)", 1)).alias("tag"), let(tag_attrs(t), lambda x: F.struct(F.lower(empty(x, "type")).alias("type"), empty(x, "id").alias("id"), empty(x, "aria-label").alias("label"), empty(x, "aria-labelledby").alias("by"))).alias("a"))
    controls = F.transform(find_all(body, f"(?i)<(?:input|select|textarea){END}[^>]*>"), control)
    controls = F.filter(controls, lambda c: ~((c["tag"] == "input") & c["a"]["type"].isin("hidden", "submit", "button", "reset", "image")))
    bare = lambda cs, ls: F.filter(cs, lambda c: ~(((c["a"]["id"] != "") & F.array_contains(ls, c["a"]["id"])) | (c["a"]["label"] != "") | (c["a"]["by"] != "")))
    fields = let(F.struct(controls.alias("c"), label_for.alias("l")), lambda x: F.struct(F.size(bare(x["c"], x["l"])).alias("bare"), F.size(x["c"]).alias("n")))
    found = F.transform(find_all(body, f"(?is)<form{END}[^>]*>.*?</form>"), lambda f: F.struct(F.coalesce(attribute(tag_attrs(f), "action"), F.lit("")).alias("action"), F.lower(F.coalesce(F.nullif(attribute(tag_attrs(f), "method"), F.lit("")), F.lit("get"))).alias("method")))
    buttons = F.transform(find_all(body, f"(?is)<button{END}[^>]*>.*?</button>"), lambda b: F.struct(strip_tags(inner_html(b)).alias("text"), F.coalesce(attribute(tag_attrs(b), "aria-label"), F.lit("")).alias("aria_label")))
    return F.struct(found.alias("forms"), buttons.alias("buttons"), fields.alias("fields"))


def list_count(body: Column) -> Column:
    return F.regexp_count(body, F.lit(LIST)).cast("int")


def table_count(body: Column) -> Column:
    return F.regexp_count(body, F.lit(f"(?i)<table{END}")).cast("int")


def interstitial(body: Column) -> Column:
    return body.rlike(OVERLAY_WORDS) & body.rlike(OVERLAY_PLACE)


def snapshot(pages: DataFrame, resolve: bool = True) -> DataFrame:
    """pages(url, html, ...) with the fields of a page snapshot; resolve=False leaves links and images unresolved."""
    base = F.col("url") if resolve else None
    html = F.coalesce(F.col("html"), F.lit(""))
    out = pages.withColumn("html", html).withColumn("__body", body_only(html)).withColumn("body_text", visible_text(F.col("__body")))
    last = lambda xs: F.coalesce(F.try_element_at(F.filter(xs, lambda x: x.isNotNull()), F.lit(-1)), F.lit(""))
    content = lambda m: F.coalesce(attribute(m, "content"), F.lit(""))
    prop = lambda m: F.lower(F.coalesce(attribute(m, "property"), F.lit("")))
    og = lambda name: last(F.transform("__metas", lambda m: F.when(prop(m) == name, content(m))))
    described = last(F.transform("__metas", lambda m: F.when(~prop(m).isin("og:title", "og:image", "og:description") & (F.lower(attribute(m, "name")) == "description"), content(m))))
    robots = F.filter(F.transform(find_all(html, "(?i)<meta[^>]*name=[\"']robots[\"'][^>]*>"), lambda m: F.coalesce(attribute(m, "content"), F.lit(""))), lambda x: x.isNotNull())
    out = out.withColumn("__metas", _metas(html)).withColumn("__links", _link_tags(html)).withColumn("headings", headings(F.col("__body"))).withColumn("json_ld", json_ld(html)).withColumn("__forms", forms(F.col("__body")))
    canonical = F.get(F.filter("__links", lambda x: F.lower(attribute(x, "rel")) == "canonical"), F.lit(0))
    alternates = F.filter("__links", lambda x: (F.lower(attribute(x, "rel")) == "alternate") & (F.coalesce(attribute(x, "hreflang"), F.lit("")) != ""))
    sentences, words = sentence_count(F.col("body_text")), word_count(F.col("body_text"))
    out = out.withColumns(
        {
            "title": page_title(html), "lang": page_lang(html), "canonical": F.coalesce(attribute(canonical, "href"), F.lit("")), "meta_robots": F.lower(F.array_join(robots, ",")),
            "og_title": og("og:title"), "og_image": og("og:image"), "meta_description": described,
            "hreflang": F.transform(alternates, lambda x: F.struct(attribute(x, "hreflang").alias("hreflang"), F.coalesce(attribute(x, "href"), F.lit("")).alias("href"))),
            **{f"h{n}": of_level(F.col("headings"), n) for n in (1, 2, 3, 4)},
            "links": links(F.col("__body"), base), "images": images(F.col("__body"), base), "ld_types": ld_types(F.col("json_ld")), "ld_dates": ld_dates(F.col("json_ld")),
            "forms": F.col("__forms.forms"), "buttons": F.col("__forms.buttons"), "unlabeled_fields": F.col("__forms.fields.bare"), "controls": F.col("__forms.fields.n"),
            "list_count": list_count(F.col("__body")), "table_count": table_count(F.col("__body")), "figcaption_count": F.regexp_count("__body", F.lit(f"(?i)<figcaption{END}")).cast("int"),
            "visible_breadcrumb": F.col("__body").rlike(BREADCRUMB), "interstitial": interstitial(F.col("__body")),
            "body_length": utf16_length(F.col("body_text")), "html_length": utf16_length(html), "sentence_count": sentences,
            "average_sentence_words": F.when(sentences > 0, words.cast("double") / sentences).otherwise(0.0),
        }
    )
    return out.withColumn("breadcrumb_schema", F.exists("ld_types", lambda t: F.lower(t) == "breadcrumblist")).drop("__body", "__metas", "__links", "__forms")
