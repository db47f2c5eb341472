"""The 36 checks as Column expressions over a snapshot with its site context.

RULES maps the number of a check to a function that gives (value, why): value is PASS, FAIL, N/A or NEEDS_REVIEW,
the first rule that holds decides. Expressions do not raise; a null decision becomes NEEDS_REVIEW.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import END, WS, trim_ws
from pagewright.functions.urls import is_absolute, url_depth, url_path
from pagewright.operators.checks import CHECKS, check_id
from pagewright.operators.extract import field, truthy

# The terms and patterns below decide verdicts.
GENERIC_HEADINGS = ["more posts", "more", "get in touch", "contact", "thank you", "subscribe", "related", "categories", "tags", "footer", "apply for", "newsletter", "follow us", "share", "comments"]
GENERIC_ANCHORS = ["click here", "here", "read more", "learn more", "more", "details", "this", "click", "link"]
REQUIRED = {
    "Article": ["headline", "author", "datePublished"],
    "NewsArticle": ["headline", "author", "datePublished"],
    "BlogPosting": ["headline", "author", "datePublished"],
    "Product": ["name", "image"],
    "Recipe": ["name", "recipeInstructions", "recipeIngredient"],
    "JobPosting": ["title", "datePosted", "hiringOrganization"],
    "Event": ["name", "startDate", "location"],
    "HowTo": ["name", "step"],
    "FAQPage": ["mainEntity"],
    "QAPage": ["mainEntity"],
    "VideoObject": ["name", "thumbnailUrl", "uploadDate"],
}
STRATEGIC = "^/(services|solutions|industries|industry|platform|product|products|use-cases|use-case)"
PATH_TYPES = [
    ("home", "^/$|^/index"),
    ("service", f"^/(services|solutions|industries|industry|product|products|use-cases?|platform){END}"),
    ("article", f"^/(blog|news|insights|articles?|posts?){END}"),
    ("case", f"^/(portfolio|case-stud(?:y|ies)|customers?|clients?){END}"),
    ("event", f"^/(events?|webinars?|conferences?){END}"),
    ("legal", f"^/(privacy|legal|terms|cookies?){END}"),
    ("corporate", f"^/(about|contact|careers?|jobs?|team){END}"),
]
TYPE_HINTS = {"Article": "article", "NewsArticle": "article", "BlogPosting": "article", "TechArticle": "article", "CaseStudy": "case", "Service": "service", "Product": "service", "Event": "event", "Person": "corporate", "Organization": "corporate", "WebSite": "home"}
EXPERT_TYPES = ["article", "case", "event"]
LOW_SENTENCES, GOOD_AVERAGE, FAIR_AVERAGE = 5, 28, 36

RULES: dict[int, Callable[[], tuple[Column, Column]]] = {}
c = F.col


def rule(n: int):
    def add(f):
        RULES[n] = f
        return f

    return add


def decide(*cases: tuple[Column, str], otherwise: str) -> Column:
    """The value of the first condition that is true."""
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.nullif(whole, F.lit(0))


def say(*parts) -> Column:
    return F.concat_ws(" ", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _path() -> Column:
    return F.coalesce(url_path(c("url")), F.lit("/"))


def page_type() -> Column:
    """The first path pattern that fits, else the first structured type with a hint, else other."""
    path, out = _path(), None
    for name, pattern in PATH_TYPES:
        cond = path.rlike("(?i)" + pattern)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    hints = F.create_map(*(F.lit(x) for pair in TYPE_HINTS.items() for x in pair))
    first = F.get(F.filter(F.transform("ld_types", lambda t: F.try_element_at(hints, t)), lambda x: x.isNotNull()), F.lit(0))
    return out.otherwise(F.coalesce(first, F.lit("other")))


def path_type(url: Column) -> Column:
    """The page type by URL alone."""
    path, out = F.coalesce(url_path(url), F.lit("/")), None
    for name, pattern in PATH_TYPES:
        cond = path.rlike("(?i)" + pattern)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("other")


@rule(1)
def _():
    return decide((c("status").isNull(), "NEEDS_REVIEW"), (c("status").between(200, 299), "PASS"), otherwise="FAIL"), say("status", c("status"))


@rule(2)
def _():
    return decide((c("in_sitemap"), "PASS"), (~c("in_sitemap"), "FAIL"), otherwise="NEEDS_REVIEW"), say("in sitemap:", c("in_sitemap"))


@rule(3)
def _():
    return decide((c("competing"), "FAIL"), (~c("competing"), "PASS"), otherwise="NEEDS_REVIEW"), say("shares title and main heading:", c("competing"))


@rule(4)
def _():
    return decide((c("inbound_links") > 0, "PASS"), (c("inbound_links") == 0, "FAIL"), otherwise="NEEDS_REVIEW"), say(c("inbound_links"), "links from the site")


@rule(5)
def _():
    return decide((F.contains(c("meta_robots"), F.lit("noindex")), "FAIL"), otherwise="PASS"), say("robots:", c("meta_robots"))


@rule(6)
def _():
    limited = c("meta_robots").rlike(rf"(?<![A-Za-z0-9_])nosnippet{END}") | c("meta_robots").rlike(f"max-snippet{WS}*:{WS}*0")
    return decide((limited, "FAIL"), otherwise="PASS"), say("robots:", c("meta_robots"))


@rule(7)
def _():
    return decide((F.size("h1") == 1, "PASS"), otherwise="FAIL"), say(F.size("h1"), "main headings")


@rule(8)
def _():
    a = c("average_sentence_words")
    return decide((c("sentence_count") < LOW_SENTENCES, "N/A"), (a <= GOOD_AVERAGE, "PASS"), (a <= FAIR_AVERAGE, "NEEDS_REVIEW"), otherwise="FAIL"), say(c("sentence_count"), "sentences of", F.round(a, 1), "words")


@rule(9)
def _():
    return decide(((c("list_count") > 0) | (c("table_count") > 0), "PASS"), (c("body_length") < 500, "N/A"), otherwise="NEEDS_REVIEW"), say(c("list_count"), "lists,", c("table_count"), "tables")


def _dated(key: str, pattern: str) -> tuple[Column, Column]:
    in_data = F.exists("ld_dates", lambda d: d.startswith(f"{key}="))
    return decide((in_data, "PASS"), (c("body_text").rlike(f"(?i)(?:{pattern})(?: on)?:?{WS}+[0-9]{{4}}"), "PASS"), (c("body_length") < 400, "N/A"), otherwise="NEEDS_REVIEW"), say(f"{key} in data:", in_data)


@rule(10)
def _():
    return _dated("datePublished", "Published")


@rule(11)
def _():
    return _dated("dateModified", "Reviewed|Updated")


@rule(12)
def _():
    def named(a: Column) -> Column:
        return truthy(field(a, "name")) | ((F.schema_of_variant(a) == "STRING") & truthy(a))

    def has_author(b: Column) -> Column:
        author = field(b, "author")
        many = F.try_variant_get(b, "$['author']", "array<variant>")
        return F.when(many.isNotNull(), F.exists(many, named)).otherwise(truthy(author) & named(author))

    byline = c("body_text").rlike(f"by{WS}+[A-Z][a-z]+{WS}+[A-Z][a-z]+")
    kind = page_type()
    return decide((~kind.isin(EXPERT_TYPES), "N/A"), (F.exists("json_ld", has_author), "PASS"), (byline, "PASS"), otherwise="NEEDS_REVIEW"), say("page type", kind)


@rule(13)
def _():
    return decide((F.size("h1") == 0, "FAIL"), ((c("body_length") > 600) & (F.size("h2") == 0), "FAIL"), otherwise="PASS"), say(F.size("h1"), F.size("h2"), F.size("h3"), "headings of levels 1 to 3")


@rule(14)
def _():
    subs = F.concat("h2", "h3")
    generic = F.filter(subs, lambda t: F.lower(trim_ws(t)).isin(GENERIC_HEADINGS) | trim_ws(t).rlike("^[0-9]+$"))
    return decide((F.size(subs) == 0, "N/A"), (ratio(F.size(generic), F.size(subs)) >= F.lit(0.6), "FAIL"), otherwise="PASS"), say(F.size(generic), "of", F.size(subs), "generic")


@rule(15)
def _():
    return decide(((c("body_length") < 200) & (c("html_length") > 4000), "FAIL"), otherwise="NEEDS_REVIEW"), say(c("body_length"), "characters of text")


@rule(16)
def _():
    texts = F.filter("links", lambda x: x["text"] != "")
    generic = F.filter(texts, lambda x: F.lower(trim_ws(x["text"])).isin(GENERIC_ANCHORS))
    r = ratio(F.size(generic), F.size(texts))
    return decide((F.size(texts) == 0, "N/A"), (r >= F.lit(0.4), "FAIL"), (r >= F.lit(0.2), "NEEDS_REVIEW"), otherwise="PASS"), say(F.size(generic), "of", F.size(texts), "generic")


@rule(17)
def _():
    return decide((url_depth(c("url")) <= 2, "N/A"), (c("breadcrumb_schema") & c("visible_breadcrumb"), "PASS"), otherwise="FAIL"), say("depth", url_depth(c("url")))


@rule(18)
def _():
    n, bad = F.size("images"), F.size(F.filter("images", lambda i: i["src_empty"]))
    return decide((n == 0, "N/A"), (ratio(bad, n) >= F.lit(0.30), "FAIL"), otherwise="PASS"), say(bad, "of", n, "without a source")


@rule(19)
def _():
    small = lambda i: (i["width"] > 0) & (i["height"] > 0) & ((i["width"] < 96) | (i["height"] < 96))
    real = F.filter("images", lambda i: ~i["decorative"] & ~i["src_empty"] & ~i["in_chrome"] & ~F.coalesce(small(i), F.lit(False)))
    missing = F.size(F.filter(real, lambda i: i["alt_missing"] | (i["alt"] == "")))
    return decide((F.size(real) == 0, "N/A"), (ratio(missing, F.size(real)) >= F.lit(0.1), "FAIL"), (missing == 0, "PASS"), otherwise="NEEDS_REVIEW"), say(missing, "of", F.size(real), "without text")


@rule(20)
def _():
    real = F.size(F.filter("images", lambda i: ~i["decorative"] & ~i["src_empty"]))
    return decide((real == 0, "N/A"), (c("figcaption_count") >= real, "PASS"), otherwise="NEEDS_REVIEW"), say(c("figcaption_count"), "captions for", real, "images")


@rule(21)
def _():
    in_data = F.exists("json_ld", lambda b: truthy(field(b, "image")) | truthy(field(b, "primaryImageOfPage")))
    return decide((c("og_image") != "", "PASS"), (in_data, "PASS"), otherwise="FAIL"), say("declared:", c("og_image"))


@rule(22)
def _():
    named = F.filter("images", lambda i: ~i["decorative"] & ~i["src_empty"] & (i["filename"] != ""))
    generic = F.size(F.filter(named, lambda i: i["filename"].rlike(r"(?i)^[0-9]+x[0-9]+\.[a-z]+$|^(image|photo|img|pic|picture)[-_]?[0-9]+\.[a-z]+$")))
    return decide((F.size(named) == 0, "N/A"), (ratio(generic, F.size(named)) >= F.lit(0.5), "FAIL"), otherwise="PASS"), say(generic, "of", F.size(named), "generic")


@rule(23)
def _():
    main = F.exists("images", lambda i: (i["resolved"] != "") & F.coalesce((i["resolved"] == c("og_image")) | ((i["width"] >= 600) & (i["height"] >= 300)), F.lit(False)))
    return decide((main, "NEEDS_REVIEW"), otherwise="N/A"), say("main image:", main)


@rule(24)
def _():
    described = F.exists("ld_types", lambda t: F.lower(t) == "videoobject")
    shown = c("body_text").rlike(rf"(?i)<video{END}|youtube\.com/embed|player\.vimeo\.com/video")
    return decide((described, "PASS"), (shown, "NEEDS_REVIEW"), otherwise="N/A"), say("described:", described)


@rule(25)
def _():
    plain = F.forall("ld_types", lambda t: F.lower(t).isin("webpage", "website", "organization"))
    return decide((F.size("ld_types") == 0, "FAIL"), (plain & c("url").rlike("/blog/|/news/|/insights/"), "FAIL"), otherwise="PASS"), say("types:", F.array_join("ld_types", ","))


@rule(26)
def _():
    def kind(b: Column) -> Column:
        t, many = field(b, "@type"), F.try_variant_get(b, "$['@type']", "array<string>")
        return F.when(F.schema_of_variant(t) == "STRING", t.try_cast("string")).otherwise(F.array_join(many, ","))

    rich = F.get(F.filter("json_ld", lambda b: F.coalesce(kind(b).isin(list(REQUIRED)), F.lit(False))), F.lit(0))
    complete = None
    for t, names in REQUIRED.items():
        ok = truthy(field(rich, names[0]))
        for n in names[1:]:
            ok = ok & truthy(field(rich, n))
        complete = F.when(kind(rich) == t, ok) if complete is None else complete.when(kind(rich) == t, ok)
    return decide((rich.isNull(), "N/A"), (complete, "PASS"), otherwise="FAIL"), say("type", kind(rich))


@rule(27)
def _():
    declared = F.exists("ld_types", lambda t: F.lower(t).isin("faqpage", "qapage"))
    shown = c("body_text").rlike(rf"(?i)\?{WS}*</?h[1-6]>?|(Q:|A:){WS}|\?{WS}")
    return decide((~declared, "N/A"), (~shown, "FAIL"), otherwise="PASS"), say("shown:", shown)


@rule(28)
def _():
    return F.lit("NEEDS_REVIEW"), say("needs a rendered view")


@rule(29)
def _():
    return decide((c("html_length") > 1_500_000, "FAIL"), otherwise="NEEDS_REVIEW"), say(c("html_length"), "characters of HTML")


@rule(30)
def _():
    return decide((c("interstitial"), "NEEDS_REVIEW"), otherwise="PASS"), say("overlay candidate:", c("interstitial"))


@rule(31)
def _():
    bad = c("unlabeled_fields")
    return decide((c("controls") == 0, "N/A"), ((bad > 2) | ((bad > 0) & (c("controls") <= 5)), "FAIL"), otherwise="PASS"), say(bad, "of", c("controls"), "without a label")


@rule(32)
def _():
    return decide(((c("html_length") > 2000) & (c("body_length") < 200), "FAIL"), otherwise="PASS"), say(c("body_length"), "characters of text")


@rule(33)
def _():
    return decide((c("url").rlike("(?i)/(privacy|legal|terms|cookies?)"), "NEEDS_REVIEW"), otherwise="N/A"), say("by URL")


@rule(34)
def _():
    return decide((F.size("hreflang") > 0, "PASS"), (c("multilingual"), "FAIL"), otherwise="N/A"), say(F.size("hreflang"), "language links")


@rule(35)
def _():
    head = lambda b: F.when(truthy(field(b, "headline")), field(b, "headline")).when(truthy(field(b, "name")), field(b, "name")).try_cast("string")
    titles = F.concat(F.array(c("title"), F.coalesce(F.get("h1", F.lit(0)), F.lit("")), c("og_title")), F.transform("json_ld", head))
    kinds = F.array_distinct(F.transform(F.filter(titles, lambda t: t.isNotNull() & (t != "")), lambda t: trim_ws(F.lower(t))))
    return decide((F.size(kinds) <= 1, "PASS"), otherwise="NEEDS_REVIEW"), say(F.array_join(F.slice(kinds, 1, 4), " | "))


@rule(36)
def _():
    relative = F.regexp_replace(F.regexp_replace(trim_ws(c("url")), r"(?s)[?#].*$|^//[^/?#]*", ""), r"^/?(\.{1,2}/)*/?", "/")
    path = F.when(is_absolute(c("url")), _path()).otherwise(relative)
    return decide((c("url").isNull(), "NEEDS_REVIEW"), (path.rlike("(?i)" + STRATEGIC + END), "NEEDS_REVIEW"), otherwise="N/A"), say("by path")


MISSING_DATA = {1, 2, 3, 4}


def wide_verdicts(pages: DataFrame, keep: list[str], numbers: list[int] | None = None) -> DataFrame:
    """The columns in keep and one value column, C001 to C036, for each check."""
    return pages.select(*keep, *(F.coalesce(RULES[n]()[0], F.lit("NEEDS_REVIEW")).alias(check_id(n)) for n in numbers or RULES))


def verdicts(pages: DataFrame, keep: list[str], with_evidence: bool = False) -> DataFrame:
    """One row for each page and check: the columns in keep, check_id, value, na_reason, and evidence if asked for."""

    def one(n: int) -> Column:
        value, why = RULES[n]()
        value = F.coalesce(value, F.lit("NEEDS_REVIEW"))
        reason = F.when(value == "N/A", "not_applicable").when(F.lit(n in MISSING_DATA) & (value == "NEEDS_REVIEW"), "missing_data")
        return F.struct(F.lit(check_id(n)).alias("check_id"), value.alias("value"), reason.alias("na_reason"), *([why.alias("evidence")] if with_evidence else []))

    return pages.select(*keep, F.explode(F.array(*(one(n) for n, *_ in CHECKS))).alias("v")).select(*keep, "v.*")
