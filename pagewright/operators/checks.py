"""The 36 checks: their fixed attributes and severity scales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Score weight and priority factor of each severity.
SEVERITIES = {"Critical": (5.0, 1.0), "High": (4.0, 0.85), "Medium": (2.0, 0.7), "Low": (1.0, 0.5)}
NEEDS_REVIEW_PENALTY = 0.5
VALUES = ("PASS", "FAIL", "N/A", "NEEDS_REVIEW")

#: number, title, severity, gap category, mode. Fixed values but for the titles.
CHECKS = [
    (1, "The page answers with a success status", "Critical", "Indexing", "deterministic"),
    (2, "The page is listed in the sitemap", "High", "Indexing", "deterministic"),
    (3, "No other page of the site has the same title and main heading", "Medium", "Indexing", "heuristic"),
    (4, "Another page links here", "High", "Indexing", "heuristic"),
    (5, "Robots may index the page", "Critical", "Indexing", "deterministic"),
    (6, "Snippets are not restricted", "High", "Snippet controls", "deterministic"),
    (7, "There is one main heading", "High", "Headings", "deterministic"),
    (8, "Sentences are short enough to extract", "Medium", "Readability", "heuristic"),
    (9, "Long text has lists or tables", "Medium", "Structure", "heuristic"),
    (10, "A publication date is given", "Medium", "Freshness", "heuristic"),
    (11, "A date of update or review is given", "Medium", "Freshness", "heuristic"),
    (12, "Expert content names its author", "Medium", "Authority", "needs-review"),
    (13, "Headings form a hierarchy", "Medium", "Headings", "deterministic"),
    (14, "Subheadings say what follows", "Medium", "Headings", "heuristic"),
    (15, "Content does not hide behind controls", "Medium", "Rendering", "needs-review"),
    (16, "Link texts say where they lead", "Medium", "Internal linking", "heuristic"),
    (17, "Deep pages have breadcrumbs", "Medium", "Internal linking", "heuristic"),
    (18, "Images have real sources", "High", "Media", "deterministic"),
    (19, "Meaningful images have alternative texts", "High", "Media", "heuristic"),
    (20, "Meaningful images have captions", "Medium", "Media", "needs-review"),
    (21, "A preferred image is declared", "Medium", "Media", "deterministic"),
    (22, "Image files have telling names", "Low", "Media", "heuristic"),
    (23, "The main image fits the topic", "Low", "Media", "needs-review"),
    (24, "Videos are described as data", "Medium", "Media", "heuristic"),
    (25, "The page type is described as data", "High", "Schema", "heuristic"),
    (26, "Structured data has its required fields", "Medium", "Schema", "heuristic"),
    (27, "Questions declared as data stand on the page", "Medium", "Schema", "heuristic"),
    (28, "The page works on phones", "High", "Rendering", "needs-review"),
    (29, "The page loads fast enough", "Low", "Performance", "needs-review"),
    (30, "No overlay covers the content", "High", "Rendering", "needs-review"),
    (31, "Form fields have labels", "High", "Accessibility", "heuristic"),
    (32, "Content does not depend on scripts", "High", "Rendering", "heuristic"),
    (33, "Legal pages are kept apart", "Medium", "Indexing", "needs-review"),
    (34, "Language versions are linked", "Medium", "Internationalization", "deterministic"),
    (35, "Titles agree with each other", "Medium", "Consistency", "needs-review"),
    (36, "Key pages answer real questions", "Medium", "Prompt coverage", "needs-review"),
]

#: Left out of priorities: field data decides it, not the page.
EXCLUDED = {29}
SITE_SCOPE = {3, 4}


def check_id(n: int) -> str:
    return f"C{n:03d}"


def check_rows() -> list[tuple]:
    return [(check_id(n), n, title, sev, gap, "site" if n in SITE_SCOPE else "page", mode, *SEVERITIES[sev], n in EXCLUDED) for n, title, sev, gap, mode in CHECKS]


def checks_table(spark: SparkSession) -> DataFrame:
    """36 rows, safe to broadcast: check_id, ordinal, title, severity, gap_category, scope, mode, weight, factor, excluded."""
    return spark.createDataFrame(check_rows(), "check_id string, ordinal int, title string, severity string, gap_category string, scope string, mode string, weight double, factor double, excluded boolean")
