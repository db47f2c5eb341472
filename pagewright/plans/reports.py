"""Reports from small aggregates: Markdown, JSON and HTML text."""

from __future__ import annotations

import html as _html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import compare, priority, scoring

CAVEATS = ["Static HTML only: nothing was rendered.", "Review verdicts are open questions, not failures.", "Rates cover the pages that were analysed."]


def _table(head: list[str], rows: list[tuple]) -> list[str]:
    cell = lambda x: str(x).replace("|", "\\|")
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]


def report_data(verdicts: DataFrame, scores: DataFrame, total_urls: DataFrame, thorough: bool = False, compared: DataFrame | None = None) -> dict:
    """Everything a report of one site shows: bounded by the number of checks and buckets."""
    matrix = scoring.check_matrix(verdicts, [])
    rows = lambda df: [r.asDict() for r in df.collect()]
    out = {
        "summary": (rows(scoring.site_summary(scores)) or [{}])[0],
        "coverage": (rows(scoring.coverage(scores, verdicts, total_urls, ["site"], thorough)) or [{}])[0],
        "top_areas": rows(compare.report_areas(matrix)),
        "matrix": rows(matrix.orderBy("check_id")),
    }
    if compared is not None:
        out["comparison"] = {
            "worse": rows(compare.worse(compared).orderBy(F.desc("delta"), "check_id", "competitor").limit(15)),
            "better": rows(compare.better(compared).orderBy("delta", "check_id", "competitor").limit(15)),
            "warnings": rows(compare.warnings(compared)),
        }
    return out


def markdown_report(site: str, data: dict) -> str:
    s, c = data["summary"], data["coverage"]
    pct = lambda x: f"{100 * x:.0f}%"
    out = [f"# Audit of {site}", "", "## Coverage", "", f"{c.get('pages_analyzed', 0)} of {c.get('total_urls', 0)} known pages analysed; {c.get('residual_review', 0)} verdicts need a review."]
    if c.get("pages_analyzed", 0) < c.get("total_urls", 0):
        out += ["", "**Partial coverage: the figures describe the analysed pages only.**"]
    out += ["", "## Summary", "", f"Average score {s.get('average_score', 0)}.", "", *_table([b for b, _ in scoring.BUCKETS], [tuple(s.get(b, 0) for b, _ in scoring.BUCKETS)])]
    out += ["", "## Top areas", "", *_table(["check", "title", "severity", "fail rate", "failed"], [(r["check_id"], r["title"], r["severity"], pct(r["fail_rate"]), r["fail"]) for r in data["top_areas"]])]
    out += ["", "## First fixes", "", *(f"{k}. {r['title']} ({r['check_id']}, {r['fail']} pages)" for k, r in enumerate([r for r in data["top_areas"] if r["fail"]][:10], 1))]
    if "comparison" in data:
        for name in ("worse", "better"):
            out += ["", f"## {name.capitalize()} than competitors", "", *_table(["check", "competitor", "own rate", "their rate", "confidence"], [(r["check_id"], r["competitor"], pct(r["target_rate"]), pct(r["competitor_rate"]), r["confidence"]) for r in data["comparison"][name]])]
    return "\n".join([*out, "", "## Caveats", "", *(f"- {x}" for x in CAVEATS), ""])


def json_report(site: str, data: dict) -> str:
    return json.dumps({"site": site, **data}, indent=2, ensure_ascii=False)


def priority_data(matrix: DataFrame) -> list[dict]:
    """35 ranked rows of one site, with what cells show."""
    return [r.asDict() for r in priority.cells(priority.dividers(priority.priority_rows(matrix, ["site"]), ["site"])).orderBy("rank").collect()]


def html_priority(site: str, rows: list[dict], coverage: dict) -> str:
    e = lambda x: _html.escape(str(x))
    body = []
    for r in rows:
        if r["starts_bucket"]:
            body.append(f'<tr class="divider"><td colspan="6">{e(r["bucket"])}</td></tr>')
        share = "–" if r["fail_pct"] is None else f"{r['fail_pct']:.0f}%"
        body.append(f'<tr><td>{r["rank"]}</td><td>{e(r["check_id"])}</td><td>{e(r["title"])}</td><td>{e(r["severity"])}</td><td class="{r["pct_class"]}">{share}</td><td>{r["priority"]:.0f} — {e(r["why"])}</td></tr>')
    note = f'{coverage.get("pages_analyzed", 0)} of {coverage.get("total_urls", 0)} pages, {coverage.get("residual_review", 0)} open reviews'
    head = "".join(f"<th>{h}</th>" for h in ("rank", "check", "title", "severity", "fail share", "priority"))
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Priorities of {e(site)}</title></head><body><h1>{e(site)}</h1><p>{e(note)}</p><table><thead><tr>{head}</tr></thead><tbody>{"".join(body)}</tbody></table></body></html>'


LINT = {
    "title": ("high", lambda t: t.startswith("# ")),
    "coverage": ("high", lambda t: "## Coverage" in t),
    "summary": ("high", lambda t: "## Summary" in t),
    "areas": ("medium", lambda t: "## Top areas" in t),
    "fixes": ("medium", lambda t: "## First fixes" in t),
    "caveats": ("high", lambda t: all(c in t for c in CAVEATS)),
    "numbers": ("medium", lambda t: "nan" not in t.lower().split() and "None" not in t),
    "partial": ("high", lambda t: not _partial(t) or "Partial coverage" in t),
    "rows": ("low", lambda t: t.count("\n| C") <= 45),
}


def _partial(text: str) -> bool:
    import re

    m = re.search(r"(\d+) of (\d+) known pages", text)
    return bool(m) and int(m[1]) < int(m[2])


def lint_report(text: str) -> list[dict]:
    """Rules that a finished report breaks."""
    return [{"rule": k, "severity": sev} for k, (sev, ok) in LINT.items() if not ok(text)]
