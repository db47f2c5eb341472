"""Removal of lines that spread over many sites, with DataFrame functions only.

One aggregation merges a HyperLogLog sketch of the sites of each line, keyed by a hash of the trimmed line. Lines
whose estimate lies clearly under the threshold stay, lines clearly above it are boilerplate, and lines within
`margin` of it get an exact count of distinct sites. Of a boilerplate line the first occurrence stays (smallest
doc_id, then position), so that its text is kept once in the corpus; all others are removed.

One plan serves all sizes: the texts are shuffled once, by (doc_id, hash of the text), to meet what they lose.

Defined results: a line is what stands between line feeds; blank lines are never removed; a null text has no lines
and stays null, an empty one stays empty; a null source is a site of its own, a null doc_id sorts first. Rows that
repeat both doc_id and text are one document, so they all come back alike; of different texts under one doc_id the
one with the least hash comes first. Very long texts are rows of lines like others. Columns of any name pass through
unchanged. An empty table gives an empty result. A text that loses no line comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch, documents, packed, unpacked

TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
MIN_SITES = 10


def _key(line):
    t = F.regexp_replace(line, TRIM, "")
    return F.when(t != "", F.xxhash64(t))


def lines_of(df: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), site, pos and h of each line that is not blank."""
    src = df.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("site"), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("pos", "line"))
    return src.select("doc_id", "th", "site", "pos", _key(F.col("line")).alias("h")).where("h is not null")


def boilerplate(lines: DataFrame, min_sites: int, margin: float, scratch: Scratch) -> DataFrame:
    """h, and doc and pos of its first occurrence, of each line on at least min_sites sites."""
    seen = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(10)).alias("sk"), F.min(F.struct("doc_id", "th", "pos")).alias("first"), F.count("*").alias("n"))
    # a line on k sites occurs at least k times, so rarer ones need no estimate
    spread = seen.where(F.col("n") >= min_sites).select("h", "first", F.hll_sketch_estimate("sk").alias("est"))
    spread = scratch.table(spread.where(F.col("est") >= min_sites * (1 - margin)), "spread")
    near = spread.where(F.col("est") <= min_sites * (1 + margin)).select("h")
    exact = lines.join(near, "h", "left_semi").select("h", "site").distinct().groupBy("h").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    sure = spread.where(F.col("est") > min_sites * (1 + margin))
    return scratch.table(sure.select("h", "first").unionByName(spread.join(exact, "h", "left_semi").select("h", "first")), "boilerplate")


def removals(df: DataFrame, min_sites: int = MIN_SITES, margin: float = 0.25) -> DataFrame:
    """doc_id, th, gone: the positions of the lines that each document loses. A written table."""
    scratch = Scratch(df.sparkSession, "line-dedup")
    lines = scratch.table(lines_of(df), "lines")
    found = boilerplate(lines, min_sites, margin, scratch)
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("pos") == F.col("first.pos"))
    hit = lines.join(found, "h").where(~first)
    out = scratch.table(hit.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone")), "gone")
    scratch.drop(lines, found)
    return out


def _marked(df: DataFrame, **options) -> DataFrame:
    """row, gone (positions, null for none) and left (the text without them)."""
    gone = removals(df, **options).withColumnsRenamed({"doc_id": "d2", "th": "t2"}).hint("shuffle_hash")
    same = F.col("d").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2"))
    j = packed(df, d=F.col("doc_id"), t=F.xxhash64("text")).join(gone, same, "left")
    text = F.col("row.text")
    left = F.array_join(F.filter(F.split(text.cast("string"), "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return j.select("row", "gone", F.when(F.col("gone").isNull(), text).otherwise(left).alias("left"))


def dedup_lines(df: DataFrame, removed: str = "n_removed", **options) -> DataFrame:
    """df with its text less the boilerplate lines, and a column `removed`, how many they were (in place of one of that name)."""
    return _marked(df, **options).select(*unpacked([c for c in df.columns if c != removed], text=F.col("left")), F.coalesce(F.size("gone"), F.lit(0)).alias(removed))


def without_emptied(df: DataFrame, **options) -> DataFrame:
    """The documents after line dedup; those that lost lines and have no word left go, as all they held stands elsewhere."""
    out = _marked(df, **options)
    return out.where(F.col("gone").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]")).select(*unpacked(df.columns, text=F.col("left")))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    d = dedup_lines(documents(spark, sf_dir))
    return d.select("doc_id", F.col("n_removed").cast("long").alias("n_removed"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, coalesce('s' || source, 'n') AS site, pos, line,
         regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k
  FROM (SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)),
boiler AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= 10),
once AS (SELECT DISTINCT doc_id, text, pos, line, k FROM lines),
ranked AS (SELECT l.*, b.k IS NOT NULL AND row_number() OVER (PARTITION BY l.k ORDER BY l.doc_id, l.text, l.pos) > 1 AS gone FROM once l LEFT JOIN boiler b ON l.k = b.k),
kept AS (SELECT doc_id, text, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS t FROM ranked GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, strlen(coalesce(t, ''))::BIGINT AS n_bytes, md5(coalesce(t, '')) AS kept_md5
FROM documents d LEFT JOIN kept ON kept.doc_id IS NOT DISTINCT FROM d.doc_id AND kept.text = d.text
"""
