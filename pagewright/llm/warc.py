"""WARC archives of pages, written and read back as Spark text with the format's own separators.

Writing: a record's end, an empty line, is the writer's line separator, so Spark's committer makes the files. Of equal
payloads of at least `least` bytes, the one with the largest page_id is a response and the others revisit it.

Reading: splits are cut at whatever looks like a record's start. Each piece that begins with a readable head is a
candidate, and its content length names its successor's offset. A payload may hold whole records of its own, so a
candidate counts only if the chain from the start of its file reaches it. Within a split, candidates whose successor is
the next piece are runs, and a run leaves the split at one exit; between exits, pointer jumping doubles the reach of
every entry, round by round, and what the file's start reaches after about log2(exits of a file) rounds stays.
A record whose payload holds such starts is put together from its pieces again.

Defined results: a null html is an empty payload, a null url leaves out its field; white space of a url is
percent-encoded in the head, other control characters go; a null page_id is smaller than any; rows that repeat the largest page_id of a payload are
all responses; payloads of any length are records. Reading drops records that end beyond their file, whatever
follows a gap in the chain, and files that do not begin with a record. Columns other than page_id, url and html,
whatever their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import Scratch

CRLF = "\r\n"
MAGIC = "WARC/1."
#: What stands between pieces; no field of a head can begin like this.
BORDER = CRLF + MAGIC
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:page:"


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def page_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, refers_to and revisit of every row of pages(page_id, url, html)."""
    spark = pages.sparkSession
    payload = _payload()
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("n"), F.xxhash64(payload).alias("h"))
    alike = ["digest", "h", "n"]
    repeated = rows.where(F.col("n") >= least).groupBy(*alike).agg(F.max("page_id").alias("newest"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    repeated = Scratch(spark, "warc").table(repeated, "repeated")
    # broadcast where the written table is small; else a skewed payload is split by AQE, since each has one row here
    joined = rows.join(repeated, alike, "left")
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("newest")).alias("refers_to"), revisit.alias("revisit"))


def record_text(date: str) -> Column:
    """A record without the empty line at its end."""
    clean = F.col("url")
    for c in "\t\n\r ":
        clean = F.replace(clean, F.lit(c), F.lit(f"%{ord(c):02X}"))
    clean = F.regexp_replace(clean, r"[\x00-\x1F\x7F]", "")
    name = lambda c: F.concat(F.lit(RECORD_ID), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    field = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    body = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit(f"{MAGIC}1{CRLF}"),
        field("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", name("page_id")),
        F.lit(f"WARC-Date: {date}{CRLF}"),
        F.when(clean.isNull(), F.lit("")).otherwise(field("WARC-Target-URI", clean)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: {SAME}{CRLF}"), field("WARC-Refers-To", name("refers_to")))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"),
        field("Content-Length", F.octet_length(body).cast("string")),
        F.lit(CRLF),
        body,
    )


def write_warc(pages: DataFrame, path: str, least: int = 1000, date: str = "1970-01-01T00:00:00Z", per_file: int = 200_000) -> None:
    """Archives of at most per_file records below path, uncompressed."""
    out = page_records(pages, least).select(record_text(date).alias("value"))
    out.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).text(path)


def _pieces(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """What stands between borders: file, block (its split), at (its order in the split), size, and its head if it can be one."""
    raw = spark.read.text(path, lineSep=BORDER).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    head = F.substring_index("value", CRLF * 2, 1)
    field = lambda k, v: F.regexp_extract(head, rf"(?i)\r\n{k}:[ \t]*({v})[ \t]*(?:\r\n|$)", 1)
    some = lambda c: F.when(c != "", c)
    readable = F.col("value").rlike(r"\A(?:WARC/1\.)?[0-9]\r\n") & F.contains("value", F.lit(CRLF * 2))
    length = some(field("Content-Length", "[0-9]{1,18}")).cast("long")
    pieces = raw.select(
        "file", "file_size", "block", "at", F.col("value").cast("binary").alias("data"), F.octet_length("value").cast("long").alias("size"),
        F.startswith(F.col("value"), F.lit(MAGIC)).alias("begins"), F.when(readable, F.octet_length(head) + 4).cast("long").alias("head"), F.when(readable, length).alias("length"),
        F.when(readable, field("WARC-Type", r"[^\r\n]*?")).alias("type"), F.when(readable, field("WARC-Record-ID", r"[^\r\n]*?")).alias("record_id"), F.when(readable, some(field("WARC-Target-URI", r"[^\r\n]*?"))).alias("uri"),
        F.when(readable, some(field("WARC-Refers-To", r"[^\r\n]*?"))).alias("refers_to"), F.when(readable, some(field("WARC-Payload-Digest", r"[^\r\n]*?"))).alias("digest"), F.when(readable, some(field("Content-Type", r"[^\r\n]*?"))).alias("content_type"),
    )
    return scratch.table(pieces, "pieces")


def _candidates(pieces: DataFrame) -> DataFrame:
    """file, block, at, off (of the candidate's first byte), next (its successor's), tight (that is the next piece), whole."""
    width = len(BORDER)
    block = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + width).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = block.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    p = F.col("base") + F.coalesce(F.sum(F.col("size") + width).over(inner), F.lit(0))
    placed = pieces.select("file", "file_size", "block", "at", "size", "begins", "head", "length").join(base, ["file", "block"]).withColumn("p", p)
    # the file's first piece holds its own magic; any other's was taken for the border
    lead = F.when(F.col("p") == 0, F.lit(0)).otherwise(F.lit(len(MAGIC)))
    sound = F.col("length").isNotNull() & ((F.col("p") == 0) == F.col("begins"))
    off = F.col("p") - lead
    end = off + lead + F.col("head") + F.col("length")
    placed = placed.withColumns({"lead": lead, "off": off, "end": F.when(sound, end)})
    placed = placed.withColumn("end", F.when(F.col("end") <= F.col("file_size"), F.col("end")))
    following = F.col("p") + F.col("size") + width - len(MAGIC)
    tight = F.coalesce(F.col("end") + 4 == following, F.lit(False))
    return placed.select("file", "block", "at", "off", (F.col("end") + 4).alias("next"), tight.alias("tight"), (F.col("end") <= F.col("p") + F.col("size")).alias("whole"))


def _reached(candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """file and off of the entries of splits that the chain from the file's start reaches, by pointer jumping."""
    back = Window.partitionBy("file", "block").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.row_number().over(Window.partitionBy("file", "block").orderBy(F.col("at").desc())) == 1
    marked = candidates.withColumn("leaves", ~F.col("tight") | last)
    exits = marked.select("file", "off", F.last(F.when(F.col("leaves"), F.struct("next")), ignorenulls=True).over(back)["next"].alias("exit"))
    exits = scratch.table(exits.where("exit is not null"), "exits")
    entries = exits.select("file", F.col("exit").alias("off")).union(exits.select("file", F.lit(0).cast("long"))).distinct()
    # exits has a row for each candidate, in a file small enough to look like one to broadcast
    jumps = scratch.table(exits.join(entries.hint("merge"), ["file", "off"]).select("file", "off", F.col("exit").alias("to")), "jumps")
    reached = scratch.table(candidates.where("off = 0 and next is not null").select("file", "off"), "reached")
    n = reached.count()
    while True:
        more = reached.join(jumps, ["file", "off"]).select("file", F.col("to").alias("off"))
        wider = scratch.table(reached.union(more).distinct(), "reached")
        jumps = scratch.table(jumps.alias("a").join(jumps.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.off"))).select("a.file", "a.off", "b.to"), "jumps")
        reached, before, n = wider, n, wider.count()
        if n == before:
            return reached


def _verified(candidates: DataFrame, reached: DataFrame) -> DataFrame:
    """candidates with `real` (its record is on the chain), and owner, the record (a struct off, whole) that holds the piece."""
    hit = candidates.join(reached.withColumn("entry", F.lit(True)), ["file", "off"], "left")
    w = Window.partitionBy("file", "block").orderBy("at")
    to_here, above = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    hit = hit.withColumn("run", F.coalesce(F.sum(F.when(F.col("tight"), 0).otherwise(1)).over(above), F.lit(0)))
    hit = hit.withColumn("real", F.col("next").isNotNull() & F.coalesce(F.last(F.when(F.col("entry"), F.col("run")), ignorenulls=True).over(to_here) == F.col("run"), F.lit(False)))
    return hit.withColumn("mine", F.last(F.when(F.col("real"), F.struct("off", "next", "whole")), ignorenulls=True).over(to_here)).select("file", "block", "at", "off", "real", "whole", "mine")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, type, record_id, uri, refers_to, digest and payload of each record on the chains of the archives below path."""
    scratch = Scratch(spark, "warc-read")
    pieces = _pieces(spark, path, scratch)
    candidates = scratch.table(_candidates(pieces), "candidates")
    verified = scratch.table(_verified(candidates, _reached(candidates, scratch)), "verified")
    # nearly all pieces are records by themselves; the others are few, so they are what a join takes out
    odd = scratch.table(verified.where(~(F.col("real") & F.col("whole"))), "odd")
    plain = pieces.join(odd.select("file", "at"), ["file", "at"], "left_anti")
    out = [plain]
    if odd.where("real").limit(1).count():
        out.append(_assembled(pieces, verified, odd))
    kept = out[0] if len(out) == 1 else out[0].unionByName(out[1], allowMissingColumns=True)
    cut = lambda start, n: F.substring("data", start.cast("int"), n.cast("int"))
    # for an HTTP message, what follows its own head
    message = F.substring_index(F.col("data").cast("string"), CRLF * 2, 2)
    is_http = F.coalesce(F.startswith(F.lower("content_type"), F.lit("application/http")), F.lit(False))
    skip = F.octet_length(message) + 4 - F.col("head")
    payload = F.when(is_http, cut(F.octet_length(message) + 5, F.greatest(F.lit(0), F.col("length") - skip))).otherwise(cut(F.col("head") + 1, F.col("length")))
    return kept.select("file", "type", "record_id", "uri", "refers_to", "digest", payload.alias("payload"))


def _assembled(pieces: DataFrame, verified: DataFrame, odd: DataFrame) -> DataFrame:
    """Records whose payload holds borders, from all their pieces."""
    carry = verified.groupBy("file", "block").agg(F.max("mine").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select("file", "block", F.last("last", ignorenulls=True).over(before).alias("earlier"))
    owned = odd.join(carry, ["file", "block"]).withColumn("owner", F.coalesce("mine", "earlier"))
    owned = owned.where(~F.col("owner.whole") & (F.col("off") < F.col("owner.next"))).select("file", "at", "off", F.col("owner.off").alias("of"))
    first = F.col("off") == F.col("of")
    parts = pieces.join(owned, ["file", "at"])
    heads = parts.where(first).drop("data", "at", "off", "block", "size", "begins")
    data = parts.groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("off", "data"))).alias("parts"))
    joined = F.expr(f"reduce(slice(parts, 2, size(parts)), parts[0].data, (a, x) -> concat(a, X'{BORDER.encode().hex()}', x.data))")
    return heads.join(data.select("file", "of", joined.alias("data")), ["file", "of"]).drop("of")


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, rf"\A{RECORD_ID}(-?[0-9]+)>\z", 1).try_cast("long")


def restored(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to; a revisit has its response's payload."""
    scratch = Scratch(records.sparkSession, "warc-restored")
    own = records.select(page_of(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.col("type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"))
    own = scratch.table(own, "records")
    wanted = own.where("record_type = 'revisit'")
    of = own.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to")).agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    revisits = wanted.drop("payload_bytes", "payload_digest").join(of, "refers_to", "left")
    return own.where("record_type = 'response'").unionByName(revisits)


def op12_warc(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc-archive")
    path = f"{scratch.root}/archives"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return restored(read_warc(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
n AS (SELECT *, CASE WHEN strlen(t) >= 1000 THEN max(page_id) OVER (PARTITION BY t) END AS newest FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN newest <> coalesce(page_id, newest - 1) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN newest <> coalesce(page_id, newest - 1) THEN newest END AS refers_to FROM n
"""
