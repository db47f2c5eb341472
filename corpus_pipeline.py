"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing to target weights, packing.

Each stage takes what the one before it kept. run() writes each stage's rows to the shared folder and reads them
again, so that a lost executor costs no more than one stage.
"""

from __future__ import annotations

from pagewright.llm.common import Scratch
from pagewright.llm.line_dedup import without_emptied
from pagewright.llm.mixing import mixed_documents
from pagewright.llm.near_dedup import one_of_each_group
from pagewright.llm.packing import pack_documents
from pagewright.llm.quality import quality_filter


def quality(spark, docs, sf_dir):
    """Documents that the adaptive rules reject go."""
    return quality_filter(docs)


def line_dedup(spark, docs, sf_dir):
    """Lines spread over many sources go, all but their first occurrence; documents left without a word go."""
    return without_emptied(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays."""
    return one_of_each_group(docs)


def mixing(spark, docs, sf_dir):
    """Documents as often as the mix to target weights draws them."""
    return mixed_documents(docs)


def packing(spark, docs, sf_dir):
    """Token pieces and their places in sequences."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Signatures, tokens and hypergeometric draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs, name)
    return docs
