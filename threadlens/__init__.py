"""threadlens: Spark-native ingest and enrichment of discussion threads."""

from threadlens.operators.models import FunctionModel, Replay
from threadlens.plans.condense import condense, condense_outcomes
from threadlens.plans.ingest import ingest_comments, ingest_posts
from threadlens.sinks.csv import write_condensed, write_threads
from threadlens.sources.csv import missing_communities, read_threads
from threadlens.sources.dumps import (
    read_comments,
    read_submissions,
    stream_posts,
    stream_submissions,
)
from threadlens.streaming.buckets import deal_out, read_dealt
from threadlens.streaming.incremental import (
    condense_incremental,
    dead_letter,
    ledger,
    results,
)

__all__ = [
    "FunctionModel",
    "Replay",
    "condense",
    "condense_incremental",
    "condense_outcomes",
    "dead_letter",
    "deal_out",
    "ingest_comments",
    "ingest_posts",
    "ledger",
    "missing_communities",
    "read_comments",
    "read_dealt",
    "read_submissions",
    "read_threads",
    "results",
    "stream_posts",
    "stream_submissions",
    "write_condensed",
    "write_threads",
]
