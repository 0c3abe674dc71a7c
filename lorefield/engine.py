"""One object for a corpus: the queries a user runs, by name."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefield.functions import globs
from lorefield.operators import events, graph, recall, schedule, search, stats, tags
from lorefield.plans.spec import SearchSpec, apply_filters
from lorefield.session import read_table


class Corpus:
    """Tables of a corpus below one folder. Every method returns a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @property
    def chunks(self) -> DataFrame:
        return self.table("chunk_results").select("chunk_id", "path", "chunk_range", "text")

    @property
    def tags(self) -> DataFrame:
        return self.table("tag_values").distinct()

    @property
    def chunk_paths(self) -> DataFrame:
        return self.chunks.select("chunk_id", "path").distinct()

    def search(self, spec: SearchSpec, about: dict[str, DataFrame] | None = None) -> DataFrame:
        """(chunk_id, path, score): the best ``k`` chunks that pass the stack and the path globs."""
        include, exclude = spec.paths()
        rows = apply_filters(self.chunks, list(spec.filters), self.tags, about)
        if include or exclude:
            rows = rows.filter(globs.passes(F.col("path"), include, exclude))
        for pattern in spec.regex:
            rows = rows.filter(F.col("text").rlike(pattern))
        query = spec.contains or spec.about
        if not query:
            return rows.select("chunk_id", "path", F.lit(1.0).alias("score")).distinct().orderBy("path", "chunk_id").limit(spec.k)
        if spec.contains and not spec.fuzzy:
            rows = rows.filter(F.contains(F.lower("text"), F.lit(spec.contains.lower())))
        if spec.multi:
            return search.multi(rows, query, spec.k)
        strategy = "fuzzy" if spec.fuzzy else spec.score
        if strategy:
            return search.ranked(search.by_strategy(rows, query, strategy), spec.k)
        return search.escalating(rows, query, spec.k)

    def grouped(self, spec: SearchSpec) -> DataFrame:
        return search.grouped(self.search(spec), self.table("files"))

    def tag_totals(self) -> DataFrame:
        return tags.totals(self.tags)

    def tag_values(self, tag: str, prefix: str = "") -> DataFrame:
        return tags.values(self.tags, tag, prefix)

    def tag_files(self, names: list[str]) -> DataFrame:
        return tags.files_of(self.tags, self.chunk_paths, names)

    def tag_complete(self, prefix: str) -> DataFrame:
        return tags.complete(self.tags, prefix)

    def inbox(self, folder: str, show_all: bool = False) -> DataFrame:
        return tags.inbox(self.tags, self.chunk_paths, folder, show_all)

    def routes(self) -> DataFrame:
        return graph.routes(self.tags, self.chunks)

    def links(self) -> DataFrame:
        return graph.resolve_links(self.tags, self.chunks)

    def recall(self, inputs: list[str], k: int = 20) -> DataFrame:
        passes = {"trigram": recall.trigram_pass(self.chunks, inputs, 50), "tag": recall.tag_pass(tags.sources(self.tags), inputs, 50)}
        return recall.merge_axes(passes).orderBy(F.desc("score"), "chunk_id").limit(max(1, min(k, 200)))

    def scheduled(self, tag: str, start: datetime, end: datetime) -> DataFrame:
        return schedule.recurring(self.tags, tag, start, end)

    def published(self, subscriptions: list[events.Subscription]) -> DataFrame:
        return events.match(events.clean_events(self.table("tag_events")), subscriptions)

    def chunk_sizes(self) -> DataFrame:
        rows = self.chunks.filter("text is not null").select("chunk_id", "path", F.length("text").alias("size")).distinct()
        rows = rows.join(self.table("files").select("path", "strategy").distinct(), "path", "left")
        return stats.size_statistics(rows.select(F.coalesce("strategy", F.lit("none")).alias("strategy"), "size"), "strategy", "size", (0.5, 0.9, 0.95, 0.99))
