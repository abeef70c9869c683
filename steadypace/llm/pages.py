"""Main text of web pages by wrappers learned for each host.

Class words are counted by host first; those on at least one page in ``RARE`` name elements, and ids never
do, so words of single pages are in no wrapper. Every task aligns its own pages into one wrapper for each
host it sees; wrappers of a host are then aligned in rounds of ``FAN`` at a time. Long streams in a wrapper
are folded by label, so its size follows the labels of the host's template, not the number of pages.
A last pass over the pages takes the text of the region that the host's wrapper names.

The regions are broadcast if their counted size allows, otherwise joined by host. Every page counts for the
wrappers; none is sampled.

Nulls: null or empty html gives an empty text; pages without a host (null URL) share one wrapper. Repeated
pages are each answered. An empty table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadypace.llm import wrappers as w
from steadypace.llm.common import with_package
from steadypace.llm.urls import host_of
from steadypace.session import materialise

FAN = 32
RARE = 10
HELD = 100_000
BROADCAST_BYTES = 16 << 20


def _with(pages: DataFrame, by_host: DataFrame, column: str) -> DataFrame:
    size = by_host.agg(F.sum(F.octet_length("host") + F.octet_length(column) + 64)).first()[0] or 0
    return pages.join(F.broadcast(by_host) if size <= BROADCAST_BYTES else by_host, "host", "left")


def host_words(pages: DataFrame) -> DataFrame:
    """(host, words): class words of at least one in ``RARE`` of a host's pages, so at most RARE times as
    many as an average page has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.record_batch({"host": pa.array([h for h, _ in held], pa.string()),
                                    "word": pa.array([w for _, w in held], pa.string()),
                                    "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return rows

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                if page.is_valid:
                    held.update((host, word) for word in w.class_words(page.as_py()) | {""})
                    if len(held) > HELD:
                        yield out()
        yield out()

    counted = pages.select("host", "html").mapInArrow(run, "host string, word string, n long")
    counted = materialise(counted.groupBy("host", "word").agg(F.sum("n").alias("n")))
    every = counted.where("word = ''").select("host", F.col("n").alias("pages"))
    return counted.join(every, "host").where(F.col("n") * RARE >= F.col("pages")).groupBy("host").agg(
        F.array_join(F.sort_array(F.collect_list("word")), " ").alias("words"))


def _parsed(page: str, words: str | None, sets: dict[str | None, frozenset]) -> list:
    if words not in sets:
        if len(sets) > 10_000:
            sets.clear()
        sets[words] = frozenset((words or "").split())
    return w.parse(page, sets[words])


def _learned(pages: DataFrame) -> DataFrame:
    """(host, part, wrapper): one row for each host and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, list] = {}
        sets: dict[str | None, frozenset] = {}
        for batch in batches:
            hosts, words = batch.column("host").to_pylist(), batch.column("words").to_pylist()
            for host, page, known in zip(hosts, batch.column("html"), words):
                if not page.is_valid:
                    continue
                new = [1, w.wrapper_of(_parsed(page.as_py(), known, sets))]
                held[host] = w.combine(held[host], new) if host in held else new
        n = len(held)
        yield pa.record_batch({
            "host": pa.array(list(held), pa.string()),
            "part": pa.array([TaskContext.get().partitionId()] * n, pa.int64()),
            "wrapper": pa.array([json.dumps(x) for x in held.values()], pa.string()),
        })

    return pages.select("host", "html", "words").mapInArrow(run, "host string, part long, wrapper string")


def _joined(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    total = None
    for text in group.sort_values("part")["wrapper"]:
        total = json.loads(text) if total is None else w.combine(total, json.loads(text))
    return pd.DataFrame({"host": [key[0]], "part": [key[1]], "wrapper": [json.dumps(total)]})


def host_wrappers(pages: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(host, wrapper): the alignment of all pages of each host. ``words`` is ``host_words`` of the pages."""
    pages = _with(pages.select("host", "html"), materialise(host_words(pages)) if words is None else words, "words")
    found, most = _learned(pages), max(1, pages.rdd.getNumPartitions())
    while most > 1:
        found = found.withColumn("group", F.floor(F.col("part") / FAN)).groupBy("host", "group").applyInPandas(
            _joined, "host string, part long, wrapper string")
        most = -(-most // FAN)
    return found.select("host", "wrapper")


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars."""
    with_package(pages.sparkSession)
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w.region(json.loads(x)) for x in batch.column("wrapper").to_pylist()]
            yield pa.record_batch({"host": batch.column("host"),
                                   "region": pa.array([json.dumps(r) for r in found], pa.string())})

    words = materialise(host_words(pages))
    regions = materialise(host_wrappers(pages, words).mapInArrow(name, "host string, region string"))
    joined = _with(_with(pages, regions, "region"), words, "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, tuple] = {}
        sets: dict[str | None, frozenset] = {}
        for batch in batches:
            texts = []
            regions, words = batch.column("region").to_pylist(), batch.column("words").to_pylist()
            for page, region, known in zip(batch.column("html"), regions, words):
                if not page.is_valid:
                    texts.append("")
                    continue
                tree = _parsed(page.as_py(), known, sets)
                if region not in places:
                    if len(places) > 10_000:
                        places.clear()
                    places[region] = tuple(json.loads(region)) if region else ([],)
                text = w.extract(tree, *places[region])
                texts.append(text or w.own_text(tree))  # the latter if unlike the host's other pages
            yield pa.record_batch({"page_id": batch.column("page_id").cast(pa.int64()),
                                   "url": batch.column("url"), "text": pa.array(texts, pa.string()),
                                   "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return joined.select("page_id", "url", "html", "region", "words").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
