"""Main text of web pages by differencing with the page of nearest URL.

Pages are ranked by host, path and url; each is aligned with its nearest neighbour of the host by the longest common
subsequence of text lines, and shared lines go: they belong to the template. What the markup names as
furniture goes as well, and paragraphs of a marked article stay even if shared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from os.path import commonprefix
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .markup import FURNITURE, OPEN, lines, shared
from .urls import host_of, path_of


@dataclass(frozen=True)
class Differencing:
    group: int = 200  # ranks in a block
    near: int = 4  # pages beyond either end of a block that it sees in a row; from there distances double
    own: float = 0.1  # a neighbour that leaves less of a page's lines, or one line only, is a copy; others are looked for


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, the page's lines but furniture as ``texts``, and of all its lines ``marks`` (hashes), ``kinds`` and a ``digest``."""

    def run(batches):
        for batch in batches:
            found = [lines(h or "") for h in batch.column("html").to_pylist()]
            marks = [[int.from_bytes(blake2b(x.text.encode(), digest_size=8).digest(), "big", signed=True) for x in f] for f in found]
            kinds = [[x.kind for x in f] for f in found]
            digest = [blake2b(repr((m, k)).encode(), digest_size=16).digest() for m, k in zip(marks, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array([[x.text for x in f if x.kind != FURNITURE] for f in found], pa.list_(pa.string())),
                 pa.array(marks, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int32())), pa.array(digest, pa.binary())],
                names=["page_id", "url", "texts", "marks", "kinds", "digest"])

    kind = pages.schema["page_id"].dataType.simpleString()
    read = pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kind}, url string, texts array<string>, marks array<long>, kinds array<int>, digest binary")
    return read.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``rank`` (from 0) by host, path, url and page_id, and no task that sees more than its range."""
    order = ["host", "path", "url", "page_id", "digest"]
    sorted_ = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sorted_ = sorted_.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return sorted_.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def _blocks(ranked: DataFrame, total: int, cfg: Differencing) -> DataFrame:
    """A row for each block that a page is in (``own``) or is shown to: blocks are runs of ``group`` ranks and see the
    pages just before and behind them, and further ones at doubling distances."""
    steps = list(range(1, cfg.near + 1))
    while steps[-1] * 2 < total:
        steps.append(steps[-1] * 2)
    all_, last = f"array({', '.join(f'{d}L' for d in steps)})", (total - 1) // cfg.group
    before = f"transform(filter({all_}, d -> (rank + d) % {cfg.group} = 0), d -> (rank + d) div {cfg.group})"
    behind = f"transform(filter({all_}, d -> (rank - d + 1) % {cfg.group} = 0), d -> (rank - d + 1) div {cfg.group} - 1)"
    found = F.expr(f"array_distinct(concat(array(rank div {cfg.group}), {before}, {behind}))")
    rows = ranked.withColumn("block", F.explode(found)).filter(F.col("block").between(0, last))
    return rows.withColumn("own", F.expr(f"block = rank div {cfg.group}"))


class _Page(NamedTuple):
    host: str
    path: str
    rank: int
    lines: list
    kinds: list[int]


def _around(at: int, group: list[_Page]) -> Iterator[int]:
    """Places of the other pages of the host, those of longest common path first, then the nearer ones. Pages are
    in order of rank, so common paths get no longer on the way out to either side."""
    page, low, high = group[at], at - 1, at + 1
    while True:
        left = group[low] if low >= 0 and group[low].host == page.host else None
        right = group[high] if high < len(group) and group[high].host == page.host else None
        if left is None and right is None:
            return
        near = lambda p: (-1, 0) if p is None else (len(commonprefix([page.path, p.path])), -abs(p.rank - page.rank))
        if near(left) >= near(right):
            yield low
            low -= 1
        else:
            yield high
            high += 1


def _gone(at: int, group: list[_Page], cfg: Differencing) -> list[int]:
    """Which of the page's lines but furniture go, counted from 0. The first neighbour that leaves enough own lines
    serves, else the one that leaves most; one that leaves none never does."""
    page = group[at]
    if OPEN not in page.kinds:
        return []
    inside = [k for k, kind in enumerate(page.kinds) if kind != FURNITURE]
    enough, most, best = max(2, cfg.own * len(inside)), 0, None
    for j in _around(at, group):
        there = set(group[j].lines)
        own = sum(page.lines[k] not in there for k in inside)
        if own > most:
            most, best = own, j
        if own >= enough:
            break
    if best is None:
        return []
    both = shared(page.lines, group[best].lines)
    return [n for n, k in enumerate(inside) if k in both and page.kinds[k] == OPEN]


def shared_lines(pages: DataFrame, cfg: Differencing = Differencing()) -> DataFrame:
    """(host, digest, gone): for pages as ``parsed`` gives them, which of the lines but furniture go, counted from 0.
    Pages of a host with equal lines count as one, at the place of the first; nothing but hashes of lines is moved."""
    first = F.min(F.struct("path", "url", "page_id", "marks", "kinds")).alias("p")
    ranked = _ranked(cut(pages.groupBy("host", "digest").agg(first)).select("host", "digest", "p.*"))
    total = ranked.count()

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank")
        members = [_Page(h, p, r, m.tolist(), k.tolist()) for h, p, r, m, k in zip(*(block[c] for c in ("host", "path", "rank", "marks", "kinds")))]
        gone = [_gone(i, members, cfg) if own else [] for i, own in enumerate(block["own"])]
        out = pd.DataFrame({"host": block["host"], "digest": block["digest"], "gone": gone})
        return out[[bool(g) for g in gone]]

    columns = ["block", "rank", "own", "host", "path", "digest", "marks", "kinds"]
    return _blocks(ranked, total, cfg).select(columns).groupBy("block").applyInPandas(run, "host string, digest binary, gone array<int>")


def extract(pages: DataFrame, cfg: Differencing = Differencing()) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html; nothing else is read): page_id, url, text (blocks
    joined by an empty line, empty if none) and n_chars.

    Null or empty html gives an empty text; a null url has an empty host and path. Copies of a page never
    serve each other as neighbours, and near copies only where no other page does; a page without a neighbour
    loses what its markup names as furniture only. Repeated rows repeat. An empty table gives an empty result.
    """
    rows = parsed(pages)
    gone = shared_lines(rows.drop("texts"), cfg)
    rows = rows.select("page_id", "url", "texts", "host", "digest").join(gone, ["host", "digest"], "left")
    left = F.filter("texts", lambda x, n: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), n))
    rows = rows.select("page_id", "url", F.array_join(left, "\n\n").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op6(pages: DataFrame) -> DataFrame:
    """The contract of the query."""
    return extract(pages).select("page_id", "url", "text", "n_chars")
