"""Files to chunks: greedy line packing with an overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.functions.text import chunk_id, token_count
from recall_engine.operators.ranges import greedy_starts


def pack_lines(lines: list[str], most: int, overlap: int, strict: bool = False) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, content), 1-based: lines join while their tokens
    (with the line end) stay within ``most``; a new chunk repeats tail lines
    until they hold ``overlap`` tokens.  These may lift it above ``most``; with
    ``strict`` those that do are left out."""
    cost = [-(-(len(x) + 1) // 4) for x in lines]
    first, size = 0, 0
    for i, c in enumerate(cost):
        if size + c > most and i > first:
            yield first + 1, i, "\n".join(lines[first:i])
            back, again = i, 0
            while back > first and again < overlap:
                back -= 1
                again += cost[back]
            while strict and back < i and again + c > most:
                again -= cost[back]
                back += 1
            first, size = back, again
        size += c
    yield first + 1, len(lines), "\n".join(lines[first:])


def within(parts: Iterator[tuple[int, int, str]], hard: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """The chunks of pack_lines, those above ``hard`` tokens cut once more: by
    lines, and lines above it by characters, each part of the same line."""
    for first, last, content in parts:
        if -(-len(content) // 4) <= hard:
            yield first, last, content
            continue
        lines, begin = content.split("\n"), 0
        for i, line in enumerate([*lines, None]):
            if line is not None and -(-(len(line) + 1) // 4) <= hard:
                continue
            if i > begin:
                yield from ((first + begin + a - 1, first + begin + b - 1, x) for a, b, x in pack_lines(lines[begin:i], hard, overlap, strict=True))
            if line is not None:
                width = 4 * hard
                yield from ((first + i, first + i, line[at : at + width]) for at in range(0, len(line), width))
            begin = i + 1


def line_chunks(files: DataFrame, most: int = 6000, overlap: int = 200, id_col: str = "file_path", text_col: str = "content", hard: int = 7500) -> DataFrame:
    """(file_path, start_line, end_line, content, token_count, id) of every file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *chunk) for path, text in zip(frame["file_path"], frame["content"], strict=True) for chunk in within(pack_lines((text or "").split("\n"), most, overlap), hard, overlap)]
            yield pd.DataFrame(rows, columns=["file_path", "start_line", "end_line", "content"])

    cut = files.select(F.col(id_col).cast("string").alias("file_path"), F.col(text_col).alias("content")).mapInPandas(run, "file_path string, start_line int, end_line int, content string")
    return cut.withColumns({"token_count": token_count(F.col("content")), "id": chunk_id(F.col("file_path"), F.col("start_line"), F.col("content"))})


def greedy_batches(rows: DataFrame, most: int, by: str, order: str, cost: str) -> DataFrame:
    """(by, order, batch), batch from 0 in each ``by``: rows in order join while
    their cost stays within ``most``; a costlier row is a batch of its own."""
    return greedy_starts(rows, most, by, order, cost)


def budget_batches(rows: DataFrame, most: int, by: str, order: str, cost: str) -> DataFrame:
    """Adds ``batch``, as greedy_batches says; rows meet it by (by, order), which
    is theirs alone, so other columns don't go through the batching."""
    return rows.join(greedy_batches(rows, most, by, order, cost), [by, order])
