"""Source files to chunks by their declarations.

Python files are parsed by the language's own parser, files of eleven other
languages by a lexer in one pass (declarations.py).  Python that doesn't parse is scanned by indentation.
Files without declarations are one chunk; chunks above the token limit are cut
by lines, and lines above the hard limit by characters.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.functions.text import chunk_id, token_count
from recall_engine.operators.chunking import pack_lines, within
from recall_engine.operators.declarations import LANGUAGES, Chunk, declarations

_CONTEXT = re.compile(r"^\s*(?:import\b|from\b|use\b|using\b|package\b|#include\b|require\b|//|#|/\*|\*)")
DECLARING = {"python", *LANGUAGES}


def python_declarations(text: str) -> list[Chunk]:
    """Functions, methods and classes, nested ones too, with their decorators."""
    found = []

    def visit(node: ast.AST, parent: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                found.append(Chunk(first, child.end_lineno, "class" if is_class else "method" if in_class else "function", child.name, parent))
                visit(child, child.name, is_class)
            else:
                visit(child, parent, in_class)

    visit(ast.parse(text), "", False)
    return found


_PYTHON = re.compile(r"^([ \t]*)(?:(class)|(?:async[ \t]+)?def)[ \t]+(\w+)")


def indented_declarations(text: str) -> list[Chunk]:
    """Functions and classes of Python that doesn't parse: each from its line to
    the next one that isn't indented deeper, blank lines and comments aside."""
    lines, found = text.split("\n"), []
    open_: list[tuple[int, Chunk]] = []
    last = 0
    for i, line in enumerate(lines, 1):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        while open_ and open_[-1][0] >= depth:
            open_.pop()[1].end_line = last
        if m := _PYTHON.match(line):
            above = open_[-1][1] if open_ else None
            kind = "class" if m[2] else "method" if above and above.chunk_type == "class" else "function"
            found.append(Chunk(i, i, kind, m[3], above.name if above else ""))
            open_.append((depth, found[-1]))
        last = i
    for _, chunk in open_:
        chunk.end_line = last
    return found


def braced_declarations(text: str, language: str = "typescript") -> list[Chunk]:
    return declarations(text, language)


def chunks_of(text: str, language: str, most: int, hard: int, overlap: int) -> Iterator[tuple[int, int, str, str, str, str, str]]:
    """(start_line, end_line, content, chunk_type, name, parent, context)."""
    lines = text.split("\n")
    found: list[Chunk] = []
    if language in DECLARING:
        try:
            found = python_declarations(text) if language == "python" else declarations(text, language)
        except (SyntaxError, ValueError, RecursionError):
            found = indented_declarations(text)
    context = ""
    if found:
        head = lines[: found[0].start_line - 1]
        context = "\n".join([x for x in head if _CONTEXT.match(x)][:15])
    for c in found or [Chunk(1, len(lines), "file", "", "")]:
        body = lines[c.start_line - 1 : c.end_line]
        limit = most if sum(-(-(len(x) + 1) // 4) for x in body) > most else hard
        parts = [*within(pack_lines(body, limit, overlap), hard, overlap)]
        for k, (first, last, content) in enumerate(parts, 1):
            name = c.name if len(parts) == 1 else f"{c.name or c.chunk_type}_part{k}"
            yield c.start_line + first - 1, c.start_line + last - 1, content, c.chunk_type, name, c.parent, context


def code_chunks(files: DataFrame, most: int = 6000, hard: int = 7500, overlap: int = 200) -> DataFrame:
    """Chunks of files (project_id, path, language, hash, content).

    A null content counts as empty: one empty chunk.  Nested declarations give
    chunks of their own beside the one that holds them.
    """
    schema = "project_id string, file_path string, language string, file_hash string, start_line int, end_line int, content string, chunk_type string, name string, parent string, context string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for frame in frames:
            for at in range(0, len(frame), 64):
                rows = [(f.project_id, f.path, f.language, f.hash, *chunk) for f in frame.iloc[at : at + 64].itertuples() for chunk in chunks_of(f.content or "", f.language or "", most, hard, overlap)]
                yield pd.DataFrame(rows, columns=names)

    cut = files.select("project_id", "path", "language", "hash", "content").mapInPandas(run, schema)
    return cut.withColumns({"token_count": token_count(F.col("content")), "id": chunk_id(F.col("file_path"), F.col("start_line"), F.col("content"))})


def declares(language: str) -> bool:
    """Whether declarations of a language are looked for."""
    return language in DECLARING


def fits(text: str, hard: int = 7500) -> bool:
    """Whether a text is within the limit of one embedding."""
    return -(-len(text) // 4) <= hard
