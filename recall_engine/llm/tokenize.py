"""Encoding with public tokenizer files: tokenizers (JSON) and tiktoken (ranks).

Encoders live in the Python workers, one per process and file.  Vocabulary
paths are parameters; executors need the files at the same path.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.llm.textcols import slices

_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ſ"
#: Any character outside of ASCII and composed Latin letters, and the apostrophe:
#: texts with one take the general way.
_OTHER = re.compile(f"[^\\t\\n\\r\\x20-\\x26\\x28-\\x7e{_LETTER[6:]}]")
#: Units of Latin text that the tokenizers' own patterns never merge or cut.
#: A vocabulary of words drops white space; a byte-level one keeps it.
_WORD_UNIT = re.compile(f"[{_LETTER}]+|[^\\s{_LETTER}]+")
_BYTE_UNIT = re.compile(f" ?[{_LETTER}]+| ?[0-9]+| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+")
#: In any text: a single space between two characters that no one counts as space.
_GAP = re.compile(r"(?<=\S) (?=\S)")
#: Where a long text may be cut for tiktoken: before white space that follows
#: none.  No match of the pattern begins before such a place and ends after it.
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \t\r\n])")
_LONG_TEXT = 1 << 16
#: Fixed value: what the pattern's \\s stands for (Unicode's White_Space).
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run of white space that is too long for the pattern's look-ahead.  But for
#: its last character before other text it is one match, \\s+(?!\\S).
_LONG_WHITE = re.compile(f"[{_WHITE}]{{4096,}}(?![^{_WHITE}])|[{_WHITE}]{{4096,}}(?=[{_WHITE}][^{_WHITE}])")
_LETTERS = re.compile(f"[{_LETTER}]+")
#: Byte-level vocabularies write bytes that aren't printable Latin-1 as the
#: characters from 256 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class UnitEncoder:
    """Encodes texts by a tokenizers file, each distinct unit once.

    Ids equal those of the library's encode(text, add_special_tokens=False):
    a special token that is spelled out in a text gets its own id.  Texts that
    hold one go to the library whole.  The memory of units is bounded and
    starts anew when full.
    """

    CACHED_UNITS = 1_000_000

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.keeps_space = keeps_space
        self.known: dict[str, bytes] = {}

    def units(self, text: str) -> list[str]:
        if not self.keeps_space:
            if _OTHER.search(text):
                return [x for x in re.split("[ \n]+", text) if x]
            return _WORD_UNIT.findall(text.lower())
        if _OTHER.search(text):
            first, *rest = _GAP.split(text)
            return [first, *(" " + x for x in rest)]
        return _BYTE_UNIT.findall(text)

    def learn(self, new: list[str]) -> None:
        """Encodes new units.  One that the tokenizer's pattern leaves whole goes
        to its merges alone; the others take the whole way."""
        merges, whole = self.tokenizer.model.tokenize, []
        one = _BYTE_UNIT if self.keeps_space else _LETTERS
        for unit in new:
            if one.fullmatch(unit) and not _OTHER.search(unit) and (self.keeps_space or unit.islower()):
                ids = [t.id for t in merges(unit.encode().decode("latin-1").translate(_BYTE_LETTERS))]
                self.known[unit] = np.array(ids, np.uint32).tobytes()
            else:
                whole.append(unit)
        for unit, found in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            self.known[unit] = np.array(found.ids, np.uint32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One uint32 array for each text."""
        if len(self.known) > self.CACHED_UNITS:
            self.known.clear()
        whole = {i for i, x in enumerate(texts) if self.added and self.added.search(x)}
        dealt = [[] if i in whole else self.units(x) for i, x in enumerate(texts)]
        found = [list(map(self.known.get, x)) for x in dealt]
        gaps = []
        for units, ids in zip(dealt, found, strict=True):
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                gaps.append((ids, at, units[at]))
        self.learn([*{unit for _, _, unit in gaps}])
        for ids, at, unit in gaps:
            ids[at] = self.known[unit]
        for _, _, unit in gaps:  # long units seldom come again
            if len(unit) > 64:
                self.known.pop(unit, None)
        for i in whole:
            found[i] = [np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32).tobytes()]
        return [np.frombuffer(b"".join(x), np.uint32) for x in found]


@lru_cache(maxsize=4)
def unit_encoder(path: str, keeps_space: bool) -> UnitEncoder:
    return UnitEncoder(path, keeps_space)


@lru_cache(maxsize=4)
def rank_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces_of(text: str, limit: int = _LONG_TEXT) -> Iterator[str]:
    """The text cut at safe places into pieces of ``limit`` characters or, where
    no safe place comes, more."""
    at = 0
    while len(text) - at > limit:
        cut = _SAFE_CUT.search(text, at + limit)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(encoding, text: str) -> list[int]:
    """The ids of encode_ordinary, for texts of any length: runs of 4096 or more
    white-space characters are matches of their own and go to the merges alone."""
    ids, at = [], 0
    for run in _LONG_WHITE.finditer(text) if len(text) > 4096 else ():
        for piece in pieces_of(text[at : run.start()]):
            ids += encoding.encode_ordinary(piece)
        ids += merged(encoding, run[0])
        at = run.end()
    for piece in pieces_of(text[at:]):
        ids += encoding.encode_ordinary(piece)
    return ids


def merged(encoding, text: str) -> list[int]:
    """The merges of one match of the pattern."""
    raw = text.encode()
    rank = encoding._mergeable_ranks.get(raw)
    return [rank] if rank is not None else encoding._encode_single_piece(raw)


def id_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=ends[1:])
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode_ranks(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """Adds ``into`` (array<int>): the byte-level BPE ids of each whole text.

    Each match of ``pattern`` is merged by the ranks on its own, no special
    tokens.  Null text counts as empty: no ids.  Texts of any length are encoded
    whole: long ones are cut where no match can cross, and long runs of white
    space are merged by themselves.  Other columns stay; one called ``into`` is
    replaced.  Rows don't depend on each other, so repeated rows, ties and an
    empty table need no rule.
    """
    keep = [c for c in docs.columns if c != into]

    def run(batches):
        encoding = rank_encoding(ranks_path, pattern)
        for batch in slices(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            arrays = [np.array(encode_text(encoding, t or ""), np.uint32) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), id_lists(arrays)], [*batch.schema.names, into])

    out = docs.select(*keep)
    return out.mapInArrow(run, out.withColumn(into, F.array(F.lit(1))).schema)


def decode_ranks(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds ``into`` (binary): the bytes that the ids of each row stand for.

    Bytes, not text: an id may end within a character.  Null ids count as none.
    """
    keep = [c for c in encoded.columns if c != into]

    def run(batches):
        encoding = rank_encoding(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(part.schema.get_field_index(ids_col))
                raw = [encoding.decode_bytes(x.as_py() or []) for x in ids]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns)), pa.array(raw, pa.binary())], [*part.schema.names, into])

    out = encoded.select(*keep)
    return out.mapInArrow(run, out.withColumn(into, F.lit(b"")).schema)
