"""Token counts: pieces once per distinct pre-token, joined to each document's pre-token frequencies and summed.

A pre-token here is a run between white space (as the tokenizer's own normaliser sees it): its pieces never reach over
white space, so the count of a text is the sum over its pre-tokens. No ids are made for a document, and the library
tokenises every distinct pre-token of the corpus once.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows that are repeated are each returned.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan, unitsums
from .shared import stored, tidy

#: White space beyond ASCII, as Unicode's White_Space has it (RE2 and Python read it alike). Fixed values.
WIDE_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLOCK_BYTES = 8 << 20


def spaced_units(column: pa.Array):
    """Runs of (first row, first unit of each row, units): the texts' runs between white space."""
    column = column.cast(pa.large_string())
    for row, offsets, data in bytescan.blocks(column, BLOCK_BYTES):
        if (data >= 0xC2).any() and pc.any(pc.match_substring_regex(column.slice(row, len(offsets) - 1), WIDE_SPACE)).as_py():
            plain = pc.replace_substring_regex(column.slice(row, len(offsets) - 1), WIDE_SPACE, " ")
            offsets, data = bytescan.string_buffer(plain)
        inside = bytescan.SPACED[data]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        starts[inner] = inside[inner]
        ends[inner - 1] = inside[inner - 1]
        begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        bounds = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(end - begin, out=bounds[1:])
        units = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[inside])))
        yield row, np.searchsorted(begin, offsets), units.cast(pa.string())


_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        one = Tokenizer.from_file(path)
        one.no_truncation()
        one.no_padding()
        _loaded[path] = one
    return _loaded[path]


def piece_counts(units: DataFrame, tokenizer: str) -> DataFrame:
    """(unit, n) with n_tokens: the library's number of pieces of each unit."""

    def count(batches):
        one = _tokenizer(tokenizer)
        for batch in batches:
            texts, sizes = batch.column(0).to_pylist(), []
            for i in range(0, len(texts), 2000):
                sizes += [len(e) for e in one.encode_batch_fast(texts[i : i + 2000], add_special_tokens=False)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["unit", "n", "n_tokens"])

    return units.mapInArrow(tidy(count), "unit string, n long, n_tokens long")


def count(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", hot: int = unitsums.HOT_UNITS) -> DataFrame:
    """One row per row of `docs`: its key, n_bytes and n_tokens. `tokenizer`: a tokenizers file that every executor can open."""
    known = stored(piece_counts(unitsums.vocabulary(docs, text, spaced_units), tokenizer), "pretokens")
    return unitsums.weighted_sums(docs, known, ["n_tokens"], spaced_units, key, text, hot)


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
