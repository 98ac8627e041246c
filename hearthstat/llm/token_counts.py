"""Token counts of sections, by spans of tokens in whole encoded texts.

A text is encoded once, as a whole, so a section's count holds the tokens the text really
has.  Every token has a span of characters; an interval join of spans with the sections'
spans, by binary search, gives each token the sections it touches.

Rule for a token that touches several sections: it counts once, in the section that holds
most of its characters, in the earlier one of equals.  A character belongs to the section of
its first byte; a token that holds only later bytes of a character counts with that byte.

Sections are the lines of a text, each with the line feed that ends it, numbered from 0.

Defined results: NULL text is the empty text, which has one section without tokens; a text
that ends in a line feed has an empty last section; repeated rows are counted each for
itself; a NULL id stays NULL; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .encode import encoder


def line_sections(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every section, and for each row the index of its first one (n + 1 values)."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    row_of = np.searchsorted(offsets, breaks, "right") - 1
    first = np.concatenate(([0], np.cumsum(1 + np.bincount(row_of, minlength=n))))
    starts = np.empty(first[-1], np.int64)
    starts[first[:-1]] = offsets[:-1]
    starts[np.arange(len(breaks)) + row_of + 1] = breaks + 1
    return starts, first


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and the sections of tokens that touch several.

    ``chars[i]`` counts the characters that begin before byte i.
    """
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    touched = []
    for t in np.flatnonzero(first != last).tolist():
        most, owner = -1, first[t]
        for s in range(first[t], last[t] + 1):
            a, b = max(starts[t], sections[s]), ends[t] if s == last[t] else min(ends[t], sections[s + 1])
            if b > a:
                touched.append(s)
                if chars[b] - chars[a] > most:
                    most, owner = chars[b] - chars[a], s
        first[t] = owner
    return first, np.array(touched, np.int64)


def section_token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``section``, ``start_char``, ``n_chars``, ``n_tokens`` and ``n_crossing`` of every section."""
    longs = ("start_char", "n_chars", "n_tokens", "n_crossing")
    schema = T.StructType([docs.schema[id_col], T.StructField("section", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in longs)])

    def count(batches):
        for batch in batches:
            code = encoder(vocabulary)
            for row, offsets, data, ids, _ in code.slices(batch.column(1)):
                sections, first = line_sections(offsets, data)
                n, m = len(offsets) - 1, len(sections)
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                ends = np.cumsum(code.byte_length[ids])
                owner, crossing = attribute(ends - code.byte_length[ids], ends, sections, chars)
                at = np.repeat(np.arange(n), np.diff(first))
                begin = chars[sections]
                stop = np.append(begin[1:], chars[-1])
                stop[first[1:] - 1] = chars[offsets[1:]]
                columns = [
                    batch.column(0).take(pa.array(at + row)),
                    pa.array(np.arange(m) - first[at], pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (begin - chars[offsets[at]], stop - begin, np.bincount(owner, minlength=m), np.bincount(crossing, minlength=m))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(count, schema)
