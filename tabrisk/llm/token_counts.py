"""Token counts of fields or sections, by offsets.

Every document is encoded once, as a whole, with the character span of each
token.  The sections of a document are character intervals; tokens and
sections are joined on overlap.  Encoding each section alone would give other
tokens at the boundaries, so their counts would not add up to the document's.

A token that overlaps several sections goes to exactly one, by ``rule``:
``"start"`` the section of its first character, ``"end"`` the section of its
last, ``"majority"`` the one with most of its characters (the earlier of
equals).  A token that overlaps no section is counted under section ``-1``.
``n_crossing`` counts the tokens of a section that also overlap another.

Defined results: a NULL or empty text has one empty section 0 without tokens
(if it has a span column, whatever that says); sections without tokens are
returned with 0; repeated rows are returned repeatedly; NULL identifiers stay
NULL; other columns are not read.  Sections must not overlap; a NULL span
list, a NULL span or a span that ends before it starts is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.llm.pieces import cut_buffer, text_slices
from tabrisk.llm.tokens import encoder

RULES = ("start", "end", "majority")


def line_sections(texts: pa.Array, max_chars: int):
    """Lines (each with its newline), cut further every ``max_chars`` characters:
    (document, section, start, end) arrays, sorted."""
    data, bounds = cut_buffer(texts)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = chars[bounds]
    newline = chars[np.flatnonzero(data == 10)] + 1
    starts = np.unique(np.concatenate([ends[:-1], newline[newline < ends[-1]]]))
    stops = np.append(starts[1:], ends[-1])
    # empty documents share their start with the next one: listed apart below
    parts = np.maximum(1, -(-(stops - starts) // max_chars))
    first = np.repeat(starts, parts)
    step = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first + step * max_chars
    stop = np.minimum(begin + max_chars, np.repeat(stops, parts))
    begin, stop = begin[stop > begin], stop[stop > begin]
    doc = np.searchsorted(ends, begin, "right") - 1
    empty = np.flatnonzero(np.diff(ends) == 0)
    doc = np.concatenate([doc, empty])
    begin = np.concatenate([begin, ends[empty]])
    stop = np.concatenate([stop, ends[empty]])
    order = np.lexsort((begin, doc))
    doc, begin, stop = doc[order], begin[order], stop[order]
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    return doc, number, begin - ends[doc], stop - ends[doc]


def span_sections(texts: pa.Array, spans: pa.Array):
    """Sections given as lists of structs ``start, end`` (code points)."""
    doc, number, begin, stop = [], [], [], []
    for d, own in enumerate(spans.to_pylist()):
        if texts[d].as_py() in (None, ""):
            own = [{"start": 0, "end": 0}]
        for n, s in enumerate(own or []):
            if s and s["start"] is not None and s["end"] is not None and s["end"] >= s["start"]:
                doc.append(d), number.append(n), begin.append(s["start"]), stop.append(s["end"])
    doc, number, begin, stop = (np.array(x, np.int64) for x in (doc, number, begin, stop))
    order = np.lexsort((begin, doc))
    return doc[order], number[order], begin[order], stop[order]


def allocate(token_doc, spans, doc, begin, stop, rule: str):
    """(section index or -1, crossing flag) per token; sections sorted by document and start."""
    if not len(token_doc) or not len(doc):
        return np.full(len(token_doc), -1), np.zeros(len(token_doc), bool)
    width = int(max(spans[:, 1].max(), stop.max())) + 1
    left, right = token_doc * width + spans[:, 0], token_doc * width + np.maximum(spans[:, 1], spans[:, 0] + 1)
    from_, to = doc * width + begin, doc * width + stop
    solid = np.flatnonzero(to > from_)
    if not len(solid):
        return np.full(len(token_doc), -1), np.zeros(len(token_doc), bool)
    f, t = from_[solid], to[solid]
    lo = np.searchsorted(t, left, "right")       # first section that ends after the token starts
    hi = np.searchsorted(f, right, "left") - 1   # last section that starts before the token ends
    hit = lo <= hi
    crossing = hi > lo
    pick = np.where(hit, hi if rule == "end" else lo, 0)
    if rule == "majority":
        for i in np.flatnonzero(crossing):
            own = np.arange(lo[i], hi[i] + 1)
            pick[i] = own[np.argmax(np.minimum(t[own], right[i]) - np.maximum(f[own], left[i]))]
    return np.where(hit, solid[pick], -1), crossing


def token_counts(docs: DataFrame, vocabulary: str, rule: str = "majority", max_chars: int = 2000,
                 spans_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, section, start, end, n_tokens, n_crossing`` per section.

    Sections are the intervals in ``spans_col`` (array of structs with fields
    ``start`` and ``end``), or the lines of the text cut every ``max_chars``.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches):
        enc = encoder(vocabulary, spans=True)
        for batch in batches:
            for part in text_slices(batch, "_text"):
                texts = part.column("_text")
                _, bounds, spans = enc.encode(texts, spans=True)
                owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
                if spans_col is None:
                    doc, number, begin, stop = line_sections(texts, max_chars)
                else:
                    doc, number, begin, stop = span_sections(texts, part.column("_spans"))
                at, crossing = allocate(owner, spans, doc, begin, stop, rule)
                tokens = np.bincount(at[at >= 0], minlength=len(doc))
                across = np.bincount(at[crossing & (at >= 0)], minlength=len(doc))
                lost = np.bincount(owner[at < 0], minlength=len(texts))
                none = np.flatnonzero(lost)
                ids = part.column("_id")
                rows = pa.array(np.concatenate([doc, none]))
                columns = [np.concatenate(x) for x in (
                    (number, np.full(len(none), -1)), (begin, np.zeros(len(none), np.int64)),
                    (stop, np.zeros(len(none), np.int64)), (tokens, lost[none]),
                    (across, np.zeros(len(none), np.int64)))]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                    ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"),
                       *([F.col(spans_col).alias("_spans")] if spans_col else []))
    return rows.mapInArrow(count, "doc_id bigint, section int, start bigint, end bigint, n_tokens bigint, n_crossing bigint")
