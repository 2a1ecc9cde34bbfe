"""Hits of letter-probability matrices by p-value.

A matrix's log odds become whole numbers, and the distribution of a window's score under the background follows by
convolution over the positions; its survival function is an array by score, which gives each hit its p-value and turns
a p-value into a threshold. Sequences of a batch are coded into one array and scored together, a position at a time.

Edge cases: letters other than A, C, G and T (in any case) are in no hit; a null sequence is empty; sequences shorter
than a matrix have no hits; repeated rows have hits of their own; a threshold of 1 or more gives every window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTERS = "ACGT"
SLICE = 1 << 20  # letters that are scored at once

_CODE = np.full(256, 4, np.int8)
for _i, _c in enumerate(LETTERS):
    _CODE[[ord(_c), ord(_c.lower())]] = _i


@dataclass(frozen=True)
class ScoreTable:
    """weights: whole numbers [position, letter], each from 0 on; score = sum / scale + least; survival: p by sum."""

    weights: np.ndarray
    scale: float
    least: float
    survival: np.ndarray

    def threshold(self, p: float) -> int:
        """The smallest sum whose p-value is at most p; one more than the greatest sum where none is."""
        return int(np.searchsorted(-self.survival, -p, "left"))


def score_table(matrix, background=(0.25, 0.25, 0.25, 0.25), pseudo: float = 0.0, levels: int = 1000) -> ScoreTable:
    """The scores of a matrix [position, letter] of probabilities in whole steps, `levels` of them between the least and
    the greatest weight; pseudo: weight of the background that is mixed into the matrix. A probability of 0 counts as 1e-9."""
    b = np.asarray(background, float) / np.sum(background)
    m = (np.asarray(matrix, float) + pseudo * b) / (1 + pseudo)
    odds = np.log2(np.maximum(m, 1e-9) / b)
    low, high = odds.min(), odds.max()
    scale = levels / (high - low) if high > low else 1.0
    weights = np.rint((odds - low) * scale).astype(np.int64)
    share = np.ones(1)
    for row in weights:
        following = np.zeros(len(share) + int(row.max()))
        for w, p in zip(row, b):
            following[w : w + len(share)] += share * p
        share = following
    return ScoreTable(weights, scale, low * len(weights), np.minimum(np.cumsum(share[::-1])[::-1], 1.0))


def motif_hits(sequences: DataFrame, matrices: dict, p_value: float = 1e-4, background=(0.25, 0.25, 0.25, 0.25), pseudo: float = 0.0, both_strands: bool = False, name: str = "name", seq: str = "seq") -> DataFrame:
    """(name, motif, start, strand, score, p_value) of every window whose p-value is at most p_value; start is 0-based.

    Without both_strands, as with RNA, the forward strand only; the reverse strand is scored by the matrix turned round.
    """
    tables = [(motif, "+", score_table(m, background, pseudo)) for motif, m in matrices.items()]
    if both_strands:  # a window's reverse complement, read forwards: letters and positions the other way round
        tables += [(motif, "-", ScoreTable(t.weights[::-1, ::-1], t.scale, t.least, t.survival)) for motif, _, t in tables]
    rows = sequences.select(F.col(name).alias("name"), F.coalesce(F.col(seq).cast("string"), F.lit("")).alias("seq"))
    schema = T.StructType([rows.schema["name"], *T._parse_datatype_string("motif string, start int, strand string, score double, p_value double").fields])

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = batch.column("seq").cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        lead = (raw & 0xC0) != 0x80  # letters, not bytes
        begins = np.concatenate([[0], np.cumsum(lead)])[offsets - offsets[0]]
        code = _CODE[raw[lead]]
        row = np.repeat(np.arange(len(text)), np.diff(begins))
        for motif, sign, t in tables:
            width = len(t.weights)
            n = len(code) - width + 1
            if n < 1:
                continue
            bad = -(1 << 40)
            full = np.concatenate([t.weights, np.full((width, 1), bad)], axis=1)
            sums = np.zeros(n, np.int64)
            for k in range(width):
                sums += full[k][code[k : k + n]]
            hit = np.flatnonzero((sums >= max(t.threshold(p_value), 0)) & (row[:n] == row[width - 1 :]))
            if len(hit):
                at = pa.array(row[hit])
                same = pa.array([motif, sign])
                copies = lambda i: same.take(pa.array(np.full(len(hit), i)))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [batch.column("name").take(at), copies(0), pa.array(hit - begins[row[hit]], pa.int32()), copies(1), pa.array(sums[hit] / t.scale + t.least), pa.array(t.survival[sums[hit]])],
                    schema.names,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column("seq")).to_numpy(zero_copy_only=False))
            begin = 0
            for end in (np.flatnonzero(np.diff(size // SLICE, append=-1)) + 1).tolist():
                yield from score(batch.slice(begin, end - begin))
                begin = end

    return rows.mapInArrow(run, schema)
