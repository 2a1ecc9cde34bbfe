"""Length-changing variants applied to a window around a position that stays fixed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_PAIRS = str.maketrans("ACGTN", "TGCAN")
_NO_ALLELE = ("-", ".", "*")


def _clean(variants) -> list[tuple[int, str, str]]:
    """(pos0, ref, alt) from right to left, with "-", "." and "*" as empty alleles."""
    alleles = [(int(v["pos"]), *("" if x in _NO_ALLELE else x for x in (v["ref"], v["alt"]))) for v in (() if variants is None else variants)]
    return sorted(alleles, key=lambda v: -v[0])


class Window:
    """A piece of a chromosome that begins at `offset`; it must reach as far as deletions pull bases in."""

    def __init__(self, seq: str, offset: int):
        self.seq, self.offset = seq, offset

    def cut(self, start: int, end: int) -> str:
        return self.seq[max(start - self.offset, 0) : max(end - self.offset, 0)]


def keep_start(w: Window, variants: list[tuple[int, str, str]], start: int, end: int) -> str:
    """[start, end) with the start fixed: insertions push bases out at the end, deletions pull some in."""
    size = end - start
    edits = []
    for pos, ref, alt in variants:
        if pos + max(len(ref), 1) <= start or pos >= end:
            continue
        if pos < start:  # what lies before the start stays as it is
            skip = start - pos
            pos, ref, alt = start, ref[skip:], alt[skip:]
        edits.append((pos, ref, alt))
        end += max(len(ref) - len(alt), 0)
    text = w.cut(start, end)
    for pos, ref, alt in edits:
        at = pos - start
        text = text[:at] + alt + text[at + len(ref) :]
    return text[:size]


def keep_end(w: Window, variants: list[tuple[int, str, str]], start: int, end: int) -> str:
    """[start, end) with the end fixed; deletions pull in bases, and variants, from before the start."""
    size = end - start
    edits = []
    for pos, ref, alt in variants:
        if pos >= end or pos + max(len(ref), 1) <= start:
            continue
        if pos + len(ref) > end:
            over = pos + len(ref) - end
            ref, alt = ref[: len(ref) - over], alt[: max(len(alt) - over, 0)]
        edits.append((pos, ref, alt))
        start -= max(len(ref) - len(alt), 0)
    first = min([start, *(p for p, _, _ in edits)])
    text = w.cut(first, end)
    for pos, ref, alt in edits:
        at = pos - first
        text = text[:at] + alt + text[at + len(ref) :]
    return text[-size:] if size else ""


def spliced(w: Window, variants: list[tuple[int, str, str]], start: int, end: int) -> str:
    """[start, end) with the variants that begin in it; its length may change."""
    text = w.cut(start, end)
    for pos, ref, alt in variants:
        if start <= pos < end:
            at = pos - start
            text = text[:at] + alt + text[at + len(ref) :]
    return text


def mutate(seq: str, offset: int, start: int, end: int, anchor: int | None, strand: str, variants) -> str:
    """The window [start, end) after all variants, on the given strand."""
    w, v = Window(seq, offset), _clean(variants)
    if anchor is None:
        out = spliced(w, v, start, end)
    elif start < anchor < end:
        out = keep_end(w, v, start, anchor) + keep_start(w, v, anchor, end)
    elif anchor <= start:
        out = keep_start(w, v, anchor, end)[start - anchor :]
    else:
        whole = keep_end(w, v, start, anchor)
        out = whole[: end - start]
    return out.translate(_PAIRS)[::-1] if strand == "-" else out


def apply_anchored(df: DataFrame) -> DataFrame:
    """Adds mutated to rows (seq, seq_start, start, end, anchor, strand, variants: array of struct(pos, ref, alt))."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [None if r.seq is None else mutate(r.seq, int(r.seq_start), int(r.start), int(r.end), None if pd.isna(r.anchor) else int(r.anchor), r.strand, r.variants) for r in b.itertuples(index=False)]
            yield b.drop(columns=["variants"]).assign(mutated=got)

    columns = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != "variants")
    return df.mapInPandas(run, f"{columns}, mutated string")
