"""Chain files and lifts against a base-by-base version."""

import random

import pytest

from seqlume.operators import liftover

CHAINS = """# a comment about a chain of things
chain 900 chr1 5000 + 100 460 newA 3000 + 50 380 1
100\t20\t0
90 0 10
50 100 80

##another
chain 500 chr1 5000 + 480 600 newB 1000 - 200 320 2
120

chain 400 chr2 5000 + 0 50 newA 3000 - 10 60 3
50
chain 100 chr1 5000 + 100 160 newC 900 + 0 60 4
60
"""


def plain_bases():
    """(chrom, base) -> list of (chain, to_chrom, place, reversed)."""
    out = {}
    for chain, chrom, t, to, size, rev, q, lines in [
        (1, "chr1", 100, "newA", 3000, False, 50, [(100, 20, 0), (90, 0, 10), (50, 0, 0)]),
        (2, "chr1", 480, "newB", 1000, True, 200, [(120, 0, 0)]),
        (3, "chr2", 0, "newA", 3000, True, 10, [(50, 0, 0)]),
        (4, "chr1", 100, "newC", 900, False, 0, [(60, 0, 0)]),
    ]:
        for n, dt, dq in lines:
            for i in range(n):
                out.setdefault((chrom, t + i), []).append((chain, to, size - 1 - (q + i) if rev else q + i, rev))
            t, q = t + n + dt, q + n + dq
    return out


def plain_lift(bases, chrom, start, end, least):
    held = {}
    for p in range(start or 0, end or 0) if chrom and start is not None and end is not None else ():
        for chain, to, at, rev in bases.get((chrom, p), ()):
            held.setdefault((chain, to, rev), []).append(at)
    fits = {k: v for k, v in held.items() if len(v) >= least * (end - start)}
    if len(fits) == 1:
        ((_, to, rev), at), = fits.items()
        return "mapped", to, min(at), max(at) + 1, rev
    total = sum(map(len, held.values()))
    return ("duplicated" if fits else "split" if held and total >= least * (end - start) else "partial" if total else "deleted", None, None, None, None)


@pytest.fixture(scope="module")
def blocks(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("chains") / "a.chain"
    path.write_text(CHAINS)
    return liftover.chains(spark, str(path))


def test_blocks(spark, blocks, tmp_path):
    rows = sorted(tuple(r) for r in blocks.collect())
    assert rows[:3] == [("1", "chr1", 100, 199, "newA", 50, 3000, False), ("1", "chr1", 220, 309, "newA", 150, 3000, False), ("1", "chr1", 310, 359, "newA", 250, 3000, False)]
    assert rows[3:] == [("2", "chr1", 480, 599, "newB", 200, 1000, True), ("3", "chr2", 0, 49, "newA", 10, 3000, True), ("4", "chr1", 100, 159, "newC", 0, 900, False)]
    (tmp_path / "none.chain").write_text("# nothing\n")
    assert liftover.chains(spark, str(tmp_path / "none.chain")).count() == 0


@pytest.mark.parametrize("least", [0.95, 0.5, 1.0])
def test_intervals(spark, blocks, least):
    rng, bases = random.Random(1), plain_bases()
    asked = [(i, rng.choice(["chr1", "chr1", "chr2", "chr9"]), a, a + rng.randrange(0, 200)) for i, a in enumerate(rng.randrange(0, 620) for _ in range(300))]
    asked += [(1000, None, 1, 5), (1001, "chr1", None, 5), (1002, "chr1", 5, None), (1003, "chr1", 150, 100), (None, "chr1", 230, 240)]
    frame = spark.createDataFrame(asked, "id long, chrom string, start long, end long")
    got = {r["id"]: tuple(r)[1:] for r in liftover.lift_intervals(frame, blocks, "id", least, width=37).collect()}
    assert got == {i: plain_lift(bases, *rest, least) for i, *rest in asked}
    assert {o[0] for o in got.values()} >= {"mapped", "duplicated", "partial", "deleted"}


def test_positions(spark, blocks):
    bases = plain_bases()
    asked = [("chr1", p) for p in range(90, 620, 7)] + [("chr2", 3), ("chr3", 3)]
    got = {}
    for r in liftover.lift_positions(spark.createDataFrame(asked, "chrom string, pos long"), blocks, width=50).collect():
        got.setdefault((r["chrom"], r["pos"]), set()).add((r["to_chrom"], r["lifted"]))
    assert got == {a: {(to, at) for _, to, at, _ in bases.get(a, [])} or {(None, None)} for a in asked}


def test_events(spark, blocks):
    rows = [("both", "chr1", "+", 240, 250, 320, 330), ("gap", "chr1", "+", 195, 215, 320, 330), ("late", "chr1", "-", 240, 250, 700, 710), ("apart", "chr1", "+", 240, 250, 490, 500), ("turned", "chr1", "-", 480, 500, 540, 560), (None, "chr2", "+", 1, 9, 20, 30)]
    frame = spark.createDataFrame(rows, "event string, chrom string, strand string, upIntStart long, upIntEnd long, dnIntStart long, dnIntEnd long")
    got = {r["event"]: tuple(r)[7:] for r in liftover.lift_events(frame, blocks, width=100).collect()}
    assert got["both"] == ("mapped", "newA", "+", 170, 180, 260, 270)
    assert [got[e][0] for e in ("gap", "late", "apart")] == ["partial", "deleted", "apart"] and got["apart"][1:] == (None,) * 6
    assert got["turned"] == ("mapped", "newB", "+", 780, 800, 720, 740)
    assert got[None] == ("mapped", "newA", "-", 2981, 2989, 2960, 2970)
