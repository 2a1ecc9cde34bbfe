"""Block-compressed VCF: every split gives the same rows, regions read only their blocks, parts are indexed."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from seqlume.sources import blocks, writers
from seqlume.sources.blocks import END, Blocks, block

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"


def records(n, seed=1):
    rng = random.Random(seed)
    rows = sorted((f"chr{rng.randrange(1, 4)}", rng.randrange(1, 200_000)) for _ in range(n))
    return [(c, p, f"id{i}", rng.choice(["A", "ACGT" * rng.randrange(1, 30)]), "T", ".", "PASS", "DP=1", "GT", "0/1", f"{i}/1") for i, (c, p) in enumerate(rows)]


def text(rows, head=HEAD):
    return head + "".join("\t".join(map(str, r)) + "\n" for r in rows)


def packed(data, size):
    data = data.encode()
    return b"".join(block(data[i : i + size]) for i in range(0, len(data), size)) + END


def read_all(path, split, region=None, samples=()):
    reader = blocks.BlockedReader(str(path), split, region, list(samples))
    return [tuple(r.values()) for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]


@pytest.mark.parametrize("size", [7, 61, 5000])
@pytest.mark.parametrize("ending", ["\n", ""])
def test_any_split_gives_all_rows_once(tmp_path, size, ending):
    rows = records(40)
    path = tmp_path / "x.vcf.gz"
    path.write_bytes(packed(text(rows)[:-1] + ending, size))
    want = [(*r[:7], "DP=1") for r in rows]
    whole = path.stat().st_size
    for split in [1, 13, 29, 100, 997, whole // 2, whole, 10 * whole]:
        assert read_all(path, split) == want, split


def test_one_line_over_many_blocks_and_lines_at_borders(tmp_path):
    path = tmp_path / "x.vcf.gz"
    rows = [("chr1", i, "x" * (50 if i % 3 else 900), "A", "T", ".", ".", ".") for i in range(1, 20)]
    lines = text(rows, "").encode().splitlines(keepends=True)
    path.write_bytes(b"".join(block(line) for line in lines) + END)  # every line is a block
    for split in (1, 40, 90, 10_000):
        assert read_all(path, split) == rows
    path.write_bytes(packed(text(rows, ""), 33))
    for split in (1, 50, 300):
        assert read_all(path, split) == rows


def test_other_gzip_files(tmp_path):
    rows = records(30, 3)
    want = [(*r[:7], "DP=1") for r in rows]
    plain = tmp_path / "plain.vcf.gz"
    plain.write_bytes(gzip.compress(text(rows[:10]).encode()) + gzip.compress(text(rows[10:], "").encode()))
    assert read_all(plain, 10) == want
    assert read_all(plain, 10, "chr2:1-100000") == [r for r in want if r[0] == "chr2" and r[1] <= 100_000]
    for content in (END, packed(HEAD, 9), b""):
        plain.write_bytes(content)
        assert read_all(plain, 5) == []
    plain.write_bytes(gzip.compress(text(rows).encode())[:-9])
    with pytest.raises(ValueError, match="cut off"):
        read_all(plain, 10)


def test_damage_is_told(tmp_path):
    path = tmp_path / "x.vcf.gz"
    good = packed(text(records(50)), 500)
    first = blocks._size_of(good)
    path.write_bytes(good[: first + 30] + bytes([good[first + 30] ^ 0xFF]) + good[first + 31 :])
    with pytest.raises(ValueError, match=f"damaged block at {first}"):
        read_all(path, 10**9)
    path.write_bytes(good[: first + 40])
    with pytest.raises(ValueError, match="no whole block"):
        read_all(path, 10**9)


def test_samples_by_name(tmp_path):
    rows = records(20, 4)
    path = tmp_path / "x.vcf.gz"
    path.write_bytes(packed(text(rows), 300))
    assert read_all(path, 200, samples=["s2"]) == [(*r[:9], r[10]) for r in rows]
    with pytest.raises(ValueError, match="no samples s3"):
        read_all(path, 200, samples=["s3"])


def test_regions(spark, tmp_path):
    rows = records(3000, 5)
    frame = spark.createDataFrame([(*r[:5], r[5], r[6]) for r in rows], "chrom string, pos long, id string, ref string, alt string, qual string, filter string")
    path = str(tmp_path / "parts")
    blocks.write_vcf_blocks(frame, path, {"DP": F.lit(1)}, HEAD.splitlines(), parts=3)
    names = sorted(os.listdir(path))
    assert [n for n in names if n.endswith(".vcf.gz")] == [f"part-0000{i}.vcf.gz" for i in range(3)] and len(names) == 6
    lines = [line for n in names if n.endswith("gz") for line in gzip.open(f"{path}/{n}", "rt").read().splitlines()]
    assert [tuple(x.split("\t")[:2]) for x in lines if x[0] != "#"] == [(c, str(p)) for c, p, *_ in rows] and lines[:2] == HEAD.splitlines()
    full = {tuple(r) for r in blocks.read_vcf_blocks(spark, path, split_bytes=700).collect()}
    assert full == {(*r[:7], "DP=1") for r in rows}
    for region in ("chr2", "chr1:1-1", "chr3:100,000-100,500", "chr2:199000", "chr2:16380-16390", "chr9:1-5", "chr1:500-80000"):
        chrom, begin, end = blocks.parse_region(region)
        want = {r[2] for r in rows if r[0] == chrom and r[1] - 1 < end and r[1] - 1 + len(r[3]) > begin}
        assert {r["id"] for r in blocks.read_vcf_blocks(spark, path, region).collect()} == want, region
    for bad in ("", "chr1:0-5", "chr1:9-8", "a b", "chr1:x"):
        with pytest.raises(ValueError, match="not a region"):
            blocks.parse_region(bad)
    with pytest.raises(Exception, match="parts"):
        blocks.write_vcf_blocks(frame, path, {}, [])


def test_a_region_opens_its_blocks_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "MOST", 400)
    rows = [(f"chr{c}", p, "i", "A", "T", ".", ".", f"chr{c}\t{p}\ti\tA\tT\t.\t.\t.") for c in (1, 2) for p in range(1, 400_000, 400)]
    writer = blocks.PartsWriter(str(tmp_path / "one"), "##h\n", False, ["chrom", "pos", "ref", "line"])
    import pyarrow as pa
    import pyspark

    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in (0, 1, 3, 7)], ["chrom", "pos", "ref", "line"])
    monkeypatch.setattr(pyspark, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("D", (), {"partitionId": lambda self: 0})())}))
    message = writer.write(iter([batch.slice(0, 900), batch.slice(900)]))
    writer.commit([message, None])
    path = f"{tmp_path}/one/part-00000.vcf.gz"
    assert not [n for n in os.listdir(tmp_path / "one") if n.startswith("_")]
    opened = []
    data = Blocks.data
    monkeypatch.setattr(Blocks, "data", lambda self, place, end=None: ((opened.append(n) or (n, d)) for n, d in data(self, place, end)))
    got = read_all(path, 10**9, "chr2:200001-210000")
    assert [r[1] for r in got] == [p for p in range(1, 400_000, 400) if 200_001 <= p <= 210_000]
    index = sum(1 for _ in data(Blocks(f"{path}.tbi"), 0))
    total = sum(1 for _ in data(Blocks(path), 0))
    assert len(opened) - index < total / 8
    writer.abort([writer.write(iter([]))])
    assert sorted(os.listdir(tmp_path / "one")) == ["part-00000.vcf.gz", "part-00000.vcf.gz.tbi"]


def test_index_wants_order():
    index = blocks.IndexBuilder()
    index.add("a", 0, 5, 0, 10)
    index.add("b", 0, 5, 10, 20)
    with pytest.raises(ValueError, match="stand together"):
        index.add("a", 9, 10, 20, 30)


def test_files_of(tmp_path):
    for n in ("b.vcf.gz", "a.vcf.gz", "_c.gz", "a.vcf.gz.tbi", "x.txt"):
        (tmp_path / n).write_bytes(END)
    both = [str(tmp_path / "a.vcf.gz"), str(tmp_path / "b.vcf.gz")]
    assert blocks.files_of(str(tmp_path)) == both == blocks.files_of(f"{tmp_path}/*.vcf.gz") == blocks.files_of(", ".join(both))
    assert blocks.files_of(f"file://{tmp_path}") == both
    with pytest.raises(FileNotFoundError):
        blocks.files_of(str(tmp_path / "none"))
    assert writers.vcf_header(["chr2", "chr1"], {})[1] == "##contig=<ID=chr1>"
