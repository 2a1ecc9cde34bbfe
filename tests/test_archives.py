"""Texts of nested archives: nothing is lost at depth or at chunks' borders, and what is left out is told."""

import gzip
import io
import json
import os
import tarfile
import zipfile

import pytest

from seqlume.operators import scan
from seqlume.sources import archives


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def tarred(mode="w", **files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


ID = b"see SSC12345 there"
NOTEBOOK = json.dumps({"cells": [{"source": ["a", "SSC99999"], "outputs": [{"data": {"image/png": "SSC00000", "text/plain": ["b"]}}]}], "n": 5}).encode()


@pytest.fixture
def folder(tmp_path):
    files = {
        "plain.txt": b"x" * 100 + ID,
        "empty": b"",
        "odd.bin": b"\xff\xfe SSC12345",
        "a.gz": gzip.compress(ID) + gzip.compress(b" and more"),
        "deep.zip": zipped(**{"one.tar": tarred(**{"two.gz": gzip.compress(b"y" * 5000 + ID), "n.ipynb": NOTEBOOK}), "readme": b"nothing"}),
        "packed.tgz": tarred("w:gz", **{"in/three.zip": zipped(four=ID)}),
        "packed.tar.bz2": tarred("w:bz2", five=ID),
        "sub/note.ipynb": NOTEBOOK,
        "sub/bad.ipynb": b"{SSC12345",
        "cut.gz": gzip.compress(os.urandom(9000))[:5000],
        "bad.zip": zipped(a=ID)[:-30],
        ".git/config": ID,
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "link").symlink_to(tmp_path / "plain.txt")
    return tmp_path


def members(spark, path, **options):
    rows = scan.archive_findings(archives.archive_texts(spark, str(path), **options), {"id": r"SSC\d{5}"}).collect()
    return {(os.path.relpath(r["path"], path), r["member"]): (r["n_bytes"], r["status"], r["id"]) for r in rows}


def test_everything_is_found(spark, folder):
    got = members(spark, folder)
    text = b"a\nSSC99999\nb"
    assert got == {
        ("plain.txt", ""): (118, "ok", True), ("empty", ""): (0, "ok", False), ("odd.bin", ""): (11, "ok", True), ("a.gz", "!gz"): (27, "ok", True),
        ("deep.zip", "!one.tar!two.gz!gz"): (5018, "ok", True), ("deep.zip", "!one.tar!n.ipynb"): (len(text), "ok", True), ("deep.zip", "!readme"): (7, "ok", False),
        ("packed.tgz", "!gz!in/three.zip!four"): (18, "ok", True), ("packed.tar.bz2", "!five"): (18, "ok", True), ("sub/note.ipynb", ""): (len(text), "ok", True), ("sub/bad.ipynb", ""): (9, "ok", True),
        ("cut.gz", "!gz"): got["cut.gz", "!gz"], ("bad.zip", ""): (0, "damaged", False), ("link", ""): (0, "link", False),
    }
    assert got["cut.gz", "!gz"][1] == "damaged"


def test_chunks_overlap(spark, tmp_path):
    data = b"".join(b"%07d SSC12345 " % i for i in range(300))
    (tmp_path / "x.gz").write_bytes(gzip.compress(data))
    for chunk, overlap in ((50, 20), (64, 0), (10_000, 100)):
        rows = sorted(archives.archive_texts(spark, str(tmp_path), chunk=chunk, overlap=overlap).collect(), key=lambda r: r["chunk"])
        joined = rows[0]["text"] + "".join(r["text"][overlap:] for r in rows[1:])
        assert joined.encode() == data and rows[-1]["n_bytes"] == len(data)
        assert [r["status"] for r in rows] == [None] * (len(rows) - 1) + ["ok"] and [r["chunk"] for r in rows] == list(range(len(rows)))
        if overlap:
            assert {m for m in range(300) if any(f"{m:07d} SSC12345" in r["text"] for r in rows)} == set(range(300))


def test_bounds_are_told(spark, folder):
    got = members(spark, folder, max_bytes=100)
    assert got["plain.txt", ""] == (100, "too large", False) and got["deep.zip", ""][1] == "too large"
    exact = members(spark, folder, max_bytes=118)
    assert exact["plain.txt", ""] == (118, "ok", True)
    shallow = members(spark, folder, max_depth=1)
    assert shallow["deep.zip", "!one.tar"] == (0, "too deep", False) and shallow["a.gz", "!gz"][1] == "ok"


def test_no_files(spark, tmp_path):
    assert archives.archive_texts(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="overlap"):
        archives.archive_texts(spark, str(tmp_path), chunk=5, overlap=5).count()
