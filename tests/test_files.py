"""The file manifest: files of any bytes and size, large ones in batches."""
import gzip
import hashlib
import random

import pytest

from augeval.sources import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("manifest")
    r = random.Random(5)
    held = {
        "random.bin": r.randbytes(300_000), "large b.bin": r.randbytes(900_000), "ended.bin": r.randbytes(70_000) + b"\n",
        "feeds.bin": b"\n" * 50_000, "one line.bin": bytes(60_000), "cr.bin": b"a\r\nb\rc\n" * 9_000, "mark.bin": b"\xef\xbb\xbf" + r.randbytes(50_000),
        "mark ended.bin": b"\xef\xbb\xbf" + b"x\n" * 20_000, "packed.gz": gzip.compress(r.randbytes(80_000)), "small.bin": b"abc", "a%20é.bin": r.randbytes(50_000),
    }
    for name, data in held.items():
        (at / name).write_bytes(data)
    (at / "table.bin").mkdir()
    for k in range(3):
        held[f"part-{k}"] = r.randbytes(60_000)
        (at / "table.bin" / f"part-{k}").write_bytes(held[f"part-{k}"])
    return at, held


@pytest.mark.parametrize("stream_bytes", [1_000, 10_000, 32 << 20])
def test_manifest_of_any_bytes(spark, folder, monkeypatch, stream_bytes):
    at, held = folder
    monkeypatch.setattr(files, "STREAM_BYTES", stream_bytes)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = {r.file: (r.length, r.md5, r.present) for r in files.manifest(spark, f"{at}/*", [*held, "missing.bin"]).collect()}
    assert got.pop("missing.bin") == (None, None, False)
    assert got == {k: (len(v), hashlib.md5(v).hexdigest(), True) for k, v in held.items()}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_a_large_file_passes_the_limit_of_a_whole_read(spark, folder, monkeypatch):
    at, held = folder
    monkeypatch.setattr(files, "STREAM_BYTES", 100_000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "200000")
    try:
        got = {r.file: r.md5 for r in files.manifest(spark, f"{at}/*.bin", list(held)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got["large b.bin"] == hashlib.md5(held["large b.bin"]).hexdigest()
