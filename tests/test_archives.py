"""Filings as streams against the pattern on whole texts."""

import gzip
import io
import random
import re
import subprocess
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from tonequarry.functions import text as T
from tonequarry.sources import archives, readers

PARTS = ["<DOCUMENT>", "<document>", "<TYPE>10-K", "<TYPE>10-K405", "<type>10K", "<TYPE>EX-27", "<TEXT>", "</TEXT>", "</DOCUMENT>", " ", "\n", "\xa0", "a", "é", "/A", "<"]


def body_of(data, step):
    body = archives.Body()
    for i in range(0, len(data), step):
        body.feed(data[i : i + step])
    return body.text()


def test_bodies_are_those_of_the_pattern():
    draw, hits = random.Random(3), 0
    for i in range(6000):
        text = "".join(draw.choices(PARTS, k=draw.choice((5, 15, 60))))
        if i % 2:
            text = "<DOCUMENT>" + draw.choice(("", "\n", " " * 300)) + "<TYPE>10-K" + draw.choice(("\n", "")) + text + "<TEXT>" + text
        m = re.search(T.DOCUMENT, text, re.IGNORECASE | re.DOTALL)
        hits += m is not None
        for step in (1, 7, 1000):
            assert body_of(text.encode("latin-1"), step) == (m and m[1]), (text, step)
    assert hits > 500


@pytest.mark.parametrize("block", [1, 5, 1 << 20])
def test_members_and_damage(monkeypatch, block):
    monkeypatch.setattr(archives, "BLOCK", block)
    a, b = gzip.compress(b"first " * 50), gzip.compress(b"second")
    whole = lambda data: b"".join(archives.inflated(io.BytesIO(data)))
    for data in (b"", a, a + b, a + b"\0" * 9, a + b"\0\0" + b):
        assert whole(data) == gzip.decompress(data)
    for data in (b"plain", b"\x1f", a[:-3], a[:20], a + b"junk", a + b[:4], a[:-6] + b"\1\2" + a[-4:]):
        with pytest.raises((EOFError, ValueError, zlib.error)):
            whole(data)
        with pytest.raises((EOFError, OSError, zlib.error)):
            gzip.decompress(data)


def test_rows_equal_those_of_whole_files(spark, tmp_path):
    form = "<SEC-HEADER>x\n<DOCUMENT>\n<TYPE>{}\n<SEQUENCE>1\n<TEXT>\n{}\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>EX-27\n<TEXT>exhibit</TEXT>\n</DOCUMENT>"
    texts = {"a b": form.format("10-K405", "Net &amp; loss caf\xe9 <TABLE>1 2 3</TABLE> end"), "c#d%20": form.format("8-K", "no"), "e": "", "f": form.format("10-K", "x" * 100_000)}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt.gz").write_bytes(gzip.compress(text.encode("latin-1")))
    (tmp_path / "bad.txt.gz").write_bytes(b"junk")
    (tmp_path / "other.txt").write_bytes(b"left out")
    (tmp_path / "empty.txt.gz").write_bytes(b"")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(str(tmp_path)).select("path", T.opened("content").alias("x"))
    whole = files.select("path", "x.length", F.when(F.col("x.ok"), T.clean_text(F.col("x.raw"))).alias("clean"), "x.ok")
    streamed = readers.filings(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, streamed.drop("error").collect()))) == sorted(map(str, map(tuple, whole.collect())))
    assert [r.error for r in streamed.where("NOT ok").collect()] == ["ValueError: not a compressed file: it begins with b'ju'"]


def test_a_large_filing_takes_little_memory(tmp_path):
    """A filing of 1 GB, most of it an exhibit, read by a process of its own."""
    path = tmp_path / "large.txt.gz"
    with gzip.open(path, "wb", compresslevel=1) as out:
        out.write(b"<DOCUMENT>\n<TYPE>10-K\n<TEXT>" + b"loss and gain\n" * 100_000 + b"</TEXT>\n<DOCUMENT>\n<TYPE>EX-99\n<TEXT>")
        for _ in range(1024):
            out.write(b"exhibit " * (1 << 17))
    code = f"import resource; from tonequarry.sources import archives\nbase = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nn, body, ok, _ = archives.one({str(path)!r})\nassert ok and n > 1 << 30 and len(body) == 1_400_000, (n, len(body))\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base)"
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=str(readers.__file__).split("/tonequarry/")[0]).stdout)
    assert used < 200 * 1024
