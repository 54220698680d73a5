"""Files read in splits: the same records and windows as of a plain reading of them."""

import gzip
import random
import struct
import zlib
from collections import Counter

import pytest

from strandmill.sources import splits
from strandmill.sources.splits import read_records


def blocked(data: bytes, size: int) -> bytes:
    """Block-gzipped, ``size`` bytes to a block, with the empty block at the end."""
    out = []
    for part in [data[i : i + size] for i in range(0, len(data), size)] + [b""]:
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        out.append(b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def windows(rows, k):
    out, sizes = Counter(), Counter()
    for name, seq, record, n in rows:
        out.update((name, record, seq[i : i + k]) for i in range(len(seq) - k + 1))
        sizes[name, record] += n
    return out, sizes


def fasta(rng, lengths):
    """A text, and what it holds: (name, sequence)."""
    text, out = "\n  \n", []
    for i, n in enumerate(lengths):
        seq = "".join(rng.choice("acgtACGTN") for _ in range(n))
        ends, at = rng.choice(("\n", "\r\n")), 0
        text += f">r{i} > about\n" if i % 3 else f">r{i}{ends}"
        while at < n:
            step = rng.choice((1, 3, 7, 60))
            text += seq[at : at + step] + ends + ("\n" if rng.random() < 0.05 else "")
            at += step
        out.append((f"r{i}", seq.upper()))
    return text, out


@pytest.fixture
def tiny(spark):
    """Splits of as few bytes as a test asks for."""
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    for c, v in old.items():
        spark.conf.set(c, v)


@pytest.mark.parametrize("size", ["16", "37", "1m"])
@pytest.mark.parametrize("k", [1, 5, 21])
def test_long_fasta_records(spark, tmp_path, tiny, size, k):
    text, own = fasta(random.Random(k), [0, 3, 5, 400, 4, 0, 21, 30, 1, 1, 90, 20])
    (tmp_path / "a.fa").write_text(text)
    tiny(size)
    rows = [(r["seq_id"], r["seq"], r["record"], r["n_bytes"]) for r in read_records(spark, str(tmp_path / "a.fa"), k).collect()]
    found, sizes = windows(rows, k)
    expected = Counter((name, seq[i : i + k]) for name, seq in own for i in range(len(seq) - k + 1))
    assert Counter({(n, w): c for (n, _, w), c in _summed(found).items()}) == expected
    assert {n: s for (n, _), s in sizes.items()} == {n: len(s) for n, s in own if len(s) >= k}
    if size == "16":
        assert len({r[1] for r in rows if r[0] == "r3"}) > 5  # in many tasks


def _summed(found):
    out = Counter()
    for (name, record, window), n in found.items():
        out[name, None, window] += n
    return out


@pytest.mark.parametrize("kind", ["plain", "blocks", "bgz"])
def test_gzipped_files(spark, tmp_path, kind):
    rng = random.Random(3)
    text, own = fasta(rng, [10, 3000, 40, 7, 9000])
    reads = [(f"q{i}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 80)))) for i in range(300)]
    fastq = "".join(f"@{n} x\n{s}\n+\n{'@' * len(s)}\n" for n, s in reads)
    for name, data in (("a", text), ("b", fastq)):
        path = tmp_path / f"{name}.{'bgz' if kind == 'bgz' else 'gz'}"
        path.write_bytes(gzip.compress(data.encode()) if kind == "plain" else blocked(data.encode(), rng.choice((70, 500))))
    found = read_records(spark, [str(p) for p in tmp_path.iterdir()], 9).collect()
    assert sorted((r["seq_id"], r["seq"]) for r in found if r["path"].endswith(("b.gz", "b.bgz"))) == sorted((n, s) for n, s in reads if len(s) >= 9)
    rows = [(r["seq_id"], r["seq"], r["record"], r["n_bytes"]) for r in found if r["seq_id"].startswith("r")]
    assert Counter({(n, w): c for (n, _, w), c in _summed(windows(rows, 9)[0]).items()}) == Counter((n, s[i : i + 9]) for n, s in own for i in range(len(s) - 8))


@pytest.mark.parametrize("size", [40, 300])
@pytest.mark.parametrize("limit", [1, 600, 1 << 22])
def test_cutting_blocks(monkeypatch, size, limit):
    """Chunks hold whole lines, whatever the blocks and whatever pieces the file comes in."""
    monkeypatch.setattr(splits, "PACKED_CHUNK", limit)
    rng = random.Random(size)
    data = "".join("x" * rng.choice((0, 3, 50, 900)) + "\n" for _ in range(60)).encode() + rng.choice((b"", b"no end"))
    packed, cutter, chunks = blocked(data, size), splits._Cutter(), []
    for i in range(0, len(packed), 77):
        chunks += cutter.feed(packed[i : i + 77])
    chunks += cutter.feed(b"", True)
    texts = [splits.undone(p)[s:] + t for p, s, t in chunks]
    assert b"".join(texts) == data and all(t.endswith(b"\n") for t in texts[:-1] if t)
    assert limit > 1000 or len([t for t in texts if t]) > (5 if limit == 1 else 2)


def test_mixed_files(spark, tmp_path, tiny):
    (tmp_path / "a.fa").write_text(">x\nACGTACGT\n>y\nAC\n")
    (tmp_path / "b.fq").write_text("@s\nACGTNACG\n+\n@@@@@>>>\n@cut\nACGGTTTTT")
    (tmp_path / "c.fa").write_text("\n \n")
    for size in ("8", "1m"):
        tiny(size)
        found = read_records(spark, [str(tmp_path / f) for f in ("a.fa", "b.fq", "c.fa")], 8).collect()
        assert sorted((r["seq_id"], r["seq"]) for r in found) == [("cut", "ACGGTTTTT"), ("s", "ACGTNACG"), ("x", "ACGTACGT")]
    (tmp_path / "d.txt").write_text("neither\n")
    with pytest.raises(Exception, match="neither FASTA nor FASTQ"):
        read_records(spark, str(tmp_path / "d.txt"), 8).collect()
