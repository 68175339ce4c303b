"""The byte-range FASTA source against the text reader and by hand, and the random stream against its own steps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import draws
from strandlake.sources import corpus, fasta

KNOWN = b">x UA=A1 n\nACDE\nFG\n>y UA=B2\r\nHI\r\n\r\nKL\r\n>z none\nMM\n>> UA=C3\n>w UA=D4\nAC>DE\n\n>v UA=E5\n>u UA=F6\nWY"


def got(df):
    return sorted(tuple(r) for r in df.collect())


def by_hand(data: bytes) -> list[tuple[str, str]]:
    out = []
    for line in data.decode().replace("\r", "").split("\n"):
        if line.startswith(">"):
            out.append([line[1:], ""])
        elif out:
            out[-1][1] += line
    return [tuple(x) for x in out]


@pytest.mark.parametrize("data", [KNOWN, KNOWN + b"\n", b"junk\n" + KNOWN, b"", b"no mark", b"\n\n>a UA=1\nAA", b">", b">a UA=1"])
def test_every_cut_gives_each_record_once(tmp_path, data, monkeypatch):
    path = tmp_path / "x.fa"
    path.write_bytes(data)
    for tail in (1, 2, 5, 1 << 16):
        monkeypatch.setattr(fasta, "TAIL_BYTES", tail)
        for split in range(1, len(data) + 2):
            reader = fasta.FastaReader({"path": str(path), "splitbytes": str(split)})
            rows = [tuple(r.values())[:2] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
            assert rows == by_hand(data), (tail, split)


def test_equal_to_the_text_reader(spark, tmp_path):
    r = random.Random(2)
    for i in range(3):
        lines = []
        for j in range(200):
            seq = "".join(r.choices("ACDEFGHIKLMNPQRSTVWY", k=r.randrange(0, 300)))
            lines.append(f">e{i}_{j} UA=A{i}_{j} é\n" if j % 9 else f">e{j}\n")
            lines += [seq[a : a + 60] + ("\r\n" if i == 1 else "\n") for a in range(0, len(seq), 60)]
        (tmp_path / f"p{i}.fa").write_text("".join(lines)[: None if i else -1], newline="")
    (tmp_path / "_hidden").write_text(">h UA=H\nAA\n")
    (tmp_path / "none.fa").write_text("")
    text = corpus.read_fasta(spark, str(tmp_path))
    for split in (97, 5000, 1 << 26):
        assert got(fasta.scan_fasta(spark, str(tmp_path), split_bytes=split)) == got(text)
    assert got(fasta.scan_fasta(spark, f"file://{tmp_path}", low=40, high=100)) == got(corpus.length_filter(text, 40, 100))
    with pytest.raises(Exception, match="FileNotFound"):
        fasta.scan_fasta(spark, str(tmp_path / "absent")).count()


def test_the_stream_is_the_sequential_one(spark):
    def sequence(seed, n):
        out = []
        for _ in range(n):
            seed ^= seed << 13 & 0xFFFFFFFF
            seed ^= seed >> 17
            seed ^= seed << 5 & 0xFFFFFFFF
            out.append(seed)
        return out

    assert sequence(1, 2) == [270369, 67634689]
    for seed in (1, 20260807, (1 << 32) - 1):
        assert draws.states(seed, np.arange(1, 3001)).tolist() == sequence(seed, 3000)
    assert draws.states(5, np.array([0, (1 << 32) - 1, 1 << 32, 1 << 62])).tolist()[:3] == [5, 5, sequence(5, 1)[0]]
    rows = spark.range(0, 2000, 1, 7).select("id", draws.uniform(F.col("id"), 9).alias("u")).collect()
    assert [r.u for r in sorted(rows)] == [x / 2**32 for x in sequence(9, 2000)]
    assert spark.sql("SELECT CAST(NULL AS LONG) AS d").select(draws.uniform(F.col("d"), 9).alias("u")).first().u is None
    with pytest.raises(ValueError):
        draws.states(0, np.arange(3))


def test_samples_read_their_windows_only(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    entries = [(f"e{j} UA=A{j}", "".join(r.choices("ACDEFGHIKLMNPQRSTVWYX" if j % 5 == 0 else "ACDEFGHIKLMNPQRSTVWY", k=r.randrange(50, 200)))) for j in range(5000)]
    data = "".join(f">{h}\n{s}\n" for h, s in entries).encode()
    (tmp_path / "x.fa").write_bytes(data)
    window, low, high = 4000, 80, 150
    want = []
    for k, state in enumerate(draws.states(7, np.arange(1, 500)).tolist()):
        at = int(state / 2**32 * (len(data) - window))
        cut = data[max(0, at - 1) : at + window].decode()
        for place, record in enumerate(cut.split("\n>")[1:-1]):
            header, seq = record.split("\n")
            if low <= len(seq) <= high and not set(seq) - set("ACDEFGHIKLMNPQRSTVWY"):
                want.append((k, place, header, seq))
    found = [tuple(x) for x in fasta.sample_fasta(spark, str(tmp_path / "x.fa"), 60, 7, window, low, high).collect()]
    assert found == want[:60]
    reader = fasta.FastaReader({"path": str(tmp_path / "x.fa"), "draws": "8", "windowbytes": str(window)})
    assert sum(x.stop - x.start for p in reader.partitions() for x in p.ranges) == 8 * window < len(data) / 10
    (tmp_path / "few.fa").write_bytes(b">a\n" + b"A" * 90 + b"\n>b\n" + b"C" * 95)
    assert {x.header for x in fasta.sample_fasta(spark, str(tmp_path / "few.fa"), 10**6).collect()} == {"a", "b"}


def test_draws_of_rows(spark):
    rows = spark.range(100, 400, 3).withColumnRenamed("id", "k")
    want = [100 + 3 * int(x / 2**32 * 100) for x in draws.states(11, np.arange(1, 51)).tolist()]
    assert [r.k for r in corpus.draw_rows(rows, "k", 50, 11).orderBy("draw").collect()] == want
    assert corpus.draw_rows(rows.limit(0), "k", 50, 11).count() == 0
