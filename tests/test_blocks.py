import gzip
import random

import pytest

from varloom.sources import blocks, vcf


def lines_of(n, seed=1):
    rng = random.Random(seed)
    names = [f"S{i}" for i in range(5)]
    head = ["##fileformat=VCFv4.2", "##INFO=<ID=CSQ,Number=.,Type=String>", "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split() + names)]
    rows = ["\t".join([f"chr{1 + i * 3 // n}", str(10 * i), ".", "C", "T", ".", "PASS", rng.randbytes(rng.choice([0, 3, 450, 45_000 if i % 97 == 96 else 5])).hex(), "GT", *(f"{rng.randrange(2)}/1" for _ in names)]) for i in range(n)]
    return head, rows, names


@pytest.mark.parametrize("split", [1, 700, 5_000, 70_000, 1 << 30])
def test_every_line_has_one_task(tmp_path, split):
    """Ranges of any size give each line once, long lines over many blocks and lines at block edges included."""
    head, rows, _ = lines_of(400)
    rows[5] = ""
    text = "\n".join(head + rows + ["the last line, without an end"]).encode()
    for size in (17, 300, blocks.TEXT):
        if split == 1 and size < 300:
            continue
        short = text if size > 17 else text[:9_000]
        path = tmp_path / f"{size}.gz"
        path.write_bytes(b"".join(blocks.block(short[i : i + size]) for i in range(0, len(short), size)) + blocks.END)
        assert gzip.decompress(path.read_bytes()) == short
        n = path.stat().st_size
        step = split if split > 1 else max(n // 300, 1)
        got = [b"".join(blocks.owned_text(str(path), at, min(at + step, n))) for at in range(0, n, step)]
        assert b"".join(got) == short, size
        if step < n // 4:
            assert sum(1 for x in got if x) > 1


def test_scan_equals_text_scan(spark, tmp_path):
    head, rows, names = lines_of(900)
    df = spark.createDataFrame([(x,) for x in rows], "value string").repartition(3)
    path = f"{tmp_path}/calls"
    blocks.write_block_lines(df, path, "\n".join(head) + "\n")
    assert blocks.is_blocked(path) and vcf.header_samples(spark, path) == names
    cut = blocks.read_block_lines(spark, path, split=20_000)
    assert cut.rdd.getNumPartitions() > 8
    assert sorted(r.value for r in cut.collect()) == sorted(head + rows)
    (tmp_path / "plain.vcf").write_text("\n".join(head + rows) + "\n")
    plain = vcf.read_lines(spark, f"{tmp_path}/plain.vcf")
    key = lambda d: sorted(map(tuple, vcf.x_genotypes(d, names).collect()))
    assert sorted(plain.collect()) == sorted(vcf.read_lines(spark, path).collect())
    assert key(plain) == key(vcf.read_lines(spark, path))


def test_samples_and_regions_are_pruned_in_the_reader(spark, tmp_path):
    head, rows, names = lines_of(300)
    path = f"{tmp_path}/calls.gz"
    with open(path, "wb") as f:
        f.write(blocks.block(("\r\n".join(head + rows) + "\r\n").encode()[: blocks.TEXT]) + blocks.END)
    whole = [x.value for x in vcf.read_lines(spark, path).collect()]
    got = [x.value.split("\t") for x in vcf.read_lines(spark, path, ["S3", "S0"], ["1:100-500", "chr2"]).collect()]
    want = [x.split("\t") for x in whole if x[0] == "#" or 100 <= int(x.split("\t")[1]) <= 500 and x.startswith("chr1\t") or x.startswith("chr2\t")]
    assert got == [x[:9] + [x[12], x[9]] for x in want] and len(got) > 30 and got[0][9:] == ["S3", "S0"]
    with pytest.raises(ValueError, match="S9"):
        vcf.read_lines(spark, path, ["S9"])


def test_headers_of_all_kinds_and_broken_blocks(spark, tmp_path):
    head, rows, names = lines_of(50)
    text = ("\n".join(head + rows) + "\n").encode()
    for name, data in (("a.vcf", text), ("a.vcf.gz", gzip.compress(text)), ("b.gz", gzip.compress(text[:30]) + gzip.compress(text[30:])), ("c.gz", blocks.block(text[:50]) + blocks.block(text[50:9_000]) + blocks.END)):
        (tmp_path / name).write_bytes(data)
        assert vcf.header_samples(spark, f"{tmp_path}/{name}") == names, name
        assert vcf.header_samples(spark, f"file://{tmp_path}/{name}") == names
    assert not blocks.is_blocked(f"{tmp_path}/b.gz")
    bad = bytearray(blocks.block(text[:9_000]))
    bad[-6] ^= 1
    (tmp_path / "d.gz").write_bytes(bytes(bad) + blocks.END)
    with pytest.raises(ValueError, match="checksum"):
        list(blocks.owned_text(f"{tmp_path}/d.gz", 0, len(bad)))
    (tmp_path / "none").mkdir()
    assert blocks.read_block_lines(spark, f"{tmp_path}/none").count() == 0 and blocks.head_lines(f"{tmp_path}/none") == []
    with pytest.raises(FileNotFoundError):
        blocks.files(f"{tmp_path}/absent")
