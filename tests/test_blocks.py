"""Files read block by block: digests of bytes, and records cut in parallel, however blocks fall."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketlens.model import SOURCE_COLUMNS
from basketlens.sources import blocks, raw_csv

FIELDS = ["1", "", "é日", 'ab"c', 'x"y"z', ' "lead', '"a\nb"', '"x""y"', '""', '"\n"', '""""', '"a,b"', '"\r\nq"', '""",""\n"', '"q""\n""z\n\n"']


def random_file(draw, rows, width, end="\n"):
    lines = [",".join(draw.choices(FIELDS, k=width)) for _ in range(rows)]
    return end.join(["h" + ",h" * (width - 1), *lines])


def digest(data):
    return "{:016x}{:016x}".format(*[int.from_bytes(data, "big") % p for p in blocks.PRIMES])


def in_blocks(data, starts):
    """Lines by block as the reader deals them: a line belongs to the block in which it begins, one at
    a block's very first byte to the block before."""
    at, dealt = 0, {s: [] for s in starts}
    lines = data.split(b"\n")
    for i, line in enumerate(lines):
        if i < len(lines) - 1 or line:
            dealt[max(s for s in starts if s < at or s == 0)].append(line)
        at += len(line) + 1
    return {s: found for s, found in dealt.items() if found}


def batches(dealt, size, extra):
    for start, found in dealt.items():
        for i in range(0, len(found), size):
            part = found[i:i + size]
            cols = [pa.array(["f"] * len(part)), pa.array([start] * len(part)), *[pa.array([extra] * len(part))] * (extra is not None), pa.array(part, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[str(i) for i in range(len(cols))])


def plain_records(data):
    """Records of a whole file by one pass over its bytes."""
    records, open_, inside = [], [], False
    for line in data.split(b"\n"):
        open_.append(line)
        inside = blocks.ends_inside(line, inside)
        if not inside:
            records.append(b"\n".join(open_))
            open_ = []
    return [r for r in [*records, *([b"\n".join(open_)] if open_ else [])] if r.strip(b" \t\r")]


def test_blocks_at_every_offset_give_the_same_digest_and_records():
    draw = random.Random(4)
    for case in range(60):
        data = random_file(draw, draw.randint(1, 6), 3).encode() + draw.choice([b"", b"\n", b'"open'])
        for cut in range(1, len(data), 1 if case < 6 else 7):
            starts = sorted({0, cut, *draw.sample(range(1, len(data)), min(2, len(data) - 1))})
            dealt = in_blocks(data, starts)
            rows = pa.Table.from_batches(list(blocks.scan(batches(dealt, 2, len(data))))).to_pandas()
            told = blocks.whole(rows.sample(frac=1, random_state=1)).iloc[0]
            assert (told.digest, told.bytes) == (digest(data), len(data)), data
            states = {"f": dict(zip(told.starts, told.inside))}
            parts = pa.Table.from_batches(list(blocks.cutter(states)(batches(dealt, 2, None)))).to_pylist()
            found, chain = [], None
            for p in sorted(parts, key=lambda p: (p["start"], p["seq"])):
                if p["kind"] == "head":
                    found[chain] += b"\n" + p["text"]
                else:
                    found.append(p["text"])
                    chain = len(found) - 1
            assert found == plain_records(data), (data, starts)


def test_fields_stay_open():
    f = blocks.ends_inside
    assert f(b'a,"b', False) and f(b'"a""', False) and f(b"x", True) and f(b'""', True)
    assert not f(b'a,b"', False) and not f(b'"a"""', False) and not f(b'"', True) and not f(b'x" y"z', True) and not f(b"", False)
    assert f(b'x","', True) and not f(b'x",', True) and not f(b' "a', False)


@pytest.mark.parametrize("size", ["128m", "900"])
def test_rows_are_those_of_the_one_task_reader(spark, tmp_path, size):
    draw, names = random.Random(3), list(SOURCE_COLUMNS)
    for name, end, mark, last in (("a", "\n", b"", b"\n"), ("b", "\r\n", b"\xef\xbb\xbf", b""), ("c", "\n", b"", b"")):
        rows = [",".join(names)]
        for i in range(120):
            rows.append(",".join(draw.choices(FIELDS, k=len(names) + draw.choice([0] * 30 + [-3, 2]))))
            rows += [""] * draw.choice([0] * 20 + [1])
        (tmp_path / f"{name}.csv").write_bytes(mark + end.join(rows).encode() + last)
    (tmp_path / "d.csv").write_text(",".join(names) + "\n" + ",".join(["7"] * len(names)) + "\n")
    read = lambda df: sorted(tuple(v.replace("\r\n", "\n") for v in r) for r in df.select(*[F.coalesce(c, F.lit("")) for c in [*names, raw_csv.BROKEN]]).collect())
    schema = ", ".join(f"`{n}` string" for n in [*names, raw_csv.BROKEN])
    expected = read(spark.read.schema(schema).options(header=True, multiLine=True, **raw_csv.FORM).csv(str(tmp_path)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        files = raw_csv.fingerprint(spark, str(tmp_path)).checkpoint()
        found = {r.path.rpartition("/")[2]: r for r in files.collect()}
        assert read(raw_csv.read_raw(spark, str(tmp_path), files)) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, r in found.items():
        data = (tmp_path / name).read_bytes()
        assert (r.bytes, r.digest, r.breaks) == (len(data), digest(data), name != "d.csv")
        assert r.header == ",".join(names) and (size == "128m" or name == "d.csv" or len(r.starts) > 10)


def test_digest_sees_line_ends_and_merges_over_files(spark, tmp_path):
    texts = {"a": "x\ny\n", "b": "x\r\ny\r\n", "c": "x\ny", "d": "y\nx\n", "e": ""}
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "0.csv").write_bytes(text.encode())
    (tmp_path / "a" / "1.csv").write_bytes(b"\xef\xbb\xbfz")
    files = raw_csv.fingerprint(spark, f"{tmp_path}/*")
    per_file = {tuple(r.path.split("/")[-2:]): r.digest for r in files.collect()}
    assert per_file["a", "0.csv"] == digest(b"x\ny\n") and len(set(per_file.values())) == 5 and ("e", "0.csv") not in per_file
    merged = {r["name"]: (r.files, r.bytes, r.digest) for r in blocks.folders(files).collect()}
    assert merged["a"] == (2, 8, digest(b"x\ny\n\xef\xbb\xbfz")) and merged["b"] == (1, 6, digest(b"x\r\ny\r\n"))
    plan = files._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Scan text") == 1 and plan.count(" Exchange") == 1 and "Join" not in plan
