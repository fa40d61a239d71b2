import hashlib

from loomery.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest string, shard int"


def run(spark, rows, root, **kw):
    warc.write(spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA), f"file://{root}", **kw)
    return warc.read(spark, f"file://{root}")


def pages(n=60):
    return [(k * 7, f"http://h/{k}", f"<p>{k % 9} é</p>" * (1 + k % 30)) for k in range(n)] + [(None, None, "x" * 200), (1, "u\r\nX: y", None), (2, "u", ""), (2, "u", "x" * 200), (2, "u", "x" * 200), (900, "v", "y" * 300_000)]


def test_contents(spark, tmp_path):
    rows = pages()
    got = run(spark, rows, tmp_path / "a", roll_bytes=2000, shard_bytes=8000).collect()
    assert sorted((r.page_id or -1, r.payload_digest) for r in got) == sorted((i or -1, hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    by = {}
    for r in got:
        by.setdefault(r.payload_digest, []).append(r)
    for i, _, h in rows:
        b = (h or "").encode()
        own = by[hashlib.sha256(b).hexdigest()]
        assert all(r.payload_bytes == len(b) for r in own)
        first = [r for r in own if r.record_type == "response"]
        if len(b) < 100:
            assert len(first) == len(own)
        else:
            assert len(first) == 1 and first[0].html == h
            least = min((r.page_id for r in own if r.page_id is not None), default=None)
            assert first[0].page_id == least and all(r.refers_to == least for r in own if r.record_type == "revisit")


def test_deterministic_and_committed(spark, tmp_path):
    rows = pages()
    for name, order, n in (("a", rows, 1), ("b", rows[::-1], 7)):
        df = spark.createDataFrame([(*r, "d", 1) for r in order], SCHEMA).repartition(n)
        warc.write(df, f"file://{tmp_path / name}", roll_bytes=2000, shard_bytes=8000)
    files = [{p.name: p.read_bytes() for p in (tmp_path / n).glob("*.gz")} for n in "ab"]
    assert files[0] == files[1] and len(files[0]) > 3
    assert not list(tmp_path.glob("*/.*.tmp"))


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path / "e").count() == 0


def test_shards_are_even_in_bytes(spark, tmp_path):
    # one id holds half of the rows, and pages of the last tenth of the ids hold most of the bytes
    rows = [(5, f"http://h/{k}", f"{k} " * 50) for k in range(300)] + [(k, "u", f"{k} " * (2000 if k > 270 else 20)) for k in range(10, 310)]
    got = run(spark, rows, tmp_path / "a", shard_bytes=20_000)
    assert got.count() == len(rows)
    files = spark.read.parquet(f"file://{tmp_path / 'a'}/manifest.parquet").collect()
    assert len(files) > 10
    per = {}
    for r in got.select("page_id", "payload_bytes").collect():
        per[r.page_id] = per.get(r.page_id, 0) + r.payload_bytes
    total = sum(per.values())
    import re

    sizes = [sum(int(x) for x in re.findall(rb"X-Payload-Length: (\d+)", b"".join(warc._members(open(tmp_path / "a" / f.name, "rb"))))) for f in files]  # noqa: SIM115
    assert sum(sizes) == total and max(sizes) < 3 * total / len(files)


def test_a_second_write_replaces_the_first(spark, tmp_path):
    rows = pages()
    first = sorted(map(str, run(spark, rows, tmp_path / "a", shard_bytes=8000).collect()))
    (tmp_path / "a" / ".000001-0000-dead.tmp").write_bytes(b"x")
    assert sorted(map(str, run(spark, rows, tmp_path / "a", shard_bytes=8000).collect())) == first
    assert not list(tmp_path.glob("a/.*.tmp"))
