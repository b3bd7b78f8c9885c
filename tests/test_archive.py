"""Payload archives: stretches, bad lines, gzip, streams that go on after a restart."""

import datetime as dt
import gzip
import json
import os
import random

import pytest

from newsloom.sources.archive import PayloadArchive

DAY = dt.date(2024, 5, 1)


def load(spark, folder, **options):
    spark.dataSource.register(PayloadArchive)
    return spark.read.format("payload_archive").options(**options).load(str(folder))


def line(source, payload, day=DAY):
    return json.dumps({"run_date": str(day), "source": source, "payload": payload}, ensure_ascii=False)


def test_every_line_once_at_any_stretch(spark, tmp_path):
    rng = random.Random(8)
    texts = ["".join(rng.choice("aé漢\U0001f600 \\\"\n") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for n in range(2):
        (tmp_path / f"p{n}.jsonl").write_bytes("\n".join(line(f"s{n}", t) for t in texts[n * 20 : n * 20 + 20]).encode() + b"\r\n" * n)
    with gzip.open(tmp_path / "p2.jsonl.gz", "wt", encoding="utf-8") as f:
        f.write("\n \n" + "\n".join(line("s2", t) for t in texts[40:]))
    (tmp_path / "_SUCCESS").write_text("no row")
    (tmp_path / ".hidden").write_text("no row")
    (tmp_path / "empty.jsonl").write_text("")
    want = sorted((DAY, f"s{i // 20}", t, None) for i, t in enumerate(texts))
    places = None
    for stretch in (41, 700, 1 << 20):
        rows = load(spark, tmp_path, stretch=stretch).collect()
        assert sorted((r.run_date, r.source, r.payload, r.issue) for r in rows) == want
        here = {(r.file, r.line_at): r.payload for r in rows}
        assert len(here) == 60 and places in (None, here)
        places = here
    assert load(spark, f"file:{tmp_path}").count() == load(spark, f"file://{tmp_path}").count() == 60


BAD = [
    ('{"source": "a"', "corrupt_json"),
    ("[1]", "not an object"),
    ("null", "not an object"),
    ('{"run_date": "1 May"}', "not a date"),
    ('{"run_date": 5}', "not a date"),
    ('{"payload": 5}', "not a text"),
    ('{"payload": NaN}', "not a text"),
    ("[" * 50_000, "corrupt_json"),
    ('{"x": ' + "9" * 6_000 + "}", "corrupt_json"),
]


def test_bad_lines_are_issues(spark, tmp_path):
    lines = [b.encode() for b, _ in BAD] + [b'{"payload": "\xff"}', b"{}", b'{"payload": "\\ud800", "issue": "own"}', line("s", "fine").encode()]
    (tmp_path / "a.jsonl").write_bytes(b"\n".join(lines))
    rows = load(spark, tmp_path).orderBy("line_at").collect()
    assert [(r.payload, r.issue) for r in rows[:-4]] == BAD
    assert [(r.payload, r.issue) for r in rows[-4:]] == [('{"payload": "�"}', "not UTF-8"), (None, None), ("?", None), ("fine", None)]
    whole = gzip.compress("\n".join(line("s", f"{n} " * 50 + str(random.Random(n).random())) for n in range(3_000)).encode())
    (tmp_path / "b.jsonl.gz").write_bytes(whole[: len(whole) // 2])
    broken = [r for r in load(spark, tmp_path).where("file = 'b.jsonl.gz'").collect()]
    assert [r.payload for r in broken if r.issue == "damaged file"] == [None]
    assert len([r for r in broken if r.issue is None]) > 100


def test_schema_on_read(spark, tmp_path):
    docs = [{"id": 1, "score": 2}, {"id": 2**63, "score": 1}, {"id": True}, {"id": None, "score": 0.5, "more": [1]}, {"score": 10**400}]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(x) for x in docs[:4]) + '\n{"score": 1' + "0" * 400 + "}")
    spark.dataSource.register(PayloadArchive)
    reader = spark.read.format("payload_archive")
    rows = reader.schema("id bigint, score double, issue string, file string").load(str(tmp_path)).collect()
    assert [(r.id, r.score, r.issue) for r in rows] == [
        (1, 2.0, None), (None, None, "not a whole number"), (None, None, "not a whole number"), (None, 0.5, None), (None, None, "not a number"),
    ]
    with pytest.raises(Exception, match="no columns of the type"):
        reader.schema("id array<string>").load(str(tmp_path)).collect()


def test_empty(spark, tmp_path):
    assert load(spark, tmp_path).collect() == [] and load(spark, tmp_path / "none").collect() == []


def test_stream_restarts(spark, tmp_path):
    """Files that land between runs are read once each, also after a batch that failed."""
    spark.dataSource.register(PayloadArchive)
    folder, taken = tmp_path / "in", []
    folder.mkdir()

    def land(n):
        draft = folder / f".draft{n}"
        draft.write_text("\n".join(line(f"s{n}", f"{n}-{i}") for i in range(5)))
        os.rename(draft, folder / f"f{n:03d}.jsonl")

    def run(fail=False):
        def sink(batch, number):
            rows = sorted(r.payload for r in batch.collect())
            if fail:
                raise RuntimeError("lost")
            taken.append((number, rows))

        stream = spark.readStream.format("payload_archive").option("stretch", 40).load(str(folder))
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(60)

    run()
    land(1)
    land(2)
    run()
    run()
    land(3)
    with pytest.raises(Exception, match="lost"):
        run(fail=True)
    land(4)
    run()
    run()
    of = lambda *files: [f"{n}-{i}" for n in files for i in range(5)]
    got = [rows for _, rows in taken if rows]
    # The batch that failed is read again as it was; what landed since is the next one.
    assert got == [of(1, 2), of(3), of(4)]
    assert len({n for n, rows in taken if rows}) == 3
