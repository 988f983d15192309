import json

import pytest
from pyspark.sql import functions as F

from scriptorium.plans import executor
from scriptorium.sources import markdown, mbox
from scriptorium.streaming import ingest

MAIL = b"""From ann@x.org Mon Jan  1 10:00:00 2024
From: =?utf-8?q?Ann_=C3=89?= <Ann@X.org>
To: me@home.org
Subject: =?utf-8?b?w4l0w6k=?=
Date: Mon, 1 Jan 2024 10:00:00 +0200
Message-ID: <1@x>
Content-Type: multipart/mixed; boundary=b

--b
Content-Type: text/plain; charset=latin-1

caf\xe9
--b
Content-Type: application/pdf
Content-Disposition: attachment; filename=a.pdf

data
--b--

From bob@y.org Tue Jan  2 10:00:00 2024
Return-Path: bob@y.org
In-Reply-To: <1@x>
References: <0@x> <1@x>
Content-Type: text/html

<p>hi<br>there</p>
From here on it is still the body

From eve@z.org Wed Jan  3 10:00:00 2024
From: eve@z.org
Received: by z; Wed, 3 Jan 2024 10:00:00 +0000

plain
"""


def test_mbox(spark, tmp_path):
    (tmp_path / "Work.mbox").write_bytes(MAIL)
    spark.dataSource.register(mbox.MboxSource)
    for split in (10, 150, 1 << 20):
        got = spark.read.format("mbox").option("splitBytes", split).load(f"{tmp_path}/*.mbox").orderBy(F.coalesce("from_addr", F.lit(""))).collect()
        assert [r.from_addr for r in got] == ["ann@x.org", "bob@y.org", "eve@z.org"], split
    ann, bob, eve = got
    assert (ann.from_display, ann.subject, ann.body.strip(), str(ann.date)) == ("Ann É", "Été", "café", "2024-01-01 08:00:00")
    assert [(a.filename, a.content_type) for a in ann.attachments] == [("a.pdf", "application/pdf")]
    assert bob.references == ["<0@x>", "<1@x>"] and bob.in_reply_to == "<1@x>" and bob.is_html_only and bob.body.startswith("hi\nthere")
    assert str(eve.date) == "2024-01-03 10:00:00" and len(eve.msg_hash) == 12 and eve.folder == "Work"


def test_mbox_index(tmp_path):
    p = tmp_path / "a.imap"
    for data in ([{"offset": 1, "length": 2}], {"version": 1, "messages": [{"offset": 1, "length": 2}]}, {"10": {"offset": 3, "length": 4}, "9": {"offset": 1, "length": 2}}):
        p.write_text(json.dumps(data))
        assert mbox.read_index(str(p))[0] == (1, 2)
    assert mbox.read_index(str(tmp_path / "none")) is None


def test_mbox_bounds(spark, tmp_path):
    box = tmp_path / "Old.mbox"
    box.write_bytes(MAIL)
    spark.dataSource.register(mbox.MboxSource)
    load = lambda **options: [r.from_addr for r in spark.read.format("mbox").options(**options).load(str(box)).orderBy("from_addr").collect()]
    assert load(since="2024-01-02") == ["eve@z.org"]  # the undated message goes with a bound
    starts = [i for i in range(len(MAIL)) if MAIL.startswith(b"From ", i) and (i == 0 or MAIL[i - 2 : i] == b"\n\n")]
    (tmp_path / "Old.mbox.imap").write_text(json.dumps([{"offset": a, "length": b - a} for a, b in zip(starts, [*starts[1:], len(MAIL)], strict=True)]))
    assert load() == ["ann@x.org", "bob@y.org", "eve@z.org"]
    assert load(since="2024-01-02") == ["eve@z.org"] and load(until="2024-01-02") == ["ann@x.org"]
    with box.open("rb") as f:
        entries = mbox.read_index(f"{box}.imap")
        assert [mbox.peek_date(f, o).day for o, _ in entries] == [1, 2, 3]
        assert mbox.first_from(f, entries, mbox.parse_date("Wed, 3 Jan 2024 00:00:00 +0000")) == 2
    assert mbox.mail_files(str(tmp_path), "old") == [str(box)] and mbox.mail_files(str(tmp_path), "new") == []


def test_tables(spark):
    texts = [
        "| a | b |\n| --- | --- |\n| 1 | 2 |\n\n| lone | row |\n\ntext\n| x |\n| y |",
        "| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |\n| x |  |  |\n| y |  |  |",
        "| a | b |\n|---|---|\n|  |  |\n|  |  |",
        "no pipes",
        None,
        "| before |\n| a | b |\n|---|---|\n| 1 | 2 |\n| c | d |\n|---|---|",  # a second heading in the same run belongs to the first table
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    blocks = markdown.table_blocks(df, "k", F.col("t")).orderBy("k", "start").collect()
    assert [(b.k, b.start, b.end, b.in_table, b.rows) for b in blocks] == [(0, 0, 2, True, 1), (0, 4, 4, False, 0), (0, 7, 8, False, 0), (1, 0, 4, True, 3), (2, 0, 3, True, 2), (5, 0, 0, False, 0), (5, 1, 5, True, 3)]
    got = {r.k: (r.score, r.tables, r.loose) for r in markdown.suspicious(df, "k", F.col("t"), 0).collect()}
    assert got == {0: (4, 1, 2), 1: (2, 1, 0), 2: (0, 1, 0), 5: (2, 1, 1)}


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: T\n---\nbody\n- [ ] call — due 2024-01-02\n- [x] done\n* [ ] later\n")
    got = markdown.read(spark, str(tmp_path)).first()
    assert got.fm == {"title": "T"} and got.body.startswith("body")
    actions = markdown.open_actions(markdown.read(spark, str(tmp_path)), "path", F.col("body")).orderBy("nth").collect()
    assert [(a.action, str(a.due)) for a in actions] == [("call", "2024-01-02"), ("later", "None")]
    with pytest.raises(ValueError):
        markdown.actions(markdown.read(spark, str(tmp_path)), "path", F.col("body"), F.col("mtime"), "2024-01-01", "no such status")
    assert markdown.listing(spark, str(tmp_path)).count() == 1


def test_executor(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1").write_text("x")
    plan = spark.createDataFrame([("move", f"{tmp_path}/a/1", f"{tmp_path}/b/1", None), ("write", None, f"{tmp_path}/c/2", "hello"), ("move", f"{tmp_path}/none", f"{tmp_path}/d", None), ("skip", "x", None, None)], "action string, src string, dst string, content string")
    assert executor.apply(plan) == {"move": 2, "write": 1, "skip": 1} and (tmp_path / "a" / "1").exists()
    assert executor.apply(plan, dry_run=False) == {"move": 1, "write": 1, "error": 1, "skip": 1}
    assert (tmp_path / "b" / "1").read_text() == "x" and (tmp_path / "c" / "2").read_text() == "hello"
    assert executor.remove_empty_directories(tmp_path) == 1
    assert executor.remove_empty_directories(tmp_path, dry_run=False) == 1 and not (tmp_path / "a").exists()


def test_streams(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 3 AS k").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long, k long").parquet(f"{tmp_path}/in")
    for check in ("c1", "c2"):  # a second reader of the same rows adds nothing
        ingest.ingest(stream(), f"{tmp_path}/out", f"{tmp_path}/{check}", "id").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10


def test_front_matter_merge(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"})], "o map<string,string>, n map<string,string>")
    assert df.select(markdown.merged_front_matter(F.col("o"), F.col("n"))).first()[0] == {"a": "1", "b": "2", "c": "3"}
