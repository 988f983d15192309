"""The pipeline's stages against plain versions, each on its own input."""

import os
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pipeline = pytest.importorskip("corpus_pipeline")

from scriptorium import tables  # noqa: E402
from scriptorium.llm import bpe, mixing, quality, simhash  # noqa: E402
from scriptorium.llm.common import documents  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark):
    docs = documents(spark, DATA)
    columns = docs.columns
    steps = dict(pipeline.STAGES)

    kept = steps["quality_filter"](spark, docs, DATA).cache()
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    score = model.scorer()
    assert kept.columns == columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if score((r.text or "").encode()) >= 0.7)

    single = steps["drop_exact_copies"](spark, kept, DATA).cache()
    last = {}
    for r in kept.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(last.values())

    apart = steps["drop_near_copies"](spark, single, DATA).cache()
    rows = sorted(single.collect(), key=lambda r: r.doc_id)
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in rows}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert apart.columns == columns and sorted(r.doc_id for r in apart.collect()) == sorted({find(i) for i in fps})

    mixed = steps["mix_sources"](spark, apart, DATA)
    assert mixed.columns == columns and sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in apart.collect())

    ids = steps["encode"](spark, apart, DATA).collect()
    e = bpe.encoder(bpe.default_path(), bpe.default_pattern())
    texts = {r.doc_id: r.text for r in apart.collect()}
    assert len(ids) == len(texts) and all(e.decode(r.token_ids) == texts[r.doc_id].encode() and r.n_tokens == len(r.token_ids) for r in ids)
    assert pipeline.run(spark, DATA).count() == len(texts)


def test_encoded_rows_carry_their_place_in_the_schedule(spark, tmp_path):
    docs = documents(spark, DATA)
    wanted = {r.doc_id: r.position for r in mixing.positions(docs).collect()}
    mixed = pipeline.mix_sources(spark, docs, DATA)
    for k, share in enumerate((0, 3, 5, 40, 100)):  # files of unequal size
        mixed.where(f"pmod(hash(doc_id), 100) >= {share}" + (f" AND pmod(hash(doc_id), 100) < {(3, 5, 40, 100)[k]}" if k < 4 else "")).coalesce(1).write.mode("append").parquet(str(tmp_path / "mixed"))
    back = spark.read.parquet(str(tmp_path / "mixed"))
    rows = pipeline.encode(spark, back, DATA).collect()
    assert {r.doc_id: r.position for r in rows} == wanted and len(rows) == len(set(wanted.values())) == docs.count()
    blocks = {s: -(-n // mixing.BLOCK_DOCS) for s, n in ((r.source, r["count"]) for r in docs.groupBy("source").count().collect())}
    slots = sorted({(r.position // mixing.BLOCK_DOCS, r.source) for r in rows}, key=lambda x: x[0])
    of = mixing.targets(blocks, mixing.tempered(mixing.source_sizes(docs)))
    assert [s for _, s in slots] == [of.names[k] for k, _ in of.order()]


def test_odd_rows_in_every_stage(spark):
    """Nulls in every column, empty and very long texts, ties, repeats, one id with two texts, clashing extra columns."""
    text = "some words of a text that is like others in this table of odd rows and goes on for a while longer"
    long = "word " * 60_000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, text, "en", "a", 1), (3, text, "en", "a", 1), (4, text, None, None, 1), (4, long, "fr", "b", 1), (None, "no id at all here", "en", "a", 1), (None, "no id at all here", "en", "a", 1), (None, "another without id", "de", None, 1), (5, "x", "en", "a", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("fp", "h", "slot", "block", "position", "token_ids", "digest", "kept", "n", "same", "score", "copy")})
    steps = dict(pipeline.STAGES)
    out = steps["quality_filter"](spark, odd, DATA)
    assert out.columns == odd.columns and out.count() <= len(rows)
    single = steps["drop_exact_copies"](spark, odd, DATA)
    want = [(None, "another without id"), (None, "no id at all here"), (2, ""), (4, text), (4, long), (5, "x")]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert single.columns == odd.columns and sorted(((r.doc_id, r.text) for r in single.collect()), key=key) == want
    apart = steps["drop_near_copies"](spark, odd, DATA)
    want = [(None, "another without id"), (None, "no id at all here"), (1, ""), (3, text), (4, long), (5, "x")]
    assert apart.columns == odd.columns and sorted(((r.doc_id, r.text or "") for r in apart.collect()), key=key) == want
    mixed = steps["mix_sources"](spark, odd, DATA)
    assert mixed.columns == odd.columns and sorted((r.text or "" for r in mixed.collect())) == sorted(r[1] or "" for r in rows)
    ids = steps["encode"](spark, odd, DATA).collect()
    assert len(ids) == len(rows) and len({r.position for r in ids}) == len(rows) - 2 and sum(r.n_tokens == 0 for r in ids) == 2


def test_empty_documents(spark):
    docs = documents(spark, DATA).limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA) if docs.columns else docs
        assert docs.count() == 0


def test_near_copies_broadcast_no_lookups(spark, monkeypatch):
    """Stage 3 explodes each fingerprint into some fifty lookups, which the engine takes for as small as the fingerprints."""
    plans, find = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: plans.append(edges._jdf.queryExecution().executedPlan().toString()) or find(edges))
    pipeline.drop_near_copies(spark, documents(spark, DATA), DATA)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def shuffled(df, column):
    """How many exchanges of df's plan hold a column."""

    def count(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return count(node.executedPlan())
        here = node.nodeName() == "Exchange" and re.search(rf"\b{column}#", node.output().mkString(" ")) is not None
        return here + sum(count(node.children().apply(i)) for i in range(node.children().size()))

    return count(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("large", [False, True])
def test_texts_are_shuffled_once_to_their_places_at_any_size(spark, monkeypatch, large):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if large:  # as if nothing counted were small enough
        monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = documents(spark, DATA)
        assert shuffled(pipeline.mix_sources(spark, docs, DATA), "text") == 1
        rows = pipeline.encode(spark, docs, DATA)
        assert shuffled(rows, "text") == 1 and shuffled(rows, "token_ids") == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("parts", [1, 4, 37, 211])
@pytest.mark.parametrize("bound", [tables.BROADCAST_BYTES, 0])
def test_mixed_rows_come_in_the_order_of_the_schedule(spark, monkeypatch, parts, bound):
    """Each partition of mixed() after the one before, each row in its place: ties, nulls, copies, small sources and no source."""
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", bound)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = documents(spark, DATA).select("doc_id", "text", "source")
        more = [(None, "again", "a")] * 300 + [(None, None, None)] * 5 + [(i, "hot", "a") for i in range(3000)] + [(i, None, f"s{i}") for i in range(40)] + [(7, "", None), (7, None, None), (7, "x", "a")]
        docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"))
        keyed = mixing.with_places(docs.withColumn("k", F.xxhash64("text")), docs, "k").collect()
        place = {(r.doc_id, r.text, r.source): r.position for r in keyed}
        out = mixing.mixed(docs)
        got = [(r.doc_id, r.text, r.source) for r in out.collect()]
        assert out.columns == ["doc_id", "text", "source"] and len(got) == len(keyed) == docs.count()
        assert sorted(got, key=repr) == sorted(((r.doc_id, r.text, r.source) for r in keyed), key=repr)
        assert [place[x] for x in got] == sorted(r.position for r in keyed)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
