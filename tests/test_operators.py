import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import scoring
from scriptorium.operators import aggregates, dedup, filters, graph, inventory, joins, manifest, requests, state, windows
from scriptorium.plans import builders


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_components_are_the_same_in_any_order(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent if find(x) != x}
    for _ in range(2):
        rng.shuffle(edges)
        got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_threads(spark):
    m = [(1, "a", []), (2, "b", ["a", "zz"]), (3, "c", ["b"]), (4, "d", []), (5, None, ["a"]), (6, "d", ["c"])]
    out = rows(graph.threads(spark.createDataFrame(m, "num long, message_id string, parents array<string>")))
    assert out == [("a", 1, 4), ("b", 1, 4), ("c", 1, 4), ("d", 1, 4)]  # the later of two rows with one id counts


def test_thread_summary_puts_undated_first(spark):
    turns = spark.createDataFrame([(1, 5, "x"), (1, None, "y"), (1, 2, "z")], "thread_id long, at int, member string")
    assert rows(graph.thread_summary(turns)) == [(1, 3, 5, "y")]
    assert [(m, n) for _, _, m, n in sorted(rows(graph.thread_order(turns)), key=lambda r: r[3])] == [("y", 1), ("z", 2), ("x", 3)]


def test_stale_groups(spark):
    parts = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), ("d", None)], "k string, at int")
    wholes = spark.createDataFrame([("a", 4), ("b", 5), ("d", 1)], "k string, whole_at int")
    assert [r[0] for r in rows(joins.stale_groups(parts, wholes, "k"))] == ["a", "c"]


def test_missing_summaries(spark):
    schema = "path string, file_type string, source_type string, source_path string, created string"
    files = spark.createDataFrame([("t1", "transcription", "note", None, "2024-01-01"), ("t2", "transcription", "mail", None, "2024-02-01"), ("t3", "transcription", "mail", None, None), ("s", "summary", None, "t1", None)], schema)
    assert [r.path for r in joins.missing_summaries(files).collect()] == ["t2", "t3"]
    assert [r.path for r in joins.missing_summaries(files, "mail", "2024-02-01", "2024-02-02").collect()] == ["t2"]


def test_aliases(spark):
    aliases = spark.createDataFrame([("ann", "person", "ann", 0), ("*@x.org", "organisation", "x", 5), ("bob@x.org", "person", "bob", 1), ("ANN", "organisation", "z", 9)], "alias string, entity_type string, slug string, rank int")
    who = spark.createDataFrame([("Ann",), ("bob@x.org",), ("eve@X.org",), ("eve@y.x.org",), (None,)], "who string")
    got = {r["who"]: r["entity"] for r in joins.resolve_aliases(who, aliases, "who").collect()}
    assert got == {"Ann": "person/ann", "bob@x.org": "person/bob", "eve@X.org": "organisation/x", "eve@y.x.org": None, None: None}


def test_filters(spark):
    path = spark.createDataFrame([("a/b.pdf",), ("a/b.exe",), ("a/.git/b.pdf",), ("- wf/b.pdf",), ("old/b.pdf",), ("old/keep/b.pdf",), ("a/tmp1/b.pdf",)], "path string")
    reason = filters.document_reason(F.col("path"), [".pdf"], [".git"], ["old/keep"], ["old"], ["tmp*"])
    assert [r[0] for r in path.select(reason).collect()] == [None, "extension", "technical_folder", "workflow_folder", "excluded_folder", None, "excluded_pattern"]
    assert [r[0] for r in spark.createDataFrame([("a/_b.md",), ("a/Attachments/c.md",), ("a/b.md",)], "p string").select(filters.trackable(F.col("p"))).collect()] == [False, False, True]
    kept = spark.createDataFrame([([("a.pdf", 1), ("b.png", 10), ("c.png", 60_000), ("d", 9), ("e.exe", 9)],)], "a array<struct<filename:string,size:long>>").select(filters.kept_attachments(F.col("a"), ["pdf"])).first()[0]
    assert [k["filename"] for k in kept] == ["a.pdf", "c.png"]
    assert rows(filters.where_equal(spark.createDataFrame([("x", None), ("y", 1)], "a string, b int"), b="None")) == [("x", None)]


def test_documents_scan_table(spark):
    src = spark.createDataFrame([("same", 1, 1, "h"), ("touched", 1, 2, "h"), ("edited", 1, 2, "k"), ("unhashed", 9, 2, "k"), ("new", 77, 1, "n"), ("copy", 5, 1, "c"), ("other", 5, 1, "d")], "path string, size int, mtime int, hash string")
    mirrors = spark.createDataFrame([("same", 1, 1, "h"), ("touched", 1, 1, "h"), ("edited", 1, 1, "h"), ("unhashed", 9, 1, None)], "path string, size int, mtime int, hash string")
    hashes = spark.createDataFrame([("z", 5, "c")], "path string, size int, hash string")
    got = {r["path"]: r["outcome"] for r in joins.document_scan(src, mirrors, hashes).collect()}
    assert got == {"same": "existing", "touched": "existing", "edited": "emit_changed", "unhashed": "existing", "new": "emit", "copy": "known_hash", "other": "emit_hashed"}


def test_sender_lists(spark):
    scored = spark.createDataFrame([("a", "ignored", -1)] * 3 + [("a", "captured", 0)] + [("b", "captured", 1)] * 2 + [("c", "captured", 9)] * 2, "domain string, band string, score int")
    assert rows(aggregates.sender_lists(aggregates.domain_bands(scored), 0)) == [("allow", "a", 3), ("deny", "b", 2), ("review", "a", 4)]


def test_aggregates_on_empty_tables(spark):
    assert rows(aggregates.zero_filled(spark.createDataFrame([], "k string"), "k", ["x", "y"])) == [("x", 0), ("y", 0)]
    assert aggregates.band_shares(spark.createDataFrame([], "band string")).count() == 0
    assert rows(aggregates.folder_stats(spark.createDataFrame([], "f string"), "f", F.lit(1))) in ([], [(None, 1, 0, None)])


def test_missing_fields(spark):
    df = spark.createDataFrame([(1, {"a": "x", "b": None}), (2, {"a": "x", "b": "y"}), (3, None)], "k int, m map<string,string>")
    assert rows(aggregates.missing_fields(df, "k", F.col("m"), ["a", "b"])) == [(1, "b"), (3, "a,b")]


@pytest.mark.parametrize(("n", "k"), [(0, 5), (3, 5), (5, 5), (100, 7), (101, 10), (50, 49)])
def test_even_sample(spark, n, k):
    got = [r[0] for r in windows.even_sample(spark.range(n), "id", k).orderBy("id").collect()]
    assert got == (list(range(n)) if n <= k else sorted({i * n // k for i in range(k)}))


def test_windows(spark):
    moves = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "o int, t string")
    assert [r.final for r in windows.collision_suffix(moves, "t", "o").orderBy("o").collect()] == ["a", "a (2)", "b"]
    refs = spark.createDataFrame([("d", "f", "1", True), ("d", "f", "2", False), ("d", "g", "1", True)], "dir string, name string, doc string, moved boolean")
    assert {(r.name, r.action) for r in windows.move_or_copy(refs).collect()} == {("f", "copy"), ("g", "move")}
    lines = spark.createDataFrame([("x", i, i in (1, 2, 5)) for i in range(7)], "g string, n int, on boolean")
    assert {(r.start, r.stop) for r in windows.islands(lines, "g", "n", "on").collect()} == {(1, 2), (5, 5)}


def test_multiset_diff_is_antisymmetric(spark):
    rng = random.Random(5)
    a, b = ([(1, rng.choice("abcd")) for _ in range(30)] for _ in range(2))
    df = lambda x: spark.createDataFrame(x, "k int, t string")
    there, back = rows(dedup.multiset_diff(df(a), df(b), "k", "t")), rows(dedup.multiset_diff(df(b), df(a), "k", "t"))
    assert [(k, t, y, x) for k, t, x, y in there] == back
    lost = Counter(t for _, t in a) - Counter(t for _, t in b)
    assert {t: x for _, t, x, _ in there if x} == dict(lost)
    assert rows(dedup.preserved(dedup.multiset_diff(df(a), df(a), "k", "t"), df(a), "k")) == [(1, True)]


def test_duplicates_hash_only_files_of_one_size(spark):
    files = spark.createDataFrame([("b", 1, "x"), ("a", 1, "x"), ("c", 1, "y"), ("d", 2, "x")], "path string, size int, c string")
    twins = dedup.size_twins(files)
    assert {r.path for r in twins.collect()} == {"a", "b", "c"}
    assert {(r.path, r.keep) for r in dedup.duplicates(files, F.lit("h")).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("p", "x", 1), ("q", "y", 2)], "path string, a string, n int")
    new = spark.createDataFrame([("p", None, 5), ("r", "z", None)], "path string, a string, n int")
    once = state.upsert(old, new, "path")
    assert rows(once) == [("p", "x", 5), ("q", "y", 2), ("r", "z", None)]
    assert rows(state.upsert(once, new, "path")) == rows(once)
    assert rows(state.upsert(old, new, "path", always=["a"]))[0] == ("p", None, 5)


def test_stats_and_moves(spark):
    files = spark.createDataFrame([("a", 1, 1.0, "h"), ("b", 1, 1.0, "h"), ("c", 1, 1.0, "h")], "path string, size long, mtime double, hash string")
    seen = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0), ("n", 3, 1.0)], "path string, size long, mtime double")
    assert rows(state.refresh_stats(files, seen)) == [("a", 1, 1.0, "h"), ("b", 2, 1.0, None), ("c", 1, 1.0, "h"), ("n", 3, 1.0, None)]


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    assert state.read(spark, path) is None
    state.swap(spark.range(3), path)
    state.swap(state.read(spark, path).where("id > 0"), path)  # reads the old one while it writes
    assert state.read(spark, path).count() == 2
    (tmp_path / "state" / "snapshot=00000009").mkdir()  # a write that broke off
    assert state.current(spark, path) == 1


def test_manifest_patch(spark):
    base = spark.createDataFrame([("a", "x", "to_confirm"), ("b", "x", "to_confirm"), ("c", "y", "auto"), ("d", None, "auto")], "id string, e string, status string")
    patches = spark.createDataFrame([("a", {"status": "auto"}, False, 1), ("a", {"status": "late"}, False, 2), ("b", None, True, 3)], "id string, changes map<string,string>, remove boolean, ord int")
    assert rows(manifest.patch(base, "id", patches)) == [("a", "x", "late"), ("c", "y", "auto"), ("d", None, "auto")]
    assert rows(manifest.patch(base, "id", None, {"e": "None"}, {"e": "z"}, {"e": "y"})) == [("a", "x", "to_confirm"), ("b", "x", "to_confirm"), ("d", "z", "auto")]


def test_manifest_build_and_plan(spark):
    schema = "source string, resume_path string, entity_type string, entity_slug string, entity_name string, sender string, confidence string, date string, title string"
    data = [("note", "r/1.md", "person", "ann", "Ann", None, "high", "2024-01-01", "Été"), ("note", "r/2.md", "unknown", "", "Bob", "b@x.org", "high", None, None), ("note", "r/3.md", "person", None, "?", None, "low", "", "T")]
    aliases = spark.createDataFrame([("*@x.org", "organisation", "x", 0)], "alias string, entity_type string, slug string, rank int")
    built = manifest.build(spark.createDataFrame(data, schema), aliases)
    got = {r.resume_path: (r.entity_type, r.entity_slug, r.new_name, r.status) for r in built.collect()}
    assert got == {"r/1.md": ("person", "ann", "2024-01-01 ete", "auto"), "r/2.md": ("organisation", "x", "2", "alias_match"), "r/3.md": ("person", None, "3", "to_confirm")}
    plan = manifest.apply_plan(built, spark.createDataFrame([("/k/Note/organisation/x/2.md",)], "path string"), "/k")
    assert {(r.src, r.action, r.reason) for r in plan.collect()} == {("r/1.md", "move", None), ("r/2.md", "skip", "target_exists"), ("r/3.md", "skip", "not_confirmed")}
    assert rows(manifest.counts(built)) == [("alias_match", 1), ("auto", 1), ("to_confirm", 1), ("total", 3)]
    extra = manifest.enrich(built, spark.createDataFrame([("r/3.md", ["c"]), ("r/1.md", ["d"])], "id string, candidates array<string>"))
    assert {(r.resume_path, tuple(r.candidates or ())) for r in extra.collect()} == {("r/1.md", ()), ("r/2.md", ()), ("r/3.md", ("c",))}


def test_ingest(spark):
    res = spark.createDataFrame([("1", "```\n---\nsource: own\n---\nx\n```", "given"), ("2", "  ", None), ("3", "x", None), ("4", "x", None)], "custom_id string, content string, source_path string")
    req = spark.createDataFrame([("3", "asked")], "custom_id string, source_path string")
    got = {r.custom_id: (r.source, r.error) for r in requests.ingest(res, req).collect()}
    assert got == {"1": ("own", None), "2": (None, "no_content"), "3": ("asked", None), "4": (None, "no_source")}
    assert spark.createDataFrame([('[{"type":"text","text":"a"},{"type":"tool"},{"type":"text","text":"b"}]',), ("plain",)], "c string").select(requests.block_text(F.col("c"))).collect()[0][0] == "ab"


def test_extract_plan(spark):
    schema = "message_id string, from_addr string, to string, cc string, subject string, date timestamp, body string, is_html_only boolean, folder string, msg_hash string, headers map<string,string>, attachments array<struct<filename:string,size:bigint>>"
    row = lambda i, body="x" * 60, folder="Work", day=1: (i, "ann@x.org", "me", "", "Hello", __import__("datetime").datetime(2024, 1, day), body, False, folder, "abc", {}, [])
    mail = spark.createDataFrame([row("<1>"), row("<2>"), row("<3>", ""), row("<4>", folder="SPAM"), row("<5>", day=9)], schema)
    known = spark.createDataFrame([(" <2> ",)], "message_id string")
    plan = builders.extract(mail, scoring.Rules(), known, spark.createDataFrame([("out/Work/2024-01-09 hello abc.md",)], "path string"), "out")
    got = {r.src: (r.action, r.reason, r.dst) for r in plan.collect()}
    assert got["<1>"] == ("write", None, "out/Work/2024-01-01 hello abc.md")
    assert got["<2>"][:2] == ("skip", "known_id") and got["<4>"][:2] == ("skip", "ignored_folder") and got["<5>"][:2] == ("skip", "target_exists")
    assert got["<3>"][1].startswith("score -1: near_empty")
    content = plan.where("src = '<1>'").first().content
    assert content.startswith("---\ntype: mail\ncreated: ") and 'message-id: "<1>"' in content and content.endswith("x\n")
    assert {(r.action, r.reason): r.n for r in builders.counts(plan).collect()}[("skip", "score")] == 1


def test_register_and_summaries(spark):
    res = spark.createDataFrame([("entity", "person/ann", None, "<!-- PROFILE -->a<!-- TIMELINE -->b"), ("entity", "person/bob", None, "none"), ("moc", None, "law", "```\nm\n```"), ("odd", None, "x", "y")], "kind string, entity string, name string, content string")
    got = sorted((r.action, r.dst or "", r.reason or "", r.content or "") for r in builders.register(res, "k").collect())
    assert got == [("skip", "", "missing_marker", ""), ("skip", "", "unknown_kind", "y"), ("write", "k/person/ann/profile.md", "", "a"), ("write", "k/person/ann/timeline.md", "", "b"), ("write", "k/topics/law.md", "", "m")]
    ing = spark.createDataFrame([("1", "---\nsource: T/a.md\ncreated: wrong\ntitle: t\n---\nbody", "T/a.md", None), ("2", "x", "Z/b.md", None), ("3", "x", "T/none.md", None), ("4", None, None, "no_content")], "custom_id string, markdown string, source string, error string")
    out = {r.src: (r.action, r.dst, r.reason, r.content) for r in builders.summaries(ing, spark.createDataFrame([("T/a.md", "2024-01-01", None)], "path string, created string, modified string"), "T", "S").collect()}
    assert out["T/a.md"] == ("write", "S/a.md", None, "---\nsource: T/a.md\ncreated: 2024-01-01\nmodified: \ntitle: t\n---\n\nbody")
    assert out["Z/b.md"][2] == "outside_root" and out["T/none.md"][2] == "no_transcription" and out[None][2] == "no_content"


def test_directories(spark):
    paths = ["docs/a.pdf", "docs/b.pdf", "repo/pyproject.toml", "repo/src/deep/x.py", "photos/IMG_1.png", *(f"photos/IMG_{i}.png" for i in range(2, 14)), "empty/readme"]
    got = {r.dir: (r.category, r.confidence) for r in inventory.classified_directories(spark.createDataFrame([(p,) for p in paths], "path string"), 3, ["pdf"], ["py"], ["png"], ["pyproject.toml"]).collect()}
    assert got == {"docs": ("documents", "high"), "repo": ("code", "high"), "photos": ("photos", "high"), "empty": ("other", "low")}


def test_reindex(spark):
    fm = "---\nsource: s.pdf\nsource_hash: sha256:abc\nsource_size: 5\nsource_mtime: 1.5\nmessage-id: <1>\n---\nx"
    files = spark.createDataFrame([("a.md", 5, 1.5, fm), ("b.md", 6, 1.5, fm), ("c.md", 7, 1.5, "x"), ("_d.md", 1, 1.0, "x")], "path string, size long, mtime double, text string")
    known = spark.createDataFrame([("b.md", 6, 1.5, "kept"), ("c.md", 9, 1.5, "old")], "path string, size long, mtime double, hash string")
    got = {r.path: (r.hash, r.source_path, r.message_id) for r in inventory.reindexed(files, F.col("text"), F.lit("transcription"), known).collect()}
    assert got == {"a.md": ("abc", "s.pdf", "<1>"), "b.md": ("kept", "s.pdf", "<1>"), "c.md": (None, None, None)}


def test_scope_lists():
    cfg = {"included": ["a"], "excluded": ["b", "e\u0301"]}
    assert builders.scope_lists(cfg, include="a", exclude="\u00e9") == {"included": ["a"], "excluded": ["b", "e\u0301"]}
    assert builders.scope_lists(cfg, include="c", moved=["\u00e9"]) == {"included": ["a", "c"], "excluded": ["b"]}


def test_relinked(spark):
    plan = builders.deduplicate(spark.createDataFrame([("x/b.png", "x/a.png", 5), ("x/a.png", "x/a.png", 5)], "path string, keep string, size long"))
    docs = spark.createDataFrame([("d.md", "b.png"), ("e.md", "c.png")], "path string, name string")
    assert rows(builders.relinked(docs, plan)) == [("d.md", "b.png", "a.png")]
    assert rows(builders.freed(plan)) == [(1, 5)]


def test_synthesis_kinds(spark):
    df = spark.createDataFrame([("S/person/ann/profile.md",), ("S/reports/digests/2024-01-01.md",), ("S/reports/digests/2024-02-01.md",), ("S/index.md",), ("S/other.txt",)], "path string")
    assert [(r.kind, r.nth) for r in inventory.latest_digests(df).orderBy("kind", "nth").collect()] == [("digest", 1), ("digest", 2), ("index", 1), ("profile", 1)]
    assert inventory.latest_digests(df).where("kind = 'digest' AND nth = 1").first().path.endswith("2024-02-01.md")


def test_sweep(spark):
    from scriptorium import tables

    tables.sweep(spark)
    kept = tables.materialise(spark.range(3), "x")
    assert kept.count() == 3 and tables.sweep(spark) == 1 and tables.sweep(spark) == 0
