import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import dates, routing, scoring, text


def one(spark, column, **values):
    """The value of an expression over one row of strings."""
    names = list(values)
    schema = ", ".join(f"{n} {'long' if isinstance(values[n], int) else 'string'}" for n in names) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("given_", "slug"),
    [("Élan & Cie  — Paris", "elan-cie-paris"), ("  --A--b__c  ", "a-b-c"), ("Straße", "strae"), ("漢字", ""), ("", ""), ("Ứng dụng", "ung-dung"), ("été", "ete")],
)
def test_slug(spark, given_, slug):
    assert one(spark, text.slug(F.col("t")), t=given_) == slug


def test_file_name_is_cut_then_trimmed(spark):
    assert one(spark, text.file_name(F.lit("2024-01-02"), F.col("t")), t="a" * 49 + " b") == "2024-01-02 " + "a" * 49
    assert one(spark, text.file_name(F.lit("2024-01-02"), F.col("t")), t="Facture Hydro") == "2024-01-02 facture-hydro"


@pytest.mark.parametrize(
    ("body", "cut"),
    [
        ("hello\nOn Monday Ann wrote:\n> old", "hello"),
        ("bonjour\nLe lundi Ann a écrit :\nvieux", "bonjour"),
        ("a\n> q1\n> q2\n\n  \nb\n", "a\nb"),
        ("a\n___\nb", "a"),
        ("a\nFrom: x\nSent: y\nold", "a"),
        ("no quotes", "no quotes"),
        ("", ""),
    ],
)
def test_cut_replies(spark, body, cut):
    assert one(spark, text.cut_replies(F.col("t")), t=body) == cut


def test_compress(spark):
    assert one(spark, text.compress(F.col("t")), t="a\nSent from my phone\nb\n-- \nsig") == "a\nSent from my phone\nb"  # list order, not place
    assert one(spark, text.compress(F.col("t")), t="a\n\n\n\n\nb\nUnsubscribe |\nc\n[image: logo]\n") == "a\n\n\nb\nc"
    assert one(spark, text.compress(F.col("t"), 10), t="12345678\n90123") == "12345678\n9\n\n…"
    assert one(spark, text.compress(F.col("t"), 10), t="123456789\n0123") == "123456789\n\n…"
    assert one(spark, text.compress(F.col("t"), 10), t="short") == "short"


def test_markdown_tokens(spark):
    md = "---\nk: v\n---\n# Title\n| a | b |\n| --- | --- |\n| x | y |\n- **bold** _it_ [link](http://u)\n1. l'été\n> q\n```py\ncode\n```"
    assert one(spark, text.markdown_tokens(F.col("t")), t=md) == ["title", "a", "b", "x", "y", "bold", "it", "link", "lété", "q", "code"]


def test_html(spark):
    html = "<p>a &amp; b</p><script>x</script><style>y</style><div>c<br>d</div>"
    assert text.html_to_text(html) == "a & b\nc\nd"
    assert one(spark, text.strip_html(F.col("t")), t=html) == "a & b\nc\nd"
    assert text.html_to_text(None) is None


def test_front_matter(spark):
    md = '---\ntitle: "A: b"\ntags: [x, y]\nlist:\n  - one\n  - two\nlong: first\n  second\n---\n\nbody\n'
    block = one(spark, text.front_matter_block(F.col("t")), t=md)
    assert text.parse_front_matter(block) == {"title": "A: b", "tags": "x,y", "list": "one,two", "long": "first second"}
    assert one(spark, text.body(F.col("t")), t=md) == "body\n"
    assert one(spark, text.front_matter_field(F.col("t"), "title"), t=md) == "A: b"
    assert one(spark, text.front_matter_block(F.col("t")), t="no front matter") is None


def test_small_text_functions(spark):
    assert one(spark, text.unfenced(F.col("t")), t="```markdown\na\nb\n```") == "a\nb"
    assert one(spark, text.unfenced(F.col("t")), t="a ``` b") == "a ``` b"
    assert one(spark, text.substitute(F.col("t"), {"a": F.lit("1")}), t="{{a}} {{b}}") == "1 {{b}}"
    assert one(spark, text.attachment_refs(F.col("t")), t="![x](Attachments/a.png) [y](./Attachments/b.pdf) ![x](Attachments/a.png)") == ["a.png", "b.pdf"]
    assert one(spark, text.attachment_list(F.col("t")), t="x\n## Attachments\n- a.pdf\n- b.png\n\n## Next\n- c") == ["a.pdf", "b.png"]
    assert one(spark, text.split_parts(F.col("t")), t="<!-- PROFILE -->\na\n<!-- TIMELINE -->\nb")[:] == ("a", "b")
    assert one(spark, text.split_parts(F.col("t")), t="<!-- PROFILE --> only") is None
    assert one(spark, text.path_variants(F.col("t"), "/k/root", "/k"), t="/k/root/a") == ["/k/root/a", "a", "root/a"]
    assert one(spark, text.path_variants(F.col("t"), "/k/root", "/k"), t="a") == ["a", "/k/root/a", "/k/a"]
    assert one(spark, text.mirror_path(F.col("t"), "/src", "/mirror"), t="/src/a/b.pdf") == "/mirror/a/b.md"
    assert one(spark, text.domain(F.col("t")), t="A <x@Y.org>") == "y.org"
    assert one(spark, text.source_from_path(F.col("t")), t="/k/Transcriptions/Notes/a.md") == "note"
    assert one(spark, text.key_values(F.col("t")), t="a=1,b=2") == {"a": "1", "b": "2"}
    assert one(spark, text.compact(F.col("t"), 10), t="abcd\nefghijklm") == "abcd\n…"
    assert one(spark, text.nfc(F.col("t")), t="é") == "é"


def test_dates(spark):
    assert str(one(spark, dates.day_in_name(F.col("t")), t="x 2024-02-29 y")) == "2024-02-29"
    assert one(spark, dates.day_in_name(F.col("t")), t="1985-01-01 2023-02-30") is None
    assert one(spark, dates.in_range(F.col("t"), "2024", "2025"), t="2024-05") is True
    assert one(spark, dates.in_range(F.col("t"), "2024", "2025"), t="2025") is False
    assert one(spark, dates.in_range(F.col("t"), "2024"), t=None) is False
    assert one(spark, dates.any_in_range([F.col("a"), F.col("b")], "2024", None), a=None, b=None) is True
    assert str(one(spark, dates.message_date(F.col("t"), F.lit(""), F.lit("")), t="Mon, 1 Jan 2024 10:00:00 +0200")) == "2024-01-01 08:00:00"
    assert str(one(spark, dates.message_date(F.lit(""), F.lit(""), F.col("t")), t="by x; Mon, 1 Jan 2024 10:00:00 +0000 (UTC)")) == "2024-01-01 10:00:00"
    assert str(one(spark, dates.parse_day(F.col("t")), t="2024-03-01T10:00")) == "2024-03-01"


def message(**given_):
    base = {"from_addr": "a@b.c", "subject": "", "body": "x" * 60, "folder": "inbox", "to": "", "cc": "", "is_html_only": False, "headers": {}, "attachments": []}
    return base | given_


@pytest.mark.parametrize(
    ("fields", "reasons"),
    [
        ({}, ""),
        ({"body": " \n "}, "near_empty [-1]"),
        ({"from_addr": "x@mygov"}, ""),
        ({"from_addr": "x@tax.gov"}, "government [+2]"),
        ({"from_addr": "jean.martin@b.c"}, "personal_sender [+1]"),
        ({"from_addr": "no-reply@b.c"}, "noreply [-1];noreply_without_action [-1]"),
        ({"from_addr": "no-reply@b.c", "body": "total 12,50 $ due 2024-01-01 " + "x" * 50}, "noreply [-1];actionable_body_many [+2]"),
        ({"subject": "RE: Invoice"}, "actionable_subject [+3];reply [+1]"),
        ({"attachments": [("a.PDF", 10)]}, "document_attached [+2]"),
        ({"headers": {"list-unsubscribe": "<x>"}}, "newsletter_header [-2]"),
        ({"cc": "me@home.example.org"}, "cc_only [-1]"),
        ({"cc": "me@home.example.org", "to": "you@home.example.org"}, ""),
        ({"folder": "Envoyés"}, "sent [+2]"),
        ({"from_addr": "info@b.c", "subject": "Last chance"}, "promotional_subject [-2];generic_address [-1]"),
    ],
)
def test_scoring(spark, fields, reasons):
    m = message(**fields)
    schema = "from_addr string, subject string, body string, folder string, to string, cc string, is_html_only boolean, headers map<string,string>, attachments array<struct<filename:string,size:bigint>>"
    row = scoring.score_messages(spark.createDataFrame([tuple(m.values())], schema), scoring.Rules()).first()
    assert row["reasons"] == reasons
    assert row["score"] == sum(int(r.split("[")[1][:-1]) for r in reasons.split(";") if r)
    assert row["band"] == ("captured" if row["score"] >= 0 else "ignored")


def test_rules_change_all_or_none():
    rules = scoring.Rules()
    same, diff = scoring.changed(rules, weight_noreply=-3)
    assert same is rules and diff == [("weight_noreply", -1, -3)]
    new, _ = scoring.changed(rules, dry_run=False, weight_noreply=-3, capture=2)
    assert new.weights["noreply"] == -3 and new.capture == 2
    with pytest.raises(ValueError):
        scoring.changed(rules, generic_addresses=("(",))
    with pytest.raises(ValueError):
        scoring.changed(rules, capture=-1)


@pytest.mark.parametrize(
    ("kind", "length", "age", "preference", "tier"),
    [("note", 2500, 0, "auto", "small"), ("note", 2501, 0, "auto", "large"), ("note", 2501, 541, "auto", "small"), ("document", 12001, 999, "auto", "large"), ("document", 100, 999, "auto", "small"), ("document", 12001, 0, "economy", "large"), ("mail", 9, 0, "quality", "large"), ("digest", 9, 0, "quality", "small"), ("thread", 9, 0, "economy", "large"), ("profile", 9, 0, "economy", "small"), ("?", 9, 999, "auto", "large")],
)
def test_routing(spark, kind, length, age, preference, tier):
    assert one(spark, routing.choose_tier(F.lit(kind), F.lit(length), F.lit(age), preference))["tier"] == tier


def test_routing_rejects_unknown_preference(spark):
    with pytest.raises(ValueError):
        routing.choose_tier(F.lit("note"), F.lit(1), F.lit(1), "cheap")


def test_classes_and_costs(spark):
    lit = F.lit
    classify = lambda name, marker, d, c, i, t, p: one(spark, routing.classify_directory(lit(name), lit(marker), lit(d), lit(c), lit(i), lit(t), lit(p)))[:]
    assert classify("X.app", False, 0, 0, 0, 1, 0) == ("bundle", "high")
    assert classify("x", True, 2, 0, 0, 3, 0) == ("mixed_documents", "medium")
    assert classify("x", False, 0, 6, 0, 11, 0) == ("code", "medium")
    assert classify("photos", False, 0, 0, 11, 11, 0) == ("photos", "high")
    assert classify("x", False, 0, 0, 11, 11, 0) == ("photos", "low")
    assert classify("x", False, 0, 0, 0, 0, 0) == ("empty", "high")
    assert one(spark, routing.has_code_marker(F.array(lit("a"), lit("B.xcodeproj")))) is True
    assert one(spark, routing.has_code_marker(F.array(lit("a")))) is False
    million = lit(1_000_000)
    assert one(spark, routing.token_cost(lit("?"), million, million, million, million)) == pytest.approx(3 + 3.75 + 0.3 + 15)
    assert one(spark, routing.action_status(lit(None).cast("date"), lit("2024-01-01").cast("date"), "2024-05-01")) == "expired"
    assert one(spark, routing.action_status(lit("2024-05-01").cast("date"), lit("2024-01-01").cast("date"), "2024-05-01")) == "open"


@given(st.dictionaries(st.from_regex(r"[a-z]{1,8}", fullmatch=True), st.from_regex(r"[A-Za-z0-9 ]{0,12}", fullmatch=True), max_size=6))
def test_front_matter_round_trip(fields):
    block = "\n".join(f"{k}: {v}" for k, v in fields.items())
    assert text.parse_front_matter(block) == {k: v.strip() for k, v in fields.items()}
