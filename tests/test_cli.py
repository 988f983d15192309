"""Verbs of the command line over a small folder."""

import json

import pytest

from scriptorium import cli

MAIL = "From a Mon Jan  1 10:00:00 2024\nFrom: ann.b@x.org\nSubject: invoice 1\nDate: Mon, 1 Jan 2024 10:00:00 +0000\nMessage-ID: <1@x>\n\nPlease pay this invoice of the month before the end of it.\n\nFrom b Tue Jan  2 10:00:00 2024\nFrom: no-reply@x.org\nSubject: Re: news\nDate: Tue, 2 Jan 2024 10:00:00 +0000\nMessage-ID: <2@x>\nIn-Reply-To: <1@x>\n\nshort\n"


@pytest.fixture()
def run(spark, capsys):
    def call(*argv):
        capsys.readouterr()
        assert cli.main(argv, spark) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x]

    return call


def test_mail(run, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "box.mbox").write_text(MAIL)
    assert {r["message_id"] for r in run("mail-list", str(tmp_path / "in"))} == {"<1@x>", "<2@x>"}
    assert [r["message_id"] for r in run("mail-list", str(tmp_path / "in"), "--since", "2024-01-02")] == ["<2@x>"]
    bands = {r["message_id"]: r["band"] for r in run("mail-score", str(tmp_path / "in"))}
    assert bands == {"<1@x>": "captured", "<2@x>": "ignored"}
    assert sum(r["n"] for r in run("mail-bands", str(tmp_path / "in"))) == 2 and run("mail-senders", str(tmp_path / "in"))[0]["n"] == 2
    assert {r["size"] for r in run("mail-threads", str(tmp_path / "in"))} == {2}
    plan = run("mail-extract", str(tmp_path / "in"), "--root", str(tmp_path / "out"))
    assert sorted(r["action"] for r in plan) == ["skip", "write"] and not (tmp_path / "out").exists()
    assert run("mail-extract", str(tmp_path / "in"), "--root", str(tmp_path / "out"), "--apply") == [{"skip": 1, "write": 1}]
    assert len(list((tmp_path / "out").rglob("*.md"))) == 1
    again = run("mail-extract", str(tmp_path / "in"), "--root", str(tmp_path / "out"), "--known")
    assert sorted(r["reason"] for r in again if r["action"] == "skip")[0] == "known_id" and len(again) == 2


def test_files(run, tmp_path):
    (tmp_path / "e" / "Attachments").mkdir(parents=True)
    (tmp_path / "e" / "empty").mkdir()
    (tmp_path / "e" / "Attachments" / "a.pdf").write_text("a")
    (tmp_path / "e" / "Attachments" / "b.pdf").write_text("a")
    (tmp_path / "e" / "timeline.md").write_text("- [ ] call — 2024-01-02\n- [ ] later\n\n![a](Attachments/a.pdf) [c](Attachments/c.pdf)\n\n| lone |\n")
    (tmp_path / "note.md").write_text("---\nsource: x\n---\nbody")
    top = str(tmp_path)
    assert [(r["entity"], r["status"]) for r in run("actions-list", top, "--day", "2024-02-01")] == [("e", "expired"), ("e", "open")]
    assert [r["name"] for r in run("audit-links", top)] == ["c.pdf"]
    assert [r["src"] for r in run("attachments-orphans", top)] == [f"{top}/e/Attachments/b.pdf"]
    assert len(run("documents-duplicates", top)) == 1 and run("documents-tables", top)[0]["score"] == 2
    assert {r["path"]: r.get("source_path") for r in run("documents-reindex", top)} == {"e/timeline.md": None, "note.md": "x"}
    assert run("synthesis-list", top)[0]["kind"] == "timeline" and run("scope-directories", top) and run("summaries-route", top, "--day", "2024-01-01")
    assert run("audit-prune", top, "--root", str(tmp_path / "state")) == []
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "x.md").write_text("x")
    assert run("notes-copy", str(tmp_path / "n"), "--root", str(tmp_path / "m"), "--apply") == [{"copy": 1}] and (tmp_path / "m" / "x.md").exists()
    assert run("notes-backlog", str(tmp_path / "n"), "--root", str(tmp_path / "m"))[0]["n"] == 1
    assert run("attachments-orphans", top, "--apply") == [{"delete": 1}] and not (tmp_path / "e" / "Attachments" / "b.pdf").exists()
    assert run("directories-clean", top) == [{"removed": 1}] and run("config-check", top) == [{"problems": []}]
    with pytest.raises(SystemExit):
        cli.main(["no-such-verb"])
