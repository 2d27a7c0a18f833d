"""The command line: editing verbs on files, reading verbs on a folder."""

import json

import pytest

from paperloom.__main__ import chosen, main
from paperloom.model.content import interpret
from paperloom.model.document import Pdf
from paperloom.model.objects import PdfError
from paperloom.model.writer import build


def _text(path, page=0):
    pdf = Pdf(path.read_bytes())
    return [s["text"] for s in interpret(pdf, pdf.pages[page])[0]]


def test_page_lists():
    assert chosen("", 3) == [0, 1, 2] and chosen("2,1", 3) == [1, 0] and chosen("2-", 4) == [1, 2, 3] and chosen("-2,4", 4) == [0, 1, 3]
    with pytest.raises(PdfError):
        chosen("5", 4)


def test_editing_verbs(tmp_path, capsys):
    one, two, out = (tmp_path / n for n in ("one.pdf", "two.pdf", "out.pdf"))
    one.write_bytes(build([[("first", 72, 700, 12)], [("second", 72, 700, 12)]], fields=[{"name": "f", "value": ""}], info={"Title": "T"}))
    two.write_bytes(build([[("third", 72, 700, 12)]]))
    run = lambda *a: main([str(x) for x in a])
    assert run("merge", out, one, two) == 0 and len(Pdf(out.read_bytes()).pages) == 3 and _text(out, 2) == ["third"]
    assert run("split", one, out, "--pages", "2") == 0 and _text(out) == ["second"]
    assert run("arrange", one, out, "--order", "2,1", "--rotate", 90) == 0 and _text(out) == ["second"] and Pdf(out.read_bytes()).pages[0]["Rotate"] == 90
    assert run("arrange", one, out, "--delete", "1") == 0 and _text(out) == ["second"]
    assert run("fill", one, out, "--set", "f=x") == 0 and Pdf(out.read_bytes()).fields()[0]["value"] == ["x"]
    assert run("set-meta", one, out, "--set", "Title=New") == 0 and Pdf(out.read_bytes()).info()["Title"] == "New"
    assert run("redact", one, out, "--rect", 60, 690, 300, 720) == 0 and _text(out) == []
    assert run("stamp", one, out, "--text", "DRAFT", "--page", 1) == 0 and _text(out, 1) == ["second", "DRAFT"]
    assert run("tag", one, out, "--lang", "en") == 0 and Pdf(out.read_bytes()).tagged
    assert run("encrypt", one, out, "--user", "u", "--rc4") == 0 and len(Pdf(out.read_bytes(), "u").pages) == 2
    assert run("optimize", one, out) == 0 and _text(out) == ["first"]
    assert run("split", one, out, "--pages", "9") == 1 and "PdfError" in capsys.readouterr().err


def test_reading_and_converting_verbs(spark, tmp_path, capsys):
    for n in ("a", "b"):
        (tmp_path / f"{n}.pdf").write_bytes(build([[(f"file {n}", 72, 700, 12)]], info={"Title": n}))
    rows = lambda *a: (main([str(x) for x in a], spark), [json.loads(x) for x in capsys.readouterr().out.splitlines()])[1]
    assert sorted(r["title"] for r in rows("info", tmp_path)) == ["a", "b"]
    assert [(r["path"][-5:], r["line_text"]) for r in rows("search", tmp_path, "--query", "FILE B")] == [("b.pdf", "file b")]
    assert {r["rule"] for r in rows("validate", tmp_path / "a.pdf", "--profile", "pdfx-4")} >= {"file-id", "output-intent"}
    rows("convert", tmp_path, tmp_path / "out", "--form", "markdown")
    assert "file a" in (tmp_path / "out" / "a.md").read_text()
    rows("export-svg", tmp_path, tmp_path / "out")
    assert (tmp_path / "out" / "b-1.svg").read_text().startswith("<svg")
