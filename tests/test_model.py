"""The file model without Spark: objects, filters, cross references, recovery, layout."""

import zlib

import pytest

from paperloom.model import conformance, crypt, edit, glyphs, layout, reading
from paperloom.model.content import interpret
from paperloom.model.document import Pdf, page_label, roman
from paperloom.model.objects import Name, Parser, PdfError, Ref, Stream, decode_stream
from paperloom.model.writer import Objects, assemble, build, encrypt, serialise


@pytest.mark.parametrize(
    ("raw", "value"),
    [(b"12", 12), (b"-.5", -0.5), (b"/A#42", Name("AB")), (b"(a\\(b\\051\\n)", b"a(b)\n"), (b"<48 6>", b"H`"), (b"[1 2 0 R /X]", [1, Ref(2, 0), Name("X")]), (b"<</A 1 /B [true null]>>", {"A": 1, "B": [True, None]}), (b"% note\n7", 7)],
)
def test_objects(raw, value):
    assert Parser(raw).next() == value


def test_nesting_is_bounded():
    with pytest.raises(PdfError):
        Parser(b"[" * 500).next()


def test_filters():
    body = bytes(range(256)) * 3
    assert decode_stream(Stream({"Filter": Name("FlateDecode")}, zlib.compress(body))) == body
    assert decode_stream(Stream({"Filter": Name("ASCIIHexDecode")}, body.hex().encode() + b">")) == body
    assert decode_stream(Stream({"Filter": Name("RunLengthDecode")}, b"\x02abc\xfex\x80")) == b"abcxxx"
    assert decode_stream(Stream({"Filter": Name("ASCII85Decode")}, b"87cURD]i,\"Ebo80~>")) == b"Hello World!"
    up = b"\x02\x01\x02\x02\x01\x01"
    assert decode_stream(Stream({"Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 2}}, zlib.compress(up))) == b"\x01\x02\x02\x03"
    assert decode_stream(Stream({"Filter": Name("LZWDecode")}, bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]))) == b"-----A---B"


def _sample(**more):
    return build([[("Hello world", 72, 700, 12), ("second line", 72, 680, 12)], [("page two", 72, 700, 12)]], **more)


def _lines(pdf, page=0):
    return [x["text"] for x in layout.lines(interpret(pdf, pdf.pages[page])[0])]


def test_round_trip_and_recovery():
    data = _sample()
    assert data == _sample()
    for pdf in (Pdf(data), Pdf(data[: data.rfind(b"xref\n0")]), Pdf(b"junk" + data)):
        assert len(pdf.pages) == 2 and _lines(pdf) == ["Hello world", "second line"] and _lines(pdf, 1) == ["page two"]
    with pytest.raises(PdfError):
        Pdf(b"nothing here")


def test_xref_and_object_streams():
    objs = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1}, 3: {"Type": Name("Page"), "MediaBox": [0, 0, 10, 20], "Parent": Ref(2, 0)}}
    parts = [serialise(o) for o in objs.values()]
    heads, at = [], 0
    for n, p in zip(objs, parts):
        heads.append(f"{n} {at}")
        at += len(p) + 1
    head = " ".join(heads).encode() + b" "
    packed = Stream({"Type": Name("ObjStm"), "N": 3, "First": len(head)}, head + b" ".join(parts))
    out = b"%PDF-1.5\n"
    first = len(out)
    out += b"4 0 obj\n" + serialise(packed) + b"\nendobj\n"
    start = len(out)
    rows = b"".join(bytes([k]) + a.to_bytes(2, "big") + bytes([b]) for k, a, b in [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, first, 0), (1, start, 0)])
    table = Stream({"Type": Name("XRef"), "W": [1, 2, 1], "Size": 6, "Root": Ref(1, 0), "Filter": Name("FlateDecode")}, zlib.compress(rows))
    out += b"5 0 obj\n" + serialise(table) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % start
    for data in (out, out[: out.rfind(b"startxref")]):
        pdf = Pdf(data)
        assert len(pdf.pages) == 1 and pdf.box(pdf.pages[0]) == [0, 0, 10, 20]


def test_metadata():
    pdf = Pdf(_sample(info={"Title": "Tïtle 漢"}, outline=[{"title": "A", "page": 0, "parent": None}, {"title": "B", "page": 1, "parent": 0}, {"title": "C", "page": 1, "parent": None}], files=[{"name": "x.txt", "data": b"body"}], fields=[{"name": "f", "value": "v"}], links=[{"page": 0, "rect": (0, 0, 9, 9), "dest_page": 1}]))
    assert pdf.info()["Title"] == "Tïtle 漢"
    assert [(o["title"], o["depth"], o["page"], o["ordinal"]) for o in pdf.outline()] == [("A", 0, 0, 0), ("B", 1, 1, 0), ("C", 0, 1, 1)]
    assert pdf.attachments()[0]["data"] == b"body"
    assert [(f["name"], f["kind"], f["value"], f["display"]) for f in pdf.fields()] == [("f", "Tx", ["v"], "v")]
    assert pdf.annotations(pdf.pages[0])[0]["dest_page"] == 1


def test_labels():
    ranges = [{"start": 0, "style": "r", "prefix": "", "first": 1}, {"start": 2, "style": "A", "prefix": "x", "first": 26}]
    assert [page_label(i, ranges) for i in range(4)] == ["i", "ii", "xZ", "xAA"]
    assert page_label(4, []) == "5" and roman(1994) == "MCMXCIV"


def test_assemble():
    data = _sample()
    pdf = Pdf(assemble([(data, [1]), (data, [0, 1])]))
    assert [_lines(pdf, i)[0] for i in range(3)] == ["page two", "Hello world", "page two"]


def test_search_and_layout():
    pdf = Pdf(build([[("aaaa", 10, 100, 10), ("bb", 100, 100, 10)]]))
    ln = layout.lines(interpret(pdf, pdf.pages[0])[0])
    assert ln[0]["text"] == "aaaa bb"
    assert [h["start"] for h in layout.search(ln, "AA")] == [0, 2]
    assert layout.search(ln, "AA", ignore_case=False) == [] and layout.search(ln, "") == []
    assert layout.search(ln, "bb")[0]["rect"][0] == pytest.approx(100)
    assert layout.dehyphenate("exam-\nple Foo-\nBar") == "example Foo-\nBar"
    assert layout.csv([["a,b", 'q"'], ["c", ""]]) == '"a,b","q"""\r\nc,'


def test_tables_and_prose():
    grid = [[(f"r{i}c{j}", 50 + 120 * j, 700 - 14 * i, 10) for i in range(5) for j in range(3)]]
    pdf = Pdf(build(grid))
    found = layout.tables(interpret(pdf, pdf.pages[0])[0])
    assert len(found) == 1 and found[0]["cells"][4] == ["r4c0", "r4c1", "r4c2"]
    prose = Pdf(build([[("one long line of plain text " * 2, 50, 700 - 14 * i, 10) for i in range(8)]]))
    assert layout.tables(interpret(prose, prose.pages[0])[0]) == []


def test_aes_and_rc4_known_answers():
    block = bytes(range(0, 256, 17))
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        sealed = crypt.aes_cbc_encrypt(bytes(range(size)), bytes(16), block)
        assert sealed.hex() == want and crypt.aes_cbc_decrypt(bytes(range(size)), bytes(16), sealed) == block
    assert crypt.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"


@pytest.mark.parametrize("aes", [True, False])
def test_encrypted_files(aes):
    data = encrypt(_sample(info={"Title": "a title"}), b"user", b"owner", aes)
    for password in ("user", "owner"):
        pdf = Pdf(data, password)
        assert _lines(pdf) == ["Hello world", "second line"] and pdf.info()["Title"] == "a title"
    with pytest.raises(PdfError):
        Pdf(data, "other")
    assert len(Pdf(data).pages) == 2 and Pdf(data).info()["Title"] != "a title"
    assert _lines(Pdf(encrypt(_sample(), aes=aes))) == ["Hello world", "second line"]


def test_reading_order():
    span = lambda t, x, y, w, mcid=None, size=10.0: {"seq": 0, "text": t, "x": x, "y": y, "size": size, "advance": w, "mcid": mcid}
    columns = [span(f"{side}{k}", x, 700 - 14 * k, 195) for k in range(4) for side, x in (("L", 50), ("R", 300))]
    assert reading.text([span("Title", 50, 760, 445), *columns]) == "Title\nL0\nL1\nL2\nL3\nR0\nR1\nR2\nR3"
    assert reading.text([span("wide", 50, 700, 100), span("gap", 160, 700, 30)]) == "wide gap" and reading.text([]) == ""
    assert reading.text([span("x", float("nan"), 1, 1), span("", 0, 0, 0)]) == ""
    assert reading.in_logical_order("a גב 1 א z") == "a א 1 בג z"


def test_structure_order():
    tags = [{"role": "P", "page": 0, "spans": [1]}, {"role": "H1", "page": 0, "spans": [0]}]
    pdf = Pdf(build([[("first", 72, 700, 12), ("second", 72, 680, 12), ("loose", 72, 660, 12)], []], tags=tags))
    tree, spans = pdf.structure(), interpret(pdf, pdf.pages[0])[0]
    assert [(e["role"], e["parent"], e["page"]) for e in tree] == [("P", None, 0), ("H1", None, 0)]
    assert reading.structured(spans, tree, 0) == "second\nfirst\nloose" and reading.structured([], tree, 1) == ""
    tree[0]["actual_text"], tree[1]["alt"] = "said", "unused"
    assert reading.structured(spans, tree, 0) == "said\nfirst\nloose"


def test_updates_keep_the_old_bytes():
    data = _sample(fields=[{"name": "a", "value": "old"}])
    out = edit.rotate(edit.annotate(edit.fill(edit.set_info(data, {"Title": "new", "Author": None}), {"a": "ünï"}), [{"page": 1, "subtype": "Highlight", "rect": (1, 2, 3, 4), "contents": "note"}]), {0: 5})
    pdf = Pdf(out)
    assert out.startswith(data) and not pdf.recovered and edit.set_info(data, {}) != b"" and edit.rotate(data, {}) == data
    assert pdf.info()["Title"] == "new" and pdf.fields()[0]["value"] == ["ünï"] and _lines(pdf) == ["Hello world", "second line"]
    assert [a["contents"] for a in pdf.annotations(pdf.pages[1])] == ["note"] and pdf.pages[0]["Rotate"] == 90
    with pytest.raises(PdfError):
        edit.fill(data, {"b": "x"})
    with pytest.raises(PdfError):
        edit.set_info(encrypt(data), {"Title": "x"})


def test_conformance():
    tags = [{"role": "H2", "page": 0, "spans": [0]}, {"role": "Figure", "page": 0, "spans": [1]}, {"role": "Odd", "page": 1, "spans": [0]}]
    rules = lambda found: {r["rule"]: r["count"] for r in found}
    assert rules(conformance.accessible(Pdf(_sample(tags=tags)))) == {"lang": 1, "figure-alt": 1, "headings": 1, "role-unmapped": 1, "page-struct-parents": 2}
    assert {"tagged", "struct-tree"} <= set(rules(conformance.accessible(Pdf(_sample()))))
    assert "encryption" in rules(conformance.archive(Pdf(encrypt(_sample()))))
    assert conformance.claimed(Pdf(_sample(xmp="<pdfaid:part>2</pdfaid:part><pdfaid:conformance>B</pdfaid:conformance>"))) == ("2", "B")


def test_glyph_names():
    names = {"A": "A", "bullet": "•", "emdash": "—", "eacute": "é", "Scaron": "Š", "alpha": "α", "Omega": "Ω", "seven": "7", "uni20AC": "€", "u1F600": "😀", "f_i": "fi", "a.alt": "a", "equal": "=", "nothing": None, "qring": None}
    assert {n: glyphs.character(n) for n in names} == names


def test_hidden_layers_are_left_out():
    o = Objects()
    root, tree = o.add(), o.add()
    on, off = (o.add({"Type": Name("OCG"), "Name": n}) for n in ("on", "off"))
    either, both = (o.add({"Type": Name("OCMD"), "OCGs": [on, off], "P": Name(p)}) for p in ("AnyOn", "AllOn"))
    font = o.add({"Type": Name("Font"), "Subtype": Name("Type1"), "Encoding": {"Differences": [65, Name("bullet")]}})
    show = lambda layer, text, y: b"/OC /%s BDC BT /F 10 Tf 10 %d Td (%s) Tj ET EMC\n" % (layer, y, text)
    body = show(b"On", b"on", 90) + show(b"Off", b"off", 70) + show(b"Either", b"either", 50) + show(b"Both", b"both", 30) + b"BT /F 10 Tf 10 10 Td (A) Tj ET"
    form = {"Font": {"F": font}, "Properties": {"On": on, "Off": off, "Either": either, "Both": both}}
    page = o.add({"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, 100, 100], "Resources": form, "Contents": o.add(Stream({}, body))})
    o.set(tree, {"Type": Name("Pages"), "Kids": [page], "Count": 1})
    o.set(root, {"Type": Name("Catalog"), "Pages": tree, "OCProperties": {"OCGs": [on, off], "D": {"OFF": [off]}}})
    assert _lines(Pdf(o.file(root))) == ["on", "either", "•"]


def test_filters_keep_their_budget_and_salvage():
    from paperloom.model.objects import Budget

    body = b"".join(b"%d, " % (k * k) for k in range(2000))
    packed = zlib.compress(body)
    flate = lambda raw, **x: decode_stream(Stream({"Filter": Name("FlateDecode")} | x, raw))
    assert flate(packed[2:-4]) == body and flate(b"\x00\x01" + packed) == body  # no header, stray bytes before it
    assert body.startswith(got := flate(packed[: len(packed) // 2])) and got
    with pytest.raises(PdfError):
        flate(b"no data at all")
    for name, raw in (("FlateDecode", zlib.compress(bytes(10**6))), ("RunLengthDecode", b"\x81a" * 10**4 + b"\x80"), ("ASCII85Decode", b"z" * 10**5)):
        with pytest.raises(PdfError):
            decode_stream(Stream({"Filter": Name(name)}, raw), budget=Budget(10**4))
    assert decode_stream(Stream({"Filter": Name("ASCII85Decode")}, b"87c\x00URD]i,\"Ebo80~>")) == b"Hello World!"
    sub = bytes([1, 1, 1, 1, 1, 3, 10, 10, 10, 10, 4, 1, 0, 0, 0])
    assert flate(zlib.compress(sub), DecodeParms={"Predictor": 15, "Columns": 4}) == bytes([1, 2, 3, 4, 10, 16, 19, 21, 11, 16, 19, 21])  # sums along the row, means and Paeth's predictor over the rows
    assert flate(zlib.compress(bytes([1, 2, 250, 10])), DecodeParms={"Predictor": 2, "Columns": 4}) == bytes([1, 3, 253, 7])
    assert flate(zlib.compress(bytes([0x1F])), DecodeParms={"Predictor": 2, "Columns": 2, "BitsPerComponent": 4}) == bytes([0x10])


def test_limits_and_repair():
    from paperloom.model.content import read
    from paperloom.model.objects import Limits

    data = _sample()
    assert Pdf(data, repair=True).recovered and _lines(Pdf(data, repair=True)) == ["Hello world", "second line"]
    few = Pdf(data, limits=Limits(operators=3))
    assert read(few, few.pages[0]).truncated and not read(Pdf(data), Pdf(data).pages[0]).truncated
    small = Pdf(data, limits=Limits(decoded=10))
    found = read(small, small.pages[0])
    assert found.spans == [] and found.truncated
    rootless = b"1 0 obj <</Type /Page /Contents 2 0 R /MediaBox [0 0 9 9]>> endobj 2 0 obj <</Length 3>> stream\nq Q\nendstream endobj"
    assert len(Pdf(rootless).pages) == 1


def test_functions():
    from paperloom.model.calc import calculator, function

    pdf = Pdf(_sample())
    assert calculator(b"{ 2 copy add 3 1 roll sub }")([5.0, 3.0]) == [8.0, 2.0]
    assert calculator(b"{ 360 atan 1 index 0 eq { pop pop 7 } { 3 -1 roll pop } ifelse }")([0.0, 0.0]) == [7.0]
    assert calculator(b"{ cvi 3 bitshift 5 xor -2 idiv }")([2.5]) == [-10.0]
    for bad in (b"{ pop }", b"{ 1 0 div }", b"{ nothing }", b"{ 3 index }"):
        with pytest.raises(PdfError):
            calculator(bad)([])
    two = function(pdf, Stream({"FunctionType": 0, "Domain": [0, 1, 0, 1], "Range": [0, 1], "Size": [2, 2], "BitsPerSample": 4}, bytes([0x0F, 0xF0])))
    assert [two([0, 0]), two([1, 0]), two([0.5, 0.5])] == [[0.0], [1.0], [0.5]]
    halves = {"FunctionType": 3, "Domain": [0, 1], "Bounds": [0.5], "Encode": [0, 1, 1, 0], "Functions": [{"FunctionType": 2, "Domain": [0, 1], "N": 1}] * 2}
    assert [function(pdf, halves)([x])[0] for x in (0.25, 0.5, 0.75, 2)] == [0.5, 1.0, 0.5, 0.0]
    with pytest.raises(PdfError):
        function(pdf, {"FunctionType": 2})


def test_forms_of_edits():
    data = _sample(links=[{"page": 0, "rect": (60, 690, 200, 720), "uri": "https://x"}], outline=[{"title": "A", "page": 1, "parent": None}])
    moved = Pdf(edit.edit_annotations(data, [{"page": 0, "ordinal": 0, "rect": (1, 2, 3, 4), "contents": "new"}]))
    assert moved.annotations(moved.pages[0])[0]["rect"] == [1, 2, 3, 4] and moved.annotations(moved.pages[0])[0]["contents"] == "new"
    gone = Pdf(edit.edit_annotations(data, [{"page": 0, "ordinal": 0, "delete": True}]))
    assert gone.annotations(gone.pages[0]) == []
    dark = edit.redact(data, [{"page": 0, "rect": (70, 695, 300, 715)}])
    assert _lines(Pdf(dark)) == ["second line"] and b"Hello" not in dark and Pdf(dark).annotations(Pdf(dark).pages[0]) == [] and Pdf(dark).outline()[0]["page"] == 1
    whole = Pdf(edit.set_info(data, {"Title": "T"}, modified="D:20260101000000Z")).info()
    assert whole["Title"] == "T" and whole["ModDate"] == "D:20260101000000Z"
    from paperloom.model.writer import rewrite

    loose = build([[("x" * 200, 10, 10, 5)]], compress=False)
    assert len(rewrite(loose)) < len(loose) and _lines(Pdf(rewrite(loose))) == ["x" * 200]
    assert Pdf(rewrite(encrypt(data, b"", b"o"))).trailer.get("Encrypt") is None


def test_safe_names():
    from paperloom.model.document import safe_name

    for name, want in [("../../etc/passwd", "passwd"), ("..\\..\\evil.dll", "evil.dll"), ("C:\\x\\y.txt", "y.txt"), ("a:b?.txt", "a_b_.txt"), ("con.txt", "_con.txt"), ("LPT1", "_LPT1"), ("x. . ", "x"), ("..", None), ("___", None), ("", None)]:
        assert safe_name(name) == want


def test_pixels_and_dashes():
    from paperloom.model import raster

    pdf = Pdf(_sample())
    image = lambda raw, **d: raster.pixels(pdf, Stream({"Width": 2, "Height": 1} | d, raw))
    assert image(b"\x00\x80", ColorSpace=Name("DeviceGray"), BitsPerComponent=8) == (2, 1, bytes([0, 0, 0, 128, 128, 128]))
    assert image(b"\x40", ImageMask=True) == (2, 1, bytes([0, 0, 0, 255, 255, 255]))
    assert image(b"\xf0", ColorSpace=Name("DeviceGray"), BitsPerComponent=4, Decode=[1, 0])[2] == bytes([0, 0, 0, 255, 255, 255])
    assert image(b"\x40", ColorSpace=[Name("Indexed"), Name("DeviceRGB"), 1, bytes([9, 8, 7, 1, 2, 3])], BitsPerComponent=1)[2] == bytes([9, 8, 7, 1, 2, 3])
    assert image(b"\xff\xff\x00\x00", ColorSpace=Name("DeviceGray"), BitsPerComponent=16)[2] == bytes([255] * 3 + [0] * 3)
    assert image(bytes(8), ColorSpace=Name("DeviceCMYK"), BitsPerComponent=8)[2] == bytes([255] * 6)
    for bad in ({"Filter": Name("DCTDecode")}, {"ColorSpace": Name("Lab"), "BitsPerComponent": 8}, {"ColorSpace": Name("DeviceGray"), "BitsPerComponent": 3}, {"Width": 0}):
        with pytest.raises(PdfError):
            image(b"", **bad)
    assert raster.dashes([(0, 0), (10, 0)], [4, 2], 5) == [[(1.0, 0.0), (5.0, 0.0)], [(7.0, 0.0), (10, 0)]]
    assert raster.dashes([(0, 0), (10, 0)], []) == raster.dashes([(0, 0), (10, 0)], [0, 0]) == [[(0, 0), (10, 0)]]


def test_fonts_by_code():
    from paperloom.model.fonts import BASES, CMap, standard_width

    assert BASES["MacRomanEncoding"][0x8E] == "é" and BASES["Symbol"][0x61] == "α" and BASES["ZapfDingbats"][0x33] == "✓" and BASES["PDFDocEncoding"][0x92] == "™" and BASES["StandardEncoding"][0xD0] == "—"
    m = CMap(b"2 begincodespacerange <00> <7F> <8140> <9FFC> endcodespacerange 1 begincidrange <8140> <817E> 633 endcidrange 1 begincidchar <20> 1 endcidchar")
    assert m.split(b"\x20\x81\x40\x41") == [(1, 0x20), (2, 0x8140), (1, 0x41)] and m.cid(0x8141) == 634 and m.cid(0x20) == 1 and m.cid(0x41) == 0
    t = CMap(b"2 beginbfrange <01> <02> [<0041> <00410042>] <10> <12> <D83DDE00> endbfrange 1 beginbfchar <20> /bullet endbfchar")
    assert t.text[1, 2] == "AB" and t.text[1, 0x12] == "\U0001f602" and t.text[1, 0x20] == "•"
    assert standard_width("Courier-Bold", "x") == 600 and standard_width("Times-Roman", "W") == 944 and standard_width("Helvetica", "É") == 667
