import io
import zipfile
import zlib

import pytest

from folioflux.sources import export, loaders, pdf
from folioflux.sources.tables import read_index, save_images, write_enriched

R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def with_parts(data: bytes, **parts) -> bytes:
    """An archive with parts put in or in place of its own."""
    out, old = io.BytesIO(), zipfile.ZipFile(io.BytesIO(data))
    with zipfile.ZipFile(out, "w") as z:
        for n in old.namelist():
            if n not in parts:
                z.writestr(n, old.read(n))
        for n, x in parts.items():
            z.writestr(n, x)
    return out.getvalue()


def test_pdf_pages_and_metadata():
    data = export.to_pdf(["This is page 1.\n  two", "", "שלום €"], {"Title": "T", "Author": "Ä"})
    got = loaders.load_pdf(data, "/x/a b.pdf")
    assert [s[0] for s in got] == ["This is page 1.\n  two", "[Image-only page]", "שלום €"]
    assert got[0][1]["title"] == "T" and got[0][1]["author"] == "Ä" and got[2][1]["page_number"] == 3 and got[0][1]["num_pages"] == 3 and got[0][1]["created"] is None


def objects(*bodies, trailer=b"/Root 1 0 R"):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, b) for i, b in enumerate(bodies, 1)) + b"trailer\n<<" + trailer + b">>\n%%EOF"


def stream(data, entries=b""):
    return b"<<%s/Length %d>>stream\n%s\nendstream" % (entries, len(data), data)


PAGE = (b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1/Resources<</Font<</F 5 0 R>>/XObject<</I 6 0 R/J 7 0 R>>>>>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>")


def test_pdf_by_position():
    font = b"<</Type/Font/Subtype/Type1/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[65/eacute/uni05D0]>>>>"
    content = rb"BT /F 10 Tf 1 0 0 1 0 700 Tm (b\(e\)low) Tj 0 50 Td (over) Tj 60 0 Td [(A)-20(B) 10 (\303)] TJ ET q 1 0 0 1 0 -100 cm BT /F 10 Tf 0 700 Td <6C617374> Tj ET Q"
    rgb, jpeg = bytes(range(12)), b"\xff\xd8jpeg"
    images = stream(zlib.compress(rgb), b"/Subtype/Image/Width 2/Height 2/BitsPerComponent 8/ColorSpace/DeviceRGB/Filter/FlateDecode"), stream(jpeg, b"/Subtype/Image/Filter/DCTDecode")
    book = pdf.Pdf(objects(*PAGE, stream(content), font, *images))
    page = book.pages()[0]
    assert pdf.page_text(book, page) == "over éאÃ\nb(e)low\nlast"
    png, raw = pdf.page_images(book, page)
    assert png.startswith(b"\x89PNG") and raw == jpeg
    got = loaders.load_pdf(objects(*PAGE, stream(content), font, *images), "/p/f x.pdf")
    assert got[0][1]["image_paths"] == ["cache/images/f_x_page1_img1.png", "cache/images/f_x_page1_img2.png"] and [b for _, b in got[0][2]] == [png, jpeg]


def test_pdf_streams_and_errors():
    text = b"BT /F 9 Tf (deep) Tj ET"
    packed = b"5 0 3 50 " + b"<</Type/Font/Subtype/Type1>>".ljust(50) + PAGE[2]
    data = objects(PAGE[0], PAGE[1], b"null", stream(zlib.compress(text), b"/Filter/FlateDecode"), b"null", stream(zlib.compress(packed), b"/Type/ObjStm/N 2/First 9/Filter/FlateDecode"))
    data = data.replace(b"3 0 obj\nnull\nendobj\n", b"").replace(b"5 0 obj\nnull\nendobj\n", b"")
    assert loaders.load_pdf(data, "x.pdf")[0][0] == "deep"
    assert pdf._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert pdf._run_length(b"\x02abc\xfed\x80") == b"abcddd" and pdf._predicted(bytes([2, 1, 1, 2, 1, 1]), {"Predictor": 12, "Columns": 2}) == bytes([1, 1, 2, 2])
    for bad, why in ((b"Not a PDF.", "failed to parse"), (b"%PDF-1.4 nothing", "failed to parse"), (objects(*PAGE, trailer=b"/Root 1 0 R/Encrypt 9 0 R"), "encrypted and requires a password")):
        with pytest.raises(loaders.UnsupportedFile, match=why):
            loaders.load_pdf(bad, "x.pdf")


def test_docx_images_and_tables():
    blip = lambda i: f'<w:p><w:r><w:drawing><a:blip xmlns:a="{A}" xmlns:r="{R}" r:embed="r{i}"/></w:drawing></w:r></w:p>'
    data = export.to_docx(["one", ""], [[["a", "b"], ["", "c"]]])
    xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode().replace("<w:tbl>", blip(1) + blip(1) + blip(2) + "<w:tbl>", 1)
    rels = export._relations(["media/i1.png", "media/i2.png"])
    got = loaders.load_docx(with_parts(data, **{"word/document.xml": xml, "word/_rels/document.xml.rels": rels, "word/media/i1.png": b"one", "word/media/i2.png": b"two"}), "/d/my file.docx")
    assert [s[0] for s in got] == ["one", "[Image-only content]", "[Image-only content]", "[Image-only content]", "a | b\nc"]
    assert got[1][1]["image_paths"] == got[2][1]["image_paths"] == ["cache/images/my_file_page3_img0.png"] and got[3][1]["image_paths"] == ["cache/images/my_file_page5_img1.png"]
    assert [b for s in got for b in (s[2] if len(s) > 2 else [])] == [("cache/images/my_file_page3_img0.png", b"one"), ("cache/images/my_file_page5_img1.png", b"two")]


def test_pptx_order_images_and_notes():
    data = export.to_pptx([(["first", " "], ""), (["second"], "123"), ([], "")])
    z = zipfile.ZipFile(io.BytesIO(data))
    pic = f'<p:pic xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"><p:blipFill><a:blip xmlns:a="{A}" xmlns:r="{R}" r:embed="r9"/></p:blipFill></p:pic></p:spTree>'
    parts = {"ppt/presentation.xml": z.read("ppt/presentation.xml").decode().replace('r:id="r1"', 'r:id="rX"').replace('r:id="r2"', 'r:id="r1"').replace('r:id="rX"', 'r:id="r2"')}
    for i in (1, 3):
        parts[f"ppt/slides/slide{i}.xml"] = z.read(f"ppt/slides/slide{i}.xml").decode().replace("</p:spTree>", pic)
        parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = '<R><r Id="r9" Target="../media/a.png"/></R>'
    parts["ppt/media/a.png"] = b"blob"
    got = loaders.load_pptx(with_parts(data, **parts), "/d/deck.pptx")
    assert [(s[0], s[1]["slide_number"]) for s in got] == [("second", 1), ("Presenter Notes (Slide 1):\n123", 1), ("first", 2)]  # the third slide's image was shown before
    assert got[2][1]["image_paths"] == ["cache/images/deck_slide2_img1.png"]


def test_xlsx_values_and_ranges():
    data = export.to_xlsx({"S": [[1, 2.5, True, "x"]] + [[f"r{i}"] if i != 3 else [] for i in range(2, 60)] + [[]]})
    z = zipfile.ZipFile(io.BytesIO(data))
    sheet = z.read("xl/worksheets/sheet1.xml").decode().replace('<row r="2">', '<row r="2"><c s="1"><v>45292</v></c><c s="1"><v>45292.5</v></c><c t="e"><v>#DIV/0!</v></c><c s="2"><v>0.25</v></c>')
    styles = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="170" formatCode="[Red]hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    got = loaders.load_xlsx(with_parts(data, **{"xl/worksheets/sheet1.xml": sheet, "xl/styles.xml": styles}), "b.xlsx")
    assert got[0][0].split("\n")[:2] == ["1\t2.5\tTrue\tx", "2024-01-01 00:00:00\t2024-01-01 12:00:00\t#DIV/0!\t06:00:00\tr2"]
    assert [s[1]["row_range"] for s in got] == ["1-51", "52-60"]


def test_images_are_saved(spark, tmp_path):
    data = with_parts(export.to_pptx([(["t"], "")]), **{"ppt/media/a.png": b"x"})
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "d.pptx").write_bytes(data)
    (tmp_path / "raw" / "broken.pdf").write_bytes(b"no")
    assert loaders.read_images(spark, str(tmp_path / "raw")).count() == 0
    images = spark.createDataFrame([("f", 0, "cache/images/a.png", b"1"), ("f", 1, "cache/images/b.png", b"2"), ("g", 0, "cache/images/a.png", b"3")], loaders.IMAGES)
    assert save_images(images, str(tmp_path)) == 2 and (tmp_path / "cache/images/a.png").read_bytes() == b"1"
    assert save_images(images.limit(0), str(tmp_path)) == 0
    listing = {r.name: r.size_kib for r in loaders.raw_listing(spark, str(tmp_path / "raw")).collect()}
    assert set(listing) == {"d.pptx", "broken.pdf"}
    loaders.register(".md", lambda data, path: [(data.decode(), {})])
    try:
        (tmp_path / "raw" / "n.md").write_text("hi")
        assert [r.content for r in loaders.read_files(spark, str(tmp_path / "raw")).where("path like '%.md'").collect()] == ["hi"]
    finally:
        del loaders.LOADERS[".md"]


def test_enriched_is_kept(spark, tmp_path):
    rows = lambda t: spark.createDataFrame([(f"{t}1", "pdf"), (f"{t}2", "docx")], "chunk_id string, doc_type string")
    where = str(tmp_path / "e")
    assert write_enriched(rows("a").where("doc_type = 'pdf'"), where) == ["pdf"] and write_enriched(rows("b"), where) == ["docx"]
    assert {r.chunk_id for r in spark.read.parquet(where).collect()} == {"a1", "b2"}
    assert write_enriched(rows("c"), where, overwrite=True) == ["docx", "pdf"] and {r.chunk_id for r in read_index(spark, where, ["pdf"]).collect()} == {"c1"}
    with pytest.raises(FileNotFoundError):
        read_index(spark, str(tmp_path / "none"))


def test_chunk_files(spark, tmp_path):
    from folioflux.sources.tables import chunk_files, read_chunk_files, with_meta

    (tmp_path / "chunks_pdf_x.tsv").write_text('chunk_id\tdoc_id\ttext\ttoken_count\tmeta_json\nc\td\tt\t1\t"{""a"":""b""}"\n')
    (tmp_path / "chunks_txt.tsv").write_text("chunk_id\tdoc_id\ttext\ttoken_count\tmeta_json\ne\td\tt\t1\t{cut\n")
    assert sorted(r.doc_type for r in chunk_files(spark, str(tmp_path)).collect()) == ["pdf_x", "txt"]
    got = {r.chunk_id: (r.doc_type, r.meta) for r in with_meta(read_chunk_files(spark, str(tmp_path))).collect()}
    assert got["c"] == ("pdf_x", {"a": "b"}) and got["e"][0] == "txt" and not got["e"][1]


def compound(named: dict[str, bytes]) -> bytes:
    """A compound file of a few streams: short ones among the small sectors."""
    import struct

    end, free, size = 0xFFFFFFFE, 0xFFFFFFFF, 512
    small, mini_fat, large, rows = b"", [], [], []
    for name, x in named.items():
        if len(x) < 4096:
            n = -(-len(x) // 64)
            rows.append((name, len(mini_fat) if n else end, len(x)))
            mini_fat += [len(mini_fat) + i + 1 for i in range(n - 1)] + [end] * bool(n)
            small += x.ljust(n * 64, b"\0")
        else:
            rows.append((name, ("large", len(large)), len(x)))
            large.append(x)
    pad = lambda x: x.ljust(-(-len(x) // size) * size, b"\0")
    sectors, fat = [], []

    def put(x: bytes) -> int:
        first, n = len(sectors), len(pad(x)) // size
        sectors.extend(pad(x)[i * size : (i + 1) * size] for i in range(n))
        fat.extend([first + i + 1 for i in range(n - 1)] + [end])
        return first

    fat.append(0xFFFFFFFD)
    sectors.append(b"")
    packed, mini = put(small or b"\0"), put(b"".join(struct.pack("<I", i) for i in mini_fat).ljust(size, b"\xff"))
    places = [put(x) for x in large]
    entry = lambda name, kind, right, child, start, held: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB3I", len(name) * 2 + 2, kind, 1, free, right, child) + b"\0" * 36 + struct.pack("<IQ", start, held)
    names = [entry("Root Entry", 5, free, 1, packed, len(small))]
    names += [entry(n, 2, i + 2 if i + 1 < len(rows) else free, free, places[s[1]] if isinstance(s, tuple) else s, held) for i, (n, s, held) in enumerate(rows)]
    directory = put(b"".join(names))
    sectors[0] = b"".join(struct.pack("<I", i) for i in fat).ljust(size, b"\xff")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<9I", 0, 1, directory, 0, 4096, mini, 1, end, 0) + struct.pack("<I", 0).ljust(4, b"\0")
    return (head + b"\xff" * (size - len(head))) + b"".join(sectors)


def test_messages_become_mails():
    from folioflux.sources.msg import MsgError, msg_to_eml, streams

    body = "Hello,\r\n\r\n" + "the pump is ready. " * 300
    named = {"__substg1.0_0037001F": "A subject".encode("utf-16-le"), "__substg1.0_1000001F": body.encode("utf-16-le"), "__substg1.0_0C1A001E": b"Anna Blum", "__substg1.0_0C1F001F": "a.blum@x.test".encode("utf-16-le"), "__substg1.0_0E04001F": "b@x.test".encode("utf-16-le"), "empty": b""}
    data = compound(named)
    assert streams(data) == named
    mail = msg_to_eml(data)
    assert loaders.load_eml(mail, "m.eml")[0][0] == body.replace("\r\n", "\n").strip()
    assert b"Subject: A subject" in mail and b"a.blum@x.test" in mail and b"To: b@x.test" in mail
    for bad in (b"", b"no", data[:300]):
        with pytest.raises(MsgError):
            streams(bad)
