"""Texts to files that the loaders read back: CSV, mail, DOCX, PPTX, XLSX, PDF. Standard library only."""

from __future__ import annotations

import csv
import io
import zipfile
import zlib
from collections.abc import Callable
from email.message import EmailMessage
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

_OFFICE = "http://schemas.openxmlformats.org/"


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _relations(targets: list[str]) -> str:
    rows = "".join(f'<Relationship Id="r{i}" Type="{_OFFICE}officeDocument/2006/relationships/part" Target={quoteattr(t)}/>' for i, t in enumerate(targets, 1))
    return f'<Relationships xmlns="{_OFFICE}package/2006/relationships">{rows}</Relationships>'


def to_csv(rows: list[list[str]]) -> bytes:
    out = io.StringIO(newline="")
    csv.writer(out).writerows(rows)
    return out.getvalue().encode()


def to_eml(text: str, subject: str = "", sender: str = "", to: str = "") -> bytes:
    mail = EmailMessage()
    for key, value in (("Subject", subject), ("From", sender), ("To", to)):
        if value:
            mail[key] = value
    mail.set_content(text)
    return mail.as_bytes()


def to_docx(paragraphs: list[str], tables: list[list[list[str]]] = ()) -> bytes:
    p = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    table = lambda rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"
    body = "".join(map(p, paragraphs)) + "".join(map(table, tables))
    return _zip({"word/document.xml": f'<w:document xmlns:w="{_OFFICE}wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def to_pptx(slides: list[tuple[list[str], str]]) -> bytes:
    """Slides of (texts of the shapes, notes)."""
    names = f'xmlns:p="{_OFFICE}presentationml/2006/main" xmlns:a="{_OFFICE}drawingml/2006/main" xmlns:r="{_OFFICE}officeDocument/2006/relationships"'
    lines = lambda t: "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in t.split("\n"))
    shape = lambda t, kind="": f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody>{lines(t)}</p:txBody></p:sp>'
    tree = lambda kind, shapes: f"<p:{kind} {names}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:{kind}>"
    listed = "".join(f'<p:sldId id="{256 + i}" r:id="r{i}"/>' for i in range(1, len(slides) + 1))
    parts = {"ppt/presentation.xml": f"<p:presentation {names}><p:sldIdLst>{listed}</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": _relations([f"slides/slide{i}.xml" for i in range(1, len(slides) + 1)])}
    for i, (texts, notes) in enumerate(slides, 1):
        parts[f"ppt/slides/slide{i}.xml"] = tree("sld", "".join(map(shape, texts)))
        if notes:
            parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = _relations([f"../notesSlides/notesSlide{i}.xml"])
            parts[f"ppt/notesSlides/notesSlide{i}.xml"] = tree("notes", shape(str(i), '<p:ph type="sldNum"/>') + shape(notes, '<p:ph type="body"/>'))
    return _zip(parts)


def to_xlsx(sheets: dict[str, list[list]]) -> bytes:
    """Sheets of rows; texts, numbers and booleans keep their kind, None and '' leave a cell out."""

    def cell(v) -> str:
        if v is None or v == "":
            return ""
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        return f"<c><v>{v!r}</v></c>" if isinstance(v, int | float) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'

    names = f'xmlns="{_OFFICE}spreadsheetml/2006/main" xmlns:r="{_OFFICE}officeDocument/2006/relationships"'
    listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
    parts = {"xl/workbook.xml": f"<workbook {names}><sheets>{listed}</sheets></workbook>", "xl/_rels/workbook.xml.rels": _relations([f"worksheets/sheet{i}.xml" for i in range(1, len(sheets) + 1)])}
    for i, rows in enumerate(sheets.values(), 1):
        body = "".join(f'<row r="{k}">{"".join(map(cell, row))}</row>' for k, row in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {names}><sheetData>{body}</sheetData></worksheet>"
    return _zip(parts)


def to_pdf(pages: list[str], info: dict[str, str] | None = None) -> bytes:
    """A page a text, a line a line, in a font whose characters the file maps itself."""
    codes = {c: i for i, c in enumerate(sorted({c for p in pages for c in p if c != "\n"}), 1)}
    pairs = [f"<{i:04x}> <{c.encode('utf-16-be').hex()}>" for c, i in codes.items()]
    blocks = "".join(f"{len(pairs[k : k + 100])} beginbfchar\n" + "\n".join(pairs[k : k + 100]) + "\nendbfchar\n" for k in range(0, len(pairs), 100))
    cmap = f"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange\n{blocks}endcmap end"
    text = lambda s: b"<feff" + s.encode("utf-16-be").hex().encode() + b">"
    stream = lambda data: b"<</Filter/FlateDecode/Length %d>>stream\n" % len(z := zlib.compress(data)) + z + b"\nendstream"
    first = 7
    objects = [
        b"<</Type/Catalog/Pages 2 0 R>>",
        b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(pages), b" ".join(b"%d 0 R" % (first + 2 * i) for i in range(len(pages)))),
        b"<<%s>>" % b"".join(b"/%s%s" % (k.encode(), text(v)) for k, v in (info or {}).items()),
        b"<</Type/Font/Subtype/Type0/BaseFont/Own/Encoding/Identity-H/DescendantFonts[5 0 R]/ToUnicode 6 0 R>>",
        b"<</Type/Font/Subtype/CIDFontType2/BaseFont/Own/DW 500/CIDSystemInfo<</Registry(Adobe)/Ordering(Identity)/Supplement 0>>>>",
        stream(cmap.encode()),
    ]
    for i, page in enumerate(pages):
        lines = "".join(f"<{''.join(f'{codes[c]:04x}' for c in line)}> Tj T*\n" for line in page.split("\n"))
        objects += [b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]/Resources<</Font<</F 4 0 R>>>>/Contents %d 0 R>>" % (first + 2 * i + 1), stream(f"BT /F 10 Tf 12 TL 40 800 Td\n{lines}ET".encode())]
    out, places = bytearray(b"%PDF-1.7\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<</Size %d/Root 1 0 R/Info 3 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at))


def as_files(texts: DataFrame, make: Callable[[str], bytes]) -> DataFrame:
    """(path, content) of files made of (path, text); null texts give none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([make(t) for t in batch.column(1).to_pylist()], pa.binary())], names=["path", "content"])

    return texts.select("path", "text").where("text is not null").mapInArrow(run, "path string, content binary")
