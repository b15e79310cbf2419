"""File loaders: bytes of a file to segments and images, by suffix. Standard library only; others can be registered."""

from __future__ import annotations

import csv
import datetime
import hashlib
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable
from email import message_from_bytes, policy
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import pdf as pdf_files

#: A loader takes (bytes, path) and gives a list of (content, metadata) or (content, metadata, images);
#: images are (path under the project's input folder, bytes), named in the metadata's image_paths.
Loader = Callable[[bytes, str], list[tuple]]
SCHEMA = "path string, seq int, content string, meta map<string,string>, ok boolean, error string"
IMAGES = "path string, seq int, image_path string, content binary"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows of a sheet in one segment.
SHEET_ROWS = 50
#: Contents that stand for a place with images alone. Fixed values.
IMAGE_ONLY = {"docx": "[Image-only content]", "pptx": "[Image-only slide]", "pdf": "[Image-only page]"}
#: Number formats of a workbook that are dates by their number. Fixed values.
_DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))


class UnsupportedFile(Exception):
    """The file is not what its suffix says, or cannot be read."""


def load_txt(data: bytes, path: str):
    return [(data.decode("utf-8"), {})]


def load_csv(data: bytes, path: str):
    """Cells joined by commas, one line a row; quoting is lost, the header is just a row."""
    rows = csv.reader(io.StringIO(data.decode("utf-8"), newline=""))
    return [("".join(",".join(r) + "\n" for r in rows), {"doc_type": "csv"})]


def load_eml(data: bytes, path: str):
    """The first plain part of a mail, or its plain body, stripped."""
    mail = message_from_bytes(data, policy=policy.default)
    part = next((p for p in mail.walk() if p.get_content_type() == "text/plain"), None) if mail.is_multipart() else mail
    body = part.get_content() if part is not None and part.get_content_maintype() == "text" else ""
    return [(body.strip(), {"source": path, "content_type": "email", "doc_type": "eml"})]


def _archive(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise UnsupportedFile(str(e)) from e


def _related(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Parts that a part of an archive refers to, by relation id."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    to = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return {r.get("Id"): to(r.get("Target")) for r in ElementTree.fromstring(z.read(rels)).iter() if r.get("Target") and r.get("TargetMode") != "External"}


def image_file(path: str, place: str, place_no: int, image_no: int) -> str:
    """Path of an extracted image under a project's input folder: <stem>_<place><n>_img<i>.png, blanks as underscores."""
    stem = posixpath.splitext(posixpath.basename(path))[0].replace(" ", "_")
    return f"cache/images/{stem}_{place}{place_no}_img{image_no}.png"


def _run_text(e) -> str:
    """Text of a paragraph's runs, those of its links included."""
    out = []
    for run in (x for c in e for x in ([c] if c.tag == f"{_W}r" else c.findall(f"{_W}r") if c.tag == f"{_W}hyperlink" else [])):
        for t in run:
            out.append(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag in (f"{_W}br", f"{_W}cr") else "-" if t.tag == f"{_W}noBreakHyphen" else "")
    return "".join(out)


def _table_rows(table) -> list[str]:
    """Rows of a table: texts of its cells by ' | ', empty ones left out; a cell over several columns or rows counts in each."""
    out, above = [], {}
    for row in table.findall(f"{_W}tr"):
        cells, at = [], 0
        for cell in row.findall(f"{_W}tc"):
            text = "\n".join(_run_text(p) for p in cell.findall(f"{_W}p")).strip()
            span, merge = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
            if merge is not None and merge.get(f"{_W}val") != "restart":
                text = above.get(at, text)
            for _ in range(int(span.get(f"{_W}val")) if span is not None else 1):
                above[at] = text
                cells.append(text)
                at += 1
        out.append(" | ".join(c for c in cells if c))
    return out


def load_docx(data: bytes, path: str):
    """A segment for every paragraph with text or images (numbered over all), then one for every table with text.

    An image that is used again is named again, but stored once."""
    z = _archive(data)
    if "word/document.xml" not in z.namelist():
        raise UnsupportedFile("no document")
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    related, saved = _related(z, "word/document.xml"), {}
    out, base = [], {"doc_type": "docx", "source_filepath": path, "doc_id": path}
    for n, p in enumerate(body.findall(f"{_W}p"), 1):
        content, paths, images = _run_text(p).strip(), [], []
        for blip in p.iter(f"{_A}blip"):
            part = related.get(blip.get(f"{_R}embed"))
            if part is None or part not in z.namelist():
                continue
            if part not in saved:
                saved[part] = image_file(path, "page", n, len(saved))
                images.append((saved[part], z.read(part)))
            paths.append(saved[part])
        if content or paths:
            out.append((content or IMAGE_ONLY["docx"], base | {"paragraph_number": n} | ({"image_paths": paths} if paths else {}), images))
    for n, table in enumerate(body.findall(f"{_W}tbl"), 1):
        rows = [r for r in _table_rows(table) if r]
        if rows:
            out.append(("\n".join(rows), base | {"table_number": n}))
    return out


def _shapes(xml: bytes):
    """The shapes of a slide in order; where there is no shape tree, the slide itself."""
    root = ElementTree.fromstring(xml)
    tree = next((e for e in root.iter() if e.tag.endswith("}spTree")), None)
    return list(tree) if tree is not None else [root]


def _shape_text(shape) -> str:
    bodies = [e for e in shape if e.tag.endswith("}txBody")]
    lines = lambda b: "\n".join("".join(r.text or "" if r.tag == f"{_A}t" else "\v" if r.tag == f"{_A}br" else "" for r in p.iter()) for p in b.iter(f"{_A}p"))
    return "\n".join(map(lines, bodies))


def _placeholder(shape) -> str | None:
    ph = next((e for e in shape.iter() if e.tag.endswith("}ph")), None)
    return None if ph is None else ph.get("type", "")


def load_pptx(data: bytes, path: str):
    """A segment for every slide with text or new images, in the presentation's order, followed by its notes.

    An image that the file has shown before is left out."""
    z = _archive(data)
    names, shown, out = set(z.namelist()), set(), []
    numbered = [m for m in (re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n) for n in names) if m]
    slides = [m[0] for m in sorted(numbered, key=lambda m: int(m[1]))]
    if "ppt/presentation.xml" in names:
        order, related = ElementTree.fromstring(z.read("ppt/presentation.xml")), _related(z, "ppt/presentation.xml")
        listed = [related.get(e.get(f"{_R}id")) for e in order.iter() if e.tag.endswith("}sldId")]
        slides = [n for n in listed if n in names] or slides
    if not slides:
        raise UnsupportedFile("no slides")
    for n, name in enumerate(slides, 1):
        related, texts, paths, images = _related(z, name), [], [], []
        for shape in _shapes(z.read(name)):
            if text := _shape_text(shape):
                texts.append(text.strip())
            if not shape.tag.endswith("}pic") or _placeholder(shape) is not None:
                continue
            part = next((related.get(b.get(f"{_R}embed")) for b in shape.iter(f"{_A}blip")), None)
            if part in names:
                blob = z.read(part)
                key = hashlib.sha1(blob).digest()
                if key not in shown:
                    shown.add(key)
                    paths.append(image_file(path, "slide", n, len(paths) + 1))
                    images.append((paths[-1], blob))
        if texts or paths:
            meta = {"slide_number": n, "type": "slide_content", "doc_type": "pptx"} | ({"image_paths": paths} if paths else {})
            out.append(("\n".join(texts).strip() or IMAGE_ONLY["pptx"], meta, images))
        notes = next((x for x in related.values() if "notesSlides/" in x and x in names), None)
        if notes:
            shapes = _shapes(z.read(notes))
            text = next((_shape_text(s) for s in shapes if len(shapes) == 1 or _placeholder(s) == "body"), "").strip()
            if text:
                out.append((f"Presenter Notes (Slide {n}):\n{text}", {"slide_number": n, "type": "presenter_notes", "doc_type": "pptx"}))
    return out


def _date(value: float, epoch: datetime.datetime) -> str:
    day, part = divmod(value, 1)
    spent = datetime.timedelta(milliseconds=round(part * 86_400_000))
    if 0 <= value < 1:
        return str((datetime.datetime.min + spent).time())
    return str(epoch + datetime.timedelta(days=day + (1 if 0 < value < 60 and epoch.year == 1899 else 0)) + spent)


def _cell(c, shared: list[str], dates: list[bool], epoch: datetime.datetime) -> str | None:
    """A cell's value as text; null for an empty cell."""
    v, kind = c.find(f"{_S}v"), c.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_S}t")) or None
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return str(v.text.strip() not in ("0", "false"))
    if kind == "d":
        return str(datetime.datetime.fromisoformat(v.text))
    if kind != "n":
        return v.text
    style = int(c.get("s") or 0)
    if style < len(dates) and dates[style]:
        return _date(float(v.text), epoch)
    return str(float(v.text) if re.search(r"[.eE]", v.text) else int(v.text))


def load_xlsx(data: bytes, path: str):
    """A segment for every 50 non-blank rows of a sheet: cells by tabs, row_range by physical row numbers.

    A group begins with the row after the one before; the last one ends with the sheet. Numbers,
    dates and booleans come out as Python writes them, errors by their name."""
    z = _archive(data)
    names = set(z.namelist())
    if "xl/workbook.xml" not in names:
        raise UnsupportedFile("no workbook")
    shared, dates = [], []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    if "xl/styles.xml" in names:
        styles = ElementTree.fromstring(z.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in styles.iter(f"{_S}numFmt")}
        is_date = lambda i: bool(re.search("[dmhys]", own[i].lower())) if i in own else i in _DATE_FORMATS
        dates = [is_date(int(x.get("numFmtId") or 0)) for x in styles.findall(f"{_S}cellXfs/{_S}xf")]
    book, related = ElementTree.fromstring(z.read("xl/workbook.xml")), _related(z, "xl/workbook.xml")
    late = any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_S}workbookPr"))
    epoch = datetime.datetime(1904, 1, 1) if late else datetime.datetime(1899, 12, 30)
    out = []
    for sheet in book.iter(f"{_S}sheet"):
        held, first, last = [], 1, 0

        def close(last):
            meta = {"doc_type": "xlsx", "sheet_name": sheet.get("name"), "row_range": f"{first}-{last}", "source_filepath": path, "type": "sheet_content"}
            out.append(("\n".join(held), meta))

        for row in ElementTree.fromstring(z.read(related[sheet.get(f"{_R}id")])).iter(f"{_S}row"):
            last = int(row.get("r") or last + 1)
            line = "\t".join(x for x in (_cell(c, shared, dates, epoch) for c in row.findall(f"{_S}c")) if x is not None)
            if line.strip():
                held.append(line)
            if len(held) == SHEET_ROWS:
                close(last)
                held, first = [], last + 1
        if held:
            close(last)
    return out


def load_pdf(data: bytes, path: str):
    """A segment for every page, with the document's metadata and the page's images."""
    try:
        book = pdf_files.Pdf(data)
        if "Encrypt" in book.trailer:
            raise UnsupportedFile("the PDF is encrypted and requires a password")
        pages, info = book.pages(), book.info()
        if not pages:
            raise UnsupportedFile("no pages found in the PDF")
        base = {"source_path": path, "doc_id": path, "source_filepath": path, "title": info.get("Title"), "author": info.get("Author"), "created": info.get("CreationDate"), "modified": info.get("ModDate"), "num_pages": len(pages)}
        out, fonts = [], {}
        for n, page in enumerate(pages, 1):
            blobs = pdf_files.page_images(book, page)
            paths = [image_file(path, "page", n, i) for i in range(1, len(blobs) + 1)]
            meta = base | {"doc_type": "pdf", "page_number": n} | ({"image_paths": paths} if paths else {})
            out.append((pdf_files.page_text(book, page, fonts) or IMAGE_ONLY["pdf"], meta, list(zip(paths, blobs))))
        return out
    except UnsupportedFile:
        raise
    except pdf_files.PdfError as e:
        raise UnsupportedFile(f"failed to parse the PDF, it might be corrupted: {e}") from e
    except Exception as e:
        raise UnsupportedFile(f"an unexpected error occurred while processing the PDF: {type(e).__name__}: {e}") from e


LOADERS: dict[str, Loader] = {".txt": load_txt, ".csv": load_csv, ".eml": load_eml, ".docx": load_docx, ".pptx": load_pptx, ".xlsx": load_xlsx, ".pdf": load_pdf}


def register(suffix: str, loader: Loader) -> None:
    """Use a loader for files of a suffix (with its dot; case matters) in read_files and read_images."""
    LOADERS[suffix] = loader


def _suffix(path: str) -> str:
    return "." + path.rsplit("/", 1)[-1].rsplit(".", 1)[-1]


def parsed(files: DataFrame, loaders: dict[str, Loader] | None = None) -> DataFrame:
    """(path, seq, content, meta, ok, error) of files (path, content) with a registered suffix.

    meta holds source_filepath and doc_type of the path, over which the loader's own keys win;
    numbers are text there and image_paths is a JSON array. A file that cannot be read, or whose
    bytes are null, gives one row with ok = false; the others are unaffected."""
    loaders = dict(loaders or LOADERS)

    def run(batches):
        import pyarrow as pa

        text = lambda v: json.dumps(v) if isinstance(v, list) else None if v is None else str(v)
        for batch in batches:
            out = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = {"source_filepath": path, "doc_type": _suffix(path)[1:]}
                try:
                    if data is None:
                        raise UnsupportedFile("no bytes")
                    out += [(path, k, s[0], [(a, text(v)) for a, v in (base | s[1]).items()], True, None) for k, s in enumerate(loaders[_suffix(path)](data, path))]
                except Exception as e:  # noqa: BLE001 - whatever a file's bytes cause must not end the job
                    out.append((path, 0, None, list(base.items()), False, f"{type(e).__name__}: {e}"))
            cols = list(zip(*out)) or [[]] * 6
            kinds = [pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "seq", "content", "meta", "ok", "error"])

    return _wanted(files, loaders).mapInArrow(run, SCHEMA)


def images_of(files: DataFrame, loaders: dict[str, Loader] | None = None) -> DataFrame:
    """(path, seq, image_path, content) of all images in files (path, content); seq is that of the image's segment. Unreadable files give none."""
    loaders = dict(loaders or LOADERS)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = [(k, name, blob) for k, s in enumerate(loaders[_suffix(path)](data, path)) for name, blob in (s[2] if len(s) > 2 else ())]
                except Exception:  # noqa: BLE001 - parsed() tells of it
                    continue
                if found:
                    seq, name, blob = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(seq)), pa.array(seq, pa.int32()), pa.array(name), pa.array(blob, pa.binary())], names=["path", "seq", "image_path", "content"])

    return _wanted(files, loaders).mapInArrow(run, IMAGES)


def _wanted(files: DataFrame, loaders: dict[str, Loader]) -> DataFrame:
    return files.select("path", "content").where(F.col("path").rlike(r"(?:" + "|".join(re.escape(s) for s in loaders) + ")$"))


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def read_files(spark: SparkSession, folder: str, loaders: dict[str, Loader] | None = None) -> DataFrame:
    """parsed() of all files under a folder."""
    return parsed(_scan(spark, folder), loaders)


def read_images(spark: SparkSession, folder: str, loaders: dict[str, Loader] | None = None) -> DataFrame:
    """images_of() all files under a folder."""
    return images_of(_scan(spark, folder), loaders)


def raw_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, name, size_kib) of the files under a folder; kind is the folder below it that holds them, no content is read."""
    files = _scan(spark, folder).select("path", "length")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("kind"), F.element_at(parts, -1).alias("name"), F.round(F.col("length") / 1024, 2).alias("size_kib"))
