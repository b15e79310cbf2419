"""Text expressions: tokens, trimming, hashing, mail cleaning, previews."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .whitespace import LINE_END, WS

#: First character up to last character of the Hebrew block. Fixed values.
_RTL = f"[{chr(0x0590)}-{chr(0x05FF)}]"
#: A line that opens a quoted earlier message. Fixed value.
REPLY_LINE = "^(On .+ wrote:|From: .+)$"


def tokens(text) -> Column:
    """Whitespace tokens in order; null for null, none for a blank text."""
    return F.filter(F.split(text, f"{WS}+"), lambda x: x != "")


def token_count(text) -> Column:
    """Number of whitespace tokens; null for null."""
    return F.when(_col(text).isNotNull(), F.size(tokens(text)))


def normalized(text) -> Column:
    """Tokens joined by single spaces: line ends and outer white space are lost."""
    return F.array_join(tokens(text), " ")


def stripped(text) -> Column:
    """Text without outer white space (all 29 characters, not only blanks)."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def content_hash(text) -> Column:
    """SHA-256 (hex) of the stripped text in UTF-8."""
    return F.sha2(stripped(text).cast("binary"), 256)


def segment_hash(content, image_paths) -> Column:
    """SHA-256 of the stripped content and the image paths joined by commas, nothing in between."""
    paths = F.array_join(F.coalesce(image_paths, F.array().cast("array<string>")), ",")
    return F.sha2(F.concat(stripped(content), paths).cast("binary"), 256)


def bytes_hash(blob) -> Column:
    """SHA-256 of bytes."""
    return F.sha2(blob, 256)


def lines(text) -> Column:
    """Lines of a text at any of the line ends; a text's last line end opens no further line."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def cleaned(text, quoted: bool = True, replies: bool = True, signature: bool = True, delimiter: str = "-- ", strict: bool = True) -> Column:
    """A mail's text without signature, earlier messages and quoted lines; each step can be left out.

    signature: drop from the first line on that, stripped, starts with the delimiter. With the
    default delimiter a line of nothing but it is not recognised, as stripping takes its blank;
    strict=False also recognises that line. replies: drop from the first line on that opens an
    earlier message. quoted: drop lines that, stripped, start with '>'.
    """
    all_lines = F.transform(lines(text), lambda x: F.struct(x.alias("raw"), stripped(x).alias("s")))

    def cut(x):
        stop = F.lit(False)
        if signature:
            stop = stop | x["s"].startswith(delimiter)
            if not strict:
                stop = stop | (x["s"] == delimiter.strip())
        if replies:
            stop = stop | x["s"].rlike(REPLY_LINE)
        return stop

    if signature or replies:
        marks = F.transform(all_lines, cut)
        first = F.array_position(marks, True)
        all_lines = F.when(first > 0, F.slice(all_lines, 1, first.cast("int") - 1)).otherwise(all_lines)
    if quoted:
        all_lines = F.filter(all_lines, lambda x: ~x["s"].startswith(">"))
    return stripped(F.array_join(F.transform(all_lines, lambda x: x["raw"]), "\n"))


def direction(text) -> Column:
    """'rtl' if the text has a character of the Hebrew block, else 'ltr'; null for null."""
    return F.when(_col(text).rlike(_RTL), "rtl").when(_col(text).isNotNull(), "ltr")


def preview(text, length: int = 80) -> Column:
    """The first characters, stripped, line feeds as blanks."""
    return F.translate(stripped(F.substring(text, 1, length)), "\n", " ")


def long_preview(text, length: int = 500) -> Column:
    """The first characters and three dots."""
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def context_prefix(text, length: int = 500) -> Column:
    """The first characters as they are."""
    return F.substring(text, 1, length)


def stem(path) -> Column:
    """File name without directory and last suffix, blanks as underscores."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.replace(F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name), F.lit(" "), F.lit("_"))


def project_root(path) -> Column:
    """The path up to its first data/projects/<name>; null where there is none."""
    return F.nullif(F.regexp_extract(path, "^(.*?data/projects/[^/]+)(?:/|$)", 1), F.lit(""))


def image_name(path, place: str, place_no, image_no) -> Column:
    """Name of an extracted image: <stem>_page<n>_img<i>.png, or another place word."""
    return F.format_string(f"%s_{place}%d_img%d.png", stem(path), place_no, image_no)


def filled(template: str, **values) -> Column:
    """A template with {{ name }} and {name} replaced by columns; braces elsewhere stay as they are."""
    out = F.lit(template)
    for name, value in values.items():
        for form in (f"{{{{ {name} }}}}", f"{{{name}}}"):
            out = F.replace(out, F.lit(form), F.coalesce(_col(value).cast("string"), F.lit("")))
    return out


def base64_text(blob) -> Column:
    """Base64 of bytes on one line."""
    return F.regexp_replace(F.base64(blob), "[\r\n]", "")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
