"""Text of files by format, from their bytes: one Arrow function over a batch, errors as data."""

from __future__ import annotations

import csv
import html
import io
import json
import re
import shutil
import subprocess
import tempfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanspark.functions.text import HTML_ENTITIES, HTML_SPACE, HTML_STEPS
from gleanspark.sources.formats import FORMATS, IMAGE_SUFFIXES, decode_bytes

BAR = " | "
READERS: dict[str, Callable[[bytes, str], str]] = {}


def reader(*names: str):
    """Register a function of (bytes, suffix) for formats."""

    def add(f):
        READERS.update(dict.fromkeys(names, f))
        return f

    return add


def read(name: str, data: bytes, suffix: str = "") -> str:
    if name not in READERS:
        raise ValueError(f"there is no reader for {name!r}")
    return READERS[name](data, suffix)


def local(node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def flat(node) -> str:
    return " ".join(t for t in (x.strip() for x in node.itertext()) if t)


def children(node, *names: str) -> Iterator:
    return (c for c in node if local(c) in names)


def below(node, name: str) -> list:
    return [c for c in node.iter() if local(c) == name]


def html_text(raw: str) -> str:
    for pattern, to in ((r"(?is)<(script|style|head)[^>]*>.*?</\1>", " "), (r"(?i)<(?:br|/p|/div|/tr|/h[1-6]|/li)\s*/?>", "\n"), (r"(?s)<[^>]+>", " ")):
        raw = re.sub(pattern, to, raw)
    return re.sub(r"\n{3,}", "\n\n", re.sub("[ \t]+", " ", html.unescape(raw))).strip()


@reader("plain", "markdown")
def _plain(data, suffix):
    return decode_bytes(data)


@reader("html")
def _html(data, suffix):
    return html_text(decode_bytes(data))


@reader("html_basic")
def _html_basic(data, suffix):
    """As ``strip_html`` does it: the entities of its table only, and white space of HTML only."""
    raw = decode_bytes(data)
    for pattern, to in HTML_STEPS:
        raw = re.sub(pattern, to, raw, flags=re.ASCII)
    for entity, to in HTML_ENTITIES:
        raw = raw.replace(entity, to)
    return re.sub(r"\n{3,}", "\n\n", re.sub("[ \t]+", " ", raw)).strip(HTML_SPACE)


@reader("xml")
def _xml(data, suffix):
    text = decode_bytes(data)
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return html_text(text)
    found = (v for e in root.iter() if local(e).lower() not in ("script", "style") for v in (e.text, e.tail))
    return "\n".join(v.strip() for v in found if v and v.strip())


@reader("json")
def _json(data, suffix):
    text = decode_bytes(data)

    def again(s, **how):
        return json.dumps(json.loads(s), ensure_ascii=False, **how)

    try:
        return again(text, indent=2)
    except json.JSONDecodeError:
        out = []
        for s in text.splitlines():
            if s := s.strip():
                try:
                    out.append(again(s))
                except json.JSONDecodeError:
                    out.append(s)
        return "\n".join(out)


@reader("csv")
def _csv(data, suffix):
    text = decode_bytes(data)
    try:
        mark = csv.Sniffer().sniff(text[:8192], ",;\t|").delimiter
    except csv.Error:
        mark = "\t" if suffix in (".tsv", ".tab") else ","
    return "\n".join(BAR.join(c.strip() for c in r) for r in csv.reader(io.StringIO(text), delimiter=mark))


_RTF = ((r"(?s)\{\\\*.*?\}", " "), (r"\\pard?\b", "\n"), (r"\\tab\b", "\t"), (r"\\[a-zA-Z]+-?\d*\s?", " "), (r"[{}]", " "), (r"[ \t]{2,}", " "))


@reader("rtf")
def _rtf(data, suffix):
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), decode_bytes(data))
    for pattern, to in _RTF:
        text = re.sub(pattern, to, text)
    return text.strip()


@reader("email")
def _email(data, suffix):
    import email
    from email import policy

    m = email.message_from_bytes(data, policy=policy.default)
    head = [f"{k}: {m[k]}" for k in "From To Cc Date Subject".split() if m[k]]
    try:
        body = m.get_body(("plain", "html"))
        text = "" if body is None else body.get_content()
        if body is not None and body.get_content_subtype() == "html":
            text = html_text(text)
    except (LookupError, ValueError, TypeError, AttributeError):
        text = decode_bytes(m.get_payload(decode=True) or b"")
    if names := [n for n in (p.get_filename() for p in m.iter_attachments()) if n]:
        head.append("Attachments: " + ", ".join(names))
    return "\n".join(head) + "\n\n" + (text or "")


@reader("pdf")
def _pdf(data, suffix):
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("text of PDF files needs pypdf") from e
    out = []
    for i, page in enumerate(pypdf.PdfReader(io.BytesIO(data)).pages, 1):
        try:
            text = page.extract_text() or ""
        except Exception:  # noqa: BLE001 - whatever a damaged page raises, the others are read
            text = ""
        if text.strip():
            out.append(f"--- page {i} ---\n{text}")
    return "\n\n".join(out)


class _Parts:
    """Members of an office container; damage of any kind is one error that names the format."""

    def __init__(self, data: bytes, what: str):
        self.what = what
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise RuntimeError(f"not a readable {what} file") from e
        self.names = self.zip.namelist()

    def tree(self, name: str):
        try:
            return ET.fromstring(self.zip.read(name))
        except (KeyError, zipfile.BadZipFile, ET.ParseError) as e:
            raise RuntimeError(f"not a readable {self.what} file") from e

    def numbered(self, pattern: str) -> list[str]:
        found = {n: m for n in self.names if (m := re.fullmatch(pattern, n))}
        return sorted(found, key=lambda n: int(found[n][1]))


@reader("docx")
def _docx(data, suffix):
    root = _Parts(data, ".docx").tree("word/document.xml")
    return "\n".join(_word_blocks(next(children(root, "body"), root)))


def _word_blocks(node) -> Iterator[str]:
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    for c in node:
        if local(c) == "p":
            if text := "".join((x.text or "") if local(x) == "t" else marks.get(local(x), "") for x in c.iter()).strip():
                yield text
        elif local(c) == "tbl":
            for r in children(c, "tr"):
                cells = [" ".join(_word_blocks(t)).strip() for t in children(r, "tc")]
                if any(cells):
                    yield BAR.join(cells)


@reader("pptx")
def _pptx(data, suffix):
    z, out = _Parts(data, ".pptx"), []
    said = lambda name: [t for t in map(flat, below(z.tree(name), "p")) if t]
    for i, name in enumerate(z.numbered(r"ppt/slides/slide(\d+)\.xml"), 1):
        out += [f"--- slide {i} ---", *said(name)]
        notes = f"ppt/notesSlides/notesSlide{i}.xml"
        if notes in z.names and (spoken := [t for t in said(notes) if t != str(i)]):
            out.append("[speaker notes] " + " ".join(spoken))
        out.append("")
    return "\n".join(out).strip()


@reader("xlsx")
def _xlsx(data, suffix):
    z, out = _Parts(data, ".xlsx"), []
    shared = [flat(s) for s in children(z.tree("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in z.names else []
    titles = [s.get("name", "") for s in below(z.tree("xl/workbook.xml"), "sheet")] if "xl/workbook.xml" in z.names else []

    def cell(c) -> str:
        if c.get("t") == "inlineStr":
            return next(map(flat, children(c, "is")), "")
        v = next(children(c, "v"), None)
        if v is None or v.text is None:
            return ""
        if c.get("t") != "s":
            return v.text.strip()
        try:
            return shared[int(v.text)].strip()
        except (ValueError, IndexError):
            return ""

    for i, name in enumerate(z.numbered(r"xl/worksheets/sheet(\d+)\.xml")):
        out.append(f"--- sheet: {titles[i] if i < len(titles) else f'sheet{i + 1}'} ---")
        for r in below(z.tree(name), "row"):
            cells = [cell(c) for c in children(r, "c")]
            filled = max((k + 1 for k, c in enumerate(cells) if c), default=0)
            if filled:
                out.append(BAR.join(cells[:filled]))
        out.append("")
    return "\n".join(out).strip()


@reader("odt", "odp", "ods")
def _open_document(data, suffix):
    def blocks(node):
        for c in node:
            space = c.tag.partition("}")[0].rpartition(":")[0].rpartition(":")[2] if isinstance(c.tag, str) else ""
            if local(c) == "table-row" and space == "table":
                cells = [flat(x) for x in children(c, "table-cell")]
                if any(cells):
                    yield BAR.join(cells)
            elif local(c) in ("p", "h") and space == "text":
                if text := flat(c):
                    yield text
            else:
                yield from blocks(c)

    return "\n".join(blocks(_Parts(data, "OpenDocument").tree("content.xml")))


@reader("epub")
def _epub(data, suffix):
    z = _Parts(data, ".epub")
    pages = (html_text(decode_bytes(z.zip.read(n))) for n in sorted(z.names) if n.lower().endswith((".xhtml", ".html", ".htm")))
    return "\n\n".join(p for p in pages if p)


@reader("doc")
def _doc(data, suffix):
    if data.startswith(b"{\\rtf"):
        return _rtf(data, suffix)
    if data.startswith(b"PK\x03\x04"):
        return _docx(data, suffix)
    office = shutil.which("soffice") or shutil.which("libreoffice")
    with tempfile.TemporaryDirectory() as d:  # a converter wants a file; it is gone when the text is there
        with open(f"{d}/a.doc", "wb") as f:
            f.write(data)
        if shutil.which("antiword"):
            done = subprocess.run(["antiword", f.name], capture_output=True, check=False, timeout=120)
            if done.returncode == 0 and done.stdout.strip():
                return decode_bytes(done.stdout)
        if office:
            subprocess.run([office, "--headless", "--convert-to", "txt:Text", "--outdir", d, f.name], capture_output=True, check=False, timeout=300)
            try:
                with open(f"{d}/a.txt", "rb") as f:
                    return decode_bytes(f.read())
            except OSError:
                pass
    raise RuntimeError("old .doc files need antiword or LibreOffice on the executors")


@reader("png", "jpeg", "gif", "webp", "tiff", "bmp")
def _image(data, suffix):
    return ""


MEDIA = {"pptx": ("ppt/media/",), "docx": ("word/media/",), "odt": ("Pictures/",), "odp": ("Pictures/",), "epub": ("",)}


def embedded_media(name: str, data: bytes, most: int = 20) -> list[tuple[str, bytes]]:
    """(name, bytes) of the images in a container, by member name; none from a damaged one."""
    if name not in MEDIA:
        return []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            members = [n for n in sorted(z.namelist()) if n.lower().endswith(IMAGE_SUFFIXES) and n.startswith(MEDIA[name])]
            return [(n.rpartition("/")[2], z.read(n)) for n in members[:most]]
    except (zipfile.BadZipFile, OSError):
        return []


def text_of(format_name: Column, content: Column, suffix: Column) -> Column:
    """struct(text, error): what a file says, or why it can't be read. Null formats are errors."""

    @arrow_udf("struct<text: string, error: string>")
    def run(names: pa.Array, contents: pa.Array, suffixes: pa.Array) -> pa.Array:
        texts, errors = [], []
        for n, c, s in zip(names.to_pylist(), contents, suffixes.to_pylist()):
            text, error = None, None
            if n is None:
                error = "UnsupportedFormat: the format can't be told"
            else:
                try:
                    text = read(n, c.as_py() or b"", s or "").encode("utf-8", "replace").decode()
                except Exception as e:  # noqa: BLE001 - a file's damage is a row's error, never a task's
                    error = f"{type(e).__name__}: {e}"
            texts.append(text)
            errors.append(error)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["text", "error"])

    return run(format_name, content, suffix)


def figures_of(format_name: Column, content: Column, name: Column, most: int = 20) -> Column:
    """array<struct<image, content>>: an image file itself, or the images in a container; at most ``most``, the option's meaning."""

    @arrow_udf("array<struct<image: string, content: binary>>")
    def run(formats: pa.Array, contents: pa.Array, names: pa.Array) -> pa.Array:
        out = []
        for f, c, n in zip(formats.to_pylist(), contents, names.to_pylist()):
            how = FORMATS[f].figures if f in FORMATS else "none"
            found = [(n, c.as_py())] if how == "self" else embedded_media(f, c.as_py() or b"", most) if how == "embedded" else []
            out.append([{"image": i, "content": b} for i, b in found[:most]])
        return pa.array(out, pa.list_(pa.struct([("image", pa.string()), ("content", pa.binary())])))

    # containers and images only: other contents never leave the JVM for this
    wanted = format_name.isin(*[f.name for f in FORMATS.values() if f.figures in ("self", "embedded")])
    return F.coalesce(run(F.when(wanted, format_name), F.when(wanted, content), name), F.array())


def page_needs_vision(page: Column) -> Column:
    """Of struct(text_length, images, drawings) of a page: little text, an image, or many drawings; unknown pages do."""
    return F.coalesce((page["text_length"] < 200) | (page["images"] > 0) | (page["drawings"] >= 12), F.lit(True))
