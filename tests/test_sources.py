import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanspark.sources import files, formats, readers, rest


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_X", ".xml"), data)
    return out.getvalue()


W_ = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = packed(**{"word__document_X": f"<w:document {W_}><w:body><w:p><w:r><w:t>Results</w:t><w:tab/><w:t>here</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>12.5</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>", "word__media__b.png": b"\x89PNG\r\n\x1a\nb", "word__media__a.png": b"\x89PNG\r\n\x1a\na"})
A_ = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
PPTX = packed(**{f"ppt__slides__slide{i}_X": f"<s {A_}><a:p><a:r><a:t>slide {i}</a:t></a:r></a:p></s>" for i in (10, 2)} | {"ppt__notesSlides__notesSlide1_X": f"<s {A_}><a:p><a:r><a:t>1</a:t></a:r></a:p><a:p><a:r><a:t>said 4.5</a:t></a:r></a:p></s>"})
S_ = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
XLSX = packed(**{"xl__workbook_X": f'<workbook {S_}><sheets><sheet name="Measurements"/></sheets></workbook>', "xl__sharedStrings_X": f"<sst {S_}><si><t>group</t></si></sst>", "xl__worksheets__sheet1_X": f'<worksheet {S_}><sheetData><row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>unit</t></is></c><c><v> 3 </v></c><c/></row><row><c/></row></sheetData></worksheet>'})
ODT = packed(mimetype="application/vnd.oasis.opendocument.text", content_X='<d xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"><text:p>Results</text:p><table:table-row><table:table-cell><text:p>A</text:p></table:table-cell><table:table-cell><text:p>4</text:p></table:table-cell></table:table-row></d>')
EPUB = packed(**{"META-INF__container_X": "<c/>", "b.xhtml": "<p>two</p>", "a.html": "<p>one</p>"})
EML = b"From: a@x.org\nTo: b@x.org\nSubject: Dose\nMIME-Version: 1.0\nContent-Type: text/html; charset=utf-8\n\n<p>5 &micro;g</p>"
PNG = b"\x89PNG\r\n\x1a\n0000"


@pytest.mark.parametrize("data, suffix, want", [
    (b"%PDF-1.7", ".txt", "pdf"), (PNG, "", "png"), (b"\xff\xd8\xff\xe0", ".dat", "jpeg"), (b"GIF89a..", "", "gif"), (b"BM..", "", "bmp"), (b"II*\0", "", "tiff"), (b"{\\rtf1 x}", ".doc", "rtf"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "", "doc"),
    (b"RIFF0000WEBPVP8 ", "", "webp"), (b"  \n<?xml version='1.0'?><a/>", "", "xml"), (b"\t<!DOCTYPE HTML><p>", "", "html"), (b"<HTML>", ".txt", "html"), (DOCX, ".zip", "docx"), (PPTX, "", "pptx"), (XLSX, "", "xlsx"), (ODT, "", "odt"), (EPUB, "", "epub"),
    (b"a,b\n1,2", ".csv", "csv"), (b"plain words", "", "plain"), (b"caf\xe9 is mostly printable", "", "plain"), (b"\x00\x01\x02", "", None), (b"\xff\xfe\x81\x82", "", None), (b"PK\x03\x04broken", ".docx", "docx"), (b"", ".md", "markdown"), (b"", "", None),
])
def test_detection(spark, data, suffix, want):
    df = spark.createDataFrame([(bytearray(data), suffix)], "c binary, s string")
    assert df.select(formats.detected(F.col("c"), F.col("s")).alias("x")).first().x == want


def test_formats(spark):
    assert formats.formats_table(spark).count() == 23 and formats.format_for_suffix(".DOCM").name == "docx" and formats.format_for_suffix(".zz") is None
    assert ".jsonl" in formats.supported_suffixes() and len(formats.describe_formats()) == 23
    assert formats.register_format(formats.Format("own", (".txt", ".own"), "text", "text/own")).name == "own" and formats.format_for_suffix(".txt").name == "plain" and formats.format_for_suffix(".own").name == "own"
    del formats.FORMATS["own"], formats._BY_SUFFIX[".own"]
    paths = spark.createDataFrame([("/a/b.TXT",), ("/a/.hidden",), ("/a.b/c",), ("x.tar.gz",)], "p string").select(formats.suffix_of(F.col("p")).alias("s")).collect()
    assert [r.s for r in paths] == [".txt", "", "", ".gz"]


@pytest.mark.parametrize("data, want", [(b"\xef\xbb\xbfa", "a"), ("é".encode("utf-16"), "é"), ("é".encode("utf-32"), "é"), ("é".encode(), "é"), (b"\x93x\x94", "“x”"), (b"\x81\xe9", "\x81é")])
def test_decode(data, want):
    assert formats.decode_bytes(data) == want


@pytest.mark.parametrize("name, data, suffix, want", [
    ("plain", "Café".encode("cp1252"), "", "Café"), ("html", b"<head><title>t</title></head><p>a&amp;b &eacute;</p><script>x</script>c", "", "a&b é\n c"), ("xml", b"<a>x<b> y </b>z<script>no</script>no</a>", "", "x\ny\nz"), ("xml", b"<a>x & y", "", "x & y"),
    ("json", b'{"a":[1]}', "", '{\n  "a": [\n    1\n  ]\n}'), ("json", b'{"a":1}\n\nbad\n{"b": "\xc3\xa9"}', ".jsonl", '{"a": 1}\nbad\n{"b": "é"}'), ("csv", b"group;unit\nA; mg \n", ".csv", "group | unit\nA | mg"), ("csv", b"solo", ".tsv", "solo"),
    ("rtf", rb"{\rtf1{\*\gen x;}\b Group\b0 A\par 12.5 \'b5g\tab x}", "", "Group A\n 12.5 µg x"), ("email", EML, "", "From: a@x.org\nTo: b@x.org\nSubject: Dose\n\n5 µg"), ("docx", DOCX, "", "Results\there\nA | 12.5"),
    ("pptx", PPTX, "", "--- slide 1 ---\nslide 2\n[speaker notes] said 4.5\n\n--- slide 2 ---\nslide 10"), ("xlsx", XLSX, "", "--- sheet: Measurements ---\ngroup | unit | 3"), ("odt", ODT, "", "Results\nA | 4"), ("epub", EPUB, "", "one\n\ntwo"), ("doc", DOCX, "", "Results\there\nA | 12.5"), ("png", PNG, "", ""),
])
def test_readers(name, data, suffix, want):
    assert readers.read(name, data, suffix) == want


def test_reader_errors():
    for name in ("docx", "pptx", "xlsx", "odt", "epub"):
        with pytest.raises(RuntimeError):
            readers.read(name, b"no zip")
    with pytest.raises(ValueError):
        readers.read("unknown", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    (d / "sub dir").mkdir()
    for name, data in (("a.txt", b"Group A reached 12.5 ug/mL."), ("sub dir/b c.DOCX", DOCX), ("p.png", PNG), (".x.txt", b"no"), ("z.pyc", b"no"), ("noext", b"words only"), ("bad.docx", b"PK\x03\x04bad"), ("twin.txt", b"Group A reached 12.5 ug/mL."), ("empty.txt", b"")):
        (d / name).write_bytes(data)
    return d


def test_folder(spark, folder):
    docs = {r.doc_id: r for r in files.folder_source(spark, str(folder)).drop("content").collect()}
    assert set(docs) == {"a", "sub_dir__b_c", "p", "bad", "twin"}
    assert docs["sub_dir__b_c"].media_type == "docx" and docs["a"].content_hash == docs["twin"].content_hash and docs["a"].metadata["relative_path"] == "a.txt"
    assert {r.name for r in files.discover(spark, str(folder)).select("name").collect()} == {"a.txt", "b c.DOCX", "p.png", "noext", "bad.docx", "twin.txt"}
    assert [r.name for r in files.discover(spark, str(folder), ["TXT"], limit=1).select("name").collect()] == ["a.txt"]
    assert files.discover(spark, str(folder / "a.txt")).count() == 1


def test_load(spark, folder):
    got = {r.doc_id: r for r in files.load_documents(files.folder_source(spark, str(folder)), with_figures=True).drop("content").collect()}
    assert got["a"].text.startswith("Group A") and got["a"].has_text_layer and got["a"].format == "plain"
    assert [f.image for f in got["sub_dir__b_c"].figures] == ["a.png", "b.png"] and got["p"].figures[0].content == PNG and not got["p"].has_text_layer
    assert got["bad"].status == "failed" and "RuntimeError" in got["bad"].read_error


def test_page_needs_vision(spark):
    df = spark.createDataFrame([(1, (500, 0, 0)), (2, (100, 0, 0)), (3, (500, 1, 0)), (4, (500, 0, 12)), (5, None)], "k int, p struct<text_length: int, images: int, drawings: int>")
    assert [r.x for r in df.orderBy("k").select(readers.page_needs_vision(F.col("p")).alias("x")).collect()] == [False, True, True, True, True]


def page_server(rows, size, by="page"):
    def fetch(url):
        from urllib.parse import parse_qs, urlparse

        q = {k: v[0] for k, v in parse_qs(urlparse(url).query).items()}
        own = [r for r in rows if q.get("query", "") in r.get("t", "") + r.get("abstractText", "") + str(r.get("title"))]
        at = (int(q["page"]) - 1) * size if by == "page" else int(q.get("offset", 0)) if by == "offset" else int(q.get("cursor", 0))
        return {"results": own[at : at + size], "next_cursor": str(at + size) if at + size < len(own) else None, "total": len(own)}

    return fetch


@pytest.mark.parametrize("paging", ["page", "offset", "cursor"])
def test_rest_pages(spark, paging):
    rows = [{"id": f"x/{i}", "title": f"T{i}", "t": "alpha" if i < 4 else "alpha beta", "tags": ["a", "", "b"]} for i in range(7)] + [{"title": "without id", "t": "beta"}]
    s = rest.build_source("rest", base_url="http://h", path="/p", paging=paging, page_size=3, text_fields=("t", "tags"), fetcher=page_server(rows, 3, paging))
    got = s.documents(spark, ["beta", "alpha"]).orderBy("term_idx", "pos").collect()
    assert [(r.doc_id, r.term_idx) for r in got] == [("x_4", 0), ("x_5", 0), ("x_6", 0), ("x_0", 1), ("x_1", 1), ("x_2", 1), ("x_3", 1)]
    assert got[0].text == "## t\nalpha beta\n\n## tags\na\nb" and json.loads(got[0].metadata)["search_term"] == "beta"
    assert s.documents(spark).count() == 7
    two = rest.build_source("rest", base_url="http://h", paging=paging, page_size=3, max_records=2, fetcher=page_server(rows, 3, paging))
    assert two.documents(spark, ["alpha"]).count() == 2 and json.loads(two.documents(spark).first().metadata)["raw"]["id"] == "x/0"


def test_rest_stops_and_presets(spark):
    asked = []
    same = rest.build_source("rest", page_size=1, fetcher=lambda url: asked.append(url) or {"results": [{"id": 1}]})
    assert len(list(same.pages())) == 2 and len(list(rest.build_source("rest", paging="none", fetcher=same.fetcher).pages())) == 1
    assert rest.dig({"a": [{"b": 1}]}, "a.0.b") == 1 and rest.dig({"a": []}, "a.0", 5) == 5 and rest.dig(3, "") == 3
    raw = {"id": "1", "title": "t", "abstractText": "words", "doi": "10.1/x", "pubYear": "2020", "journalInfo": {"journal": {"title": "J"}}}
    doc = rest.SOURCES["europepmc"].document(raw)
    assert doc["uri"] == "https://doi.org/10.1/x" and doc["metadata"]["journal"] == "J" and doc["text"] == "## abstractText\nwords"
    doc = rest.SOURCES["openalex"].document({"id": "https://o/W1", "display_name": "D", "abstract_inverted_index": {"b": [1], "a": [0, 2]}})
    assert doc["doc_id"] == "https:__o_W1" and doc["text"] == "## title\nD\n\n## abstract\na b a"
    doc = rest.SOURCES["patents"].document({"patent_id": 7, "patent_title": "P", "claims": ["c1", "c2"], "assignees": [{"name": "N"}], "patent_date": "2001"})
    assert doc["doc_id"] == "7" and doc["metadata"]["assignee"] == "N" and doc["metadata"]["filing_date"] == "2001" and doc["text"] == "## claims\nc1\nc2"
    assert rest.available_sources() == ["europepmc", "folder", "openalex", "patents", "rest"]
    with pytest.raises(KeyError):
        rest.build_source("nothing")


def test_search_terms(tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("# head\n\nAlpha Vaccine\nalpha   vaccine\nbeta\n")
    assert rest.read_search_terms(str(p)) == ["Alpha Vaccine", "beta"]
    p = tmp_path / "t.csv"
    p.write_text('Query,n\n"a, b",1\nc,2\n')
    assert rest.read_search_terms(str(p)) == ["a, b", "c"]
