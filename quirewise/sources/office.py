"""Per-file decoding helpers for Office files: zip and XML from the standard library.

They run inside Spark tasks, one file at a time; everything around them is a Spark job.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

# Number format ids that show a date or a time.
DATE_FORMAT_IDS = [14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47]
DATE_LETTERS = re.compile(r"[ymdhs]", re.IGNORECASE)
QUOTED_OR_BRACKETED = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(element, name: str = "t") -> str:
    return "".join(e.text or "" for e in element.iter() if _local(e.tag) == name)


def column_name(index: int) -> str:
    letters = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _xml(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name))


def _targets(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relationship id to part name."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in archive.namelist():
        return {}
    return {
        r.get("Id"): posixpath.normpath(posixpath.join("/", folder, r.get("Target"))).lstrip("/")
        for r in _xml(archive, rels)
        if r.get("TargetMode") != "External"
    }


def _relation_id(element) -> str:
    return next(v for k, v in element.attrib.items() if _local(k) == "id" and k != "id")


def _date_styles(archive: zipfile.ZipFile) -> list[bool]:
    if "xl/styles.xml" not in archive.namelist():
        return []
    root = _xml(archive, "xl/styles.xml")
    custom = {
        int(e.get("numFmtId")): bool(DATE_LETTERS.search(QUOTED_OR_BRACKETED.sub("", e.get("formatCode", ""))))
        for e in root.iter()
        if _local(e.tag) == "numFmt"
    }
    formats = next((e for e in root if _local(e.tag) == "cellXfs"), [])
    ids = [int(x.get("numFmtId", 0)) for x in formats]
    return [custom.get(i, i in DATE_FORMAT_IDS) for i in ids]


def _date_text(serial: float, from_1904: bool) -> str:
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    moment = start + timedelta(milliseconds=round(serial * 86_400_000))
    return moment.isoformat(sep=" ")


def _number_text(text: str) -> str:
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def read_workbook(content: bytes) -> Iterator[tuple[str, int, dict, dict]]:
    """``(sheet, row_no, cells, kinds)`` for every data row of every sheet.

    The first row that holds anything is the header; it comes as a row without ``row_no``.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in archive.namelist():
            strings = [_texts(e) for e in _xml(archive, "xl/sharedStrings.xml") if _local(e.tag) == "si"]
        dates = _date_styles(archive)
        targets = _targets(archive, "xl/workbook.xml")
        book = _xml(archive, "xl/workbook.xml")
        from_1904 = any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book)
        for entry in (e for e in book.iter() if _local(e.tag) == "sheet"):
            with archive.open(targets[_relation_id(entry)]) as part:
                yield from _sheet_rows(part, entry.get("name"), strings, dates, from_1904)


def _sheet_rows(part, sheet: str, strings: list[str], dates: list[bool], from_1904: bool):
    """Rows as the XML streams by; blank rows keep their place."""
    header: list[str] | None = None
    row_no = last = blank = 0
    for _, element in ElementTree.iterparse(part):
        if _local(element.tag) != "row":
            continue
        row: dict[int, tuple[str, str]] = {}
        position = -1
        for c in element:
            position = column_index(c.get("r")) if c.get("r") else position + 1
            value = _cell(c, strings, dates, from_1904)
            if value is not None:
                row[position] = value
        number = int(element.get("r", last + 1))
        blank += number - last - 1
        last = number
        element.clear()
        if header is None:
            blank = 0
            if row:
                header = _header(row)
                yield sheet, None, dict.fromkeys(header), {}
            continue
        if not row:
            blank += 1
            continue
        for _ in range(blank):  # blank rows count only when data follows
            yield sheet, row_no, dict.fromkeys(header), dict.fromkeys(header)
            row_no += 1
        blank = 0
        cells = {name: row[i][0] if i in row else None for i, name in enumerate(header)}
        kinds = {name: row[i][1] if i in row else None for i, name in enumerate(header)}
        yield sheet, row_no, cells, kinds
        row_no += 1
    if header is None:
        yield sheet, None, {}, {}


def _header(row: dict[int, tuple[str, str]]) -> list[str]:
    """Header names; a blank one is named by position, a repeated one gets a number."""
    names: list[str] = []
    used: dict[str, int] = {}
    for i in range(max(row) + 1):
        name = row[i][0] if i in row else f"Unnamed: {i}"
        seen = used.get(name, 0)
        used[name] = seen + 1
        names.append(f"{name}.{seen}" if seen else name)
    return names


def _cell(c, strings: list[str], dates: list[bool], from_1904: bool) -> tuple[str, str] | None:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return _texts(c), "text"
    raw = next((e.text for e in c if _local(e.tag) == "v"), None)
    if raw is None:
        return None
    if kind == "s":
        return strings[int(raw)], "text"
    if kind == "b":
        return ("true" if raw == "1" else "false"), "bool"
    if kind == "e":
        return None
    if kind == "d":
        return raw.replace("T", " "), "date"
    if kind == "n":
        style = int(c.get("s", 0))
        if style < len(dates) and dates[style]:
            return _date_text(float(raw), from_1904), "date"
        return _number_text(raw), "number"
    return raw, "text"


def read_docx(content: bytes) -> str:
    """Paragraph texts of the document body, one per line; paragraphs inside tables are not listed."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = next(e for e in _xml(archive, "word/document.xml") if _local(e.tag) == "body")
        return "\n".join(_paragraph(p) for p in body if _local(p.tag) == "p")


def _paragraph(p) -> str:
    out = []
    for run in p:
        runs = [run] if _local(run.tag) == "r" else [r for r in run if _local(r.tag) == "r"] if _local(run.tag) == "hyperlink" else []
        for r in runs:
            for e in r:
                name = _local(e.tag)
                out.append((e.text or "") if name == "t" else "\t" if name == "tab" else "\n" if name in ("br", "cr") else "")
    return "".join(out)


def read_pptx(content: bytes) -> str:
    """Every text run on its own line, slides in show order."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        targets = _targets(archive, "ppt/presentation.xml")
        show = _xml(archive, "ppt/presentation.xml")
        slides = [targets[_relation_id(e)] for e in show.iter() if _local(e.tag) == "sldId"]
        return "\n".join(run for slide in slides for run in _slide_runs(_xml(archive, slide)))


def _slide_runs(slide) -> Iterator[str]:
    tree = next(e for e in slide.iter() if _local(e.tag) == "spTree")
    for shape in (e for e in tree if _local(e.tag) == "sp"):
        for body in (e for e in shape if _local(e.tag) == "txBody"):
            for run in (e for p in body if _local(p.tag) == "p" for e in p if _local(e.tag) == "r"):
                yield _texts(run)
