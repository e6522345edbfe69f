"""Table functions in Python, called laterally: tables of HTML pages, sheets of Excel workbooks, entries of YAML texts.

Each class is made inside a function and imports what it needs in its methods, so that it travels to the executors by
value: they need nothing of this package. A page, workbook or text is one row; its rows stream out of it.
"""

from __future__ import annotations

from pyspark.sql.functions import udtf


def html_rows():
    """Table function (html) -> table_no, row_no, cells: the grid of each table, numbered from 0.

    A cell that spans columns or rows stands in each place that it spans, at most 1,000 and 65,534 as HTML has it; rows
    that only spans reach are added at the end. A row that is shorter than what a span from above leaves to its right
    has empty cells between. Tables that are not closed end with the page; a nested table's cells are its own.
    """

    @udtf(returnType="table_no int, row_no int, cells array<string>")
    class HtmlRows:
        def eval(self, html: str):
            from html.parser import HTMLParser

            tables: list[list[list[tuple[str, int, int]]]] = []

            def span(attrs, name: str, most: int) -> int:
                value = (dict(attrs).get(name) or "").strip()
                return min(int(value), most) if value.isascii() and value.isdigit() and len(value) < 9 else 1

            class Parser(HTMLParser):
                def __init__(self) -> None:
                    super().__init__()
                    self.open: list[list] = []  # [rows, cells or None, (texts, columns, rows) or None]

                def handle_starttag(self, tag: str, attrs) -> None:
                    if tag == "table":
                        tables.append([])
                        self.open.append([tables[-1], None, None])
                    elif self.open and tag == "tr":
                        self.close_row()
                        self.open[-1][1] = []
                    elif self.open and tag in ("td", "th"):
                        self.close_cell()
                        if self.open[-1][1] is None:
                            self.open[-1][1] = []
                        self.open[-1][2] = ([], max(1, span(attrs, "colspan", 1000)), span(attrs, "rowspan", 65534))

                def handle_data(self, data: str) -> None:
                    if self.open and self.open[-1][2]:
                        self.open[-1][2][0].append(data)

                def handle_endtag(self, tag: str) -> None:
                    if self.open:
                        if tag in ("td", "th"):
                            self.close_cell()
                        elif tag == "tr":
                            self.close_row()
                        elif tag == "table":
                            self.close_table()

                def close_cell(self) -> None:
                    top = self.open[-1]
                    if top[2]:
                        texts, columns, rows = top[2]
                        top[1].append((" ".join("".join(texts).split()), columns, rows))
                        top[2] = None

                def close_row(self) -> None:
                    self.close_cell()
                    top = self.open[-1]
                    if top[1]:
                        top[0].append(top[1])
                    top[1] = None

                def close_table(self) -> None:
                    self.close_row()
                    self.open.pop()

            parser = Parser()
            parser.feed(html or "")
            parser.close()
            while parser.open:
                parser.close_table()

            for table_no, rows in enumerate(tables):
                above: dict[int, tuple[str, int]] = {}  # column -> text and rows that it still spans
                row_no = 0

                def grid(cells, above):
                    line, below = [], {}

                    def take() -> None:
                        text, left = above.pop(len(line))
                        if left > 1:
                            below[len(line)] = (text, left - 1)
                        line.append(text)

                    for text, columns, spanned in cells:
                        while len(line) in above:
                            take()
                        for _ in range(columns):
                            if spanned != 1:  # 0 spans to the end of the table
                                below[len(line)] = (text, spanned - 1 if spanned else 1 << 30)
                            above.pop(len(line), None)
                            line.append(text)
                    while above:
                        if len(line) in above:
                            take()
                        else:
                            line.append("")
                    return line, below

                for cells in rows:
                    line, above = grid(cells, above)
                    yield table_no, row_no, line
                    row_no += 1
                above = {c: (t, left) for c, (t, left) in above.items() if left < 1 << 29}
                while above:
                    line, above = grid([], above)
                    yield table_no, row_no, line
                    row_no += 1

    return HtmlRows


def sheet_rows():
    """Table function (content, sheet) -> row_no, cells of one sheet of an Excel workbook (.xlsx), rows numbered as Excel does.

    A null sheet is the first one; a name that is not there raises. Cells without a value are null, and rows without any
    cell are not there. Dates are texts in ISO form, numbers texts as short as they go, errors null. The sheet's XML is
    streamed; what is held is the shared strings.
    """

    @udtf(returnType="row_no int, cells array<string>")
    class SheetRows:
        def eval(self, content: bytes, sheet: str):
            import datetime
            import io
            import re
            import xml.etree.ElementTree as ET
            import zipfile

            local = lambda e: e.tag.rpartition("}")[2]
            own = lambda e, name: next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)
            if content is None:
                return
            book = zipfile.ZipFile(io.BytesIO(bytes(content)))
            there = set(book.namelist())
            workbook = ET.fromstring(book.read("xl/workbook.xml"))
            since = next((e.get("date1904") for e in workbook.iter() if local(e) == "workbookPr"), None)
            start = datetime.datetime(1904, 1, 1) if since in ("1", "true") else datetime.datetime(1899, 12, 30)
            sheets = {e.get("name"): own(e, "id") for e in workbook.iter() if local(e) == "sheet"}
            name = next(iter(sheets), None) if sheet is None else sheet
            if name not in sheets:
                raise ValueError(f"no sheet {name!r}; there are {list(sheets)}")
            targets = {e.get("Id"): e.get("Target") for e in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
            target = targets[sheets[name]]
            target = target.lstrip("/") if target.startswith("/") else f"xl/{target}"

            def text_of(e) -> str:
                """The texts of an item, without those that say how it is read."""
                if local(e) == "t":
                    return e.text or ""
                return "".join(text_of(x) for x in e if local(x) not in ("rPh", "phoneticPr"))

            shared: list[str] = []
            if "xl/sharedStrings.xml" in there:
                with book.open("xl/sharedStrings.xml") as f:
                    for _, e in ET.iterparse(f):
                        if local(e) == "si":
                            shared.append(text_of(e))
                            e.clear()
            dated: list[bool] = []
            if "xl/styles.xml" in there:
                styles = ET.fromstring(book.read("xl/styles.xml"))
                formats = {e.get("numFmtId"): e.get("formatCode") or "" for e in styles.iter() if local(e) == "numFmt"}
                built_in = {*map(str, (*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))}
                told = lambda code: re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|general', "", code.lower()))
                for xfs in (e for e in styles if local(e) == "cellXfs"):
                    dated = [bool(told(formats[i])) if (i := x.get("numFmtId")) in formats else i in built_in for x in xfs]

            def number(raw: str, style: str | None) -> str:
                value = float(raw)
                if style is not None and int(style) < len(dated) and dated[int(style)]:
                    at = start + datetime.timedelta(seconds=round(value * 86400))
                    return at.date().isoformat() if at.time() == datetime.time() and value >= 1 else at.isoformat(" ")
                return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)

            def value_of(c) -> str | None:
                kind, v = c.get("t", "n"), next((x for x in c if local(x) in ("v", "is")), None)
                if v is None or kind == "e":
                    return None
                if kind == "inlineStr":
                    return text_of(v)
                raw = v.text or ""
                if kind == "s":
                    return shared[int(raw)]
                if kind == "b":
                    return "true" if raw == "1" else "false"
                if kind in ("str", "d"):
                    return raw
                return number(raw, c.get("s")) if raw else None

            def column(ref: str) -> int:
                n = 0
                for ch in re.match("[A-Z]*", ref)[0]:
                    n = 26 * n + ord(ch) - 64
                return n - 1

            last = 0
            with book.open(target) as f:
                for _, e in ET.iterparse(f):
                    if local(e) != "row":
                        continue
                    last = int(e.get("r") or last + 1)
                    cells: list[str | None] = []
                    for c in e:
                        if local(c) == "c":
                            place = column(c.get("r") or "")
                            place = len(cells) if place < 0 else place
                            cells += [None] * (place - len(cells))
                            cells[place:] = [value_of(c)]
                    if cells:
                        yield last, cells
                    e.clear()

    return SheetRows


def yaml_rows():
    """Table function (text) -> place, path, value: the scalars of a YAML text in order, paths by dots, entries of lists by number.

    Mappings and lists nest by indentation, in brackets and braces on one line too; scalars are plain, quoted, literal (|)
    or folded (>), and comments go. Empty and null (~) values are null. Anchors, tags and further documents are not read.
    A line that is none of this raises.
    """

    @udtf(returnType="place int, path string, value string")
    class YamlRows:
        def eval(self, text: str):
            import re

            key = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\[\]{},"'&*!|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?=\s|$)""")
            escapes = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}

            def scalar(raw: str) -> str | None:
                raw = raw.strip()
                if raw[:1] == '"':
                    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else escapes.get(m[1], m[1]), raw[1:-1])
                if raw[:1] == "'":
                    return raw[1:-1].replace("''", "'")
                return None if raw in ("", "~", "null", "Null", "NULL") else raw

            def bare(raw: str) -> str:
                """Without a comment behind it."""
                m = re.match(r"""\s*(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*')\s*(?=#|$)""", raw)
                return m[0] if m else re.sub(r"(^|\s)#.*", "", raw)

            def parted(inner: str) -> list[str]:
                """Entries between commas that stand in no quotes and no brackets."""
                out, depth, quote, begin = [], 0, "", 0
                for i, ch in enumerate(inner):
                    if quote:
                        quote = "" if ch == quote and inner[i - 1] != "\\" else quote
                    elif ch in "\"'" and not inner[begin:i].strip():
                        quote = ch
                    elif ch in "[{":
                        depth += 1
                    elif ch in "]}":
                        depth -= 1
                    elif ch == "," and not depth:
                        out.append(inner[begin:i])
                        begin = i + 1
                return [*out, inner[begin:]] if inner[begin:].strip() else out

            def inline(path: str, raw: str):
                raw = raw.strip()
                at = lambda name: f"{path}.{name}" if path else name
                if raw[:1] == "[" and raw[-1:] == "]":
                    for k, part in enumerate(parted(raw[1:-1])):
                        yield from inline(at(str(k)), part)
                elif raw[:1] == "{" and raw[-1:] == "}":
                    for part in parted(raw[1:-1]):
                        m = key.match(part.strip())
                        if not m:
                            raise ValueError(f"no key in {part.strip()!r}")
                        yield from inline(at(scalar(m[1])), part.strip()[m.end() :])
                else:
                    yield path, scalar(raw)

            lines, out = (text or "").replace("\r\n", "\n").split("\n"), []
            stack: list[list] = [[-1, "", 0]]  # [indentation, path, entries of a list so far]
            i = 0
            while i < len(lines):
                line = lines[i]
                i += 1
                if not line.strip() or line.lstrip()[0] == "#" or line.strip() in ("---", "..."):
                    continue
                if "\t" in line[: len(line) - len(line.lstrip())]:
                    raise ValueError(f"line {i} is indented by tabs")
                indent, rest = len(line) - len(line.lstrip()), line.strip()
                while True:  # a list's dashes and a mapping's keys may begin one behind the other on one line
                    item = rest == "-" or rest.startswith("- ")
                    while stack[-1][0] > indent or (stack[-1][0] == indent and not (item and stack[-1][2] is None)):
                        stack.pop()  # an entry of a list may stand under its key without indentation
                    up = stack[-1]
                    if item:
                        holder = next(s for s in reversed(stack) if s[0] < indent or s[2] is None)
                        holder[3:] = [holder[3] + 1 if len(holder) > 3 else 0]
                        path = f"{holder[1]}.{holder[3]}" if holder[1] else str(holder[3])
                        stack.append([indent, path, 0])
                        inner = rest[1:].lstrip()
                        indent += len(rest) - len(inner)
                        rest = inner
                        if key.match(rest) or rest.startswith("- "):
                            continue
                        value = rest
                    else:
                        m = key.match(rest)
                        if not m:
                            raise ValueError(f"line {i} is neither a key nor an entry: {rest[:40]!r}")
                        path = f"{up[1]}.{scalar(m[1])}" if up[1] else scalar(m[1])
                        stack.append([indent, path, None])
                        value = rest[m.end() :]
                    break
                value = bare(value).strip()
                if re.fullmatch(r"[|>][-+]?", value):
                    block, own = [], stack[-1][0]
                    while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip()) > own):
                        block.append(lines[i])
                        i += 1
                    while block and not block[-1].strip():
                        block.pop()
                    cut = min((len(b) - len(b.lstrip()) for b in block if b.strip()), default=0)
                    block = [b[cut:] for b in block]
                    made = "\n".join(block) if value[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(block)).replace("\n\n", "\n")
                    out.append((path, made + ("" if value.endswith("-") or not block else "\n")))
                elif value:
                    out += inline(path, value)
                else:
                    deeper = next((n for n in lines[i:] if n.strip() and n.lstrip()[0] != "#"), "")
                    far = len(deeper) - len(deeper.lstrip())
                    nested = deeper and (far > stack[-1][0] or (far == stack[-1][0] and stack[-1][2] is None and deeper.lstrip().startswith(("- ", "-\n")) or deeper.strip() == "-" and far >= stack[-1][0]))
                    if not nested:
                        out.append((path, None))
            for place, (path, value) in enumerate(out):
                yield place, path, value

    return YamlRows
