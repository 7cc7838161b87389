"""Rows of a section from its XML events: paragraphs, saved lines, fields, pictures, cells and tables, in one walk.

A paragraph's text is that of the ``t`` elements of its own runs, with line breaks and tabs as characters; text of
nested tables belongs to the paragraphs in their cells.
"""

from __future__ import annotations

#: Elements of a ``t`` that stand for a character.
_CHARACTERS = {"lineBreak": "\n", "tab": "\t"}


def _int(attributes: dict[str, str], name: str, otherwise: int = 0) -> int:
    try:
        return int(attributes.get(name, otherwise))
    except ValueError:
        return otherwise


class Section:
    """Takes the begins and ends of elements; ``rows`` grows as paragraphs, cells and tables end."""

    def __init__(self, number: int):
        self.rows: list[dict] = []
        self._number = number
        self._path: list[str] = []
        self._node = self._paragraphs = self._tables = self._fields = 0
        #: Open elements of each kind, the innermost last.
        self._paras: list[dict] = []
        self._open_tables: list[dict] = []
        self._cells: list[dict] = []
        self._pictures: list[dict] = []
        self._begins: list[dict] = []

    def _under(self, *names: str) -> bool:
        return self._path[-len(names) :] == list(names)

    def start(self, tag: str, a: dict[str, str]) -> None:
        self._node += 1
        para = self._paras[-1] if self._paras else None
        own = para is not None and len(self._path) == para["depth"] + 1 and self._path[-1] == "run"  # right below a run of the paragraph
        if tag == "p":
            self._paras.append({"kind": "paragraph", "section_no": self._number, "node": self._node, "para_idx": self._paragraphs, "in_cell": bool(self._cells), "style_id": a.get("styleIDRef"), "para_pr_id": a.get("paraPrIDRef"), "line_segs": 0, "has_table": False, "has_secpr": False, "depth": len(self._path) + 1, "said": [], "in_text": 0, "mute": 0, "pictures": [], "of_cell": self._under("tc", "subList"), "of_caption": self._under("tbl", "caption", "subList") or self._under("tbl", "caption")})
            self._paragraphs += 1
        elif tag in ("fieldBegin", "fieldEnd"):
            begins = tag == "fieldBegin"
            row = {"kind": "field", "section_no": self._number, "node": self._node, "ord": self._fields, "side": "begin" if begins else "end", "field_id": a.get("id") if begins else a.get("beginIDRef"), "field_type": a.get("type"), "url": None}
            self._fields += 1
            self.rows.append(row)
            if begins:
                self._begins.append({"row": row, "depth": len(self._path) + 1, "command": 0, "said": []})
        elif para is not None and para["in_text"]:
            if not para["mute"] and len(self._path) == para["in_text"] and tag in _CHARACTERS:
                para["said"].append(_CHARACTERS[tag])
                para["mute"] = len(self._path) + 1
        elif tag == "t" and own:
            para["in_text"] = len(self._path) + 1
        elif tag == "tbl":
            if own:
                para["has_table"] = True
            self._open_tables.append({"kind": "table", "section_no": self._number, "node": self._node, "table_index": self._tables, "para_idx": para["para_idx"] if para else None, "row_cnt": _int(a, "rowCnt"), "col_cnt": _int(a, "colCnt"), "page_break": a.get("pageBreak"), "treat_as_char": 0, "depth": len(self._path) + 1, "captions": []})
            self._tables += 1
        elif tag == "secPr" and own:
            para["has_secpr"] = True
        elif tag == "pic" and own:
            self._pictures.append({"kind": "picture", "section_no": self._number, "node": self._node, "para_idx": para["para_idx"], "depth": len(self._path) + 1, "sizes": {}, "ref": None, "said": None})
        elif tag == "tc" and self._under("tbl", "tr"):
            table = self._open_tables[-1]
            self._cells.append({"kind": "cell", "section_no": self._number, "node": self._node, "table_index": table["table_index"], "row": 0, "col": 0, "row_span": 1, "col_span": 1, "width": 0, "height": 0, "depth": len(self._path) + 1, "texts": []})
        elif tag == "lineseg" and para is not None and self._under("p", "linesegarray") and len(self._path) == para["depth"] + 1:
            self.rows.append({"kind": "line", "section_no": self._number, "para_idx": para["para_idx"], "line_no": para["line_segs"]} | {n: _int(a, n) for n in ("textpos", "vertpos", "vertsize", "spacing")})
            para["line_segs"] += 1
        self._details(tag, a)
        self._path.append(tag)

    def _details(self, tag: str, a: dict[str, str]) -> None:
        """Attributes that stand in elements below a picture, cell, table or field."""
        depth = len(self._path)
        if self._pictures:
            pic = self._pictures[-1]
            if tag in ("curSz", "sz"):
                pic["sizes"][tag] = (_int(a, "width"), _int(a, "height"))
            elif tag == "img":
                pic["ref"] = a.get("binaryItemIDRef")
            elif tag == "shapeComment":
                pic["said"] = []
        if self._cells and depth == (cell := self._cells[-1])["depth"]:
            if tag == "cellAddr":
                cell |= {"row": _int(a, "rowAddr"), "col": _int(a, "colAddr")}
            elif tag == "cellSpan":
                cell |= {"row_span": _int(a, "rowSpan", 1), "col_span": _int(a, "colSpan", 1)}
            elif tag == "cellSz":
                cell |= {"width": _int(a, "width"), "height": _int(a, "height")}
        if tag == "pos" and self._open_tables and depth == self._open_tables[-1]["depth"]:
            self._open_tables[-1]["treat_as_char"] = _int(a, "treatAsChar")
        if self._begins and a.get("name") == "Command" and not self._begins[-1]["command"] and self._begins[-1]["row"]["url"] is None:
            self._begins[-1] |= {"command": depth + 1, "said": []}

    def characters(self, data: str) -> None:
        para = self._paras[-1] if self._paras else None
        if para is not None and para["in_text"] and not para["mute"]:
            para["said"].append(data)
        if self._pictures and self._pictures[-1]["said"] is not None and "shapeComment" in self._path:
            self._pictures[-1]["said"].append(data)
        if self._begins and self._begins[-1]["command"] == len(self._path):
            self._begins[-1]["said"].append(data)

    def end(self, tag: str) -> None:
        depth = len(self._path)
        self._path.pop()
        if self._begins and self._begins[-1]["command"] and depth == self._begins[-1]["command"]:
            begin = self._begins[-1]
            begin["row"]["url"], begin["command"] = "".join(begin["said"]) or None, 0
        if self._begins and depth == self._begins[-1]["depth"]:
            self._begins.pop()
        if self._pictures and depth == self._pictures[-1]["depth"]:
            pic = self._pictures.pop()
            width, height = pic["sizes"].get("curSz") or pic["sizes"].get("sz") or (0, 0)
            said = pic["said"]
            row = {k: pic[k] for k in ("kind", "section_no", "node", "para_idx", "ref")} | {"stop": self._node, "width": width, "height": height, "comment": "".join(said) if said is not None else None}
            self._paras[-1]["pictures"].append(row)
        if self._cells and depth == self._cells[-1]["depth"]:
            cell = self._cells.pop()
            text = "\n".join(cell.pop("texts"))
            del cell["depth"]
            self.rows.append(cell | {"stop": self._node, "text": text})
        if self._open_tables and depth == self._open_tables[-1]["depth"]:
            table = self._open_tables.pop()
            caption = "\n".join(table.pop("captions")) or None
            del table["depth"]
            self.rows.append(table | {"stop": self._node, "caption": caption})
        if self._paras:
            para = self._paras[-1]
            if para["mute"] == depth:
                para["mute"] = 0
            if para["in_text"] == depth:
                para["in_text"] = 0
            if para["depth"] == depth:
                self._end_paragraph(self._paras.pop())

    def _end_paragraph(self, para: dict) -> None:
        text = "".join(para["said"])
        if para["of_cell"] and self._cells:
            self._cells[-1]["texts"].append(text)
        if para["of_caption"] and self._open_tables:
            self._open_tables[-1]["captions"].append(text)
        self.rows += [r | {"caption": text} for r in para["pictures"]]
        keep = ("kind", "section_no", "node", "para_idx", "in_cell", "style_id", "para_pr_id", "line_segs", "has_table", "has_secpr")
        self.rows.append({k: para[k] for k in keep} | {"stop": self._node, "text": text, "line_breaks": text.count("\n")})
