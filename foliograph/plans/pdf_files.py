"""PDF files of every make, from conversations: sealed, packed, damaged, updated, linked.

The engine itself writes plain files only. These builders make what it has to read, so
that queries can compare what comes out with the tables the files were made from.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from ..sources.pdf import Name, Ref, Stream, Text
from ..sources.pdf_crypt import PADDING, Aes, hash_2b, rc4
from ..sources.pdf_write import printed, text_value, written

ROW = 16  # bytes of a row that predictors work on


def base_objects(texts: list[str]) -> tuple[list[object], list[int]]:
    """(objects, numbers of the pages): a catalog, a tree, a font, a page for each text."""
    objects: list = [{"Type": Name("Catalog"), "Pages": Ref(2)}, None, {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}]
    pages = []
    for text in texts:
        objects.append(Stream({}, text.encode()))
        objects.append({"Type": Name("Page"), "Parent": Ref(2), "Contents": Ref(len(objects)), "Resources": {"Font": {"F1": Ref(3)}}})
        pages.append(len(objects))
    objects[1] = {"Type": Name("Pages"), "Kids": [Ref(p) for p in pages], "Count": len(pages), "MediaBox": [0, 0, 595, 842]}
    return objects, pages


# -- sealed ------------------------------------------------------------------------------


def _legacy_keys(revision: int, user: bytes, owner: bytes, permissions: int, first: bytes) -> tuple[bytes, bytes, bytes]:
    """(file key, O, U) of revisions 2 to 4."""
    size, more = (5, 0) if revision == 2 else (16, 50)
    steps = range(20 if revision > 2 else 1)

    def again(data: bytes, keep: int) -> bytes:
        for _ in range(more):
            data = hashlib.md5(data[:keep]).digest()
        return data

    def turned(key: bytes, data: bytes) -> bytes:
        for k in steps:
            data = rc4(bytes(b ^ k for b in key), data)
        return data

    o = turned(again(hashlib.md5((owner + PADDING)[:32]).digest(), 16)[:size], (user + PADDING)[:32])
    key = again(hashlib.md5((user + PADDING)[:32] + o + struct.pack("<i", permissions) + first).digest(), size)[:size]
    u = turned(key, PADDING) if revision == 2 else turned(key, hashlib.md5(PADDING + first).digest()) + bytes(16)
    return key, o, u


def _modern_keys(revision: int, user: bytes, owner: bytes) -> tuple[bytes, dict]:
    """(file key, entries) of revisions 5 and 6."""
    made = hash_2b if revision == 6 else lambda p, salt, extra: hashlib.sha256(p + salt + extra).digest()
    key, u_salts, o_salts = bytes(range(7, 39)), (b"checking", b"wrapping"), (b"CHECKING", b"WRAPPING")
    u = made(user, u_salts[0], b"") + b"".join(u_salts)
    o = made(owner, o_salts[0], u) + b"".join(o_salts)
    wrap = lambda p, salt, extra: Aes(made(p, salt, extra)).chain_encrypt(bytes(16), key)
    return key, {"U": Text(u), "O": Text(o), "UE": Text(wrap(user, u_salts[1], b"")), "OE": Text(wrap(owner, o_salts[1], u))}


def sealed_file(objects: list[object], revision: int, method: str, user: str, owner: str, permissions: int) -> bytes:
    """The objects' strings and streams encrypted, with the dictionary that opens them."""
    first = hashlib.md5(f"{revision}{user}".encode()).digest()
    if revision >= 5:
        key, entries = _modern_keys(revision, user.encode(), owner.encode())
    else:
        key, o, u = _legacy_keys(revision, user.encode(), owner.encode(), permissions, first)
        entries = {"O": Text(o), "U": Text(u)}
    head = {"Filter": Name("Standard"), "V": {2: 1, 3: 2, 4: 4}.get(revision, 5), "R": revision, "P": permissions, "Length": 128} | entries
    if revision >= 4:
        head |= {"CF": {"StdCF": {"CFM": Name(method)}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}

    def locked(num: int, data: bytes) -> bytes:
        own = key if revision >= 5 else hashlib.md5(key + struct.pack("<I", num)[:3] + b"\0\0" + b"sAlT" * (method == "AESV2")).digest()[: min(len(key) + 5, 16)]
        if method == "V2":
            return rc4(own, data)
        pad = 16 - len(data) % 16
        start = hashlib.md5(data).digest()
        return start + Aes(own).chain_encrypt(start, data + bytes([pad]) * pad)

    def inner(num: int, value: object) -> object:
        if isinstance(value, Text):
            return Text(locked(num, value))
        if isinstance(value, list):
            return [inner(num, v) for v in value]
        if isinstance(value, dict):
            return {k: inner(num, v) for k, v in value.items()}
        return Stream(inner(num, value.head), locked(num, value.raw)) if isinstance(value, Stream) else value

    data = written([*(inner(k, v) for k, v in enumerate(objects, 1)), head], 1)
    ids = f"[<{first.hex()}> <{first.hex()}>]".encode()
    return data.replace(b"trailer\n<<", b"trailer\n<< /Encrypt %d 0 R /ID %s" % (len(objects) + 1, ids))


# -- packed ------------------------------------------------------------------------------


def _guess(kind: int, left: int, up: int, corner: int) -> int:
    if kind == 4:
        base = left + up - corner
        return min((left, up, corner), key=lambda v: abs(base - v))
    return {1: left, 2: up, 3: (left + up) // 2}[kind]


def predicted(data: bytes, kind: int) -> bytes:
    """Rows of ROW bytes, each as its differences from what a PNG predictor guesses."""
    out, last = bytearray(), bytes(ROW)
    for at in range(0, len(data), ROW):
        row = data[at : at + ROW]
        out.append(kind)
        out += bytes((row[k] - _guess(kind, row[k - 1] if k else 0, last[k], last[k - 1] if k else 0)) & 255 for k in range(ROW))
        last = row
    return bytes(out)


def coded(text: str, way: int) -> Stream:
    """A text as a stream in one of ten ways, with spaces up to whole rows."""
    data = text.encode()
    data += b" " * (-len(data) % ROW)
    flate, parms = Name("FlateDecode"), {"Columns": ROW, "Colors": 1, "BitsPerComponent": 8}
    if way == 0:
        return Stream({}, data)
    if 2 <= way <= 5:
        return Stream({"Filter": [flate], "DecodeParms": [parms | {"Predictor": 10 + way}]}, zlib.compress(predicted(data, way - 1)))
    if way == 6:
        rows = [data[k : k + ROW] for k in range(0, len(data), ROW)]
        steps = b"".join(bytes((r[k] - (r[k - 1] if k else 0)) & 255 for k in range(ROW)) for r in rows)
        return Stream({"Filter": flate, "DecodeParms": parms | {"Predictor": 2}}, zlib.compress(steps))
    packed = zlib.compress(data)
    if way == 7:
        return Stream({"Filter": flate}, packed[:-2] + b"xx")  # a wrong checksum
    if way == 8:
        return Stream({"Filter": flate}, packed[2:-4])  # neither header nor checksum
    return Stream({"Filter": [flate, Name("Identity"), flate] if way == 9 else flate}, zlib.compress(packed) if way == 9 else packed)


def packed_file(objects: list[object], junk: bytes = b"") -> bytes:
    """Plain objects in one compressed container, places in a cross-reference stream
    whose rows are predicted; junk goes before the header."""
    plain = [k for k, v in enumerate(objects, 1) if not isinstance(v, Stream)]
    heads, body = [], b""
    for k in plain:
        heads.append(f"{k} {len(body)}")
        body += printed(objects[k - 1]) + b" "
    head = (" ".join(heads) + " ").encode()
    box, table = len(objects) + 1, len(objects) + 2
    streams = {k: v for k, v in enumerate(objects, 1) if isinstance(v, Stream)}
    streams[box] = Stream({"Type": Name("ObjStm"), "N": len(plain), "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(head + body))
    out, rows = b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n", {k: (2, box, n) for n, k in enumerate(plain)}
    for k, v in streams.items():
        rows[k] = (1, len(out), 0)
        out += b"%d 0 obj\n" % k + printed(v) + b"\nendobj\n"
    rows[table] = (1, len(out), 0)
    last, coded_rows = bytes(7), b""
    for k in range(1, table + 1):
        a, b, c = rows[k]
        row = struct.pack(">BIH", a, b, c)
        coded_rows += b"\2" + bytes((x - y) & 255 for x, y in zip(row, last, strict=True))
        last = row
    told = Stream({"Type": Name("XRef"), "Size": table + 1, "W": [1, 4, 2], "Index": [1, table], "Root": Ref(1), "Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 7}}, zlib.compress(coded_rows))
    return junk + out + b"%d 0 obj\n" % table + printed(told) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % len(out)


# -- damaged and updated -----------------------------------------------------------------


def damaged_file(objects: list[object], way: int) -> bytes:
    """A file whose places are lost in one of five ways; in the fourth the first page's
    content (object 4) comes once more, with each a as A, and the later one counts."""
    data = packed_file(objects) if way == 2 else written(objects, 1)
    if way == 1:
        return data.replace(b"1 0 obj", b"%% moved\n1 0 obj", 1)
    if way == 3:
        newer = Stream({}, objects[3].raw.replace(b"a", b"A"))
        data += b"4 0 obj\n" + printed(newer) + b"\nendobj\n"
    if way == 4:
        data = data.replace(b"trailer", b"trial  ")
    return re.sub(rb"startxref\s+\d+", b"startxref\n0", data)


def updated_file(objects: list[object], changed: dict[int, object], freed: list[int], hybrid: bool) -> bytes:
    """Two updates after the file: one replaces objects, told by a table or, if hybrid,
    by a stream beside an empty table; the last frees numbers, which brings older objects
    back."""
    data = written(objects, 1)
    before = int(re.findall(rb"startxref\s+(\d+)", data)[-1])
    size, places = len(objects) + 2, {}
    for k, v in changed.items():
        places[k] = len(data)
        data += b"%d 0 obj\n" % k + printed(v) + b"\nendobj\n"
    trailer = {"Size": size, "Root": Ref(1), "Prev": before}
    if hybrid:
        at = len(data)
        index = [x for k in places for x in (k, 1)]
        rows = b"".join(struct.pack(">BIH", 1, o, 0) for o in places.values())
        data += b"%d 0 obj\n" % (size - 1) + printed(Stream({"Type": Name("XRef"), "Size": size, "W": [1, 4, 2], "Index": index, "Root": Ref(1)}, rows)) + b"\nendobj\n"
        trailer["XRefStm"], sections = at, b"0 0 \n"
    else:
        sections = b"".join(b"%d 1\n%010d 00000 n \n" % (k, o) for k, o in places.items())
    first = len(data)
    data += b"xref\n" + sections + b"trailer\n" + printed(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % first
    last = len(data)
    data += b"xref\n" + b"".join(b"%d 1\n%010d 00001 f \n" % (k, 0) for k in freed) + b"trailer\n" + printed({"Size": size, "Root": Ref(1), "Prev": first})
    return data + b"\nstartxref\n%d\n%%%%EOF\n" % last


# -- trees, outlines, links, forms ---------------------------------------------------------


def tree_objects(texts: list[str]) -> list[object]:
    """Pages in nodes of three; the second of a node is turned, and kids hold nulls,
    repeats and the root itself. The last page is a tree node with contents only."""
    objects, pages = base_objects(texts)
    tops = []
    for n, at in enumerate(range(0, len(pages), 3)):
        own = pages[at : at + 3]
        objects.append({"Type": Name("Pages"), "Parent": Ref(2), "MediaBox": [0, 0, 100, n], "Kids": [Ref(own[0]), None, *map(Ref, own), Ref(2)]})
        tops.append(Ref(len(objects)))
        if len(own) > 1:
            objects[own[1] - 1]["Rotate"] = 90
    objects[pages[-1] - 1]["Type"] = Name("Pages")
    objects[1]["Kids"] = [*tops, tops[0]]
    objects[0]["Pages"] = Ref(2)
    return objects


def _goal(page: int, n: int, names: dict, tree: list) -> dict:
    """What leads to the n-th page (object page), by one of six ways."""
    explicit, way = [Ref(page), Name("Fit")], n % 6
    if way == 1:
        names[f"n{n}"] = explicit
        return {"Dest": Name(f"n{n}")}
    if way == 2:
        tree.append({"Names": [Text(f"t{n}".encode()), explicit]})
        return {"Dest": Text(f"t{n}".encode())}
    if way == 3:
        return {"Dest": [n - 1, Name("Fit")]}
    if way == 4:
        return {"A": {"S": Name("GoTo"), "D": explicit}}
    if way == 5:
        names[f"d{n}"] = {"D": explicit}
        return {"Dest": Name(f"d{n}")}
    return {"Dest": explicit}


def linked_objects(texts: list[str], roles: list[str], opened: bool) -> list[object]:
    """Bookmarks (other turns below a user's), links to the next page and the one after,
    and a form with a field for each role that has a widget on each of its pages."""
    objects, pages = base_objects(texts)
    names, tree = {}, []

    def put(value: object) -> Ref:
        objects.append(value)
        return Ref(len(objects))

    goals = [_goal(p, n, names, tree) for n, p in enumerate(pages, 1)]
    top = put({"Type": Name("Outlines")})
    levels: dict[int, list[Ref]] = {top.num: []}
    parent = top
    for n, role in enumerate(roles, 1):
        over = top if n == 1 or role == "user" else parent
        own = put({"Title": text_value(f"{role} ñ {n}"), "Parent": over} | goals[n - 1])
        levels[over.num].append(own)
        if over is top:
            parent = own
            levels[own.num] = []
    for num, kids in levels.items():
        if kids:
            objects[num - 1] |= {"First": kids[0], "Last": kids[-1], "Count": len(kids) if opened else -len(kids)}
        for a, b in zip(kids, kids[1:], strict=False):
            objects[a.num - 1]["Next"], objects[b.num - 1]["Prev"] = b, a
    fields: dict[str, Ref] = {}
    for n, (role, page) in enumerate(zip(roles, pages, strict=True), 1):
        notes = [put({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [0, 0, 9, 9]} | goals[n + step - 1]) for step in (1, 2) if n + step <= len(pages)]
        if role not in fields:
            fields[role] = put({"FT": Name("Tx"), "T": Text(role.encode()), "V": Text(b"v"), "Kids": []})
        widget = put({"Type": Name("Annot"), "Subtype": Name("Widget"), "Rect": [0, 0, 9, 9], "Parent": fields[role]})
        objects[fields[role].num - 1]["Kids"].append(widget)
        objects[page - 1]["Annots"] = [*notes, widget]
    objects[0] |= {"Outlines": top, "Dests": names, "Names": {"Dests": {"Kids": [put(x) for x in tree]}}, "AcroForm": {"Fields": list(fields.values()), "SigFlags": 3}}
    return objects


def files_of(conversations: DataFrame, made: Callable[[int, pd.DataFrame], bytes]) -> DataFrame:
    """(doc_id, conv_id, content): a file for each conversation, from its turns in order."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("turn")
        conv = int(rows["conv_id"].iloc[0])
        return pd.DataFrame([{"doc_id": str(conv), "conv_id": conv, "content": made(conv, rows)}])

    return conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandas(one, "doc_id string, conv_id long, content binary")
