"""PDF bytes to objects: scanner, cross references, filters, recovery, pages, names.

Values are None, bool, int, float, Text (bytes), Name, Ref, list, dict and Stream. The
scanner is one regular expression and an explicit stack, so nesting can't exhaust the
interpreter. Every problem with a whole file is a PdfError, which the DataFrame source
turns into a status row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np


class PdfError(ValueError):
    """A file that can't be read."""


class PasswordError(PdfError):
    """None of the passwords opens the file."""


class Name(str):
    __slots__ = ()


class Text(bytes):
    """A string's bytes, unescaped; shown_hex only says how it was written."""

    shown_hex = False


@dataclass(frozen=True)
class Ref:
    num: int
    gen: int = 0


@dataclass
class Stream:
    head: dict
    raw: bytes = b""
    start: int = -1
    sealed: bool = False  # still encrypted


WHITE = b"\0\t\n\x0c\r "
_TOKEN = re.compile(rb"(?:[\0\t\n\x0c\r ]+|%[^\r\n]*)*(?:(?P<ref>(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+R(?![^\0\t\n\x0c\r ()<>\[\]{}/%]))|(?P<open><<|\[)|(?P<close>>>|\])|(?P<name>/[^\0\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<hex><[^>]*>?)|(?P<text>\()|(?P<word>[^\0\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<odd>.))", re.S)
_INT, _REAL = re.compile(rb"[+-]?\d+"), re.compile(rb"[+-]?(?:\d+\.\d*|\.\d+)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}
_TEXT_PART = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|\r|\n)|(.))|([()])|(\r\n?)|([^\\()\r]+)", re.S)
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+obj(?![a-zA-Z])")


def _literal(data: bytes, at: int) -> tuple[Text, int]:
    """The string whose opening parenthesis is before at, and where it ends."""
    out, depth = [], 1
    while (m := _TEXT_PART.match(data, at)) is not None:
        at = m.end()
        octal, line_end, other, paren, cr, run = m.groups()
        if octal:
            out.append(bytes([int(octal, 8) & 255]))
        elif other is not None:
            out.append(_ESCAPES.get(other, other))
        elif paren:
            depth += 1 if paren == b"(" else -1
            if not depth:
                break
            out.append(paren)
        elif cr:
            out.append(b"\n")
        elif run:
            out.append(run)
    return Text(b"".join(out)), at


def _word(word: bytes) -> object:
    """A number or keyword; malformed numbers are 0, unknown keywords null."""
    if word in (b"true", b"false"):
        return word == b"true"
    if word[:1] in b"+-.0123456789":
        if _INT.fullmatch(word):
            n = int(word)
            return n if -(1 << 63) <= n < 1 << 63 else float(n)
        if _REAL.fullmatch(word):
            return float(word)
        return 0.0 if b"." in word else 0
    return None


def scan(data: bytes, at: int = 0) -> tuple[object, int, bytes]:
    """(value, end, keyword): the value at a position; keyword if it was a bare word."""
    stack: list[tuple[list, bool]] = []
    while True:
        m = _TOKEN.match(data, at)
        if m is None:
            value, at, word = None, len(data), b""
            while stack:  # what is open at the end of the data is closed there
                items, is_dict = stack.pop()
                value = _as_dict(items) if is_dict else items
                if stack:
                    stack[-1][0].append(value)
            return value, at, word
        at, kind, word = m.end(), m.lastgroup, b""
        if kind == "open":
            stack.append(([], m["open"] == b"<<"))
            continue
        if kind == "close":
            if not stack:
                return None, at, m["close"]
            items, is_dict = stack.pop()
            value = _as_dict(items) if is_dict else items
        elif m["ref"]:
            value = Ref(int(m[2]), int(m[3]))
        elif kind == "name":
            value = Name(re.sub(rb"#([0-9a-fA-F]{2})", lambda x: bytes([int(x[1], 16)]), m["name"][1:]).decode("latin-1"))
        elif kind == "hex":
            digits = re.sub(rb"[^0-9a-fA-F]", b"", m["hex"])
            value = Text(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
            value.shown_hex = True
        elif kind == "text":
            value, at = _literal(data, at)
        elif kind == "word":
            word = m["word"]
            if word in (b"endobj", b"obj", b"stream", b"endstream", b"xref", b"trailer") and stack:
                while len(stack) > 1:
                    items, is_dict = stack.pop()
                    stack[-1][0].append(_as_dict(items) if is_dict else items)
                items, is_dict = stack.pop()
                return _as_dict(items) if is_dict else items, m.start("word"), b""
            value = _word(word)
        else:
            value = None
        if not stack:
            return value, at, word
        stack[-1][0].append(value)


def _as_dict(items: list) -> dict:
    """Pairs of a dictionary; the last of equal keys wins, odd ends are left out."""
    out, k = {}, 0
    while k + 1 < len(items):
        if isinstance(items[k], Name):
            out[str(items[k])] = items[k + 1]
            k += 2
        else:
            k += 1
    return out


def whole(value: object) -> int | None:
    """An integer, or a real without its fraction."""
    return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


# -- filters --------------------------------------------------------------------------


def inflate(data: bytes) -> bytes:
    """Deflated bytes, with or without a header, as far as they go."""
    for bits in (15, -15):
        d = zlib.decompressobj(bits)
        try:
            return d.decompress(data) + d.flush()
        except zlib.error:  # once more, byte by byte, for what comes before the fault
            d, out = zlib.decompressobj(bits), bytearray()
            try:
                for k in range(len(data)):
                    out += d.decompress(data[k : k + 1])
            except zlib.error:
                pass
            if out:
                return bytes(out)
    raise PdfError("a stream can't be inflated")


def unpredict(data: bytes, predictor: int, colors: int, bits: int, columns: int) -> bytes:
    """Undo PNG predictors (10 and more) or the TIFF one (2) of 8-bit samples."""
    width, step = (columns * colors * bits + 7) // 8, max(1, colors * bits // 8)
    if predictor == 2 and bits == 8:
        rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    if predictor < 10:
        return data
    out, last = bytearray(), bytearray(width)
    for at in range(0, len(data) - width, width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        if kind == 2:
            row = bytearray((np.frombuffer(row, np.uint8) + np.frombuffer(last, np.uint8)).tobytes())
        elif kind == 1:
            samples = np.zeros(-(-width // step) * step, np.uint8)
            samples[:width] = np.frombuffer(row, np.uint8)
            row = bytearray(np.cumsum(samples.reshape(-1, step), axis=0, dtype=np.uint8).tobytes()[:width])
        elif kind in (3, 4):
            for k in range(width):
                left = row[k - step] if k >= step else 0
                up, corner = last[k], last[k - step] if k >= step else 0
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    base = left + up - corner
                    guess = min((abs(base - left), 0, left), (abs(base - up), 1, up), (abs(base - corner), 2, corner))[2]
                row[k] = (row[k] + guess) & 255
        out += row
        last = row
    return bytes(out)


# -- documents --------------------------------------------------------------------------


@dataclass
class Place:
    """Where an object is: at an offset, or the index-th of a container."""

    offset: int = -1
    container: int = 0
    index: int = 0


@dataclass
class Page:
    num: int
    attrs: dict


INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")


@dataclass
class Document:
    data: bytes
    places: dict[int, Place] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    known: dict[int, object] = field(default_factory=dict)
    containers: dict[int, list] = field(default_factory=dict)
    opener: object = None  # decrypts, once there is a key
    rebuilt: bool = False
    page_list: list[Page] | None = None
    names: dict[bytes, object] | None = None

    # cross references

    def read_chain(self) -> None:
        """Sections from the newest on: the first place of a number stays, missing
        trailer keys are filled. Freed numbers say nothing, so older ones resurface."""
        found = list(re.finditer(rb"startxref[\0\t\n\x0c\r ]*(\d+)", self.data))
        if not found:
            raise PdfError("no startxref")
        todo, seen = [int(found[-1][1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                continue
            seen.add(at)
            head = re.compile(rb"[\0\t\n\x0c\r ]*xref").match(self.data, at)
            trailer = self.table(head.end()) if head else self.stream_section(at)
            for key, value in trailer.items():
                self.trailer.setdefault(key, value)
            todo.extend(n for n in (whole(trailer.get("XRefStm")), whole(trailer.get("Prev"))) if n is not None)

    def table(self, at: int) -> dict:
        section = re.compile(rb"[\0\t\n\x0c\r ]*(\d+)[\0\t\n\x0c\r ]+(\d+)(?=[\0\t\n\x0c\r ])")
        entry = re.compile(rb"[\0\t\n\x0c\r ]*(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+([nf])")
        while (m := section.match(self.data, at)) is not None:
            first, count, at = int(m[1]), int(m[2]), m.end()
            for num in range(first, first + count):
                e = entry.match(self.data, at)
                if e is None:
                    raise PdfError("a cross-reference table is damaged")
                at = e.end()
                if e[3] == b"n":
                    self.places.setdefault(num, Place(offset=int(e[1])))
        _, at, word = scan(self.data, at)
        value, _, _ = scan(self.data, at)
        if word != b"trailer" or not isinstance(value, dict):
            raise PdfError("no trailer")
        return value

    def stream_section(self, at: int) -> dict:
        value = self.object_at(at)[1]
        if not isinstance(value, Stream):
            raise PdfError("no cross-reference stream")
        head, data = value.head, self.decoded(value)
        w = [whole(x) or 0 for x in head.get("W") or []]
        if len(w) < 3:
            raise PdfError("widths are missing")
        index, k, size = head.get("Index") or [0, head.get("Size") or 0], 0, sum(w)
        for first, count in zip(index[::2], index[1::2], strict=False):
            for num in range(first, first + count):
                row = data[k : k + size]
                k += size
                if len(row) < size:
                    break
                a, b, c = (int.from_bytes(row[sum(w[:j]) : sum(w[: j + 1])]) for j in range(3))
                kind = a if w[0] else 1
                if kind == 1:
                    self.places.setdefault(num, Place(offset=b))
                elif kind == 2:
                    self.places.setdefault(num, Place(container=b, index=c))
        return head

    def rebuild(self) -> None:
        """Places from a scan of all bytes, the last object of a number winning; then
        containers, which never beat direct objects; then the best trailer."""
        self.rebuilt, self.known, self.containers, self.page_list, self.names = True, {}, {}, None, None
        self.places = {int(m[1]): Place(offset=m.start()) for m in _OBJECT.finditer(self.data)}
        direct = sorted(self.places, key=lambda n: -self.places[n].offset)
        for num in direct:
            value = self.get(num)
            if isinstance(value, Stream) and value.head.get("Type") == "ObjStm":
                for k, (own, _) in enumerate(self.container(num)):
                    self.places.setdefault(own, Place(container=num, index=k))
        candidates = [scan(self.data, m.end())[0] for m in reversed(list(re.finditer(rb"trailer", self.data)))]
        candidates += [v.head for v in map(self.get, direct) if isinstance(v, Stream) and v.head.get("Type") == "XRef"]
        catalogs = [n for n in [*direct, *sorted(self.places)] if isinstance(self.get(n), dict) and self.get(n).get("Type") == "Catalog"]
        for trailer in [*candidates, *({"Root": Ref(n)} for n in catalogs)]:
            if isinstance(trailer, dict) and self.good_root(trailer):
                self.trailer = {k: v for k, v in trailer.items() if k in ("Root", "Encrypt", "ID", "Info")}
                return
        raise PdfError("no catalog")

    def good_root(self, trailer: dict) -> bool:
        root = self.resolve(trailer.get("Root"))
        return isinstance(root, dict) and isinstance(self.resolve(root.get("Pages")), dict)

    # objects

    def object_at(self, at: int) -> tuple[int, object]:
        m = re.compile(rb"[\0\t\n\x0c\r ]*(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+obj").match(self.data, max(at, 0))
        if m is None:
            raise PdfError(f"no object at {at}")
        value, end, _ = scan(self.data, m.end())
        if isinstance(value, dict):
            s = re.compile(rb"(?:[\0\t\n\x0c\r ]+|%[^\r\n]*)*stream(\r\n|\n|\r)?").match(self.data, end)
            if s:
                value = Stream(value, start=s.end(), sealed=True)
                value.raw = self.cut(value)
        return int(m[1]), value

    def cut(self, stream: Stream) -> bytes:
        """The declared length if endstream follows it, else up to the next endstream."""
        length = stream.head.get("Length")
        if isinstance(length, Ref):
            length = self.resolve(length) if length.num in self.places else None
        length = whole(length)
        if length is not None and length >= 0:
            end = stream.start + length
            if re.compile(rb"[\0\t\n\x0c\r ]*endstream").match(self.data, end):
                return self.data[stream.start : end]
        end = self.data.find(b"endstream", stream.start)
        raw = self.data[stream.start : end if end >= 0 else len(self.data)]
        return raw.removesuffix(b"\n").removesuffix(b"\r") if raw.endswith(b"\n") else raw.removesuffix(b"\r")

    def get(self, num: int) -> object:
        """An object by number; one that isn't where it should be starts one rebuild."""
        if num in self.known:
            return self.known[num]
        place = self.places.get(num)
        if place is None:
            return None
        self.known[num] = None  # an object that needs itself sees null
        try:
            if place.container:
                found = self.container(place.container)
                value = found[place.index][1] if place.index < len(found) and found[place.index][0] == num else dict(found).get(num)
            else:
                own, value = self.object_at(place.offset)
                if own != num:
                    raise PdfError(f"object {own} where {num} should be")
                value = self.opener.opened(num, place, value, self) if self.opener else value
        except (PdfError, IndexError):
            if self.rebuilt:
                return None
            opener, trailer = self.opener, dict(self.trailer)
            self.rebuild()
            self.opener, self.trailer = opener, trailer | self.trailer
            return self.get(num)
        self.known[num] = value
        return value

    def container(self, num: int) -> list[tuple[int, object]]:
        if num not in self.containers:
            self.containers[num] = []
            stream = self.get(num)
            if isinstance(stream, Stream):
                data, n, first = self.decoded(stream), whole(stream.head.get("N")) or 0, whole(stream.head.get("First")) or 0
                heads = [int(x) for x in data[:first].split()[: 2 * n]]
                self.containers[num] = [(own, scan(data, first + at)[0]) for own, at in zip(heads[::2], heads[1::2], strict=False)]
        return self.containers[num]

    def resolve(self, value: object) -> object:
        for _ in range(100):
            if not isinstance(value, Ref):
                return value
            value = self.get(value.num)
        return None

    def mapping(self, value: object) -> dict:
        value = self.resolve(value)
        return value if isinstance(value, dict) else value.head if isinstance(value, Stream) else {}

    def decoded(self, stream: Stream) -> bytes:
        """Bytes through the filters; only Flate and Identity are known."""
        names, parms = self.resolve(stream.head.get("Filter")), self.resolve(stream.head.get("DecodeParms"))
        names = names if isinstance(names, list) else [names] if names else []
        parms = parms if isinstance(parms, list) else [parms]
        data = stream.raw
        for k, name in enumerate(self.resolve(n) for n in names):
            if name in ("Identity", "Crypt"):
                continue
            if name not in ("FlateDecode", "Fl"):
                raise PdfError(f"filter {name} is not known")
            p = self.mapping(parms[k] if k < len(parms) else None)
            p = {key: whole(self.resolve(p.get(key))) or default for key, default in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1))}
            data = unpredict(inflate(data), p["Predictor"], p["Colors"], p["BitsPerComponent"], p["Columns"])
        return data

    # structure

    @property
    def root(self) -> dict:
        return self.mapping(self.trailer.get("Root"))

    def pages(self) -> list[Page]:
        """Pages in order with inherited attributes; what comes twice in the tree counts once.

        A node without a type, or a tree node, gives its kids, or is a page if it has
        none but contents, and else an error; a node of any other type is a page.
        """
        if self.page_list is not None:
            return self.page_list
        out, seen = [], set()
        stack = [(self.root.get("Pages"), {})]
        while stack:
            value, above = stack.pop()
            if isinstance(value, Ref):
                if value.num in seen:
                    continue
                seen.add(value.num)
            if not isinstance(self.resolve(value), (dict, Stream)):
                continue
            node = self.mapping(value)
            own = above | {k: node[k] for k in INHERITED if node.get(k) is not None}
            kids, kind = self.resolve(node.get("Kids")), node.get("Type")
            inner = kind == "Pages" or not isinstance(kind, Name) or kind == ""
            if inner and isinstance(kids, list):
                stack.extend((k, own) for k in reversed(kids))
            elif inner and node.get("Contents") is None:
                raise PdfError("a node of the page tree has no kids")
            else:
                attrs = {k: v for k, v in node.items() if k != "Parent"}
                out.append(Page(value.num if isinstance(value, Ref) else 0, own | attrs))
        if not out:
            raise PdfError("the document has no pages")
        self.page_list = out
        return out

    def named_destinations(self) -> dict[bytes, object]:
        """The catalog's dictionary first, then the name tree; the first of a name wins."""
        if self.names is not None:
            return self.names
        out = {k.encode("latin-1"): v for k, v in self.mapping(self.root.get("Dests")).items()}
        stack, seen = [(self.mapping(self.root.get("Names")).get("Dests"), 0)], set()
        while stack:
            value, depth = stack.pop()
            if depth > 32 or (isinstance(value, Ref) and value.num in seen):
                continue
            seen.add(value.num if isinstance(value, Ref) else -1)
            node = self.mapping(value)
            names = self.resolve(node.get("Names")) or []
            for key, target in zip(names[::2], names[1::2], strict=False):
                key = self.resolve(key)
                out.setdefault(bytes(key) if isinstance(key, Text) else str(key).encode("latin-1"), target)
            stack.extend((k, depth + 1) for k in reversed(self.resolve(node.get("Kids")) or []))
        self.names = out
        return out

    def destination(self, value: object) -> list | None:
        """A destination as its explicit array, through names and dictionaries."""
        for _ in range(8):
            value = self.resolve(value)
            if isinstance(value, list):
                return value or None
            if isinstance(value, dict):
                value = value.get("D")
            elif isinstance(value, (Text, Name)):
                value = self.named_destinations().get(bytes(value) if isinstance(value, Text) else str(value).encode("latin-1"))
            else:
                return None
        return None


def parse(data: bytes, passwords: tuple[str, ...] = ()) -> Document:
    """A document; bytes before the header are dropped, so offsets count from it."""
    at = data[: 1024 + 5].find(b"%PDF-")
    if at < 0:
        raise PdfError("no PDF header")
    doc = Document(data[at:])
    try:
        doc.read_chain()
        open_sealed(doc, passwords)
        fine = doc.good_root(doc.trailer)
    except PasswordError:
        raise
    except (PdfError, ValueError, TypeError, IndexError):
        fine = False
    if not fine:
        doc.opener, doc.trailer = None, {}
        doc.rebuild()
        open_sealed(doc, passwords)
        if not doc.good_root(doc.trailer):
            raise PdfError("no pages")
    return doc


def open_sealed(doc: Document, passwords: tuple[str, ...]) -> None:
    if doc.trailer.get("Encrypt") is not None:
        from .pdf_crypt import opener

        doc.opener = opener(doc, passwords)
        doc.known, doc.containers = {}, {}


def walk(value: object) -> Iterator[object]:
    """A value and all values inside it, without following references."""
    stack = [value]
    while stack:
        v = stack.pop()
        yield v
        if isinstance(v, list):
            stack.extend(reversed(v))
        elif isinstance(v, (dict, Stream)):
            d = v.head if isinstance(v, Stream) else v
            stack.extend(d[k] for k in sorted(d, reverse=True))


def mapped(value: object, ref: Callable[[Ref], object]) -> object:
    """A copy of a value with each reference replaced."""
    if isinstance(value, Ref):
        return ref(value)
    if isinstance(value, list):
        return [mapped(v, ref) for v in value]
    if isinstance(value, dict):
        return {k: mapped(v, ref) for k, v in value.items()}
    if isinstance(value, Stream):
        return Stream({k: mapped(v, ref) for k, v in value.head.items()}, value.raw)
    return value
