"""Objects to PDF bytes, canonical bytes of objects, and deduplication inside a file."""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

from ..operators.graph import _strong
from .pdf import Name, Ref, Stream, Text, mapped, walk

#: Types whose objects are someone, not something.
IDENTITY_TYPES = ("Page", "Pages", "Catalog", "Annot", "OCG", "OCMD", "Outlines", "StructTreeRoot", "StructElem", "Sig")
_REGULAR = frozenset(range(0x21, 0x7F)) - frozenset(b"()<>[]{}/%#")


def real_text(x: float) -> str:
    """The shortest decimal without an exponent; what isn't a number is 0."""
    if not math.isfinite(x) or x == 0:
        return "0"
    if x == int(x):
        return str(int(x))
    text = repr(x)
    if "e" not in text:
        return text
    digits, power = text.split("e")
    sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
    head, _, tail = digits.partition(".")
    shift = int(power)
    return f"{sign}0.{'0' * (-shift - 1)}{head}{tail}" if shift < 0 else f"{sign}{head}{tail.ljust(shift, '0')}"


def name_bytes(name: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if c in _REGULAR else b"#%02X" % c for c in name.encode("latin-1", "replace"))


def text_literal(value: bytes) -> bytes:
    """A literal where all bytes can be shown, else hexadecimal."""
    if getattr(value, "shown_hex", False) or any(c not in b"\t\n\r" and not 0x20 <= c <= 0x7E for c in value):
        return b"<" + value.hex().upper().encode() + b">"
    out = bytes(value).replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    return b"(" + out.replace(b"\n", b"\\n").replace(b"\r", b"\\r") + b")"


def printed(value: object) -> bytes:
    """A value as PDF source; a stream's Length is that of its bytes."""
    if isinstance(value, Name):
        return name_bytes(value)
    if isinstance(value, bytes):
        return text_literal(value)
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return real_text(value).encode()
    if isinstance(value, Ref):
        return b"%d %d R" % (value.num, value.gen)
    if isinstance(value, list):
        return b"[" + b" ".join(map(printed, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b"".join(b" " + name_bytes(k) + b" " + printed(value[k]) for k in sorted(value)) + b" >>"
    if isinstance(value, Stream):
        return printed(value.head | {"Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    return b"null"


def written(objects: list[object], root: int) -> bytes:
    """A file of objects 1, 2, ... with a classic cross-reference table."""
    parts, offsets, at = [b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"], [], 0
    at = len(parts[0])
    for num, value in enumerate(objects, 1):
        offsets.append(at)
        parts.append(b"%d 0 obj\n" % num + printed(value) + b"\nendobj\n")
        at += len(parts[-1])
    rows = b"".join(b"%010d 00000 n \n" % o for o in offsets)
    parts.append(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + rows)
    parts.append(b"trailer\n" + printed({"Size": len(objects) + 1, "Root": Ref(root)}) + b"\nstartxref\n%d\n%%%%EOF\n" % at)
    return b"".join(parts)


def has_identity(value: object) -> bool:
    d = value.head if isinstance(value, Stream) else value
    if not isinstance(d, dict):
        return False
    has = lambda k: d.get(k) is not None
    return d.get("Type") in IDENTITY_TYPES or (has("Rect") and has("Subtype")) or has("FT") or (has("T") and (has("Kids") or has("Parent")))


def segments(value: object) -> tuple[list[bytes], list[int]]:
    """Unambiguous bytes of a value, cut where it refers to an object, and the numbers
    referred to: the digest is over the pieces with the objects' digests between."""
    pieces, refs, now = [], [], []
    tagged = lambda tag, data: now.append(tag + struct.pack(">Q", len(data)) + data)
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, tuple):  # a dictionary key
            tagged(b"K", v[0].encode("latin-1", "replace"))
        elif isinstance(v, Ref):
            pieces.append(b"".join(now) + b"R")
            refs.append(v.num)
            now = []
        elif isinstance(v, Name):
            tagged(b"N", v.encode("latin-1", "replace"))
        elif isinstance(v, bytes):
            tagged(b"S", v)
        elif isinstance(v, bool):
            now.append(b"t" if v else b"f")
        elif isinstance(v, int):
            now.append(b"i" + struct.pack(">q", v))
        elif isinstance(v, float):
            now.append(b"r" + struct.pack(">d", v))
        elif isinstance(v, list):
            now.append(b"A" + struct.pack(">Q", len(v)))
            stack.extend(reversed(v))
        elif isinstance(v, (dict, Stream)):
            d = v.head if isinstance(v, Stream) else v
            keys = sorted(k for k in d if k != "Length")
            if isinstance(v, Stream):
                tagged(b"T", v.raw)
            now.append(b"D" + struct.pack(">Q", len(keys)))
            stack.extend(x for k in reversed(keys) for x in (d[k], (k,)))
        else:
            now.append(b"n")
    return [*pieces, b"".join(now)], refs


def digests(objects: dict[int, object], salt: bytes = b"") -> dict[int, bytes]:
    """Merkle digests: equal content, equal digest. Members of cycles and objects with
    identity get a digest of their own; what only points at a cycle is hashed."""
    parts = {n: segments(v) for n, v in objects.items()}
    edges = [(n, r) for n, (_, refs) in parts.items() for r in refs if r in objects]
    label = _strong(list(objects), edges)
    size: dict[int, int] = {}
    for c in label.values():
        size[c] = size.get(c, 0) + 1
    loops = {a for a, b in edges if a == b}
    out = {n: hashlib.sha256(b"\0identity\0" + salt + struct.pack(">Q", n)).digest() for n, v in objects.items() if size[label[n]] > 1 or n in loops or has_identity(v)}
    for start in objects:
        stack = [start]
        while stack:
            n = stack[-1]
            if n in out:
                stack.pop()
                continue
            pieces, refs = parts[n]
            waiting = [r for r in refs if r in objects and r not in out]
            if waiting:
                stack.extend(waiting)
                continue
            h = hashlib.sha256()
            for piece, r in zip(pieces, [*refs, None], strict=True):
                h.update(piece if r is None or r in out else piece[:-1] + b"n")
                if r in out:
                    h.update(out[r])
            out[stack.pop()] = h.digest()
    return out


def references(value: object) -> Iterator[int]:
    return (v.num for v in walk(value) if isinstance(v, Ref))


def compacted(objects: list[object], root: int, dedupe: bool = True) -> tuple[list[object], int, dict]:
    """Objects that the root reaches, renumbered in order; equal ones as one if asked.

    Also the objects merged into others, the stream bytes that saved, and those kept.
    """
    table = dict(enumerate(objects, 1))
    keeper = {n: n for n in table}
    if dedupe:
        first: dict[bytes, int] = {}
        own = digests(table)
        keeper = {n: first.setdefault(own[n], n) for n in table}
    reached, stack = set(), [keeper[root]]
    while stack:
        n = stack.pop()
        if n not in reached:
            reached.add(n)
            stack.extend(keeper[r] for r in references(table[n]) if r in table)
    new = {n: k for k, n in enumerate(sorted(reached), 1)}
    gone = [n for n in table if n not in reached and keeper[n] != n]
    stats = {"merged": len(gone), "bytes_saved": sum(len(table[n].raw) for n in gone if isinstance(table[n], Stream)), "kept": len(new)}

    def ref(r: Ref) -> object:
        k = new.get(keeper.get(r.num, 0))
        return Ref(k) if k else None

    return [mapped(table[n], ref) for n in sorted(reached)], new[keeper[root]], stats


def text_value(s: str) -> Text:
    """Text as ASCII, or UTF-16 with a byte order mark."""
    return Text(s.encode("ascii") if s.isascii() else b"\xfe\xff" + s.encode("utf-16-be"))
