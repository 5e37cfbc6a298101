"""Passwords and decryption of PDF files: RC4 and AES, revisions 2 to 6."""

from __future__ import annotations

import hashlib
import struct

from .pdf import Document, PasswordError, PdfError, Ref, Stream, Text, whole

#: The padding of short passwords.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
#: Characters whose code differs from Latin-1, from 0x18 and from 0x80 on.
LOW_SPECIAL = "˘ˇˆ˙˝˛˚˜"
HIGH_SPECIAL = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž"


def document_encoded(text: str) -> bytes | None:
    """A password in the format's own encoding; null if a character isn't in it."""
    special = {c: 0x18 + k for k, c in enumerate(LOW_SPECIAL)} | {c: 0x80 + k for k, c in enumerate(HIGH_SPECIAL)} | {"€": 0xA0}
    out = []
    for c in text:
        n = ord(c)
        if n < 0x18 or 0x20 <= n < 0x7F or (0xA1 <= n <= 0xFF and n != 0xAD):
            out.append(n)
        elif c in special:
            out.append(special[c])
        else:
            return None
    return bytes(out)


def rc4(key: bytes, data: bytes) -> bytes:
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out[k] = b ^ box[(box[i] + box[j]) & 255]
    return bytes(out)


def _times2(x: int) -> int:
    return (x << 1) ^ (0x11B if x & 0x80 else 0)


def _product(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = _times2(a), b >> 1
    return out


def _boxes() -> tuple[bytes, bytes]:
    """The substitution box and its inverse, from inverses in the field and the affine map."""
    box = bytearray(256)
    power, log, x = [0] * 255, {}, 1
    for k in range(255):
        power[k], log[x] = x, k
        x ^= _times2(x)
    for v in range(256):
        inverse = power[(255 - log[v]) % 255] if v else 0
        turned = inverse
        for k in range(1, 5):
            turned ^= ((inverse << k) | (inverse >> (8 - k))) & 255
        box[v] = turned ^ 0x63
    return bytes(box), bytes(box.index(v) for v in range(256))


BOX, BOX_BACK = _boxes()
MIX = {n: bytes(_product(v, n) for v in range(256)) for n in (2, 3, 9, 11, 13, 14)}


class Aes:
    """AES of one key; blocks are 16 bytes in column order."""

    def __init__(self, key: bytes):
        n, words, rcon = len(key) // 4, [key[k : k + 4] for k in range(0, len(key), 4)], 1
        self.rounds = n + 6
        for k in range(n, 4 * (self.rounds + 1)):
            last = words[-1]
            if k % n == 0:
                last = bytes(BOX[b] for b in last[1:] + last[:1])
                last = bytes([last[0] ^ rcon]) + last[1:]
                rcon = _times2(rcon)
            elif n > 6 and k % n == 4:
                last = bytes(BOX[b] for b in last)
            words.append(bytes(a ^ b for a, b in zip(words[k - n], last, strict=True)))
        self.keys = [b"".join(words[k : k + 4]) for k in range(0, len(words), 4)]
        self.shift = [(k + 4 * (k % 4)) % 16 for k in range(16)]
        self.shift_back = [(k - 4 * (k % 4)) % 16 for k in range(16)]

    @staticmethod
    def _add(a: bytes, b: bytes) -> bytes:
        return (int.from_bytes(a) ^ int.from_bytes(b)).to_bytes(16)

    def encrypt(self, block: bytes) -> bytes:
        s = self._add(block, self.keys[0])
        two, three = MIX[2], MIX[3]
        for r in range(1, self.rounds + 1):
            s = bytes(BOX[s[k]] for k in self.shift)
            if r < self.rounds:
                s = bytes(two[s[c + k]] ^ three[s[c + (k + 1) % 4]] ^ s[c + (k + 2) % 4] ^ s[c + (k + 3) % 4] for c in (0, 4, 8, 12) for k in range(4))
            s = self._add(s, self.keys[r])
        return s

    def decrypt(self, block: bytes) -> bytes:
        s = block
        for r in range(self.rounds, 0, -1):
            s = self._add(s, self.keys[r])
            if r < self.rounds:
                s = bytes(MIX[14][s[c + k]] ^ MIX[11][s[c + (k + 1) % 4]] ^ MIX[13][s[c + (k + 2) % 4]] ^ MIX[9][s[c + (k + 3) % 4]] for c in (0, 4, 8, 12) for k in range(4))
            s = bytes(BOX_BACK[s[k]] for k in self.shift_back)
        return self._add(s, self.keys[0])

    def chain_encrypt(self, start: bytes, data: bytes) -> bytes:
        out = []
        for k in range(0, len(data), 16):
            start = self.encrypt(self._add(data[k : k + 16], start))
            out.append(start)
        return b"".join(out)

    def chain_decrypt(self, start: bytes, data: bytes) -> bytes:
        out = []
        for k in range(0, len(data) - 15, 16):
            out.append(self._add(self.decrypt(data[k : k + 16]), start))
            start = data[k : k + 16]
        return b"".join(out)


def unsealed(key: bytes, data: bytes) -> bytes:
    """AES data whose first block starts the chain; padding that is wrong stays."""
    if len(data) < 32:
        return b""
    plain = Aes(key).chain_decrypt(data[:16], data[16:])
    pad = plain[-1] if plain else 0
    return plain[:-pad] if 1 <= pad <= 16 and plain.endswith(bytes([pad]) * pad) else plain


def hash_2b(password: bytes, salt: bytes, extra: bytes) -> bytes:
    """The hash of revision 6: at least 64 rounds, until the last byte allows an end."""
    k, rounds = hashlib.sha256(password + salt + extra).digest(), 0
    while True:
        block = Aes(k[:16]).chain_encrypt(k[16:32], (password + k + extra) * 64)
        kind = sum(block[:16]) % 3
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[kind](block).digest()
        rounds += 1
        if rounds >= 64 and block[-1] <= rounds - 32:
            return k[:32]


class Opener:
    """Decrypts what a document holds, once a password fits."""

    def __init__(self, head: dict, number: int, first_id: bytes):
        self.head, self.number, self.first_id = head, number, first_id
        self.version, self.revision = whole(head.get("V")) or 0, whole(head.get("R")) or 0
        self.metadata = head.get("EncryptMetadata") is not False
        p = whole(head.get("P"))
        self.restricted = p is not None and (p & 0xF3C) != 0xF3C
        if self.version in (1, 2):
            self.streams = self.strings = "V2"
        elif self.version in (4, 5):
            filters = head.get("CF") or {}
            method = lambda key: (filters.get(str(head.get(key) or "")) or {}).get("CFM")
            self.streams, self.strings = method("StmF"), method("StrF")
        else:
            raise PdfError(f"encryption version {self.version} is not known")
        self.key = b""

    def value(self, name: str) -> bytes:
        v = self.head.get(name)
        return bytes(v) if isinstance(v, Text) else b""

    def try_password(self, password: str) -> bool:
        utf = password.encode()
        if self.revision >= 5:
            return self._modern(utf[:127])
        own = document_encoded(password)
        return any(self._legacy(p) for p in dict.fromkeys([utf] if own is None else [own, utf]))

    def _legacy_key(self, password: bytes) -> bytes:
        bits = whole(self.head.get("Length"))
        n = 5 if self.revision == 2 else bits // 8 if bits and 40 <= bits <= 128 else 16
        parts = (password + PADDING)[:32] + self.value("O") + struct.pack("<I", (whole(self.head.get("P")) or 0) & 0xFFFFFFFF) + self.first_id
        if self.revision >= 4 and not self.metadata:
            parts += b"\xff" * 4
        key = hashlib.md5(parts).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            key = hashlib.md5(key[:n]).digest()
        return key[:n]

    @staticmethod
    def _nineteen(key: bytes, data: bytes, order: range) -> bytes:
        for k in order:
            data = rc4(bytes(b ^ k for b in key), data)
        return data

    def _fits(self, key: bytes) -> bool:
        if self.revision == 2:
            return rc4(key, PADDING) == self.value("U")[:32]
        want = self._nineteen(key, hashlib.md5(PADDING + self.first_id).digest(), range(20))
        return want == self.value("U")[:16]

    def _legacy(self, password: bytes) -> bool:
        key = self._legacy_key(password)
        if not self._fits(key):
            n, digest = len(key), hashlib.md5((password + PADDING)[:32]).digest()
            for _ in range(50 if self.revision >= 3 else 0):
                digest = hashlib.md5(digest).digest()
            user = self._nineteen(digest[:n], self.value("O")[:32], range(19, -1, -1) if self.revision >= 3 else range(1))
            key = self._legacy_key(user)
            if not self._fits(key):
                return False
        self.key = key
        return True

    def _modern(self, password: bytes) -> bool:
        made = hash_2b if self.revision >= 6 else lambda p, s, e: hashlib.sha256(p + s + e).digest()
        user, owner = self.value("U")[:48], self.value("O")[:48]
        for own, wrapped, extra in ((user, "UE", b""), (owner, "OE", user)):
            if len(own) == 48 and made(password, own[32:40], extra) == own[:32]:
                self.key = Aes(made(password, own[40:48], extra)).chain_decrypt(bytes(16), self.value(wrapped)[:32])
                return True
        return False

    def _bytes(self, method: str | None, num: int, gen: int, data: bytes) -> bytes:
        if method not in ("V2", "AESV2", "AESV3"):
            return data
        if method == "AESV3":
            return unsealed(self.key, data)
        parts = self.key + struct.pack("<I", num)[:3] + struct.pack("<I", gen)[:2] + (b"sAlT" if method == "AESV2" else b"")
        key = hashlib.md5(parts).digest()[: min(len(self.key) + 5, 16)]
        return unsealed(key, data) if method == "AESV2" else rc4(key, data)

    def opened(self, num: int, place: object, value: object, doc: Document) -> object:
        """A direct object, decrypted; those inside containers came decrypted with them."""
        if num == self.number:
            return value
        gen = int(doc.data[place.offset :].split(None, 2)[1])

        def inner(v: object) -> object:
            if isinstance(v, Text):
                out = Text(self._bytes(self.strings, num, gen, v))
                out.shown_hex = v.shown_hex
                return out
            if isinstance(v, list):
                return [inner(x) for x in v]
            return {k: inner(x) for k, x in v.items()} if isinstance(v, dict) else v

        if isinstance(value, Stream):
            if value.head.get("Type") == "XRef":
                return value
            filters = value.head.get("Filter")
            plain = (value.head.get("Type") == "Metadata" and not self.metadata) or "Crypt" in (filters if isinstance(filters, list) else [filters])
            return Stream(inner(value.head), value.raw if plain else self._bytes(self.streams, num, gen, value.raw))
        return inner(value)


def opener(doc: Document, passwords: tuple[str, ...]) -> Opener:
    reference = doc.trailer["Encrypt"]
    head = doc.mapping(reference)
    if head.get("Filter") != "Standard":
        raise PdfError("only the standard encryption is known")
    ids = doc.trailer.get("ID")
    first = bytes(ids[0]) if isinstance(ids, list) and ids and isinstance(ids[0], Text) else b""
    out = Opener({k: doc.resolve(v) for k, v in head.items()}, reference.num if isinstance(reference, Ref) else 0, first)
    if not any(out.try_password(p) for p in ("", *passwords)):
        raise PasswordError("no password fits")
    return out
