"""The standard security handler: RC4 and AES in plain Python and numpy, key derivation, and keys of single objects."""

from __future__ import annotations

import hashlib

import numpy as np

from .objects import Name, PdfError, Stream

#: Fixed value: the padding of passwords in the file format.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = (a << 1 ^ 0x11B) if a & 128 else a << 1
        b >>= 1
    return out


def _tables() -> tuple[list[int], list[list[int]], np.ndarray, dict[int, np.ndarray]]:
    """The S-box from its definition, the tables of an encryption round, the inverse box and products for decryption."""
    inverse = {a: b for a in range(1, 256) for b in range(1, 256) if _times(a, b) == 1} | {0: 0}
    box = []
    for x in range(256):
        b = inverse[x]
        box.append(b ^ 0x63 ^ (rot := (b << 8 | b)) >> 7 & 255 ^ rot >> 6 & 255 ^ rot >> 5 & 255 ^ rot >> 4 & 255)
    words = [_times(s, 2) << 24 | s << 16 | s << 8 | _times(s, 3) for s in box]
    rounds = [[(w >> 8 * i | w << (32 - 8 * i)) & 0xFFFFFFFF for w in words] for i in range(4)]
    back = np.argsort(np.array(box)).astype(np.uint8)
    return box, rounds, back, {k: np.array([_times(x, k) for x in range(256)], np.uint8) for k in (9, 11, 13, 14)}


_READY: list = []


def _aes_tables():
    if not _READY:
        _READY.extend(_tables())
    return _READY


def _schedule(key: bytes) -> list[int]:
    box, n = _aes_tables()[0], len(key) // 4
    sub = lambda w: box[w >> 24] << 24 | box[w >> 16 & 255] << 16 | box[w >> 8 & 255] << 8 | box[w & 255]
    w, step = [int.from_bytes(key[4 * i : 4 * i + 4], "big") for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        t = w[-1]
        if i % n == 0:
            t, step = sub((t << 8 | t >> 24) & 0xFFFFFFFF) ^ step << 24, _times(step, 2)
        elif n == 8 and i % 8 == 4:
            t = sub(t)
        w.append(w[i - n] ^ t)
    return w


def aes_cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks, no padding."""
    box, (t0, t1, t2, t3), _, _ = _aes_tables()
    w = _schedule(key)
    last, out = len(w) - 4, bytearray()
    chain = int.from_bytes(iv, "big")
    for at in range(0, len(data), 16):
        s = chain ^ int.from_bytes(data[at : at + 16], "big")
        a, b, c, d = s >> 96 ^ w[0], s >> 64 & 0xFFFFFFFF ^ w[1], s >> 32 & 0xFFFFFFFF ^ w[2], s & 0xFFFFFFFF ^ w[3]
        for k in range(4, last, 4):
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ w[k],
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ w[k + 1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ w[k + 2],
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ w[k + 3],
            )
        v = (a, b, c, d)
        chain = 0
        for i in range(4):
            x = box[v[i] >> 24] << 24 | box[v[(i + 1) % 4] >> 16 & 255] << 16 | box[v[(i + 2) % 4] >> 8 & 255] << 8 | box[v[(i + 3) % 4] & 255]
            chain = chain << 32 | x ^ w[last + i]
        out += chain.to_bytes(16, "big")
    return bytes(out)


def aes_cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks, all at once in numpy; bytes after the last whole block are left out."""
    _, _, back, by = _aes_tables()
    w = np.array(_schedule(key), dtype=">u4").view(np.uint8).reshape(-1, 16)
    blocks = np.frombuffer(data, np.uint8, len(data) // 16 * 16).reshape(-1, 16)
    rows = np.array([(i - 4 * (i % 4)) % 16 for i in range(16)])  # a byte of row r comes from r columns to the left
    s = blocks ^ w[-1]
    for k in range(len(w) - 2, -1, -1):
        s = back[s[:, rows]] ^ w[k]
        if k:
            a, b, c, d = (s.reshape(-1, 4, 4)[:, :, i] for i in range(4))
            s = np.stack([by[14][p] ^ by[11][q] ^ by[13][r] ^ by[9][t] for p, q, r, t in ((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))], axis=2).reshape(-1, 16)
    before = np.concatenate([np.frombuffer(iv, np.uint8).reshape(1, 16), blocks[:-1]]) if len(blocks) else blocks
    return (s ^ before).tobytes()


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(data), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _unpad(data: bytes) -> bytes:
    n = data[-1] if data else 0
    return data[:-n] if 1 <= n <= 16 and data.endswith(bytes([n]) * n) else data


def hash_r6(password: bytes, salt: bytes, owner: bytes = b"", revision: int = 6) -> bytes:
    k = hashlib.sha256(password + salt + owner).digest()
    if revision < 6:
        return k
    turn = 0
    while True:
        e = aes_cbc_encrypt(k[:16], k[16:32], (password + k + owner) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        turn += 1
        if turn >= 64 and e[-1] <= turn - 32:
            return k[:32]


class Handler:
    """What decrypts the strings and streams of a file, from its Encrypt dictionary and a password (user's or owner's)."""

    def __init__(self, d: dict, file_id: bytes, password: bytes):
        self.version, self.revision = d.get("V", 0), d.get("R", 2)
        self.metadata = d.get("EncryptMetadata", True) is not False
        length = d.get("Length", 40) if self.version in (2, 3) else 40
        self.streams = self.strings = "V2"
        if self.version >= 4:
            filters = d.get("CF") or {}
            kind = lambda name: (filters.get(str(name)) or {}).get("CFM", "None") if name != "Identity" else "None"
            self.streams, self.strings, length = str(kind(d.get("StmF", "Identity"))), str(kind(d.get("StrF", "Identity"))), 128
        self.bytes = 5 if self.revision == 2 else max(5, min(16, length // 8))
        self.d, self.file_id = d, file_id
        self.key = self._key_v5(password[:127]) if self.version >= 5 else self._key_rc4(password)
        if self.key is None:
            raise PdfError("wrong password")

    def _from_user(self, password: bytes) -> bytes:
        d = self.d
        h = hashlib.md5((password + PAD)[:32] + d["O"][:32] + (d["P"] & 0xFFFFFFFF).to_bytes(4, "little") + self.file_id + (b"" if self.metadata or self.revision < 4 else b"\xff" * 4)).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            h = hashlib.md5(h[: self.bytes]).digest()
        return h[: self.bytes]

    def proof(self, key: bytes) -> bytes:
        """The U entry that belongs to key."""
        if self.revision == 2:
            return rc4(key, PAD)
        out = hashlib.md5(PAD + self.file_id).digest()
        for i in range(20):
            out = rc4(bytes(c ^ i for c in key), out)
        return out

    def owner_key(self, password: bytes) -> bytes:
        h = hashlib.md5((password + PAD)[:32]).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            h = hashlib.md5(h).digest()
        return h[: self.bytes]

    def _key_rc4(self, password: bytes) -> bytes | None:
        own, found = self.owner_key(password), self.d["O"][:32]
        for i in range(19, -1, -1) if self.revision >= 3 else (0,):
            found = rc4(bytes(c ^ i for c in own), found)
        for candidate in (password, found):
            key = self._from_user(candidate)
            proof = self.proof(key)
            if self.d["U"][: len(proof)] == proof:
                return key
        return None

    def _key_v5(self, password: bytes) -> bytes | None:
        o, u = self.d["O"][:48], self.d["U"][:48]
        for stored, wrapped, more in ((u, self.d["UE"], b""), (o, self.d["OE"], u)):
            if hash_r6(password, stored[32:40], more, self.revision) == stored[:32]:
                return aes_cbc_decrypt(hash_r6(password, stored[40:48], more, self.revision), bytes(16), wrapped[:32])
        return None

    def object_key(self, num: int, gen: int, kind: str) -> bytes:
        if kind == "AESV3":
            return self.key
        salt = num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if kind == "AESV2" else b"")
        return hashlib.md5(self.key + salt).digest()[: min(16, len(self.key) + 5)]

    def _open(self, data: bytes, num: int, gen: int, kind: str) -> bytes:
        if kind == "None":
            return data
        key = self.object_key(num, gen, kind)
        return rc4(key, data) if kind == "V2" else _unpad(aes_cbc_decrypt(key, data[:16], data[16:])) if len(data) >= 32 else b""

    def decrypt(self, o, num: int, gen: int):
        """An object as it was before encryption. Cross-reference streams were never encrypted."""
        if isinstance(o, bytes):
            return self._open(o, num, gen, self.strings)
        if isinstance(o, list):
            return [self.decrypt(x, num, gen) for x in o]
        if isinstance(o, dict):
            return {k: self.decrypt(v, num, gen) for k, v in o.items()}
        if isinstance(o, Stream):
            kind = o.dict.get("Type")
            if kind == "XRef" or kind == "Metadata" and not self.metadata:
                return o
            first = o.dict.get("Filter")
            first = first[0] if isinstance(first, list) and first else first
            raw = o.raw if isinstance(first, Name) and first == "Crypt" else self._open(o.raw, num, gen, self.streams)
            return Stream(self.decrypt(o.dict, num, gen), raw)
        return o
