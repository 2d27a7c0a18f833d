"""What a detached signature says was signed: the digest among its signed attributes. DER by tags, no certificates."""

from __future__ import annotations

#: Object identifiers, as in DER.
DIGESTS = {bytes.fromhex("2b0e03021a"): "sha1", bytes.fromhex("608648016503040201"): "sha256", bytes.fromhex("608648016503040202"): "sha384", bytes.fromhex("608648016503040203"): "sha512"}
MESSAGE_DIGEST = bytes.fromhex("2a864886f70d010904")
SIGNED_DATA = bytes.fromhex("2a864886f70d010702")
TIMESTAMP = bytes.fromhex("2a864886f70d010910020e")
MAX_DEPTH = 24


def elements(data: bytes, at: int = 0, end: int | None = None):
    """(tag, start, end) of the DER elements side by side; stops at what isn't well formed."""
    end = len(data) if end is None else end
    while at + 2 <= end:
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > end:
                return
            n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if at + n > end:
            return
        yield tag, at, at + n
        at += n


def message_digest(data: bytes) -> tuple[str | None, bytes | None]:
    """(algorithm, digest) of the first signer with the attribute, or nulls."""
    algorithm, todo = None, [(0, len(data), 0)]
    found: list[tuple[int, bytes]] = []
    while todo:
        start, end, depth = todo.pop()
        inner = list(elements(data, start, end))
        for k, (tag, a, b) in enumerate(inner):
            if tag == 0x06:
                oid = data[a:b]
                if oid in DIGESTS and algorithm is None:
                    algorithm = DIGESTS[oid]
                elif oid == MESSAGE_DIGEST and k + 1 < len(inner) and inner[k + 1][0] == 0x31:
                    own = [data[x:y] for t, x, y in elements(data, *inner[k + 1][1:]) if t == 0x04]
                    found += [(a, v) for v in own[:1]]
        if depth < MAX_DEPTH:
            todo += [(a, b, depth + 1) for tag, a, b in reversed(inner) if tag & 0x20]
    return (algorithm, min(found)[1]) if algorithm and found else (algorithm, None)


def embedded(data: bytes) -> tuple[int, bool]:
    """(certificates, whether an attribute holds a timestamp)."""
    stamped = data.find(b"\x06" + bytes([len(TIMESTAMP)]) + TIMESTAMP) >= 0
    for tag, a, b in elements(data):
        inner = list(elements(data, a, b))
        if tag == 0x30 and len(inner) > 1 and inner[0][0] == 0x06 and data[slice(*inner[0][1:])] == SIGNED_DATA:
            for _, c, d in elements(data, *inner[1][1:]):
                sets = [x for x in elements(data, c, d) if x[0] == 0xA0]
                return (len([x for x in elements(data, *sets[0][1:]) if x[0] == 0x30]) if sets else 0), stamped
    return 0, stamped
