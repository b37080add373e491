"""A sorted-string table of documents' token ids, one file per shard, through Spark's own writers and readers.

File layout, in this order; integers are little-endian unless said otherwise:

* data blocks. A block holds entries in key order, each as three varints (bytes shared with the key before,
  further key bytes, value bytes) and then the further key bytes and the value; the first entry of a block
  shares nothing. A block is closed at ``BLOCK`` bytes and stored zstd-compressed.
* Bloom filter over the keys: ``BLOOM_BITS`` bits a key, ``BLOOM_HASHES`` probes.
* block index: for each block its last key, offset, stored length and CRC-32.
* footer of 41 bytes: offset and length of the Bloom filter, offset and length of the index, number of
  entries (five u64) and a line feed, which the text writer adds as the end of its line.

A key is one byte (0 null, 1 else) and the id as 8 bytes big-endian with its sign bit flipped, so byte order
is numeric order. A value is the ids as u16. The writer casts each finished image to a string and hands it
to the text sink with one record per file: the bytes go out unchanged, and Spark's commit protocol keeps
exactly one copy of each file when tasks are run again.
"""

from __future__ import annotations

import bisect
import struct
import zlib

BLOCK = 65_536
BLOOM_BITS = 10
BLOOM_HASHES = 7
FOOTER = "<5Qc"
FOOTER_BYTES = struct.calcsize(FOOTER)


def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Gathers entries in key order; finish() gives the file without its final line feed."""

    def __init__(self):
        import zstandard

        self._zstd = zstandard.ZstdCompressor(level=1)
        self._done: list[bytes] = []
        self._index: list[bytes] = []
        self._keys: list[bytes] = []
        self._block = bytearray()
        self._last = b""
        self.size = 0

    def add(self, key: bytes, value: bytes) -> None:
        if self._keys and key < self._keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        while shared < len(self._last) and self._last[shared] == key[shared]:
            shared += 1
        self._block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self._last = key
        self._keys.append(key)
        if len(self._block) >= BLOCK:
            self._close_block()

    def _close_block(self) -> None:
        if self._block:
            stored = self._zstd.compress(bytes(self._block))
            self._index.append(_varint(len(self._last)) + self._last + _varint(self.size) + _varint(len(stored)) + struct.pack("<I", zlib.crc32(stored)))
            self._done.append(stored)
            self.size += len(stored)
            self._block, self._last = bytearray(), b""

    def finish(self) -> bytes:
        self._close_block()
        bits = max(64, len(self._keys) * BLOOM_BITS)
        bloom = bytearray((bits + 7) // 8)
        for key in self._keys:
            for p in _probes(key, len(bloom) * 8):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self._index)
        footer = struct.pack("<5Q", self.size, len(bloom), self.size + len(bloom), len(index), len(self._keys))
        return b"".join([*self._done, bytes(bloom), index, footer])


class Reader:
    """Point lookups and scans over one file's bytes."""

    def __init__(self, data: bytes):
        self._data = memoryview(data)
        *place, end = struct.unpack(FOOTER, self._data[-FOOTER_BYTES:])
        if end != b"\n":
            raise ValueError("not a sorted-string table")
        bloom_at, bloom_len, index_at, index_len, self.entries = place
        self._bloom = self._data[bloom_at : bloom_at + bloom_len]
        index, at = bytes(self._data[index_at : index_at + index_len]), 0
        self.last_keys: list[bytes] = []
        self._places: list[tuple[int, int, int]] = []
        while at < len(index):
            n, at = _read_varint(index, at)
            self.last_keys.append(index[at : at + n])
            offset, at = _read_varint(index, at + n)
            length, at = _read_varint(index, at)
            self._places.append((offset, length, struct.unpack_from("<I", index, at)[0]))
            at += 4

    def may_hold(self, key: bytes) -> bool:
        return all(self._bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self._bloom) * 8))

    def block(self, k: int):
        """(key, value) pairs of block k."""
        import zstandard

        offset, length, crc = self._places[k]
        stored = self._data[offset : offset + length]
        if zlib.crc32(stored) != crc:
            raise ValueError("a block is damaged")
        data, at, key = zstandard.ZstdDecompressor().decompress(stored), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, data[at : at + size]
            at += size

    def get(self, doc_id: int | None) -> bytes | None:
        """The value of doc_id, by Bloom filter, binary search of the index and one block; None if absent."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return None
        k = bisect.bisect_left(self.last_keys, key)
        if k == len(self.last_keys):
            return None
        return next((v for x, v in self.block(k) if x == key), None)

    def get_all(self, doc_id: int | None):
        """The values of all entries of doc_id; entries of one key may run over several blocks."""
        key = key_of(doc_id)
        if self.may_hold(key):
            for k in range(bisect.bisect_left(self.last_keys, key), len(self.last_keys)):
                yield from (v for x, v in self.block(k) if x == key)
                if self.last_keys[k] != key:
                    break

    def scan(self):
        for k in range(len(self._places)):
            yield from self.block(k)
