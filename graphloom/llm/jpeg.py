"""Media columns: texts stored as baseline JPEG streams, read back through a Huffman decoder of DC-only luminance thumbnails.

Writing. The payload is one luminance image of flat 8x8 blocks: the DC quantiser is 8, so a block's quantised DC coefficient is its byte
less 128 and each of its 64 samples is that byte. Any baseline decoder shows the payload's bytes, and the DC-only thumbnail *is* the
payload. Blocks stand in rows of 24 with a restart marker after every row. A stream holds at most 24 x 8184 blocks; a longer
payload becomes several streams, one after another.

Reading. Markers are parsed for each stream; all restart segments of all streams of a batch are then decoded side
by side, one Huffman symbol at a time, as numpy vectors. Any baseline stream is read (several components, subsampling, non-interleaved scans,
with or without restarts); AC coefficients are parsed and skipped.

Defined results: null counts as the empty text; the payload is the UTF-8 text and bytes 255 up to a positive
multiple of 576, so an empty text is stored as 576 bytes; repeated rows have equal results. A stream that cannot be parsed has no thumbnail; neither has one whose
scan holds an unknown code, lacks a restart segment or has them out of order, or whose segments don't end where their last block does. Long texts are encoded and decoded in
runs of whole streams, so memory beyond the text and its stored form is bounded.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textbatch import chunks

UNIT = 576
ACROSS = 24
MOST_ROWS = 8184
#: Bytes of a payload that are encoded at once: whole streams.
RUN = 5 * ACROSS * MOST_ROWS
#: Numbers of DC luminance codes by length, and their symbols (ITU-T T.81, table K.3).
DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: The only AC symbol is "end of block".
AC_BITS = (1,) + (0,) * 15
AC_SYMBOLS = (0,)


def _codes(bits: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), codes in canonical order."""
    out, code, i = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[symbols[i]] = (code, length)
            code += 1
            i += 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    out = b"\xff\xd8" + _segment(0xDB, bytes([0, 8] + [1] * 63))
    out += _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * rows, 8 * ACROSS, 1, 1, 0x11, 0))
    out += _segment(0xC4, bytes([0x00, *DC_BITS, *DC_SYMBOLS])) + _segment(0xC4, bytes([0x10, *AC_BITS, *AC_SYMBOLS]))
    return out + _segment(0xDD, struct.pack(">H", ACROSS)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each difference from -255 to 255, with its magnitude bits and the end of block."""
    dc, (end, end_length) = _codes(DC_BITS, DC_SYMBOLS), _codes(AC_BITS, AC_SYMBOLS)[0]
    code, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        c, n = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        code[d + 255] = ((c << size | extra) << end_length) | end
        length[d + 255] = n + size + end_length
    return code, length


_CODE, _LENGTH = _tables()
_HEADERS: dict[int, bytes] = {}
#: A marker that ends a scan's data.
_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)


def encode(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload, whose size is a positive multiple of UNIT."""
    data = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64).reshape(-1, ACROSS)
    value = data - 128
    diff = value.copy()
    diff[:, 1:] -= value[:, :-1]
    code, length = _CODE[diff + 255], _LENGTH[diff + 255]
    ends = np.cumsum(length, axis=1)
    size = (ends[:, -1] + 7) >> 3
    first = np.cumsum(size) - size
    start = (first * 8)[:, None] + ends - length
    shifted = (code << (24 - length - (start & 7))).ravel()
    at = (start >> 3).ravel()
    total = int(size.sum())
    stream = np.zeros(total + 2)
    for k in range(3):
        stream += np.bincount(at + k, (shifted >> (16 - 8 * k)) & 255, total + 2)[: total + 2]
    stream = stream[:total].astype(np.uint8)
    stream[first + size - 1] |= ((1 << (8 * size - ends[:, -1])) - 1).astype(np.uint8)
    # a zero after each byte 255, and a marker after each row
    stuffed = stream == 255
    row = np.repeat(np.arange(len(size)), size)
    before = np.cumsum(stuffed) - stuffed
    place = np.arange(total) + before + 2 * row
    out = np.zeros(total + int(stuffed.sum()) + 2 * len(size), np.uint8)
    out[place] = stream
    row_end = place[first + size - 1] + 1 + stuffed[first + size - 1]
    rows = np.array([len(p) // ACROSS for p in payloads])
    frames = [min(MOST_ROWS, n - s) for n in rows.tolist() for s in range(0, n, MOST_ROWS)]
    frame_last = np.cumsum(frames) - 1
    number = np.arange(len(size)) - np.repeat(frame_last - np.array(frames) + 1, frames)
    marker = (0xD0 + number % 8).astype(np.uint8)
    marker[frame_last] = 0xD9
    out[row_end] = 255
    out[row_end + 1] = marker
    raw, stops = out.tobytes(), (row_end[frame_last] + 2).tolist()
    stored, at, f = [], 0, 0
    for n in rows.tolist():
        parts = []
        for _ in range(-(-n // MOST_ROWS)):
            parts += [_HEADERS.setdefault(frames[f], _header(frames[f])), raw[at : stops[f]]]
            at = stops[f]
            f += 1
        stored.append(b"".join(parts))
    return stored


@dataclass
class Scan:
    """A scan's data and what it takes to read it."""

    image: int
    start: int
    blocks: tuple[tuple[int, bytes, bytes], ...]  # (component, DC table, AC table) of each block of an MCU
    across: int
    down: int
    restart: int


@dataclass
class Image:
    stream: int
    width: int
    height: int
    across: int  # luminance blocks, with those that fill the last MCUs
    down: int
    h: int
    v: int
    quantiser: int


def _parse(data: bytes, stream: int, base: int, images: list[Image], scans: list[Scan]) -> None:
    """Appends the images of a stored form, and their scans with luminance; ValueError if it can't be read."""
    i, n = 0, len(data)
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    quant: dict[int, int] = {}
    huff: dict[int, bytes] = {}
    parts: dict[int, tuple[int, int, int]] = {}
    restart = 0
    while i + 4 <= n:
        if data[i] != 0xFF:
            raise ValueError("no marker")
        m = data[i + 1]
        if m == 0xFF:
            i += 1
            continue
        if m in (0xD8, 0xD9):
            i += 2
            continue
        size = data[i + 2] << 8 | data[i + 3]
        body = data[i + 4 : i + 2 + size]
        if len(body) != size - 2:
            raise ValueError("cut off")
        i += 2 + size
        if m == 0xDB:
            j = 0
            while j < len(body):
                wide = body[j] >> 4
                quant[body[j] & 15] = body[j + 1] << 8 | body[j + 2] if wide else body[j + 1]
                j += 129 if wide else 65
        elif m == 0xC4:
            j = 0
            while j < len(body):
                k = 17 + sum(body[j + 1 : j + 17])
                huff[body[j]] = body[j + 1 : j + k]
                j += k
        elif m == 0xDD:
            restart = body[0] << 8 | body[1]
        elif m in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("not 8 bits")
            height, width = body[1] << 8 | body[2], body[3] << 8 | body[4]
            if not height or not width:
                raise ValueError("no size")
            order = [body[6 + 3 * k] for k in range(body[5])]
            parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])}
            most_h, most_v = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
            mcus = (-(-width // (8 * most_h)), -(-height // (8 * most_v)))
            h, v, q = parts[order[0]]
            images.append(Image(stream, width, height, mcus[0] * h, mcus[1] * v, h, v, quant[q]))
        elif 0xC2 <= m <= 0xCF and m != 0xC8 and m != 0xCC:
            raise ValueError("not baseline")
        elif m == 0xDA:
            inside = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            if not parts or order[0] in [c for c, _ in inside]:
                image = images[-1]
                if len(inside) == 1:
                    own = parts[inside[0][0]]
                    across, down = -(-(-(-image.width * own[0] // most_h)) // 8), -(-(-(-image.height * own[1] // most_v)) // 8)
                    blocks = ((0, huff[inside[0][1] >> 4], huff[0x10 | inside[0][1] & 15]),)
                else:
                    across, down = mcus
                    blocks = tuple((k, huff[t >> 4], huff[0x10 | t & 15]) for k, (c, t) in enumerate(inside) for _ in range(parts[c][0] * parts[c][1]))
                    if inside[0][0] != order[0]:
                        raise ValueError("luminance is not first")
                scans.append(Scan(len(images) - 1, base + i, blocks, across, down, restart))
            end = _END.search(data, i)
            i = end.start() if end else n


_LOOKUP: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: the symbol they begin with, times 32, plus its code's length (0: no code)."""
    if table not in _LOOKUP:
        out = np.zeros(1 << 16, np.int32)
        for symbol, (code, length) in _codes(tuple(table[:16]), tuple(table[16:])).items():
            out[code << (16 - length) : (code + 1) << (16 - length)] = symbol * 32 + length
        if len(_LOOKUP) > 64:
            _LOOKUP.clear()
        _LOOKUP[table] = out
    return _LOOKUP[table]


def thumbnails(stored: list[bytes]) -> list[list[tuple[int, int, np.ndarray]] | None]:
    """For each stored form its images as (width, height, DC-only luminance), or None if it can't be read."""
    images: list[Image] = []
    scans: list[Scan] = []
    bad = set()
    base = 0
    for s, data in enumerate(stored):
        marks = len(images), len(scans)
        try:
            _parse(data, s, base, images, scans)
            if len(images) == marks[0] or {x.image for x in scans[marks[1] :]} != set(range(marks[0], len(images))):
                raise ValueError("no image")
        except (ValueError, IndexError, KeyError):
            bad.add(s)
            del images[marks[0] :], scans[marks[1] :]
        base += len(data)
    d = np.frombuffer(b"".join(stored) + b"\xff\xd9" + bytes(8), np.uint8)
    planes = [np.zeros((m.down, m.across), np.int64) for m in images]
    for layout in dict.fromkeys(x.blocks for x in scans):
        bad |= {images[i].stream for i in _decode(d, [x for x in scans if x.blocks == layout], images, planes)}
    out: list = [None if s in bad else [] for s in range(len(stored))]
    for m, p in zip(images, planes, strict=True):
        if m.stream not in bad:
            mean = np.clip((p * m.quantiser + 1028) // 8, 0, 255).astype(np.uint8)
            out[m.stream].append((m.width, m.height, mean))
    return out


def _decode(d: np.ndarray, scans: list[Scan], images: list[Image], planes: list[np.ndarray]) -> set[int]:
    """Fills the planes with quantised DC coefficients of scans with the same blocks to an MCU; the images whose scans are damaged."""
    damaged: set[int] = set()
    blocks = scans[0].blocks
    ff = np.flatnonzero(d[:-1] == 255)
    after = d[ff + 1]
    restarts = ff[(after >= 0xD0) & (after <= 0xD7)]
    stops = ff[(after > 0) & (after < 0xD0) | (after > 0xD7) & (after < 255)]
    keep = np.ones(len(d), bool)
    keep[ff[after == 0] + 1] = False
    keep[ff[after == 255]] = False  # fill before a marker
    place = np.cumsum(keep) - keep
    starts, finish, owners, mcu0, mcus = [], [], [], [], []
    for k, s in enumerate(scans):
        stop = stops[np.searchsorted(stops, s.start)]
        total = s.across * s.down
        if s.restart:
            a, b = np.searchsorted(restarts, (s.start, stop))
            n = min(b - a + 1, -(-total // s.restart))
            at = np.concatenate([[s.start], restarts[a : a + n - 1] + 2])
            if b - a + 1 != -(-total // s.restart) or (d[restarts[a:b] + 1] - 0xD0 != np.arange(b - a) % 8).any():
                damaged.add(s.image)
            finish.append(np.append(restarts[a : a + n - 1], stop))
            m0 = np.arange(n) * s.restart
            size = np.minimum(s.restart, total - m0)
        else:
            at, m0, size = np.array([s.start]), np.zeros(1, np.int64), np.array([total])
            finish.append(np.array([stop]))
        starts.append(at)
        owners.append(np.full(len(at), k))
        mcu0.append(m0)
        mcus.append(size)
    bit = place[np.concatenate(starts)] * 8
    owner, first, many = np.concatenate(owners), np.concatenate(mcu0), np.concatenate(mcus)
    flat = np.concatenate([d[keep], np.zeros(8, np.uint8)]).astype(np.int64)
    word = flat[:-3] << 24 | flat[1:-2] << 16 | flat[2:-1] << 8 | flat[3:]
    limit = (len(word) - 1) * 8
    order = np.argsort(-many, kind="stable")
    bit, owner, first, many = bit[order], owner[order], first[order], many[order]
    finish = place[np.concatenate(finish)][order] * 8
    wrong = np.zeros(len(many), bool)
    luma = sum(c == blocks[0][0] for c, _, _ in blocks)
    got = np.zeros((int(many[0]) if len(many) else 0, luma, len(many)), np.int16)
    before = np.zeros((max(c for c, _, _ in blocks) + 1, len(many)), np.int64)

    def peek(p: np.ndarray) -> np.ndarray:
        return (word[p >> 3] >> (16 - (p & 7))) & 0xFFFF

    for m in range(got.shape[0]):
        n = int(np.searchsorted(-many, -m, "left"))  # lanes that still have an MCU
        b = bit[:n]
        for j, (c, dc, ac) in enumerate(blocks):
            entry = _lookup(dc)[peek(b)]
            wrong[:n] |= (entry & 31) == 0
            b = b + (entry & 31)
            size = entry >> 5
            extra = peek(b) >> (16 - size)
            extra = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
            b = b + size
            before[c, :n] += extra
            if j < luma:
                got[m, j, :n] = before[c, :n]
            lanes, k, at = None, np.ones(n, np.int64), b
            while len(at):  # AC symbols, until the end of block
                entry = _lookup(ac)[peek(np.minimum(at, limit))]
                symbol, length = entry >> 5, entry & 31
                if lanes is None:
                    wrong[:n] |= length == 0
                else:
                    wrong[lanes] |= length == 0
                at = at + length + (symbol & 15)
                k = k + (symbol >> 4) + 1
                on = (symbol != 0) & (k < 64) & (length > 0) & (at < limit)
                if lanes is None:
                    b = at
                    lanes = np.flatnonzero(on)
                else:
                    b[lanes] = at
                    lanes = lanes[on]
                at, k = at[on], k[on]
            b = np.minimum(b, limit)
        bit[:n] = b
    wrong |= (bit > finish) | (bit <= finish - 8)
    damaged |= {scans[k].image for k in np.unique(owner[wrong]).tolist()}
    plain = np.array([len(blocks) == 1 and s.across == images[s.image].across for s in scans])
    sizes = np.array([planes[s.image].size if p else 0 for s, p in zip(scans, plain, strict=True)])
    if plain.all():
        joined, base = np.zeros(int(sizes.sum()), np.int64), np.cumsum(sizes) - sizes
        to = base[owner] + first
        for m in range(got.shape[0]):
            n = int(np.searchsorted(-many, -m, "left"))
            joined[to[:n] + m] = got[m, 0, :n]
        for s, at, size in zip(scans, base.tolist(), sizes.tolist(), strict=True):
            planes[s.image][:] = joined[at : at + size].reshape(planes[s.image].shape)
        return damaged
    for i, k in enumerate(owner.tolist()):
        s, n = scans[k], int(many[i])
        image = images[s.image]
        index = first[i] + np.arange(n)
        y, x = index // s.across, index % s.across
        plane = planes[s.image]
        if len(blocks) == 1:
            plane[y, x] = got[:n, 0, i]
        else:
            for j in range(luma):
                plane[y * image.v + j // image.h, x * image.h + j % image.h] = got[:n, j, i]
    return damaged


def average_hash(thumbnail: np.ndarray) -> str:
    """16 hex digits: which of 8 x 8 areas are brighter than their mean."""
    rows, columns = (np.linspace(0, n, 9).astype(int) for n in thumbnail.shape)
    sums = np.add.reduceat(np.add.reduceat(thumbnail.astype(np.int64), np.minimum(rows[:-1], thumbnail.shape[0] - 1), axis=0), np.minimum(columns[:-1], thumbnail.shape[1] - 1), axis=1)
    areas = sums / np.outer(np.maximum(np.diff(rows), 1), np.maximum(np.diff(columns), 1))
    return np.packbits(areas > areas.mean()).tobytes().hex()


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def _stored(array: pa.Array) -> Iterator[tuple[int, list[bytes], list[bytes], list]]:
    """(first row, texts, stored forms, thumbnails read back)."""
    for row, part in chunks(array):
        texts = part.to_pylist()
        if len(texts) == 1 and len(texts[0]) > RUN:
            whole = payload(texts[0])
            runs = [encode([whole[i : i + RUN]])[0] for i in range(0, len(whole), RUN)]
            thumbs = [t for r in runs for t in thumbnails([r])[0]]
            yield row, texts, [b"".join(runs)], [thumbs]
            continue
        stored = encode([payload(t) for t in texts])
        yield row, texts, stored, thumbnails(stored)


def _feature(images: list[tuple[int, int, np.ndarray]]) -> str:
    return f"{images[0][0]}x{sum(h for _, h, _ in images)}:{average_hash(np.concatenate([t for _, _, t in images]))}"


def media(docs: DataFrame) -> DataFrame:
    """doc_id, media (the stored form), n_bytes, feature (dimensions and thumbnail hash): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts, stored, thumbs in _stored(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array(stored, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([_feature(t) for t in thumbs], pa.string())], names=["doc_id", "media", "n_bytes", "feature"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, media binary, n_bytes long, feature string")


def read_thumbnails(table: DataFrame, column: str = "media") -> DataFrame:
    """The table with width, height, thumbnail (rows joined, of all images) and feature of its streams; null where one can't be read."""

    @F.arrow_udf("width int, height int, thumbnail binary, feature string")
    def read(media: pa.Array) -> pa.Array:
        found = thumbnails([x or b"" for x in media.to_pylist()])
        rows = [None if t is None else {"width": t[0][0], "height": sum(h for _, h, _ in t), "thumbnail": b"".join(x.tobytes() for _, _, x in t), "feature": _feature(t) if len({x.shape[1] for _, _, x in t}) == 1 else None} for t in found]
        return pa.array(rows, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("thumbnail", pa.binary()), ("feature", pa.string())]))

    return table.withColumn("read_back", read(F.col(column)))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; the payload is what the decoder read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts, stored, thumbs in _stored(batch.column(1)):
                back = [b"".join(x.tobytes() for _, _, x in t) for t in thumbs]
                columns = [
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(b) for b in back], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                    pa.array([zlib.crc32(b[-32:]) for b in back], pa.int64()),
                    pa.array([len(m) for m in stored], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in stored], pa.string()),
                    pa.array([_feature(t) for t in thumbs], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
