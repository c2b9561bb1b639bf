"""Media columns: payloads kept losslessly in baseline JPEG, read back through a DC-only decoder.

A payload byte becomes one flat 8x8 block of a grey baseline JPEG.  With a DC
quantiser of 8 the coefficient of a flat block of value v is exactly v - 128,
so every JPEG reader shows the payload as the picture at an eighth of its
size, and the DC-only luminance thumbnail *is* the payload.  Scans have a
restart marker after every ``INTERVAL`` blocks; intervals start at a byte and
know nothing of each other, so numpy decodes all of a batch side by side, one
block of each interval per step, through a table that takes 16 bits to a whole
block (DC code, DC bits and end-of-block).

The reader parses markers (SOI, APPn, COM, DQT, SOF0, DHT, DRI, SOS, RSTn,
EOI), skips fill bytes, takes any DC and AC Huffman tables and quantiser, and
also handles AC coefficients of real files, slowly (``decode_thumbnail``).
Progressive or arithmetic files are refused.

Defined results: a null text counts as empty; an empty payload is padded to
192 bytes; payloads beyond one picture's size go on in further pictures, one
after the other in the same media value; repeated rows give equal values; columns
other than id and text are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import map_batches, texts_of

UNIT = 192  #: payloads are padded to a multiple of this
INTERVAL = 192  #: blocks from one restart marker to the next
MOST_WIDE, MOST_HIGH = 8064, 8191  #: blocks of one picture; 65,535 pixels at most

#: Our DC table: code lengths of the categories 0 to 9 (canonical order below); AC: only end-of-block, one bit.
DC_LENGTHS = {7: 2, 4: 2, 3: 3, 0: 4, 1: 4, 2: 4, 5: 4, 6: 5, 8: 6, 9: 7}


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Huffman codes, by the order a DHT segment gives: symbol -> (code, bits)."""
    code, last, out = 0, 0, {}
    for symbol, bits in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= bits - last
        out[symbol], last = (code, bits), bits
        code += 1
    return out


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    symbols = [s for s, _ in sorted(lengths.items(), key=lambda x: x[1])]
    counts = bytes(sum(b == n for b in lengths.values()) for n in range(1, 17))
    return struct.pack(">BBH", 0xFF, 0xC4, 3 + 16 + len(symbols)) + bytes([kind]) + counts + bytes(symbols)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each difference -255..255 (at +255): bits of the whole block, and how many."""
    codes = _canonical(DC_LENGTHS)
    word, size = np.zeros(511, np.uint32), np.zeros(511, np.uint8)
    for diff in range(-255, 256):
        category = abs(diff).bit_length()
        code, bits = codes[category]
        low = diff if diff >= 0 else diff + (1 << category) - 1
        word[diff + 255] = ((code << category | low) << 1) | 0  # end-of-block is the single bit 0
        size[diff + 255] = bits + category + 1
    return word, size


_WORD, _SIZE = _tables()
_WIDTH = int(_SIZE.max())
#: Bits of each block's word, left-aligned, one per byte; the last 8 rows are 0 to 7 padding ones.
_BITS = np.zeros((511 + 8, _WIDTH), np.uint8)
_LENGTH = np.zeros(511 + 8, np.int64)
for _d in range(511):
    _n = int(_SIZE[_d])
    _LENGTH[_d] = _n
    _BITS[_d, :_n] = [(int(_WORD[_d]) >> (_n - 1 - k)) & 1 for k in range(_n)]
for _n in range(8):
    _LENGTH[511 + _n] = _n
    _BITS[511 + _n, :_n] = 1
_MASK = np.arange(_WIDTH) < _LENGTH[:, None]


def _shape(n: int) -> tuple[int, int]:
    """Blocks across and down for ``n`` (a multiple of 192) blocks: near to 4:3 for long payloads, whole rows always."""
    rows = n // UNIT
    best = 1
    for k in range(1, MOST_WIDE // UNIT + 1):
        if rows % k == 0 and (rows // k > MOST_HIGH or UNIT * k <= rows // k or best == 1 and rows // best > MOST_HIGH):
            best = k
    return UNIT * best, rows // best


def _header(wide: int, high: int) -> bytes:
    quant = bytes([8]) + bytes([1] * 63)
    return (
        b"\xff\xd8"
        + b"\xff\xdb" + struct.pack(">HB", 67, 0) + quant
        + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, high * 8, wide * 8, 1) + bytes([1, 0x11, 0])
        + _dht(0x00, DC_LENGTHS) + _dht(0x10, {0: 1})
        + b"\xff\xdd" + struct.pack(">HH", 4, INTERVAL)
        + b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0x00, 0, 63, 0])
    )


def _scans(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes (stuffed) of all intervals, and the end of each; ``blocks``: intervals x INTERVAL samples."""
    rows = blocks.shape[0]
    level = blocks.astype(np.int16) - 128
    diff = np.empty((rows, INTERVAL + 1), np.int16)
    diff[:, 0] = level[:, 0]
    diff[:, 1:INTERVAL] = level[:, 1:] - level[:, :-1]
    diff[:, :INTERVAL] += 255
    bits = _LENGTH[diff[:, :INTERVAL]].sum(axis=1)
    diff[:, INTERVAL] = 511 + (-bits % 8)
    each = (bits + 7) // 8
    flat = diff.reshape(-1)
    data = np.packbits(_BITS[flat][_MASK[flat]])
    marks = np.flatnonzero(data == 0xFF)
    ends = np.cumsum(each)
    if len(marks):
        ends = ends + np.searchsorted(marks, ends, side="left")
        data = np.insert(data, marks + 1, 0)
    return data, ends


def encode(payloads: Sequence[bytes]) -> list[bytes]:
    """The media value of each payload; lengths must be positive multiples of 192."""
    parts: list[tuple[int, int, int, int]] = []  # payload, rows of 192, across, down
    most = MOST_WIDE * MOST_HIGH
    for k, p in enumerate(payloads):
        if not p or len(p) % UNIT:
            raise ValueError("a payload must be a positive multiple of 192 bytes")
        for start in range(0, len(p), most):
            n = min(most, len(p) - start)
            parts.append((k, n // UNIT, *(_shape(n) if n < most else (MOST_WIDE, MOST_HIGH))))
    out: list[list[bytes]] = [[] for _ in payloads]
    joined = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, INTERVAL)
    row, part = 0, 0
    while part < len(parts):
        last, rows = part, 0
        while last < len(parts) and (rows == 0 or rows + parts[last][1] <= 4096):
            rows += parts[last][1]
            last += 1
        own = [x for k in range(part, last) for x in _coded(joined[row : row + rows], [parts[k]])] if rows > 65536 else _coded(joined[row : row + rows], parts[part:last])
        for (k, *_), media in zip(parts[part:last], own, strict=True):
            out[k].append(media)
        row, part = row + rows, last
    return [b"".join(x) for x in out]


def _coded(blocks: np.ndarray, parts: list[tuple[int, int, int, int]]) -> list[bytes]:
    """Pictures over successive rows of ``blocks``, in steps of bounded size."""
    pieces: list[bytes] = []
    step = 4096
    for start in range(0, len(blocks), step):
        data, ends = _scans(blocks[start : start + step])
        whole, at = data.tobytes(), 0
        for end in ends.tolist():
            pieces.append(whole[at:end])
            at = end
    out, at = [], 0
    for _, rows, wide, high in parts:
        own = []
        for k in range(rows):
            if k:
                own.append(bytes([0xFF, 0xD0 + (k - 1) % 8]))
            own.append(pieces[at + k])
        out.append(_header(wide, high) + b"".join(own) + b"\xff\xd9")
        at += rows
    return out


# -- reading -----------------------------------------------------------------


class Picture:
    """Parsed markers of one baseline JPEG."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no SOI marker")
        self.quant: dict[int, list[int]] = {}
        self.huffman: dict[int, tuple[bytes, bytes]] = {}
        self.interval, self.parts, at = 0, [], at + 2
        self.width = self.height = 0
        while True:
            if data[at] != 0xFF:
                raise ValueError(f"no marker at byte {at}")
            while data[at] == 0xFF:  # fill bytes may stand before a marker
                at += 1
            marker, at = data[at], at + 1
            if marker == 0xD9:
                raise ValueError("a picture without a scan")
            n = struct.unpack_from(">H", data, at)[0]
            body, at = data[at + 2 : at + n], at + n
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide, name = body[k] >> 4, body[k] & 15
                    size = 128 if wide else 64
                    self.quant[name] = list(struct.unpack(f">{'64H' if wide else '64B'}", body[k + 1 : k + 1 + size]))
                    k += 1 + size
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    counts = body[k + 1 : k + 17]
                    m = sum(counts)
                    self.huffman[body[k]] = (counts, body[k + 17 : k + 17 + m])
                    k += 17 + m
            elif marker == 0xC0:
                depth, self.height, self.width, m = struct.unpack_from(">BHHB", body)
                if depth != 8 or not self.width or not self.height:
                    raise ValueError("only 8-bit samples and known sizes")
                self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(m)]
            elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError(f"not baseline (SOF marker {marker:#x})")
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                break
        self.start = at
        if not self.parts:
            raise ValueError("a scan before SOF0")

    def luminance(self) -> tuple[int, int, int]:
        """Quantiser of the DC coefficient, and the DC and AC tables, of the first component."""
        name, _, _, quant = self.parts[0]
        own = next(x for x in self.scan if x[0] == name)
        return self.quant[quant][0], own[1], 0x10 | own[2]


def _codes(table: tuple[bytes, bytes]) -> dict[tuple[int, int], int]:
    counts, symbols = table
    code, k, out = 0, 0, {}
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            out[bits, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


_BLOCKS: dict = {}


def _block_table(dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """From 16 bits to the DC difference and the length of a whole block (0: not a DC-only block of 16 bits)."""
    if (dc, ac) in _BLOCKS:
        return _BLOCKS[dc, ac]
    diff, size = np.zeros(65536, np.int32), np.zeros(65536, np.int64)
    end = [(bits, code) for (bits, code), s in _codes(ac).items() if s == 0]
    for (bits, code), category in _codes(dc).items():
        for end_bits, end_code in end:
            total = bits + category + end_bits
            if total > 16:
                continue
            for low in range(1 << category):
                value = low if category == 0 or low >> (category - 1) else low - (1 << category) + 1
                first = ((code << category | low) << end_bits | end_code) << (16 - total)
                diff[first : first + (1 << (16 - total))] = value
                size[first : first + (1 << (16 - total))] = total
    if len(_BLOCKS) > 16:
        _BLOCKS.clear()
    _BLOCKS[dc, ac] = diff, size
    return diff, size


def _intervals(data: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scan bytes without stuffing, the first byte of each interval there (and the end), and where the scan ends."""
    marks = np.flatnonzero(data[start:-1] == 0xFF) + start
    after = data[marks + 1]
    stop = marks[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    if not len(stop):
        raise ValueError("a scan without an end")
    stop = int(stop[0])
    keep = marks < stop
    marks, after = marks[keep], after[keep]
    restart = marks[after != 0]
    gone = np.sort(np.concatenate([marks[after == 0] + 1, restart, restart + 1])) - start
    body = np.delete(data[start:stop], gone)
    begins = restart - start - np.searchsorted(gone, restart - start, side="left")
    return body, np.concatenate([[0], begins, [len(body)]]), stop


def decode(medias: Sequence[bytes]) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Of each media value: the DC-only luminance samples, row by row, and the size in blocks of each picture."""
    out: list[tuple[list, list]] = [([], []) for _ in medias]
    waiting: list[tuple] = []
    held = 0
    for k, media in enumerate(medias):
        data, at = np.frombuffer(media, np.uint8), 0
        while at < len(media):
            p = Picture(media, at)
            quant, dc, ac = p.luminance()
            body, begins, stop = _intervals(data, p.start)
            wide, high = -(-p.width // 8), -(-p.height // 8)
            at = stop + 2
            out[k][1].append((wide, high))
            job = (k, len(out[k][0]), quant, p.huffman[dc], p.huffman[ac], body, begins, p.interval or wide * high, wide * high)
            out[k][0].append(None)
            if len(p.parts) != 1 or p.parts[0][1] * p.parts[0][2] != 1:
                raise ValueError("payloads are stored in one component")
            if waiting and (held > 1 << 20 or waiting[0][2:5] != job[2:5] or waiting[0][7] != job[7]):
                _lockstep(waiting, out)
                waiting, held = [], 0
            waiting.append(job)
            held += len(body)
    if waiting:
        _lockstep(waiting, out)
    return [(b"".join(x), sizes) for x, sizes in out]


def _lockstep(jobs: list[tuple], out: list) -> None:
    """Decode all intervals of these pictures side by side."""
    diff, size = _block_table(jobs[0][3], jobs[0][4])
    quant, interval = jobs[0][2], jobs[0][7]
    data = np.concatenate([*(j[5] for j in jobs), np.full(4, 255, np.uint8)]).astype(np.uint32)
    window = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    shift, at, end, blocks = 0, [], [], []
    for j in jobs:
        n = len(j[6]) - 1
        if n != -(-j[8] // interval):
            raise ValueError("a picture with too few or too many intervals")
        at.append(j[6][:-1] + shift)
        end.append(j[6][1:] + shift)
        own = np.full(n, interval)
        own[-1] = j[8] - interval * (n - 1)
        blocks.append(own)
        shift += len(j[5])
    position, end, blocks = np.concatenate(at).astype(np.int64) * 8, np.concatenate(end) * 8, np.concatenate(blocks)
    steps = int(blocks.max())
    level = np.zeros((len(position), steps), np.int16)
    now = np.zeros(len(position), np.int32)
    whole = bool((blocks == steps).all())
    for k in range(steps):
        code = (window[position >> 3] >> (8 - (position & 7)).astype(np.uint32)) & 0xFFFF
        n = size[code]
        if whole:
            if not n.all():
                raise ValueError("a block with more than its DC coefficient")
            now += diff[code]
            position += n
        else:
            live = blocks > k
            if not n[live].all():
                raise ValueError("a block with more than its DC coefficient")
            now += np.where(live, diff[code], 0)
            position += np.where(live, n, 0)
        level[:, k] = now
    if (position > end).any() or (end - position > 7).any():
        raise ValueError("an interval ends too early or too late")
    value = np.clip(np.rint(level * (quant / 8.0)) + 128, 0, 255).astype(np.uint8)
    row = 0
    for j in jobs:
        n = len(j[6]) - 1
        out[j[0]][0][j[1]] = value[row : row + n].reshape(-1)[: j[8]].tobytes()
        row += n


def decode_thumbnail(media: bytes) -> np.ndarray:
    """DC-only luminance thumbnail (an eighth of the size) of any baseline JPEG of one scan, colour and AC included."""
    p = Picture(media)
    body, begins, _ = _intervals(np.frombuffer(media, np.uint8), p.start)
    bits, codes = np.unpackbits(body).tolist(), {k: _codes(v) for k, v in p.huffman.items()}
    across, down = max(x[1] for x in p.parts), max(x[2] for x in p.parts)
    mcus_x, mcus_y = -(-p.width // (8 * across)), -(-p.height // (8 * down))
    tables = {name: (dc, 0x10 | ac) for name, dc, ac in p.scan}
    h, v, quant = p.parts[0][1], p.parts[0][2], p.quant[p.parts[0][3]][0]
    thumb = np.zeros((mcus_y * v, mcus_x * h))
    at, interval = 0, p.interval or mcus_x * mcus_y

    def symbol(table: dict) -> int:
        nonlocal at
        code = 0
        for n in range(1, 17):
            code, at = code << 1 | bits[at], at + 1
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such Huffman code")

    last: dict[int, int] = {}
    for mcu in range(mcus_x * mcus_y):
        if mcu % interval == 0:
            at, last = int(begins[mcu // interval]) * 8, {x[0]: 0 for x in p.parts}
        for k, (name, ch, cv, _) in enumerate(p.parts):
            dc, ac = (codes[t] for t in tables[name])
            for block in range(ch * cv):
                n = symbol(dc)
                low, at = int("".join(map(str, bits[at : at + n])) or "0", 2), at + n
                last[name] += low if n == 0 or low >> (n - 1) else low - (1 << n) + 1
                done = 1
                while done < 64:
                    s = symbol(ac)
                    if s == 0:
                        break
                    done, at = done + 1 + (s >> 4), at + (s & 15)
                if k == 0:
                    thumb[mcu // mcus_x * v + block // ch, mcu % mcus_x * h + block % ch] = last[name] * quant / 8 + 128
    return np.clip(np.rint(thumb[: -(-p.height // 8), : -(-p.width // 8)]), 0, 255).astype(np.uint8)


def thumbnail_hashes(samples: bytes, wide: int, high: int) -> tuple[str, str]:
    """Average and difference hash (64 bits each, hex) of an 8x8 and a 9x8 mean of the thumbnail."""
    grid = np.frombuffer(samples, np.uint8).reshape(high, wide)

    def mean(columns: int, rows: int) -> np.ndarray:
        # edges of equal shares; a thumbnail of fewer rows repeats them
        y, x = np.arange(rows) * high // rows, np.arange(columns) * wide // columns
        tall = np.add.reduceat(grid.astype(np.int64), np.unique(y), axis=0)
        full = np.add.reduceat(tall, np.unique(x), axis=1)
        ny, nx = np.diff(np.append(np.unique(y), high)), np.diff(np.append(np.unique(x), wide))
        full = full / ny[:, None] / nx[None, :]
        return full[np.searchsorted(np.unique(y), y)][:, np.searchsorted(np.unique(x), x)]

    small, slope = mean(8, 8), mean(9, 8)
    return np.packbits(small > small.mean()).tobytes().hex(), np.packbits(slope[:, 1:] > slope[:, :-1]).tobytes().hex()


def pad(text: bytes) -> bytes:
    """The text and spaces up to a positive multiple of 192 bytes."""
    return text + b" " * (-len(text) % UNIT or (0 if text else UNIT))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes (unpadded) and media (binary), the stored form."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [x.encode("utf-8") for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(encode([pad(x) for x in raw]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_batches(texts_of(docs, id_col, text_col), per_batch, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Of ``media_columns``: payload read back from the stored bytes, digests, dimensions and thumbnail hashes."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        stored = batch.column(2).to_pylist()
        rows = []
        for whole, (payload, sizes) in zip(stored, decode(stored), strict=True):
            wide, hashes, at = sizes[0][0], [], 0
            for w, h in sizes:
                hashes.append(":".join(thumbnail_hashes(payload[at : at + w * h], w, h)))
                at += w * h
            rows.append((
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(whole), hashlib.sha256(whole).hexdigest(),
                f"{wide * 8}x{sizes[0][1] * 8}x{len(sizes)}:{'+'.join(hashes)}", wide * 8, sum(h for _, h in sizes) * 8,
            ))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
        columns = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"])

    return map_batches(media.select("doc_id", "n_bytes", "media"), per_batch, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int")
