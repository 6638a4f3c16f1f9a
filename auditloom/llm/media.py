"""Motion-JPEG in AVI: writing, reading by RIFF index, intra-frame decoding, shots.

Frames are baseline grey JPEG. A payload byte becomes one flat 8 x 8 block: its
DC coefficient, quantised by 8, is the byte less 128 exactly, so the stored
samples are lossless; 64 bytes make a 64 x 64 frame. The decoder reads Huffman
tables and AC coefficients too; frames that share their headers are decoded
side by side, a block of each at a time.

Shots are cut where the histogram difference of neighbouring frames exceeds an
adaptive threshold: mean plus a multiple of the deviation over the differences
just before it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the JPEG format: zigzag order, and code lengths of the usual luminance DC table.
ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
DC_COUNTS, DC_SYMBOLS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))
#: Only the end-of-block symbol, one bit long: blocks are flat.
AC_COUNTS, AC_SYMBOLS = [1] + [0] * 15, [0]

FRAME = 64  # samples, and pixels a side
FPS = 25
#: Frames that are coded or decoded side by side.
LANES = 2048
#: Shots: histogram bins, frames looked back on, deviations, least difference (of a frame's samples).
BINS, LOOK_BACK, DEVIATIONS, LEAST = 16, 12, 3.0, 0.25


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol to (code, length)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=1)
def _frame_head() -> bytes:
    tables = bytes([0x00, *DC_COUNTS, *DC_SYMBOLS]) + bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0]) + bytes([8] * 64))
        + _segment(0xC0, struct.pack(">BHHB3B", 8, FRAME, FRAME, 1, 1, 0x11, 0))
        + _segment(0xC4, tables)
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


@lru_cache(maxsize=1)
def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and length of a flat block whose DC differs by -255..255 from the one before."""
    dc, (eob, eob_length) = _codes(DC_COUNTS, DC_SYMBOLS), _codes(AC_COUNTS, AC_SYMBOLS)[0]
    bits, lengths = [], []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        bits.append(((code << size | extra) << eob_length) | eob)
        lengths.append(n + size + eob_length)
    return np.array(bits, np.uint64), np.array(lengths, np.int64)


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded scans of ``samples[frame, 64]``, stuffed, end to end, and their bounds."""
    bits, lengths = _difference_codes()
    step = np.empty(samples.shape, np.int16)
    step[:, 0] = samples[:, 0].astype(np.int16) - 128
    np.subtract(samples[:, 1:], samples[:, :-1], out=step[:, 1:], dtype=np.int16)
    step += 255
    n = lengths[step]
    end = np.cumsum(n, axis=1)
    size = (end[:, -1] + 7) // 8
    first = np.concatenate([[0], np.cumsum(size)])
    at = end - n + 8 * first[:-1, None]
    # A code of at most 18 bits lies in two words of 32; codes share words but no bits.
    value = bits[step] << (64 - n - (at & 31)).view(np.uint64)
    place, total = (at >> 5).ravel(), int(first[-1])
    room = total // 4 + 2
    high = np.bincount(place, (value >> np.uint64(32)).ravel(), room)
    low = np.bincount(place + 1, (value & np.uint64(0xFFFFFFFF)).ravel(), room)
    out = (high + low).astype(">u4").view(np.uint8)[:total].copy()
    spare = 8 * size - end[:, -1]
    out[first[1:] - 1] |= ((1 << spare) - 1).astype(np.uint8)  # the last byte is filled with ones
    stuffed = np.flatnonzero(out == 0xFF)
    if len(stuffed):
        first = first + np.searchsorted(stuffed, first)
        out = np.insert(out, stuffed + 1, 0)
    return out, first


def write_avi(samples: np.ndarray, scans: bytes, bounds: list[int]) -> bytes:
    """An AVI file of one stream with ``len(samples)`` frames and an ``idx1`` index."""
    frames, head = len(samples), _frame_head()
    at = np.array(bounds, np.int64)
    size = np.diff(at) + len(head) + 2
    opening = {n: b"00dc" + struct.pack("<I", n) + head for n in set(size.tolist())}
    ending = (b"\xff\xd9", b"\xff\xd9\0")
    chunks: list[bytes] = []
    for i, n in enumerate(size.tolist()):
        chunks += (opening[n], scans[bounds[i] : bounds[i + 1]], ending[n & 1])
    whole = 8 + size + (size & 1)
    if int(whole.sum()) + 16 * frames + 1024 > 0xFFFFFFFF:
        raise ValueError("the payload needs a file beyond RIFF's 32-bit sizes")
    index = np.zeros((frames, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, size
    index[:, 2] = 4 + np.cumsum(whole) - whole
    largest = int(size.max())
    box = lambda tag, body: tag + struct.pack("<I", len(body)) + body
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, frames, 0, 1, largest, FRAME, FRAME, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, FRAME, FRAME)
    strf = struct.pack("<IiiHH4sIiiII", 40, FRAME, FRAME, 1, 24, b"MJPG", FRAME * FRAME * 3, 0, 0, 0, 0)
    headers = box(b"LIST", b"hdrl" + box(b"avih", avih) + box(b"LIST", b"strl" + box(b"strh", strh) + box(b"strf", strf)))
    body = b"AVI " + headers + box(b"LIST", b"movi" + b"".join(chunks)) + box(b"idx1", index.tobytes())
    return box(b"RIFF", body)


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second, and the frames that the index lists, in its order.

    Without an index the ``movi`` list is walked. Raises ``ValueError`` on what
    is not a whole RIFF AVI file.
    """
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    end = 8 + int.from_bytes(data[4:8], "little")
    if end > len(data):
        raise ValueError("the file is cut short")
    rate, movi, index, lists = float(FPS), None, None, [(12, end)]
    while lists:
        at, stop = lists.pop(0)
        while at + 8 <= stop:
            tag, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if at + 8 + size > stop:
                raise ValueError("a chunk leaves its list")
            if tag == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movi = (at + 8, at + 8 + size)
            elif tag == b"LIST":
                lists.append((at + 12, at + 8 + size))
            elif tag == b"strh" and data[at + 8 : at + 12] == b"vids":
                scale, per = struct.unpack_from("<II", data, at + 28)
                rate = per / scale if scale and per else rate
            elif tag == b"idx1":
                index = (at + 8, at + 8 + size)
            at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no movi list")
    found = []
    if index:
        entries = np.frombuffer(data, "<u4", (index[1] - index[0]) // 16 * 4, index[0]).reshape(-1, 4)
        entries = entries[(entries[:, 0] >> 16) == int.from_bytes(b"dc", "little")]
        if len(entries):
            # Offsets count from the list's type or, in some files, from the file's start.
            at = entries[:, 2].astype(np.int64)
            near = movi[0] + int(at[0])
            at = at + movi[0] if data[near : near + 4] == entries[0, :1].tobytes() else at
            found = list(zip((at + 8).tolist(), entries[:, 3].tolist(), strict=True))
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at + 2 : at + 4] == b"dc":
                found.append((at + 8, size))
            at += 8 + size + (size & 1)
    if any(a + n > end for a, n in found):
        raise ValueError("a frame lies beyond the file")
    return rate, [data[a : a + n] for a, n in found]


@dataclass
class FrameHead:
    """What the segments before a frame's scan say."""

    width: int = 0
    height: int = 0
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, np.ndarray] = field(default_factory=dict)  # 16 bits ahead to length << 8 | symbol
    quant_id: int = 0
    dc: int = 0
    ac: int = 0
    scan: int = 0


@lru_cache(maxsize=256)
def parse_head(head: bytes) -> FrameHead:
    """Parse the segments up to the scan data of a baseline grey frame."""
    out, at = FrameHead(), 2
    if head[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        if at + 4 > len(head) or head[at] != 0xFF:
            raise ValueError("a segment is cut short")
        marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, 128 if body[0] >> 4 else 64
                table = np.zeros(64)
                table[ZIGZAG] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1)
                out.quant[body[0] & 15] = table
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                symbols = list(body[17 : 17 + sum(counts)])
                table = np.zeros(1 << 16, np.int16)
                for symbol, (code, n) in _codes(counts, symbols).items():
                    table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
                out.tables[body[0]] = table
                body = body[17 + sum(counts) :]
        elif marker == 0xC0:
            bits, out.height, out.width, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts != 1:
                raise ValueError("only grey frames of 8 bits are read")
            out.quant_id = body[8]
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline frames are read")
        elif marker == 0xDD and any(body):
            raise ValueError("restart intervals are not read")
        elif marker == 0xDA:
            out.dc, out.ac, out.scan = body[2] >> 4, 0x10 | body[2] & 15, at
            return out


def _head_of(frame: bytes) -> bytes:
    at = frame.find(b"\xff\xda")
    if at < 0:
        raise ValueError("a frame has no scan")
    return frame[: at + 2 + int.from_bytes(frame[at + 2 : at + 4], "big")]


def decode_frames(frames: list[bytes]) -> tuple[np.ndarray, dict[tuple[int, int], np.ndarray], FrameHead]:
    """Blocks of frames that share their headers.

    Returns mean sample values ``[frame, block]`` in float, the pixels of those
    blocks that are not flat, by (frame, block), and the headers.
    """
    text = _head_of(frames[0])
    head = parse_head(text)
    if not all(f.startswith(text) for f in frames):
        raise ValueError("frames differ in their headers")
    blocks = -(-head.width // 8) * -(-head.height // 8)
    scans = [f[head.scan : f.rfind(b"\xff\xd9")].replace(b"\xff\0", b"\xff") for f in frames]
    first = np.concatenate([[0], np.cumsum([len(s) + 8 for s in scans])])
    data = np.frombuffer(b"".join([x for s in scans for x in (s, b"\xff" * 8)]) + b"\xff" * 8, np.uint8)
    ahead = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    words = np.ascontiguousarray(ahead).view(">u8").ravel().astype(np.uint64)
    limit = 8 * first[1:]
    at, lanes = 8 * first[:-1], len(frames)
    dc_table, ac_table, quant = head.tables[head.dc], head.tables[head.ac], head.quant[head.quant_id]
    level, levels, rough = np.zeros(lanes, np.int64), np.zeros((blocks, lanes), np.int64), {}
    u, damaged = np.uint64, np.zeros(lanes, bool)
    for block in range(blocks):
        word = words[np.minimum(at, limit) >> 3] << (at & 7).view(u)
        code = dc_table[(word >> u(48)).view(np.int64)].astype(np.int64)
        n, size = code >> 8, code & 255
        damaged |= n == 0
        word <<= n.view(u)
        value = ((word >> u(1)) >> (63 - size).view(u)).view(np.int64)
        half = (1 << size) >> 1
        level += value - (value < half) * (2 * half - 1)
        word <<= size.view(u)
        code = ac_table[(word >> u(48)).view(np.int64)]
        damaged |= code == 0
        at = at + (n + size)
        levels[block] = level
        detail = (code & 255) != 0
        if detail.any():
            at += np.where(detail, 0, code >> 8)
            if damaged.any() or (at > limit).any():
                raise ValueError("a scan is damaged")
            for lane in np.flatnonzero(detail).tolist():
                at[lane], rough[lane, block] = _rough_block(words, int(at[lane]), int(level[lane]), ac_table, quant, int(limit[lane]))
        else:
            at += code >> 8
    if damaged.any() or (at > limit).any():
        raise ValueError("a scan is damaged")
    means = (levels * (quant[0] / 8) + 128).T
    for (lane, block), pixels in rough.items():
        means[lane, block] = pixels.mean()
    return means, rough, head


def _rough_block(words: np.ndarray, at: int, dc: int, table: np.ndarray, quant: np.ndarray, limit: int) -> tuple[int, np.ndarray]:
    """A block with AC coefficients: the bit after it, and its pixels."""
    coefficients, k = np.zeros(64), 1
    coefficients[0] = dc
    while k < 64:
        ahead = int(words[at >> 3]) << (at & 7) & (1 << 64) - 1
        code = int(table[ahead >> 48])
        n, run, size = code >> 8, code >> 4 & 15, code & 15
        if not n or at > limit:
            raise ValueError("a scan is damaged")
        at += n + size
        if not size:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("a scan is damaged")
        value = ahead >> (64 - n - size) & (1 << size) - 1
        coefficients[ZIGZAG[k]] = value if value >> (size - 1) else value - (1 << size) + 1
        k += 1
    return at, np.clip(_COSINES.T @ (coefficients * quant).reshape(8, 8) @ _COSINES + 128, 0, 255)


_COSINES = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def shot_starts(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each frame starts a shot; ``values[frame, sample]``, videos end at ``bounds``."""
    frames, samples = values.shape
    bins = (np.clip(values, 0, 255).astype(np.int64) * BINS) >> 8
    histogram = np.bincount((np.arange(frames)[:, None] * BINS + bins).ravel(), minlength=frames * BINS).reshape(frames, BINS)
    change = np.zeros(frames)
    change[1:] = np.abs(np.diff(histogram, axis=0)).sum(1) / (2 * samples)
    opening = np.zeros(frames, bool)
    opening[bounds[:-1][np.diff(bounds) > 0]] = True
    change[opening] = 0
    # Moments over the differences before each frame, within its video; integers keep them exact.
    scaled = np.rint(change * 2 * samples).astype(np.int64)
    s1, s2 = (np.concatenate([[0], np.cumsum(x)]) for x in (scaled, scaled * scaled))
    own = np.repeat(bounds[:-1], np.diff(bounds)) + 1
    here = np.arange(frames)
    lo = np.minimum(np.maximum(here - LOOK_BACK, own), here)
    n = np.maximum(here - lo, 1)
    mean = (s1[here] - s1[lo]) / n
    deviation = np.sqrt(np.maximum((s2[here] - s2[lo]) / n - mean * mean, 0))
    cut = (change > LEAST) & (scaled > mean + DEVIATIONS * deviation) & (here > own)
    return cut | opening


def pad(payload: bytes) -> bytes:
    """The payload with zero bytes up to a positive multiple of a frame's samples."""
    return payload + b"\0" * (-len(payload) % FRAME or (0 if payload else FRAME))


def store(payloads: list[bytes]) -> list[bytes]:
    """An AVI file of each payload; lengths are positive multiples of ``FRAME``."""
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    bounds = np.concatenate([[0], np.cumsum([len(p) // FRAME for p in payloads])])
    files: list[bytes] = []
    pending: list[bytes] = []
    ends: list[int] = [0]
    for lo in range(0, len(samples), LANES):
        scans, at = encode_frames(samples[lo : lo + LANES])
        pending.append(scans.tobytes())
        ends += (at[1:] + ends[-1]).tolist()
    scans = b"".join(pending)
    for i in range(len(payloads)):
        a, b = int(bounds[i]), int(bounds[i + 1])
        files.append(write_avi(samples[a:b], scans, ends[a : b + 1]))
    return files


@dataclass
class Clip:
    """What a stored file holds: samples, frame rate and the first frames of its shots."""

    samples: np.ndarray  # [frame, block]
    rate: float
    starts: list[int]


def load(files: list[bytes]) -> list[Clip]:
    """Decode files; their frames are flat-block grey frames or any baseline grey ones of one size."""
    videos = [read_avi(f) for f in files]
    frames = [f for _, v in videos for f in v]
    bounds = np.concatenate([[0], np.cumsum([len(v) for _, v in videos])])
    groups: dict[bytes, list[int]] = {}
    head, members = b"", []
    for i, f in enumerate(frames):
        if not head or not f.startswith(head):
            head = _head_of(f)
            members = groups.setdefault(head, [])
        members.append(i)
    rows: list[np.ndarray] = [np.zeros(0)] * len(frames)
    for members in groups.values():
        for lo in range(0, len(members), LANES):
            part = members[lo : lo + LANES]
            for i, row in zip(part, decode_frames([frames[i] for i in part])[0], strict=True):
                rows[i] = row
    if len({len(r) for r in rows}) <= 1:
        samples = np.array(rows).reshape(len(rows), -1)
        starting = shot_starts(samples, bounds) if len(rows) else np.zeros(0, bool)
        cut = [(samples[lo:hi], starting[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    else:
        cut = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if len({len(r) for r in rows[lo:hi]}) > 1:
                raise ValueError("a file's frames differ in size")
            one = np.array(rows[lo:hi]).reshape(hi - lo, -1)
            cut.append((one, shot_starts(one, np.array([0, hi - lo])) if hi > lo else np.zeros(0, bool)))
    return [Clip(samples, rate, np.flatnonzero(s).tolist()) for (samples, s), (rate, _) in zip(cut, videos, strict=True)]


def _files_of(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[list[bytes], list[bytes], list[bytes]]]:
    """Raw bytes, payloads and files of runs of texts that hold about ``most`` bytes together."""
    run, size = [], 0
    for i, text in enumerate(texts):
        run.append((text or "").encode())
        size += len(run[-1])
        if size >= most or i == len(texts) - 1:
            payloads = [pad(x) for x in run]
            yield run, payloads, store(payloads)
            run, size = [], 0


def write_media(docs: DataFrame, text_col: str = "text", into: str = "media") -> DataFrame:
    """``docs`` with an AVI file of each text's bytes; null counts as empty, which is one frame of zeros.

    A column named like ``into`` is replaced, all others stay. A file whose
    sizes pass RIFF's 32 bits raises ``ValueError``.
    """
    kept = [c for c in docs.columns if c != into]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [f for _, _, made in _files_of(batch.column(kept.index(text_col)).to_pylist()) for f in made]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(files, pa.binary())], [*kept, into])

    return docs.select(*kept).mapInArrow(run, f"{fields}, `{into}` binary")


def clip_rows(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each shot: ``clip, first_frame, frames, start_ms, end_ms``.

    A null file has no rows; one that can't be read has a single row with a
    null ``clip`` and the reason in ``error``.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    clip = load([data])[0]
                except ValueError as e:
                    rows.append((name, None, None, None, None, None, str(e)))
                    continue
                ends = [*clip.starts[1:], len(clip.samples)]
                rows += [(name, i, a, b - a, round(1000 * a / clip.rate), round(1000 * b / clip.rate), None) for i, (a, b) in enumerate(zip(clip.starts, ends, strict=True))]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [batch.schema.types[0], *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [id_col, "clip", "first_frame", "frames", "start_ms", "end_ms", "error"])

    return media.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, clip long, first_frame long, frames long, start_ms long, end_ms long, error string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back, and digest both.

    A null or empty text is one frame of zeros. Every row is handled by itself,
    null ids and repeated rows included; other columns are not read.
    """
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in fields.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = [], batch.column(0).to_pylist()
            for raw, _, files in _files_of(batch.column(1).to_pylist()):
                for source, stored, clip in zip(raw, files, load(files), strict=True):
                    back = np.rint(clip.samples).astype(np.uint8).tobytes()
                    feature = f"frames={len(clip.samples)};ms={round(1000 * len(clip.samples) / clip.rate)};shots={len(clip.starts)};sum={int(clip.samples.sum())};cuts={crc32(np.array(clip.starts, '<u4').tobytes()):08x}"
                    rows.append((ids[len(rows)], len(source), len(back), sha256(back).hexdigest(), crc32(back[-64:]), len(stored), sha256(stored).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_col).mapInArrow(run, fields)
