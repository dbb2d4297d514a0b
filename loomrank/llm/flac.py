"""FLAC in numpy: an encoder, a frame-parallel decoder, and PCM blocks with seekable sample offsets.

The decoder reads the Rice codes of many frames at once, one sample of every frame a step: a table of the
next set bit gives each unary quotient, the remainders are gathered afterwards, and fixed or general linear
predictors rebuild the samples, the general ones too one sample of every frame a step. Header CRC-8, frame CRC-16 and the stream's MD5 are verified. Samples are
signed and of 8 or 16 bits, one channel.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.llm.common import delete_path, map_batches, materialise

BLOCK, RATE = 4096, 8000
#: Bytes of frames whose bits are laid open at once.
OPEN_BYTES = 1 << 20
#: Taps of the general predictor that each frame of a text is offered besides the fixed ones.
LPC_ORDER = 8
#: Shares of a table whose streams lie on disk by turns.
SHARES = 4
# Fixed values of the format: block sizes by code, the binomial coefficients of the fixed predictors, CRC polynomials.
BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
CRC8, CRC16 = 0x07, 0x8005
CODE_OF = {n: c for c, n in BLOCK_CODES.items()}


class Crc:
    """A CRC over any number of bytes by a table of each byte's effect at each distance from the end."""

    def __init__(self, poly: int, bits: int):
        top, full = 1 << (bits - 1), (1 << bits) - 1
        first = []
        for b in range(256):
            c = b << (bits - 8)
            for _ in range(8):
                c = (c << 1 ^ poly if c & top else c << 1) & full
            first.append(c)
        self.bits, self.step = bits, np.array(first, np.uint32)
        self.tables = self.step[None, :]
        self.flat, self.rows = self.tables.ravel(), np.zeros(1, np.int64)

    def __call__(self, data: bytes | np.ndarray) -> int:
        d = np.frombuffer(data, np.uint8)
        while len(self.tables) < len(d):
            # one more zero byte behind: shift the register through the byte table
            new, last, full = [], self.tables[-1], (1 << self.bits) - 1
            for _ in range(max(64, len(self.tables))):
                last = (last << 8 & full) ^ self.step[last >> (self.bits - 8)]
                new.append(last)
            self.tables = np.concatenate([self.tables, np.array(new)])
            self.flat, self.rows = self.tables.astype(np.uint16).ravel(), np.arange(len(self.tables) - 1, -1, -1) * 256
        return int(np.bitwise_xor.reduce(self.flat.take(self.rows[len(self.rows) - len(d) :] + d))) if len(d) else 0


crc8, crc16 = Crc(CRC8, 8), Crc(CRC16, 16)


class BadFlac(ValueError):
    """A checksum or a field of the stream is wrong."""


def put(bits: np.ndarray, at: int, value: int, width: int) -> int:
    for i in range(width):
        bits[at + i] = value >> (width - 1 - i) & 1
    return at + width


def utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(0xFE ^ (lead << 1)) & 0xFF | n, *reversed(tail)])


def lpc_of(x: np.ndarray, order: int, precision: int = 12) -> tuple[np.ndarray, int] | None:
    """Quantised linear predictor by the autocorrelation of the windowed samples; None for silence."""
    w = x * np.hanning(len(x) + 2)[1:-1]
    r = np.array([np.dot(w[: len(w) - i], w[i:]) for i in range(order + 1)])
    if r[0] <= 0:
        return None
    a = np.linalg.solve(r[np.abs(np.subtract.outer(np.arange(order), np.arange(order)))] + np.eye(order) * r[0] * 1e-6, r[1:])
    shift = int(np.clip(precision - 1 - np.ceil(np.log2(np.abs(a).max() + 1e-9)), 0, 15))
    return np.clip(np.round(a * 2.0**shift), -(1 << (precision - 1)), (1 << (precision - 1)) - 1).astype(np.int64), shift


def rice_choice(u: np.ndarray) -> tuple[int, int]:
    """Best Rice parameter of folded residuals and the bits it takes."""
    guess = max(0, int(np.log2(u.mean() + 1))) if len(u) else 0
    return min((int((u >> k).sum()) + len(u) * (k + 1), k) for k in range(max(0, guess - 1), min(14, guess + 1) + 1))[::-1]


def encode_frame(x: np.ndarray, number: int, width: int, lpc_order: int) -> bytes:
    n = len(x)
    code = CODE_OF.get(n, 7)
    header = bytes([0xFF, 0xF8, code << 4 | 4, {8: 1, 16: 4}[width] << 1]) + utf8_number(number) + (struct.pack(">H", n - 1) if code == 7 else b"")
    header += bytes([crc8(header)])
    if (x == x[0]).all():
        bits = np.zeros(8 + width, np.uint8)
        put(bits, 8, int(x[0]) & (1 << width) - 1, width)
    else:
        residuals = [x]
        while len(residuals) < min(5, n):
            residuals.append(residuals[-1][1:] - residuals[-1][:-1])
        cost = [int(np.abs(r).sum()) for r in residuals]
        order = min(range(len(cost)), key=cost.__getitem__)
        res, coefs, shift = residuals[order], None, 0
        if lpc_order and n > 2 * lpc_order and (q := lpc_of(x.astype(float), lpc_order)):
            guess = sum((c * x[lpc_order - 1 - i : n - 1 - i].astype(np.int64) for i, c in enumerate(q[0])), np.zeros(n - lpc_order, np.int64)) >> q[1]
            if np.abs(x[lpc_order:] - guess).sum() < cost[order]:
                res, (coefs, shift), order = x[lpc_order:] - guess, q, lpc_order
        u = (res << 1) ^ (res >> 31 if res.dtype == np.int32 else res >> 63)
        k, size = rice_choice(u)
        head = 8 + order * width + (9 + 12 * order if coefs is not None else 0)
        if head + 10 + size >= 8 + n * width:
            bits = np.zeros(8 + n * width, np.uint8)
            put(bits, 0, 1 << 1, 8)
            bits[8:] = ((x[:, None] >> np.arange(width - 1, -1, -1)) & 1).ravel()
        else:
            bits = np.zeros(head + 10 + size, np.uint8)
            at = put(bits, 0, ((32 | order - 1) if coefs is not None else (8 | order)) << 1, 8)
            for v in x[:order].tolist():
                at = put(bits, at, v & (1 << width) - 1, width)
            if coefs is not None:
                at = put(bits, put(bits, at, 11, 4), shift, 5)
                for c in coefs.tolist():
                    at = put(bits, at, c & 0xFFF, 12)
            at = put(bits, put(bits, at, 0, 6), k, 4)
            place = np.cumsum((u >> k) + (k + 1), dtype=np.int64)
            place += at - k - 1
            bits[place] = 1
            for j in range(k - 1, -1, -1):
                place += 1
                bits[place] = u >> j & 1
    frame = header + np.packbits(bits).tobytes()
    return frame + struct.pack(">H", crc16(frame))


def encode(samples: np.ndarray, width: int = 8, lpc_order: int = 0, block: int = BLOCK) -> bytes:
    """A FLAC stream of signed samples with STREAMINFO and a SEEKTABLE point a frame; no samples give no frame."""
    x = samples.astype(np.int32)
    frames = [encode_frame(x[i : i + block], i // block, width, lpc_order) for i in range(0, len(x), block)]
    sizes = [len(f) for f in frames] or [0]
    md5 = hashlib.md5(samples.astype({8: "i1", 16: "<i2"}[width]).tobytes(), usedforsecurity=False).digest()
    packed = RATE << 44 | 0 << 41 | (width - 1) << 36 | len(x)
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
    points = b"".join(struct.pack(">QQH", i * block, sum(sizes[:i]) if i < 2 else at, min(block, len(x) - i * block)) for i, at in enumerate(np.cumsum([0, *sizes[:-1]]).tolist()) if frames)
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points + b"".join(frames)


@dataclass
class Stream:
    width: int
    total: int
    md5: bytes
    first: int
    #: (first sample, byte offset in the stream, samples) of each frame
    points: list[tuple[int, int, int]]


def read_header(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise BadFlac("no FLAC stream")
    at, last, info, points = 4, False, b"", []
    while not last:
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body, at = data[at + 4 : at + 4 + size], at + 4 + size
        if kind == 0:
            info = body
        elif kind == 3:
            points = [struct.unpack_from(">QQH", body, i) for i in range(0, size, 18)]
    packed = int.from_bytes(info[10:18], "big")
    total = packed & (1 << 36) - 1
    points = [(s, at + o, n) for s, o, n in points if s != (1 << 64) - 1]
    if sum(p[2] for p in points) != total:  # no seek table, or one of some frames only
        points = found_frames(data, at, total)
    return Stream((packed >> 36 & 31) + 1, total, info[18:34], at, points)


def head_at(d: np.ndarray, a: int) -> tuple[int, int] | None:
    """Samples and end of the frame header at byte ``a``; None where there is none by its sync code and CRC-8."""
    if len(d) < a + 6 or d[a] != 0xFF or d[a + 1] & 0xFE != 0xF8:
        return None
    code, at = int(d[a + 2]) >> 4, a + 4
    lead = int(d[at])
    at += 1 if lead < 0x80 else 8 - (0xFF ^ lead).bit_length()
    n = BLOCK_CODES.get(code, 0)
    if code in (6, 7):
        n = int.from_bytes(d[at : at + code - 5].tobytes(), "big") + 1
        at += code - 5
    at += {12: 1, 13: 2, 14: 2}.get(int(d[a + 2]) & 15, 0)
    return (n, at) if n and at < len(d) and crc8(d[a:at]) == d[at] else None


def found_frames(data: bytes, first: int, total: int) -> list[tuple[int, int, int]]:
    """The frames of a stream by their sync codes and both checksums, in order; an error if they don't add up to all samples."""
    d = np.frombuffer(data, np.uint8)
    starts = [int(i) for i in np.flatnonzero((d[:-1] == 0xFF) & (d[1:] & 0xFE == 0xF8)) if i >= first and head_at(d, int(i))]
    points, sample, i = [], 0, 0
    while i < len(starts):
        a, n = starts[i], head_at(d, starts[i])[0]
        # samples may look like a header: a frame ends where its CRC-16 holds
        ends = ((j, e) for j, e in enumerate([*starts[i + 1 :], len(d)], i + 1) if crc16(d[a : e - 2]) == int(d[e - 2]) << 8 | int(d[e - 1]))
        j, _ = next(ends, (None, None))
        if j is None:
            raise BadFlac("frame CRC-16")
        points.append((sample, a, n))
        sample, i = sample + n, j
    if total and sample != total:
        raise BadFlac("frames of some samples are missing")
    return points


def get(data: np.ndarray, at: int, width: int, signed: bool = False) -> int:
    a, b = at >> 3, at + width + 7 >> 3
    v = int.from_bytes(data[a:b].tobytes(), "big") >> (8 * b - at - width) & (1 << width) - 1
    return v - (1 << width) if signed and width and v >> (width - 1) else v


@dataclass
class Frame:
    n: int
    width: int
    kind: str
    at: int = 0
    warm: list[int] | None = None
    coefs: list[int] | None = None
    shift: int = 0
    #: (parameter, samples, raw width or -1) of each Rice partition
    parts: int = 0
    escape: int = 15
    samples: np.ndarray | None = None


def open_frame(d: np.ndarray, a: int, b: int, width: int) -> Frame:
    """Header and subframe header of the frame in bytes a..b of ``d``; both checksums are verified."""
    if d[a] != 0xFF or d[a + 1] & 0xFE != 0xF8:
        raise BadFlac("no frame where one should begin")
    code, at = int(d[a + 2]) >> 4, a + 4
    lead = int(d[at])
    at += 1 if lead < 0x80 else 8 - (0xFF ^ lead).bit_length()
    n = BLOCK_CODES.get(code, 0)
    if code in (6, 7):
        n = int.from_bytes(d[at : at + code - 5].tobytes(), "big") + 1
        at += code - 5
    at += {12: 1, 13: 2, 14: 2}.get(int(d[a + 2]) & 15, 0)
    if crc8(d[a:at]) != d[at]:
        raise BadFlac("frame header CRC-8")
    if crc16(d[a : b - 2]) != int(d[b - 2]) << 8 | int(d[b - 1]):
        raise BadFlac("frame CRC-16")
    bit = 8 * (at + 1)
    kind = get(d, bit + 1, 6)
    if get(d, bit + 7, 1) or not n:
        raise BadFlac("wasted bits are not supported")
    bit += 8
    if kind == 0:
        return Frame(n, width, "constant", samples=np.full(n, get(d, bit, width, True), np.int64))
    if kind == 1:
        raw = np.unpackbits(d[bit >> 3 : (bit + n * width + 7) >> 3])[: n * width] if not bit % 8 else None
        v = raw.reshape(n, width).astype(np.int64) @ (1 << np.arange(width - 1, -1, -1))
        return Frame(n, width, "verbatim", samples=np.where(v >> (width - 1), v - (1 << width), v))
    if 8 <= kind <= 12:
        order, coefs, shift = kind - 8, None, 0
    elif kind >= 32:
        order = kind - 31
    else:
        raise BadFlac(f"subframe type {kind}")
    warm = [get(d, bit + i * width, width, True) for i in range(order)]
    bit += order * width
    if kind >= 32:
        precision, shift = get(d, bit, 4) + 1, get(d, bit + 4, 5, True)
        coefs = [get(d, bit + 9 + i * precision, precision, True) for i in range(order)]
        bit += 9 + order * precision
    method, parts = get(d, bit, 2), get(d, bit + 2, 4)
    if method > 1:
        raise BadFlac("residual method")
    return Frame(n, width, "rice", bit + 6, warm, coefs, shift, parts, 31 if method else 15)


def decode_frames(d: np.ndarray, spans: list[tuple[int, int]], widths: list[int]) -> list[np.ndarray]:
    """Samples of the frames at byte spans of ``d``, decoded side by side."""
    frames = [open_frame(d, a, b, w) for (a, b), w in zip(spans, widths, strict=True)]
    lanes = [f for f in frames if f.kind == "rice"]
    if lanes:
        bits = np.unpackbits(d)
        bits[-1] = 1  # of the zero bytes behind the last frame
        ones = np.flatnonzero(bits)
        ahead = np.repeat(ones, np.diff(ones, prepend=-1))
        rounds = max(1 << f.parts for f in lanes)
        pieces: list[list[np.ndarray]] = [[] for _ in lanes]
        where = [f.at for f in lanes]
        for r in range(rounds):  # partition r of each frame that has one
            todo = []
            for i, f in enumerate(lanes):
                if r < 1 << f.parts:
                    width = 5 if f.escape == 31 else 4
                    k = get(d, where[i], width)
                    count = (f.n >> f.parts) - (len(f.warm or []) if r == 0 else 0)
                    where[i] += width
                    if k == f.escape:
                        raw = get(d, where[i], 5)
                        pieces[i].append(np.array([get(d, where[i] + 5 + j * raw, raw, True) for j in range(count)], np.int64))
                        where[i] += 5 + count * raw
                    elif count:
                        todo.append((count, i, k))
            todo.sort(reverse=True)
            if not todo:
                continue
            counts = np.array([t[0] for t in todo])
            ks = np.array([t[2] for t in todo])
            pos = np.array([where[t[1]] for t in todo])
            stops = np.zeros((counts[0], len(todo)), np.int64)
            live = np.searchsorted(-counts, -np.arange(1, counts[0] + 1), "right").tolist()
            skip = ks + 1
            m = len(todo)
            for s, left in enumerate(live):
                if left != m:
                    m, pos, skip = left, pos[:left], skip[:left]
                row = stops[s, :m]
                ahead.take(pos, out=row, mode="clip")
                np.add(row, skip, out=pos)
            for lane, (count, i, k) in enumerate(todo):
                p = stops[:count, lane].copy()
                u = p.copy()
                u[0] -= where[i]
                u[1:] -= p[:-1] + (k + 1)
                last = int(p[-1])
                for _ in range(k):
                    p += 1
                    u <<= 1
                    u |= bits.take(p)
                pieces[i].append(np.where(u & 1, -(u + 1 >> 1), u >> 1))
                where[i] = last + k + 1
        general: dict[tuple[int, int], list[tuple[Frame, np.ndarray]]] = {}
        for f, p in zip(lanes, pieces, strict=True):
            res = np.concatenate(p) if p else np.zeros(0, np.int64)
            if f.coefs is None:
                f.samples = undone(res, f)
            else:  # frames of about one length, so that few lanes run empty
                general.setdefault((len(f.coefs), len(res).bit_length()), []).append((f, res))
        for some in general.values():
            predict(some)
    return [f.samples for f in frames]


def undone(res: np.ndarray, f: Frame) -> np.ndarray:
    """Samples of a fixed predictor: one difference is undone at a time, from the highest."""
    warm = np.array(f.warm, np.int64)
    for o in range(len(warm), 0, -1):
        first = int(np.diff(warm[:o], o - 1)[0])
        res = np.cumsum(np.concatenate([[first], res]))
    return res


def predict(some: list[tuple[Frame, np.ndarray]]) -> None:
    """Samples of frames with general predictors of one order from their residuals, one sample of every frame a step."""
    some = sorted(some, key=lambda x: -len(x[1]))
    order, sizes = len(some[0][0].coefs), np.array([len(r) for _, r in some])
    out = np.zeros((order + sizes[0], len(some)), np.int64)
    for i, (f, r) in enumerate(some):
        out[:order, i] = f.warm
        out[order : order + len(r), i] = r
    back = np.array([f.coefs[::-1] for f, _ in some], np.int64).T.copy()
    shifts = np.array([f.shift for f, _ in some])
    for i, m in enumerate(np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right").tolist()):
        out[order + i, :m] += np.einsum("ij,ij->j", out[i : i + order, :m], back[:, :m]) >> shifts[:m]
    for i, (f, r) in enumerate(some):
        f.samples = out[: order + len(r), i]


def decode_all(streams: list[bytes]) -> list[np.ndarray]:
    """Samples of each stream; frames of many streams are decoded together, and each stream's MD5 is verified."""
    heads = [read_header(s) for s in streams]
    got: list[list[np.ndarray]] = [[] for _ in streams]
    some: list[bytes] = []
    spans: list[tuple[int, int]] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal some, spans, owners, size
        if spans:
            d = np.frombuffer(b"".join(some) + bytes(8), np.uint8)
            for o, x in zip(owners, decode_frames(d, spans, [heads[o].width for o in owners]), strict=True):
                got[o].append(x)
        some, spans, owners, size = [], [], [], 0

    for i, (s, h) in enumerate(zip(streams, heads, strict=True)):
        ends = [p[1] for p in h.points[1:]] + [len(s)]
        for (_, a, _), b in zip(h.points, ends, strict=True if h.points else False):
            some.append(s[a:b])
            spans.append((size, size + b - a))
            owners.append(i)
            size += b - a
            if size > OPEN_BYTES:
                flush()
    flush()
    out = []
    for h, parts in zip(heads, got, strict=True):
        x = (np.concatenate(parts) if parts else np.zeros(0, np.int64)).astype({8: "i1", 16: "<i2"}[h.width])
        if len(x) != h.total or hashlib.md5(x.tobytes(), usedforsecurity=False).digest() != h.md5:
            raise BadFlac("stream MD5")
        out.append(x)
    return out


def decode_range(data: bytes, start: int, count: int) -> np.ndarray:
    """Samples start..start + count, from the frames that hold them alone."""
    h = read_header(data)
    ends = [p[1] for p in h.points[1:]] + [len(data)]
    hit = [(p, e) for p, e in zip(h.points, ends, strict=False) if p[0] < start + count and p[0] + p[2] > start]
    d = np.frombuffer(data + bytes(8), np.uint8)
    x = np.concatenate(decode_frames(d, [(p[1], e) for p, e in hit], [h.width] * len(hit)) or [np.zeros(0, np.int64)])
    return x[start - hit[0][0][0] :][:count] if hit else x


def payload_of(text: str | None, unit: int = 64) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(-len(raw) % unit or (0 if raw else unit)), len(raw)


def feature_of(x: np.ndarray) -> str:
    """Samples, least, greatest, mean in thousandths, root mean square in thousandths and sign changes."""
    v = x.astype(np.int64)
    if not len(v):
        return "0:0:0:0:0:0"
    return f"{len(v)}:{v.min()}:{v.max()}:{1000 * int(v.sum()) // len(v)}:{int(np.sqrt(int((v * v).sum()) / len(v)) * 1000)}:{int(((v[1:] < 0) != (v[:-1] < 0)).sum())}"


def to_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's padded UTF-8 bytes as a FLAC stream of 8-bit samples.

    Each frame takes the better of the fixed predictors and a general one of LPC_ORDER taps. A null or empty text is one unit of zero bytes. Byte b is sample b - 128. Further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media, sizes = [], []
            for t in b.column("text").to_pylist():
                payload, n = payload_of(t)
                media.append(encode((np.frombuffer(payload, np.uint8) ^ 0x80).view(np.int8), lpc_order=LPC_ORDER))
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_bytes long, media binary")


def stored_media(docs: DataFrame) -> DataFrame:
    """``to_media`` written to the shared folder and read back: each stream has its seek table, a sample offset a frame."""
    return materialise(to_media(docs))


BLOCKS = "array<struct<sample_offset: long, n_samples: long, byte_offset: long, pcm: binary>>"


def decoded_blocks(media: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media_bytes, media_sha256, blocks``: each stream decoded into PCM blocks, one a frame, in order.

    A block has its first sample, its number of samples, its frame's byte in the stream (what a seek needs) and the samples
    as bytes. Repeated rows come back repeated; a stream without samples has no block.
    """
    kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int64()), ("byte_offset", pa.int64()), ("pcm", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            streams = b.column("media").to_pylist()
            blocks = [[{"sample_offset": s, "n_samples": n, "byte_offset": at, "pcm": x[s : s + n].tobytes()} for s, at, n in read_header(m).points] for m, x in zip(streams, decode_all(streams), strict=True)]
            hashes = [hashlib.sha256(m).hexdigest() for m in streams]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array([len(m) for m in streams], pa.int64()), pa.array(hashes), pa.array(blocks, kind)], ["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"])

    return map_batches(media.select("doc_id", "n_bytes", "media"), run, f"doc_id long, n_bytes long, media_bytes long, media_sha256 string, blocks {BLOCKS}")


def stored_blocks(docs: DataFrame) -> DataFrame:
    """``decoded_blocks`` of each text's stream, written to the shared folder and read back.

    Streams are written, read back and decoded for one of SHARES shares of the rows at a time (by the hash of doc_id), and
    deleted once their blocks are written: both forms of a whole table would take the disk of two.
    """
    spark, paths = docs.sparkSession, []
    for k in range(SHARES):
        media = stored_media(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)) == k))
        blocks = materialise(decoded_blocks(media))
        delete_path(spark, media.loomrank_path)
        paths.append(blocks.loomrank_path)
    return spark.read.schema(blocks.schema).parquet(*paths)


def block_features(blocks: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature`` from PCM blocks of 8-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for found in b.column("blocks").to_pylist():
                x = np.frombuffer(b"".join(p["pcm"] for p in found), np.int8)
                raw = (x.view(np.uint8) ^ 0x80).tobytes()
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), feature_of(x)))
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *made[:3], b.column("media_bytes"), b.column("media_sha256"), made[3]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_batches(blocks, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_features(media: DataFrame) -> DataFrame:
    """``block_features`` of streams of 8-bit samples."""
    return block_features(decoded_blocks(media))


def pcm_blocks(media: DataFrame) -> DataFrame:
    """One row a frame: ``doc_id, block, sample_offset, n_samples, byte_offset, pcm``."""
    rows = decoded_blocks(media.withColumn("n_bytes", F.lit(None).cast("long"))).select("doc_id", F.posexplode("blocks").alias("block", "b"))
    return rows.select("doc_id", F.col("block").cast("long").alias("block"), "b.sample_offset", "b.n_samples", "b.byte_offset", "b.pcm")
