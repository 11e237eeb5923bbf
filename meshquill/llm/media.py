"""Media columns: AVI motion-JPEG, written, indexed, decoded and cut into shots.

A payload is stored as the AC coefficients of grey baseline JPEG frames of 32 x 32 pixels: an AC value of category 8 takes
exactly 256 values, whose 8 extra bits are the payload byte, so storage is lossless in the format's own unit (the quantised
coefficient; all quantisers are 1). A block holds 63 bytes and no end-of-block code, a frame 16 blocks. The last frame is
filled with zeros; a comment segment in each frame tells how many bytes count. The RIFF index (``idx1``) lists the frames.

Reading goes by the index, or by the chunks where there is none; further RIFF parts (``AVIX``, of files above a gigabyte) are read by
their chunks. A frame is decoded alone, by its own tables: quantisers (DQT), Huffman codes (DHT; where a frame has none, as is usual in
motion-JPEG, those of the format's annex), components and their sampling (SOF0 or SOF1), restart intervals, runs, end-of-block and differences of the
mean; colour and any size included. Frames of one form are decoded side by side, a symbol of each at a time, in groups of at most
TOGETHER blocks, so memory is bounded by the group and by the file, whatever the number of files. Progressive, lossless and
arithmetic frames are not motion-JPEG and count as errors. The luma goes through the inverse cosine transform to pixels.

A cut is a histogram difference above the mean plus three deviations of the differences around it and above a tenth of the
largest possible; the frames between cuts are timed clips. A file that can't be read gives one row with its error and no clip;
a null file gives no row.

Every document is worked on by itself in a task; there is no shuffle. A null text is an empty one (64 zero bytes); equal texts
give equal values; repeated rows each give theirs, an empty table an empty one, and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

SIDE, FPS = 32, 25
TOGETHER = 1 << 15
#: Bytes of texts whose payloads, files and frames a task holds at a time (one longer text is a group of its own).
HELD = 2 << 20
BLOCKS = (SIDE // 8) ** 2
PER_FRAME = BLOCKS * 63
BLOCK_BITS = 1 + 63 * 9
#: Fixed values of the JPEG format: the zigzag scan.
ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56,
          57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]


#: Fixed values of the JPEG format: how many codes of each length its usual tables have, and the symbols of their short codes; the others follow
#: in order. A table goes by class * 16 + number: 0 for brightness, 1 for colour.
USUAL = {
    0x00: ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], []),
    0x01: ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], []),
    0x10: ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], [0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32,
            0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82]),
    0x11: ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], [0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81,
            0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1]),
}


def usual_tables() -> dict[int, bytes]:
    """The usual Huffman tables as in a DHT segment: lengths, then symbols."""
    symbols = {0: list(range(12)), 1: sorted([0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))])}
    return {of: bytes(lengths) + bytes([*short, *(x for x in symbols[of >> 4] if x not in short)]) for of, (lengths, short) in USUAL.items()}


def _basis() -> np.ndarray:
    """Inverse transform of each coefficient in scan order, in units of 2**-13; whole numbers keep sums exact in any order."""
    x = np.arange(8)
    cos = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1.0)[None, :]
    full = np.einsum("yv,xu->vuyx", cos, cos).reshape(64, 64) / 4
    return np.rint(full[ZIGZAG] * 8192)


BASIS = _basis()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEAD = (b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\x01\x11\x00")
        + _segment(0xC4, b"\x00" + b"\x01" + b"\x00" * 15 + b"\x00") + _segment(0xC4, b"\x10" + b"\x01" + b"\x00" * 15 + b"\x08"))
SCAN = _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def encode(payload: bytes) -> bytes:
    """An AVI file that holds the payload."""
    n = max(1, -(-len(payload) // PER_FRAME))
    movi, index, at = [b"movi"], [], 4
    for first in range(0, n, TOGETHER // BLOCKS):
        some = min(TOGETHER // BLOCKS, n - first)
        part = np.frombuffer(payload, np.uint8)[first * PER_FRAME : (first + some) * PER_FRAME]
        data = np.zeros(some * PER_FRAME, np.uint8)
        data[: len(part)] = part
        bits = np.zeros((some * BLOCKS, BLOCK_BITS), np.uint8)
        bits[:, 1:].reshape(-1, 63, 9)[:, :, 1:] = np.unpackbits(data).reshape(-1, 63, 8)
        for i, scan in enumerate(np.packbits(bits, axis=1).reshape(some, -1), first):
            counted = min(PER_FRAME, len(payload) - i * PER_FRAME)
            jpeg = HEAD + _segment(0xFE, b"bytes=%d" % counted) + SCAN + scan.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
            index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(jpeg)))
            movi.append(_chunk(b"00dc", jpeg))
            at += len(movi[-1])
    largest = max(map(len, movi))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    streams = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + streams) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def frames(media: bytes) -> tuple[list[bytes], float]:
    """The video chunks of an AVI file by its index, and the seconds between frames."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movies, index, step = 12, [], b"", 1 / FPS
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"RIFF":  # a further part
            at += 12
            continue
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movies.append((at + 8, at + 8 + size))
        elif name == b"LIST" and media[at + 12 : at + 16] == b"avih":
            step = struct.unpack_from("<I", media, at + 20)[0] / 1e6 or step
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if not movies:
        raise ValueError("no movi list")
    out, first = [], movies[0][0]
    found = [(o, n) for name, _, o, n in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if name[2:] in (b"dc", b"db")]
    if found:  # offsets count from the list or from the file
        base = first if media[first + found[0][0] + 2 : first + found[0][0] + 4] in (b"dc", b"db") else 0
        out = [media[base + o + 8 : base + o + 8 + n] for o, n in found]
    for movi, end in movies[1:] if found else movies:
        at = movi + 4
        while at + 8 <= min(end, len(media)):
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST":
                at += 12
                continue
            if name[2:] in (b"dc", b"db"):
                out.append(media[at + 8 : at + 8 + size])
            at += 8 + size + size % 2
    return out, step


def code_table(body: bytes) -> tuple[np.ndarray, int]:
    """A Huffman table as an array over 16 bits, code length * 256 + symbol (0: no code), and the bytes it takes."""
    lengths = np.frombuffer(body[:16], np.uint8).astype(np.int64)
    symbols = np.frombuffer(body[16 : 16 + lengths.sum()], np.uint8).astype(np.int64)
    size = np.repeat(np.arange(1, 17), lengths)
    out, spans = np.zeros(1 << 16, np.int32), 1 << (16 - size)
    filled = np.repeat(size * 256 + symbols, spans)[: 1 << 16]  # codes of rising length follow each other from 0 on
    out[: len(filled)] = filled
    return out, 16 + int(lengths.sum())


def form_of(jpeg: bytes) -> tuple[bytes, int]:
    """The bytes before the scan without comments, which say how a frame is decoded, and where the scan begins."""
    at, kept = 2, []
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while at + 4 <= len(jpeg):
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        if marker != 0xFE and not 0xE0 <= marker <= 0xEF:
            kept.append(jpeg[at : at + 2 + size])
        at += 2 + size
        if marker == 0xDA:
            return b"".join(kept), at
    raise ValueError("no scan")


def plan_of(form: bytes) -> dict:
    """width, height, restart, quantisers, and for each block of a minimum coded unit its component and tables."""
    at, quant, codes, plan = 0, {}, {}, {"restart": 0}
    while at < len(form):
        marker, size = form[at + 1], struct.unpack_from(">H", form, at + 2)[0]
        body = form[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                table_, used = code_table(body[1:])
                codes[body[0]] = table_
                body = body[1 + used :]
        elif marker in (0xC0, 0xC1):
            _, plan["height"], plan["width"], n = struct.unpack_from(">BHHB", body)
            plan["parts"] = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            plan["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
        at += 2 + size
    if len(scan) != len(plan["parts"]):
        raise ValueError("more than one scan")
    for of, usual in usual_tables().items() if any(dc not in codes or 16 + ac not in codes for _, dc, ac in scan) else []:
        codes.setdefault(of, code_table(usual)[0])
    alone = len(scan) == 1  # then blocks go row by row, whatever the sampling
    plan["blocks"] = [(k, codes[dc], codes[16 + ac]) for k, (c, dc, ac) in enumerate(scan) for _ in range(1 if alone else plan["parts"][c][0] * plan["parts"][c][1])]
    h, v, q = plan["parts"][scan[0][0]]
    most = [max(p[i] for p in plan["parts"].values()) for i in (0, 1)]
    plan["luma"], plan["quant"] = (1, 1) if alone else (h, v), quant[q]
    plan["across"], plan["down"] = ((-(-plan[x] // (8 * (1 if alone else m)))) for x, m in zip(("width", "height"), most))
    plan["sampled"] = (most[0] // h, most[1] // v)
    return plan


def scans(jpeg: bytes, at: int) -> list[bytes]:
    """The entropy-coded bytes of a frame, from one restart marker to the next."""
    end = jpeg.rfind(b"\xff\xd9")
    body = jpeg[at : end if end > at else len(jpeg)]
    cuts_ = [m.start() for m in re.finditer(b"\xff[\xd0-\xd7]", body)]
    return [body[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip([0, *(c + 2 for c in cuts_)], [*cuts_, len(body)])]


def coefficients(plan: dict, strips: list[bytes], units: list[int]) -> np.ndarray:
    """Quantised coefficients in scan order (blocks x 64) of strips of minimum coded units, one symbol of each strip at a time."""
    per = len(plan["blocks"])
    tables = np.concatenate([np.stack([dc for _, dc, _ in plan["blocks"]]), np.stack([ac for _, _, ac in plan["blocks"]])]).ravel()
    part = np.array([k for k, _, _ in plan["blocks"]])
    sizes = np.array([len(s) for s in strips])
    starts = np.concatenate([[0], np.cumsum(sizes + 8)[:-1]])
    raw = np.frombuffer(b"".join(s + b"\xff" * 8 for s in strips), np.uint8).astype(np.int64)
    word = raw[:-4] << 32 | raw[1:-3] << 24 | raw[2:-2] << 16 | raw[3:-1] << 8 | raw[4:]
    last = (starts + sizes) * 8
    total = np.array(units) * per
    first = np.concatenate([[0], np.cumsum(total)[:-1]])
    out = np.zeros(int(total.sum()) * 64, np.int16)
    means = np.zeros((len(strips), int(part.max()) + 1), np.int64)
    live = np.flatnonzero(total > 0)
    bit, block, k = starts[live] * 8, np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    while len(live):
        window = word[bit >> 3] >> 24 - (bit & 7) & 0xFFFF
        of = block % per
        entry = tables[(of + np.where(k > 0, per, 0)) * 65536 + window].astype(np.int64)
        length, symbol = entry >> 8, entry & 255
        if not length.all() or (bit > last[live]).any():
            raise ValueError("broken scan")
        bit += length
        n = symbol & 15
        extra = word[bit >> 3] >> (40 - (bit & 7) - n) & (1 << n) - 1
        bit += n
        value = np.where(extra < 1 << n >> 1, extra - (1 << n) + 1, extra)
        zero = k == 0
        if zero.any():
            means[live[zero], part[of[zero]]] += value[zero]
            value[zero] = means[live[zero], part[of[zero]]]
        k += np.where(zero, 0, symbol >> 4)
        ends = ~zero & (n == 0)
        k = np.where(ends & (symbol != 0xF0), 64, k)  # end of block; 0xF0 is a run of 16 zeros
        keep = ~ends & (k < 64)
        out[(first[live] + block)[keep] * 64 + k[keep]] = value[keep]
        k += 1
        full = k >= 64
        if full.any():
            block += full
            k[full] = 0
            more = block < total[live]
            if not more.all():
                live, bit, block, k = live[more], bit[more], block[more], k[more]
    return out.reshape(-1, 64)


def decoded(jpegs: list[bytes]):
    """For each frame in order: its luma coefficients (scan order) and its luma pixels, or the error that it gives."""
    forms: dict[bytes, list[tuple[int, int]]] = {}
    out: list = [None] * len(jpegs)
    for i, jpeg in enumerate(jpegs):
        try:
            form, at = form_of(jpeg)
            forms.setdefault(form, []).append((i, at))
        except (ValueError, IndexError, struct.error) as e:
            out[i] = ValueError(str(e))
    for form, members in forms.items():
        try:
            plan = plan_of(form)
            per_frame = plan["across"] * plan["down"] * len(plan["blocks"])
            step = max(1, TOGETHER // per_frame)
        except (ValueError, KeyError, IndexError, struct.error, UnboundLocalError, ZeroDivisionError) as e:
            for i, _ in members:
                out[i] = ValueError(f"no baseline frame: {e}")
            continue
        for s in range(0, len(members), step):
            some = members[s : s + step]
            try:
                got = _frames_of(plan, [(jpegs[i], at) for i, at in some])
            except (ValueError, IndexError):
                got = [_one(plan, jpegs[i], at) for i, at in some]  # only broken frames are lost
            for (i, _), x in zip(some, got):
                out[i] = x
    return out


def _one(plan: dict, jpeg: bytes, at: int):
    try:
        return _frames_of(plan, [(jpeg, at)])[0]
    except (ValueError, IndexError) as e:
        return ValueError(str(e))


def _frames_of(plan: dict, jpegs: list[tuple[bytes, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    units, strips, sizes = plan["across"] * plan["down"], [], []
    for jpeg, at in jpegs:
        parts = scans(jpeg, at) if plan["restart"] else [b"".join(scans(jpeg, at))]
        each = plan["restart"] or units
        if len(parts) != -(-units // each):
            raise ValueError("restart intervals are missing")
        strips += parts
        sizes += [min(each, units - k * each) for k in range(len(parts))]
    h, v = plan["luma"]
    full = coefficients(plan, strips, sizes).reshape(len(jpegs), plan["down"], plan["across"], len(plan["blocks"]), 64)
    luma = full[:, :, :, : h * v]
    pixels = np.clip(np.floor((luma * plan["quant"]) @ BASIS / 8192 + 128.5), 0, 255).astype(np.uint8)
    pixels = pixels.reshape(len(jpegs), plan["down"], plan["across"], v, h, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6)
    pixels = pixels.reshape(len(jpegs), plan["down"] * v * 8, plan["across"] * h * 8)
    wide, high = -(-plan["width"] // plan["sampled"][0]), -(-plan["height"] // plan["sampled"][1])
    return [(luma[i].reshape(-1, 64), pixels[i, :high, :wide]) for i in range(len(jpegs))]


def payload_of(jpeg: bytes, luma: np.ndarray) -> bytes:
    """The payload bytes of a frame that encode() wrote."""
    values = luma[:, 1:].ravel()
    at = jpeg.find(b"bytes=")
    counted = int(jpeg[at + 6 : jpeg.index(b"\xff", at)]) if at >= 0 else len(values)
    return np.where(values < 0, values + 255, values).astype(np.uint8)[:counted].tobytes()


def decode(media: bytes) -> tuple[bytes, np.ndarray, float]:
    """The payload of a file of encode(), the pixels of each frame (frames x 1024) and the seconds between frames."""
    found, step = frames(media)
    got = decoded(found)
    return b"".join(payload_of(j, x[0]) for j, x in zip(found, got)), np.stack([x[1].ravel() for x in got]), step


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Shares of a frame's pixels in 16 steps of brightness, in units of 2**-20."""
    return (np.bincount(pixels.ravel() >> 4, minlength=16).astype(np.int64) << 20) // pixels.size


def cuts(histograms: np.ndarray, around: int = 12, factor: float = 3.0, least: float = 0.1) -> list[int]:
    """Frames at which a shot begins, 0 first."""
    change = np.abs(np.diff(histograms, axis=0)).sum(axis=1)
    out = [0]
    for i, x in enumerate(change):
        near = np.concatenate([change[max(0, i - around) : i], change[i + 1 : i + 1 + around]])
        if x >= least * (2 << 20) and (len(near) == 0 or x > near.mean() + factor * near.std()):
            out.append(i + 1)
    return out


def histograms_of(files: list[bytes]) -> list[tuple[np.ndarray, float] | Exception]:
    """The histograms of each file's frames and the seconds between them, or why it can't be read; the frames of all files are decoded in common groups."""
    out, every, owner = [], [], []
    for i, media in enumerate(files):
        try:
            found, step = frames(media)
            if not found:
                raise ValueError("no frames")
        except (ValueError, IndexError, struct.error) as e:
            out.append(e)
            continue
        out.append(([], step))
        every += found
        owner += [i] * len(found)
    group = TOGETHER // BLOCKS
    for s in range(0, len(every), group):
        part = [(i, j) for i, j in zip(owner[s : s + group], every[s : s + group]) if not isinstance(out[i], Exception)]
        for (i, _), x in zip(part, decoded([j for _, j in part])):
            if isinstance(out[i], Exception):
                continue
            if isinstance(x, ValueError):
                out[i] = x
            else:
                out[i][0].append(histogram(x[1]))
    return [x if isinstance(x, Exception) else (np.stack(x[0]), x[1]) for x in out]


def timed(seen: np.ndarray, step: float) -> list[tuple[int, float, float, int]]:
    starts = cuts(seen)
    return [(i, a * step, b * step, b - a) for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(seen)]))]


def clips(media: bytes) -> list[tuple[int, float, float, int]]:
    """Timed clip rows of an AVI file: number, first second, last second, frames."""
    got = histograms_of([media])[0]
    if isinstance(got, Exception):
        raise got
    return timed(*got)


def pad(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\x00" * (max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
CLIPS = "doc_id long, clip int, start_s double, end_s double, frames int, error string"


def _digest_rows(texts: list[str | None]) -> list[tuple]:
    """The digests of some texts: their files are written, read by their index, and all their frames decoded in common groups."""
    stored = []
    for text in texts:
        payload, n = pad(text)
        stored.append((payload, n, encode(payload)))
    found = [frames(media)[0] for _, _, media in stored]
    every = [j for js in found for j in js]
    state = [[hashlib.sha256(), 0, b"", [], 0] for _ in stored]  # digest, bytes, last bytes, histograms, luma
    owner = [i for i, js in enumerate(found) for _ in js]
    group = TOGETHER // BLOCKS
    for s in range(0, len(every), group):
        for i, jpeg, x in zip(owner[s : s + group], every[s : s + group], decoded(every[s : s + group])):
            if isinstance(x, ValueError):
                raise x
            part, h = payload_of(jpeg, x[0]), state[i]
            h[0].update(part)
            h[1] += len(part)
            h[2] = (h[2] + part)[-64:]
            h[3].append(histogram(x[1]))
            h[4] += int(x[1].sum(dtype=np.int64))
    out = []
    for (payload, n, media), (digest, size, tail, seen, luma) in zip(stored, state):
        if digest.digest() != hashlib.sha256(payload).digest():
            raise ValueError("the stored payload differs")
        feature = f"frames={len(seen)};starts={','.join(map(str, cuts(np.stack(seen))))};luma={luma}"
        out.append((n, size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature))
    return out


def _digests(batches):
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in slices(batches):
        rows, held, size = [], [], 0
        for text in batch.column(1).to_pylist():
            if held and size + len(text or "") > HELD:
                rows, held, size = rows + _digest_rows(held), [], 0
            held.append(text)
            size += len(text or "")
        rows += _digest_rows(held)
        columns = [batch.column(0).cast(pa.int64()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[1:]))]
        yield pa.RecordBatch.from_arrays(columns, names)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, media (binary AVI) of each row."""
    def work(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(pad(t)[0]) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(work, "doc_id long, media binary")


def _clip_rows(ids: list[int], files: list[bytes]) -> list[tuple]:
    rows = []
    for i, got in zip(ids, histograms_of(files)):
        rows += [(i, None, None, None, None, str(got))] if isinstance(got, Exception) else [(i, *c, None) for c in timed(*got)]
    return rows


def _grouped(items, size, most: int):
    """Lists of items of at most so many bytes together (one larger item is a list of its own)."""
    held, total = [], 0
    for x in items:
        if held and total + size(x) > most:
            yield held
            held, total = [], 0
        held.append(x)
        total += size(x)
    if held:
        yield held


def to_clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of doc_id, media; a file that can't be read has one row with its error."""
    def work(batches):
        for batch in slices(batches):
            pairs = ((i, m.as_py()) for i, m in zip(batch.column(0).to_pylist(), batch.column(1)) if m.is_valid)
            for some in _grouped(pairs, lambda x: len(x[1]), HELD):
                columns = list(zip(*_clip_rows(*map(list, zip(*some)))))
                kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "clip", "start_s", "end_s", "frames", "error"])
    return media.select("doc_id", "media").mapInArrow(work, CLIPS)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_digests, DIGEST)


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, clip, start_s, end_s, frames, error: the shots of every document's media."""
    return to_clips(to_media(table(spark, sf_dir, "documents")))
