"""MPEG audio as a media column: payload bytes in the ancillary data of layer III frames, and a parser for any stream.

``encode`` writes an ID3v2 tag, a frame with a variable-bitrate table (frames, bytes, 100-entry table of contents) and
one silent MPEG-1 layer III mono frame (48 kHz, 80 kbit/s, checksum) per 192 payload bytes: every granule has length
0, so decoders play silence and the main data after the side information is free for the payload.
``parse`` resynchronises on frame headers, reads ID3v1/ID3v2 tags and Xing/Info/VBRI tables, verifies the checksums
of all frames and gives the exact duration (samples over rate) and each frame's seek offset.

Cases: a null text counts as empty and is stored as one block of padding; a very long text is one stream, held whole
by one task; bytes that belong to no frame are counted as skipped; a stream without frames parses to zero frames and
duration 0; streams that ``encode`` did not mark have no payload; equal texts give equal media, repeated rows each
their own row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textarrays import passes

BLOCK = 192
#: Name of the tag that ``encode`` keeps the unpadded length in.
MARK = "bytes"
# Fixed values of the MPEG audio frame header: bit rates (kbit/s), sampling rates (Hz) and samples a frame.
KBITS = {
    (1, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 2.5: [11025, 12000, 8000]}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    checked: bool
    kbits: int
    rate: int
    size: int
    samples: int
    side: int
    mono: bool


_seen: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None where they are none."""
    if four not in _seen:
        if len(_seen) > 100_000:
            _seen.clear()
        _seen[four] = _header(four)
    return _seen[four]


def _header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(four[1] >> 3 & 3)
    layer = 4 - (four[1] >> 1 & 3)
    rate, kbits = four[2] >> 2 & 3, four[2] >> 4
    if version is None or layer == 4 or rate == 3 or kbits in (0, 15) or four[3] & 3 == 2:
        return None
    family = 1 if version == 1 else 2
    hz, kb, pad, mono = RATES[version][rate], KBITS[family, layer][kbits - 1], four[2] >> 1 & 1, four[3] >> 6 == 3
    samples = SAMPLES[family, layer]
    size = (12 * kb * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kb * 1000 // hz + pad
    side = (17 if mono else 32) if family == 1 else (9 if mono else 17)
    return Header(version, layer, not four[1] & 1, kb, hz, size, samples, side if layer == 3 else 0, mono)


def _crc_table() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
        out[i] = c
    return out


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """MPEG checksum (polynomial x8005, start xFFFF) of each row of bytes."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ _CRC[(c >> np.uint16(8)) ^ rows[:, k]]
    return c


HEAD = bytes([0xFF, 0xFA, 0x64, 0xC0])
_H = header(HEAD)
_DATA = 4 + 2 + _H.side


def _frame() -> np.ndarray:
    f = np.zeros(_H.size, np.uint8)
    f[:4] = np.frombuffer(HEAD, np.uint8)
    c = int(crc16(np.concatenate([f[2:4], f[6:_DATA]])[None, :])[0])
    f[4], f[5] = c >> 8, c & 255
    return f


_FRAME = _frame()


def _synchsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def encode(payload: bytes, n_bytes: int) -> bytes:
    """Media bytes for a payload whose length is a positive multiple of 192; the unpadded length goes to the tag."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    frames = np.tile(_FRAME, (len(blocks) + 1, 1))
    frames[1:, _DATA : _DATA + BLOCK] = blocks
    text = b"\x00" + MARK.encode() + b"\x00" + str(n_bytes).encode()
    tag = b"TXXX" + _synchsafe(len(text)) + b"\x00\x00" + text
    toc = bytes(k * 256 // 100 for k in range(100))
    info = b"Info" + struct.pack(">III", 7, len(blocks), frames.size) + toc
    frames[0, _DATA : _DATA + len(info)] = np.frombuffer(info, np.uint8)
    return b"ID3\x04\x00\x00" + _synchsafe(len(tag)) + tag + frames.tobytes()


@dataclass
class Audio:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)
    rate: int = 0
    samples: int = 0
    skipped: int = 0
    checked: int = 0
    good: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    data_at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _tags(raw: bytes) -> tuple[int, dict[str, str]]:
    start, tags = 0, {}
    while raw[start : start + 3] == b"ID3" and len(raw) - start >= 10:
        major, (a, b, c, d) = raw[start + 3], raw[start + 6 : start + 10]
        size = a << 21 | b << 14 | c << 7 | d
        at, stop = start + 10, min(start + 10 + size, len(raw))
        while at + 10 <= stop and raw[at] and major >= 3:
            n = int.from_bytes(raw[at + 4 : at + 8]) if major == 3 else raw[at + 4] << 21 | raw[at + 5] << 14 | raw[at + 6] << 7 | raw[at + 7]
            name, body = raw[at : at + 4].decode("latin-1"), raw[at + 10 : at + 10 + n]
            if name[0] == "T" and body:
                code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                key, _, value = body[1:].decode(code, "replace").partition("\0") if name == "TXXX" else (name, "", body[1:].decode(code, "replace"))
                tags[key] = value.rstrip("\0")
            at += 10 + n
        start = start + 10 + size
    return start, tags


def _closing_tag(raw: bytes, at: int) -> dict[str, str] | None:
    """The ID3v1 tag that ends the stream at ``at``, if there is one."""
    if len(raw) - at != 128 or raw[at : at + 3] != b"TAG":
        return None
    return {k: v for k, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)) if (v := raw[at + a : at + b].rstrip(b"\0 ").decode("latin-1"))}


def _vbr(raw: bytes, at: int, h: Header) -> dict[str, object]:
    x = at + 4 + 2 * h.checked + h.side
    if raw[x : x + 4] in (b"Xing", b"Info"):
        flags, at, out = int.from_bytes(raw[x + 4 : x + 8]), x + 8, {"kind": raw[x : x + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], at = int.from_bytes(raw[at : at + 4]), at + 4
        if flags & 4:
            out["toc"] = list(raw[at : at + 100])
        return out
    x = at + 36
    if raw[x : x + 4] == b"VBRI":
        entries, scale, width, each = (int.from_bytes(raw[x + k : x + k + 2]) for k in (18, 20, 22, 24))
        steps = [int.from_bytes(raw[x + 26 + width * k : x + 26 + width * (k + 1)]) * scale for k in range(entries)]
        return {"kind": "VBRI", "bytes": int.from_bytes(raw[x + 10 : x + 14]), "frames": int.from_bytes(raw[x + 14 : x + 18]), "frames_an_entry": each, "toc": steps}
    return {}


def parse(raw: bytes) -> Audio:
    """Tags, tables, checksums, exact duration and seek offsets of a stream."""
    (at, tags), end = _tags(raw), len(raw)
    out, buf = Audio(tags=tags), np.frombuffer(raw, np.uint8)
    runs: list[tuple[np.ndarray, int, int]] = []
    first = True
    while at + 4 <= end:
        h = header(raw[at : at + 4])
        follows = at + h.size if h else 0
        tail = _closing_tag(raw, at)
        if tail is not None:
            # Frames come first: a tag stands where no frame is left, never inside of one.
            out.tags |= tail
            at = end
            break
        last = follows + 4 > end or _closing_tag(raw, follows) is not None
        if not h or follows > end or (not last and header(raw[follows : follows + 4]) is None) or (out.rate and h.rate != out.rate):
            nxt = raw.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped, at = out.skipped + nxt - at, nxt
            continue
        if first:
            first, out.rate = False, h.rate
            out.table = _vbr(raw, at, h)
            if out.table:
                at = follows
                continue
        n = (end - at) // h.size
        rows = buf[at : at + n * h.size].reshape(n, h.size)
        same = (rows[:, :4] == rows[0, :4]).all(axis=1)
        n = n if same.all() else int(np.argmin(same))
        rows = rows[:n]
        if h.checked and h.layer == 3 and h.size >= 6 + h.side:
            got = rows[:, 4].astype(np.uint16) << np.uint16(8) | rows[:, 5]
            out.checked += n
            out.good += int((crc16(np.concatenate([rows[:, 2:4], rows[:, 6 : 6 + h.side]], axis=1)) == got).sum())
        runs.append((at + h.size * np.arange(n), h.size, 4 + 2 * h.checked + h.side))
        out.samples += n * h.samples
        at += n * h.size
    out.skipped += end - at
    if runs:
        out.offsets = np.concatenate([r[0] for r in runs])
        out.sizes = np.concatenate([np.full(len(r[0]), r[1]) for r in runs])
        out.data_at = np.concatenate([r[0] + r[2] for r in runs])
    return out


def decode(raw: bytes, audio: Audio) -> bytes:
    """The payload blocks that ``encode`` stored, read from the frames' main data; none of other streams."""
    room = audio.offsets + audio.sizes - audio.data_at >= BLOCK
    if MARK not in audio.tags or not room.any():
        return b""
    return np.frombuffer(raw, np.uint8)[audio.data_at[room][:, None] + np.arange(BLOCK)].tobytes()


def encode_texts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as MPEG audio bytes."""

    def run(batches):
        for batch, t in passes(batches, "text"):
            raw, n_bytes, media = t.buf.tobytes(), np.diff(t.offsets), []
            for a, n in zip(t.offsets[:-1].tolist(), n_bytes.tolist(), strict=True):
                payload = raw[a : a + n]
                media.append(encode(payload + b" " * (max(BLOCK, -(-n // BLOCK) * BLOCK) - n), n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary"
    return documents.select("doc_id", documents[text].alias("text")).mapInArrow(run, schema)


def media_features(media: DataFrame) -> DataFrame:
    """Parse a column ``media``: payload digests, exact duration, seek offsets (as a digest) and checksum counts."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_samples", "sample_rate", "seek_offsets"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for raw in part.column(2).to_pylist():
                    raw = raw or b""
                    audio = parse(raw)
                    payload = decode(raw, audio)
                    seconds = f"{audio.samples}/{audio.rate}"
                    step = int(audio.sizes[0]) if len(audio.sizes) and (audio.sizes == audio.sizes[0]).all() else 0
                    first = int(audio.offsets[0]) if len(audio.offsets) else -1
                    listed = audio.table.get("frames", "-")
                    feature = f"frames={len(audio.offsets)};listed={listed};seconds={seconds};first={first};step={step};good={audio.good}/{audio.checked};skipped={audio.skipped}"
                    # Equal frames need no list of offsets: first and step give each; other streams list them all.
                    seek = audio.offsets[:1].tolist() + [step] if step else audio.offsets.tolist()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, len(audio.offsets), audio.samples, audio.rate, seek))
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=names)

    schema = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_samples long, sample_rate long, seek_offsets array<long>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
