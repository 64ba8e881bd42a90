"""Media columns: Matroska files as packet tables.

parse() walks the EBML elements of one file: element ids and sizes are variable-length integers, masters nest, a
Segment or Cluster may have an unknown size. Blocks give packets, one for each frame of their lacing (none, Xiph,
fixed-size, EBML), with track, timestamp and byte range; Cues give seek points. build() writes a file of one 8-bit
PCM track, so that text bytes can be stored as samples without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import long_field, map_batches, string_field, table

# Element ids of the Matroska format.
EBML, EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}

#: build(): bytes of a frame, frames of a block, blocks of a cluster, samples a second.
FRAME, FRAMES, BLOCKS, RATE = 1024, 8, 16, 8000


@dataclass
class Media:
    """What a file holds. tracks: number, type, codec; packets: track, timestamp ns, offset, size, lacing, keyframe, cluster; cues: timestamp ns, track, cluster's offset."""

    scale: int = 1_000_000
    duration_ms: float | None = None
    doc_type: str = ""
    tracks: list[tuple[int, int, str]] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, int, bool, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0


def vint(b: bytes, at: int, marker: bool = False) -> tuple[int, int]:
    """The variable-length integer at a place, with its length marker or without, and the place after it; -1 is an unknown size."""
    if at >= len(b) or not b[at]:
        raise ValueError(f"no variable-length integer at {at}")
    n = 9 - b[at].bit_length()
    if at + n > len(b):
        raise ValueError(f"cut off at {at}")
    value = int.from_bytes(b[at : at + n], "big")
    if marker:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def elements(b: bytes, at: int, end: int, stop: set[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements in a range; one of unknown size ends before an id of its level, which `stop` and TOP hold."""
    while at < end:
        kind, body = vint(b, at, True)
        size, body = vint(b, body)
        if kind in stop:
            return
        if size < 0:
            if kind == SEGMENT:
                close = end
            else:
                close = body
                for k, _, e in elements(b, body, end):
                    if k in TOP:
                        break
                    close = e
        else:
            close = body + size
        if close > end:
            raise ValueError(f"element {kind:x} at {at} ends at {close}, beyond {end}")
        yield kind, body, close
        at = close


def _uint(b: bytes, s: int, e: int) -> int:
    return int.from_bytes(b[s:e], "big")


def _float(b: bytes, s: int, e: int) -> float:
    return struct.unpack(">f" if e - s == 4 else ">d", b[s:e])[0] if e > s else 0.0


def laced(b: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Offsets and sizes of a block's frames."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    n, at = b[at] + 1, at + 1
    if lacing == FIXED:
        size, rest = divmod(end - at, n)
        if rest:
            raise ValueError("fixed-size lacing doesn't divide its block")
        sizes = [size] * n
    else:
        sizes = []
        for k in range(n - 1):
            if lacing == XIPH:
                size = 0
                while True:
                    size, at = size + b[at], at + 1
                    if b[at - 1] < 255:
                        break
            else:
                before = at
                size, at = vint(b, at)
                if size < 0:  # all ones: here a number as others
                    size = (1 << 7 * (at - before)) - 1
                if k:
                    size = sizes[-1] + size - ((1 << 7 * (at - before) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing is longer than its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(b: bytes) -> Media:
    """Read a whole file; ValueError where it is malformed."""
    media = Media()

    def block(s: int, e: int, time: int, key: bool | None) -> None:
        track, at = vint(b, s)
        if at + 3 > e:
            raise ValueError("a block is cut off")
        relative, flags = struct.unpack(">hB", b[at : at + 3])
        lacing = flags >> 1 & 3
        frames = laced(b, at + 3, e, lacing)
        media.blocks += 1
        for k, (o, n) in enumerate(frames):
            step = durations.get(track, 0)
            media.packets.append((track, (time + relative) * media.scale + k * step, o, n, lacing, bool(flags & 0x80) if key is None else key, len(media.clusters) - 1))

    durations: dict[int, int] = {}
    try:
        for kind, s, e in elements(b, 0, len(b)):
            if kind == EBML:
                media.doc_type = next((b[x:y].decode("ascii", "replace") for k, x, y in elements(b, s, e) if k == DOC_TYPE), "")
            elif kind == SEGMENT:
                for top, s1, e1 in elements(b, s, e):
                    if top == INFO:
                        for k, x, y in elements(b, s1, e1):
                            if k == TIMESTAMP_SCALE:
                                media.scale = _uint(b, x, y)
                            elif k == DURATION:
                                media.duration_ms = _float(b, x, y)
                    elif top == TRACKS:
                        for k, x, y in elements(b, s1, e1):
                            if k == TRACK_ENTRY:
                                own = {i: (p, q) for i, p, q in elements(b, x, y)}
                                get = lambda i, own=own: _uint(b, *own.get(i, (0, 0)))
                                media.tracks.append((get(TRACK_NUMBER), get(TRACK_TYPE), bytes(b[slice(*own.get(CODEC_ID, (0, 0)))]).decode("ascii", "replace")))
                                durations[get(TRACK_NUMBER)] = get(DEFAULT_DURATION)
                    elif top == CLUSTER:
                        media.clusters.append(s1)
                        time = 0
                        for k, x, y in elements(b, s1, e1, TOP):
                            if k == TIMESTAMP:
                                time = _uint(b, x, y)
                            elif k == SIMPLE_BLOCK:
                                block(x, y, time, None)
                            elif k == BLOCK_GROUP:
                                own = {i: (p, q) for i, p, q in elements(b, x, y)}
                                if BLOCK in own:
                                    block(*own[BLOCK], time, REFERENCE_BLOCK not in own)
                    elif top == CUES:
                        for k, x, y in elements(b, s1, e1):
                            if k == CUE_POINT:
                                time, places = 0, []
                                for i, p, q in elements(b, x, y):
                                    if i == CUE_TIME:
                                        time = _uint(b, p, q)
                                    elif i == CUE_TRACK_POSITIONS:
                                        own = {j: _uint(b, u, v) for j, u, v in elements(b, p, q)}
                                        places.append((own.get(CUE_TRACK, 0), s + own.get(CUE_CLUSTER_POSITION, 0)))
                                media.cues += [(time * media.scale, t, o) for t, o in places]
    except (IndexError, struct.error) as error:
        raise ValueError(str(error)) from error
    return media


def _size(n: int, least: int = 1) -> bytes:
    k = least
    while n >= (1 << 7 * k) - 1:
        k += 1
    return (n | 1 << 7 * k).to_bytes(k, "big")


def _id(kind: int) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big")


def element(kind: int, body: bytes) -> bytes:
    return _id(kind) + _size(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def simple_block(track: int, relative: int, frames: list[bytes], lacing: int) -> bytes:
    """A SimpleBlock of keyframes."""
    head = _size(track) + struct.pack(">hB", relative, 0x80 | lacing << 1)
    if lacing != NO_LACING:
        head += bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == EBML_LACING and len(frames) > 1:
        head += _size(len(frames[0]))
        for a, c in zip(frames, frames[1:-1], strict=False):
            k, d = 1, len(c) - len(a)
            while not -((1 << 7 * k - 1) - 1) <= d <= (1 << 7 * k - 1) - 1:
                k += 1
            head += (d + ((1 << 7 * k - 1) - 1) | 1 << 7 * k).to_bytes(k, "big")
    return element(SIMPLE_BLOCK, head + b"".join(frames))


def build(payload: bytes) -> bytes:
    """A file of one 8-bit PCM track whose frames are the payload. Lacings alternate; the last frame of all may be short."""
    header = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"versefold") + element(WRITING_APP, b"versefold"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME * 10**9 // RATE) + audio))
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    body, cues, per = [info, tracks], [], FRAMES * BLOCKS
    at = len(info) + len(tracks)
    for c in range(0, len(frames), per):
        time = c * FRAME * 1000 // RATE
        parts = [number(TIMESTAMP, time)]
        for k in range(c, min(c + per, len(frames)), FRAMES):
            own = frames[k : k + FRAMES]
            even = len(own[-1]) == len(own[0])
            lacing = NO_LACING if len(own) == 1 else (FIXED, EBML_LACING, XIPH)[k // FRAMES % 3]
            lacing = EBML_LACING if lacing == FIXED and not even else lacing
            parts.append(simple_block(1, k * FRAME * 1000 // RATE - time, own, lacing))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        at += len(cluster)
        body.append(cluster)
    return header + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


PACKET = T.StructType([T.StructField("track", T.IntegerType()), long_field("timestamp_ns"), long_field("byte_start"), long_field("byte_size"), T.StructField("lacing", T.IntegerType()), T.StructField("keyframe", T.BooleanType()), T.StructField("cluster", T.IntegerType())])


def packets(files: DataFrame, content: str = "content") -> DataFrame:
    """files without their content, with a row for each packet: track, timestamp_ns, byte_start, byte_size, lacing, keyframe, cluster.

    A null, empty or malformed file has one row whose packet columns are null and whose `error` says why (null: no
    packets). Columns of these names are replaced.
    """
    kind = T.ArrayType(PACKET)
    arrow = pa.list_(pa.struct([("track", pa.int32()), ("timestamp_ns", pa.int64()), ("byte_start", pa.int64()), ("byte_size", pa.int64()), ("lacing", pa.int32()), ("keyframe", pa.bool_()), ("cluster", pa.int32())]))

    def fn(batch: pa.RecordBatch) -> dict:
        rows, errors = [], []
        for x in batch.column(content):
            b = x.as_buffer()
            try:
                rows.append([dict(zip(PACKET.names, p, strict=True)) for p in parse(b.to_pybytes()).packets] if b is not None else [])
                errors.append(None)
            except ValueError as error:
                rows.append([])
                errors.append(str(error))
        return {"_packets": pa.array(rows, arrow), "error": pa.array(errors, pa.string())}

    made = map_batches(files, fn, [T.StructField("_packets", kind), string_field("error")])
    keep = [c for c in made.columns if c not in {content, "_packets", "error", *PACKET.names}]
    return made.select(*keep, "error", F.explode_outer("_packets").alias("_p")).select(*keep, "_p.*", "error")


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each text (null: empty) stored as a Matroska file, read back and described.

    Adds n_bytes, payload_bytes, payload_sha256, tail_crc32 (of what is read back, padded with zeros to 64 bytes),
    content (the file) and feature. Columns of these names are replaced.
    """
    fields = [long_field("n_bytes"), long_field("payload_bytes"), string_field("payload_sha256"), long_field("tail_crc32"), T.StructField("content", T.BinaryType()), string_field("feature")]

    def fn(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in fields}
        for x in batch.column(text):
            b = x.as_buffer()
            raw = b.to_pybytes() if b is not None else b""
            file = build(raw + bytes(-len(raw) % 64 if raw else 64))
            media = parse(file)
            back = b"".join(file[o : o + n] for _, _, o, n, _, _, _ in media.packets)
            samples = np.frombuffer(back, np.uint8)
            lacings = np.bincount([p[4] for p in media.packets], minlength=4)
            for name, v in (
                ("n_bytes", len(raw)),
                ("payload_bytes", len(back)),
                ("payload_sha256", hashlib.sha256(back).hexdigest()),
                ("tail_crc32", zlib.crc32(back[-64:])),
                ("content", file),
                ("feature", f"tracks={len(media.tracks)};clusters={len(media.clusters)};cues={len(media.cues)};blocks={media.blocks};packets={len(media.packets)};lacing={','.join(map(str, lacings.tolist()))};duration_ms={media.duration_ms:.3f};sum={int(samples.sum(dtype=np.int64))};rises={int(np.count_nonzero(samples[1:] > samples[:-1]))}"),
            ):
                out[name].append(v)
        return {f.name: pa.array(out[f.name], pa.binary() if f.name == "content" else pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in fields}

    return map_batches(docs, fn, fields)


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stored(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("content").cast("long").alias("media_bytes"), F.sha2("content", 256).alias("media_sha256"), "feature")
