"""Matroska: lossless round trips, each lacing, unknown sizes, malformed files."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from versefold.llm import matroska as mk


def sizes(n):
    rng = random.Random(n)
    return [rng.choice([0, 1, 5, 254, 255, 256, 300, 510, 70_000]) for _ in range(n)]


@pytest.mark.parametrize(("lacing", "n"), [(mk.NO_LACING, 1), *((k, n) for k in (mk.XIPH, mk.EBML_LACING, mk.FIXED) for n in (1, 2, 3, 8, 256))])
def test_lacing(lacing, n):
    frames = [bytes([k % 256]) * s for k, s in enumerate([7] * n if lacing == mk.FIXED else sizes(n))]
    block = mk.simple_block(129, -5, frames, lacing)
    file = mk.element(mk.SEGMENT, mk.element(mk.CLUSTER, mk.number(mk.TIMESTAMP, 100) + block))
    media = mk.parse(file)
    assert [file[o : o + s] for _, _, o, s, _, _, _ in media.packets] == frames
    assert {p[0] for p in media.packets} == {129} and media.packets[0][1] == 95_000_000
    assert {p[4] for p in media.packets} == {lacing} and all(p[5] for p in media.packets)


def test_known_bytes():
    assert mk.vint(b"\x81", 0) == (1, 1) and mk.vint(b"\x40\x02", 0) == (2, 2) and mk.vint(b"\xff", 0) == (-1, 1)
    assert mk.vint(b"\x1a\x45\xdf\xa3", 0, True) == (mk.EBML, 4)
    # EBML lacing of 800, 500, 1000: the first size, then a difference of -300, and the rest.
    assert mk.laced(bytes.fromhex("02" "4320" "5ed3") + bytes(2300), 0, 2305, mk.EBML_LACING) == [(5, 800), (805, 500), (1305, 1000)]
    # Xiph lacing of 800, 500, 1000.
    assert mk.laced(bytes.fromhex("02" "ffffff23" "fff5") + bytes(2300), 0, 2307, mk.XIPH) == [(7, 800), (807, 500), (1307, 1000)]


def test_unknown_sizes_groups_and_cues():
    group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, b"\x81\x00\x02\x00abc") + mk.number(mk.REFERENCE_BLOCK, 1))
    unknown = b"\x01\xff\xff\xff\xff\xff\xff\xff"
    cluster = mk._id(mk.CLUSTER) + unknown + mk.number(mk.TIMESTAMP, 3) + group
    cues = mk.element(mk.CUES, mk.element(mk.CUE_POINT, mk.number(mk.CUE_TIME, 3) + mk.element(mk.CUE_TRACK_POSITIONS, mk.number(mk.CUE_TRACK, 1) + mk.number(mk.CUE_CLUSTER_POSITION, 0))))
    file = mk._id(mk.SEGMENT) + unknown + cluster + cluster + cues
    media = mk.parse(file)
    assert [(p[1], file[p[2] : p[2] + p[3]], p[5], p[6]) for p in media.packets] == [(5_000_000, b"abc", False, 0), (5_000_000, b"abc", False, 1)]
    assert media.cues == [(3_000_000, 1, 12)]


@pytest.mark.parametrize("n", [0, 1, 64, 1024, 8192, 8193, 131_072, 131_136, 400_000])
def test_build_and_parse(n):
    payload = random.Random(n).randbytes(n)
    file = mk.build(payload)
    media = mk.parse(file)
    assert b"".join(file[o : o + s] for _, _, o, s, _, _, _ in media.packets) == payload
    assert media.tracks == [(1, 2, "A_PCM/INT/LIT")] and media.doc_type == "matroska" and media.duration_ms == n / 8
    assert len(media.cues) == len(media.clusters)
    for _, _, at in media.cues:
        assert mk.vint(file, at, True)[0] == mk.CLUSTER
    times = [p[1] for p in media.packets]
    assert times == sorted(times) and (not times or times[-1] == (len(times) - 1) * 128_000_000)


def test_cut_files_are_errors_not_crashes():
    file = mk.build(bytes(5000))
    rng = random.Random(1)
    for k in range(1, len(file), 97):
        with pytest.raises(ValueError):  # noqa: PT011
            mk.parse(file[:k])
    for _ in range(300):
        broken = bytearray(file)
        for _ in range(5):
            broken[rng.randrange(len(file))] = rng.randrange(256)
        try:
            mk.parse(bytes(broken))
        except ValueError:
            pass


def test_stored(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(-1, None), (-2, ""), (-3, "é" * 32), (-4, "x" * 300_000), (-4, "x" * 300_000)]
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], "doc_id long, text string, content string, n_bytes int")
    got = mk.stored(df).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    empty = {r.doc_id: (r.payload_bytes, bytes(r.content), r.feature) for r in got if r.doc_id in (-1, -2)}
    assert empty[-1] == empty[-2] and empty[-1][0] == 64
    assert mk.stored(df.limit(0)).count() == 0
    table = mk.packets(mk.stored(df).where("doc_id = -4").select("doc_id", "content"))
    assert table.agg(F.sum("byte_size")).first()[0] == 2 * 300_032
    odd = mk.packets(spark.createDataFrame([(1, None, "t"), (2, b"", "t"), (3, b"\x00\x01", "t")], "id int, content binary, track string"))
    assert {r.id: (r.byte_size, r.error is None) for r in odd.collect()} == {1: (None, True), 2: (None, True), 3: (None, False)}


def test_query_against_plain_code(spark, sf_dir):
    """Features and digests of the stored form, from the texts and from a file that is built and taken apart again here."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = mk.op4_matroska(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        file = mk.build(padded)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        said = dict(x.split("=") for x in r.feature.split(";"))
        n = -(-len(padded) // mk.FRAME)
        clusters = -(-n // (mk.FRAMES * mk.BLOCKS))
        assert (int(said["packets"]), int(said["clusters"]), int(said["cues"]), int(said["tracks"])) == (n, clusters, clusters, 1)
        assert int(said["blocks"]) == -(-n // mk.FRAMES) and sum(map(int, said["lacing"].split(","))) == n
        assert (int(said["sum"]), int(said["rises"])) == (sum(padded), sum(b > a for a, b in zip(padded, padded[1:], strict=False)))
        assert float(said["duration_ms"]) == len(padded) * 1000 / mk.RATE
