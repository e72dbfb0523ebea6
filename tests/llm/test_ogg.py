import hashlib
import random
import zlib

from cutplan.llm import ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum_equals_bitwise_definition():
    rng = random.Random(1)
    for n in (0, 1, 5, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_crc(data)


def test_round_trip_lacing_and_times():
    rng = random.Random(2)
    for n in (1, 64, 254, 255, 256, 999, 1000, 1001, 2000, 70_000, 300_000):
        for packet, streams in ((1000, 2), (255, 1), (510, 3), (70_000, 2)):
            payload = rng.randbytes(n)
            got, bad = ogg.read(ogg.write(payload, streams, packet))
            assert bad == 0 and ogg.payload_of(got) == payload and all(s.ended for s in got.values())
            for k, serial in enumerate(sorted(got)):
                want = [min(n, (i * streams + k + 1) * packet) / ogg.RATE for i in range(len(got[serial].packets))]
                if n % packet == 0 or len(want) < 1 or want[-1] < n / ogg.RATE:
                    assert ogg.seconds(got[serial], streams, packet) == want


def test_damage_is_counted_and_later_pages_are_read():
    data = bytearray(ogg.write(bytes(range(256)) * 400))
    data[200] ^= 1
    streams, bad = ogg.read(bytes(data))
    assert bad >= 1 and ogg.payload_of(streams) != bytes(range(256)) * 400
    assert ogg.read(data[:-5])[1] >= 1 and ogg.read(b"")[0] == {}


def test_query_rows(spark):
    texts = [None, "", "a", "é" * 40, "x" * 64, "y" * 200_000, "a", "OggS OggS"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = {r.doc_id: r for r in ogg.digest(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (rows[i].n_bytes, rows[i].payload_bytes) == (len(raw), len(want))
        assert rows[i].payload_sha256 == hashlib.sha256(want).hexdigest() and rows[i].tail_crc32 == zlib.crc32(want[-64:])
        assert "bad_pages=0" in rows[i].feature
    assert rows[2].media_sha256 == rows[6].media_sha256 and rows[0].feature == rows[1].feature
    assert ogg.digest(docs.limit(0)).count() == 0 and ogg.encode(docs).columns == ["doc_id", "text", "media"]


def test_missing_pages_are_counted():
    payload = bytes(range(256)) * 1200
    data = ogg.write(payload)
    at = [i for i in range(len(data)) if data[i : i + 4] == b"OggS"]
    streams, bad = ogg.read(data[: at[3]] + data[at[4] :])
    assert bad == 1 and len(ogg.payload_of(streams)) < len(payload)


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (3, None)], "doc_id long, text string")
    rows = ogg.digest(docs).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == [-1, -1, 3, 3]
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in rows if r.n_bytes}) == 1
