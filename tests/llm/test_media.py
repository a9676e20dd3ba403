import hashlib
import zlib

import numpy as np
import pytest

from lodestar.llm import media


def test_tables():
    """Points of G.711, the symmetry of both laws, and steps that grow with the level."""
    mu, a = media.mulaw_table().astype(int), media.alaw_table().astype(int)
    assert mu[0x00] == -32124 and mu[0x80] == 32124 and mu[0xFF] == 0 and mu[0x7F] == 0
    assert a[0x55] == -8 and a[0xD5] == 8 and a[0x2A] == -32256 and a[0xAA] == 32256
    assert (mu[:128] == -mu[128:]).all() and (a[:128] == -a[128:]).all()
    assert (np.diff(np.sort(mu[128:])) > 0).all() and len(set(a)) == 256


def plain_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media._STEPS[index])
            move = (step >> 3) + (step if code & 4 else 0) + ((step >> 1) if code & 2 else 0) + ((step >> 2) if code & 1 else 0)
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def test_adpcm_across_blocks():
    blocks = np.random.default_rng(1).integers(0, 256, (300, media.BLOCK), dtype=np.uint8)
    assert media.adpcm_blocks(blocks).tolist() == [plain_adpcm(bytes(b)) for b in blocks]
    assert media.adpcm_blocks(blocks[:0]).shape == (0, 121)


@pytest.mark.parametrize("to", [16000, 11025, 6000, 48000, 8000])
def test_resampling_a_tone(to):
    at = lambda rate, n: 10000 * np.sin(np.arange(n) * 2 * np.pi * 440 / rate)
    pcm = at(8000, 4000).astype(np.int16)
    out = media.resample(pcm, 8000, to)
    assert abs(len(out) - 4000 * to / 8000) <= 1
    assert np.abs(out - at(to, len(out)))[200:-200].max() < 40
    assert len(media.resample(pcm[:0], 8000, to)) == 0 and len(media.resample(pcm[:1], 8000, to)) >= 1


def test_files_round_trip():
    for codec in (media.MULAW, media.ALAW, media.ADPCM):
        for n in (64, 128, 6400):
            data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
            assert media.unwav(media.wav(data, 8000, codec)) == (data, 8000, codec, 64 if codec == media.ADPCM else 1)
    for bad in (b"", b"RIFF", b"RIFF\0\0\0\0WAVE", b"x" * 100):
        with pytest.raises(ValueError):
            media.unwav(bad)


def test_adpcm_header():
    """The format chunk of ADPCM has two bytes more: samples per block."""
    import struct

    own = media.wav(b"\1" * 128, 8000, media.ADPCM)
    size, tag, channels, rate, speed, align, bits, more, per_block = struct.unpack("<IHHIIHHHH", own[16:40])
    assert (size, tag, channels, rate, align, bits, more, per_block) == (20, 0x11, 1, 8000, 64, 4, 2, 121)
    assert own[40:44] == b"fact" and struct.unpack("<I", own[48:52])[0] == 2 * 121 and struct.unpack("<I", own[4:8])[0] == len(own) - 8


def test_broken_files_are_null(spark):
    """A file that is cut anywhere, or whose header is of no use, is no file; blocks of another size are read as they are."""
    whole = [media.wav(bytes(range(128)), 8000, codec) for codec in (media.MULAW, media.ADPCM)]
    values = [w[:n] for w in whole for n in range(len(w))] + [whole[1][:32] + b"\x04\x00" + whole[1][34:], whole[0][:24] + bytes(4) + whole[0][28:]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, media binary")
    assert [r.id for r in media.to_pcm(df).where("pcm IS NOT NULL").collect()] == []
    block32 = whole[1][:32] + b"\x20\x00" + whole[1][34:]
    got = media.to_pcm(spark.createDataFrame([(block32,)], "media binary"), to=8000).first().pcm
    want = np.concatenate([plain_adpcm(bytes(range(128))[i : i + 32]) for i in range(0, 128, 32)])
    assert np.frombuffer(got, "<i2").tolist() == want.tolist()


def test_every_row(docs, rows, empty, clashing):
    for df in (docs, clashing):
        got = sorted(map(tuple, media.stored(df).collect()), key=repr)
        want = []
        for r in rows:
            text = (r[1] or "").encode()
            payload = text + b"\0" * (-len(text) % 64 or (0 if text else 64))
            own = media.wav(payload)
            assert media.unwav(own)[0] == payload
            want.append((r[0], len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(own), hashlib.sha256(own).hexdigest()))
        assert [g[:7] for g in got] == sorted(want, key=repr)
    for r in media.stored(docs).collect():  # the feature is that of the stored PCM
        if r.doc_id in (0, 5, 102):
            payload = next(x[1] for x in rows if x[0] == r.doc_id).encode().ljust(r.payload_bytes, b"\0")
            pcm = media.resample(media.mulaw_table()[np.frombuffer(payload, np.uint8)], 8000, 16000)
            assert r.feature.split(";pcm:")[1] == f"{zlib.crc32(pcm.astype('<i2').tobytes()):x}"
    same = {}
    for r in media.stored(docs.unionByName(docs)).collect():
        assert same.setdefault(r.payload_sha256, r.feature) == r.feature
    assert media.stored(empty).count() == 0


def test_columns(spark):
    rows = [(1, b"\x00\x80" * 64), (2, None), (3, b"")]
    df = media.to_media(spark.createDataFrame(rows, "id int, raw binary"), "raw", codec=media.ALAW)
    out = {r.id: r for r in media.to_pcm(df, to=8000).collect()}
    assert np.frombuffer(out[1].pcm, "<i2").tolist() == [int(media.alaw_table()[0]), int(media.alaw_table()[0x80])] * 64
    assert out[2].media is None and out[2].pcm is None and out[3].pcm == b""
    broken = spark.createDataFrame([(b"no file",)], "media binary")
    assert media.to_pcm(broken).first().pcm is None
