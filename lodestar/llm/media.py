"""Telephony audio in table columns: mu-law, A-law and IMA ADPCM, expanded to PCM and resampled.

mu-law and A-law are expanded through tables of 256 entries, made from the rules of ITU-T G.711. IMA ADPCM comes in blocks of
``BLOCK`` bytes: a little-endian 16-bit first sample, a step index, a zero byte, then two samples a byte, low half first. Each
sample of a block depends on the one before, but blocks don't depend on each other: the k-th samples of all blocks of
a batch of rows are decoded at once. Resampling is by a windowed sinc in polyphase form. Stored PCM is 16-bit
little-endian, mono.

``to_media`` stores bytes as 8-bit samples in a RIFF file without loss, and ``to_pcm`` reads such files, expands and resamples
them; each adds columns and keeps the others. ``stored`` does both for texts, a null one as an empty one. Rows are decoded one
by one, so equal values give equal results and repeated rows repeat them; batches are cut by their bytes, so memory is in
proportion to the longest value. No shuffle; an empty table gives an empty one.
"""

from __future__ import annotations

import struct
from functools import lru_cache
from math import gcd, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLOCK = 64
MULAW, ALAW, ADPCM = "mulaw", "alaw", "adpcm"
_TAGS = {MULAW: 7, ALAW: 6, ADPCM: 0x11}

# How far the step index moves for each magnitude of an ADPCM sample.
_INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
# The 89 step sizes of IMA ADPCM.
_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


@lru_cache(maxsize=1)
def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


@lru_cache(maxsize=1)
def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(exponent == 0, low + 8, (low + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """(blocks, BLOCK) bytes to (blocks, samples): the first samples come from the headers."""
    n, width = blocks.shape
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], len(_STEPS) - 1).astype(np.int32)
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    at = 1
    for column in columns:
        for code in (column & 15, column >> 4):
            step, size = _STEPS[index], (code & 7).astype(np.int32)
            move = step >> 3
            move += np.where(size & 4, step, 0)
            move += np.where(size & 2, step >> 1, 0)
            move += np.where(size & 1, step >> 2, 0)
            value += np.where(code & 8, -move, move)
            np.clip(value, -32768, 32767, out=value)
            index += _INDEX_MOVES[size]
            np.clip(index, 0, len(_STEPS) - 1, out=index)
            out[at] = value
            at += 1
    return out.T


@lru_cache(maxsize=16)
def phases(up: int, down: int, taps: int = 8) -> np.ndarray:
    """A row of ``2 * taps`` weights for each of ``up`` phases; each row sums to 1."""
    cutoff = min(1.0, up / down)
    offset = np.arange(up)[:, None] / up
    x = np.arange(-taps + 1, taps + 1)[None, :] - offset
    weights = np.sinc(x * cutoff) * np.cos(np.clip(x / (taps + 1), -1, 1) * np.pi / 2) ** 2
    return weights / weights.sum(1, keepdims=True)


def resample(pcm: np.ndarray, rate: int, to: int, taps: int = 8) -> np.ndarray:
    """16-bit PCM at another rate; beyond its ends a signal is zero."""
    if rate == to or not len(pcm):
        return pcm
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    bank = phases(up, down, taps)
    n = -(-len(pcm) * up // down)
    padded = np.zeros(len(pcm) + 2 * taps, np.float64)
    padded[taps - 1 : taps - 1 + len(pcm)] = pcm
    out = np.empty(n)
    for first in range(min(up, n)):
        at = np.arange(first, n, up) * down
        phase, start = at[0] % up, at // up
        step = down  # of start, from one sample of this phase to the next
        if step == 1:
            filtered = np.convolve(padded, bank[phase][::-1], "valid")
            out[first::up] = filtered[start[0] : start[0] + len(start)]
        else:
            windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * taps)[start]
            out[first::up] = windows @ bank[phase]
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def expand(data: np.ndarray, codec: str, block: int = BLOCK) -> np.ndarray:
    """Bytes of one value to PCM. ADPCM bytes after the last whole block are dropped by the format."""
    if codec == MULAW:
        return mulaw_table()[data]
    if codec == ALAW:
        return alaw_table()[data]
    if codec == ADPCM:
        return adpcm_blocks(data[: len(data) // block * block].reshape(-1, block)).reshape(-1)
    raise ValueError(f"unknown codec: {codec}")


def wav(payload: bytes, rate: int = 8000, codec: str = MULAW) -> bytes:
    """A RIFF file of one channel with the payload as its samples. ADPCM's header says how many samples a block has."""
    per_block = 1 + 2 * (BLOCK - 4)
    if codec == ADPCM:
        align, bits, samples, speed, more = BLOCK, 4, len(payload) // BLOCK * per_block, rate * BLOCK // per_block, struct.pack("<H", per_block)
    else:
        align, bits, samples, speed, more = 1, 8, len(payload), rate, b""
    form = struct.pack("<HHIIHHH", _TAGS[codec], 1, rate, speed, align, bits, len(more)) + more
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwav(media: bytes) -> tuple[bytes, int, str, int]:
    """The samples' bytes, the rate, the codec and the bytes of a block of a RIFF file.

    Another format, a file that ends before its chunks do, no rate, or ADPCM blocks without samples raise ValueError.
    """
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate, codec, block = 12, 0, "", 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            raise ValueError("the file ends within a chunk")
        if name == b"fmt ":
            if size < 16:
                raise ValueError("the format chunk is too short")
            tag, channels, rate, _, block = struct.unpack_from("<HHIIH", media, at + 8)
            codec = next((k for k, v in _TAGS.items() if v == tag), "")
            if channels != 1 or not codec or not rate or (codec == ADPCM and block < 5):
                raise ValueError("one channel of mu-law, A-law or ADPCM with a rate is expected")
        elif name == b"data":
            if not codec:
                raise ValueError("samples before their format")
            return media[at + 8 : at + 8 + size], rate, codec, block
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def level(pcm: np.ndarray) -> str:
    """Root mean square, peak and sign changes, as whole numbers."""
    x = pcm.astype(np.int64)
    rms = isqrt(int(x @ x) // max(1, len(x)))
    return f"{rms},{int(np.abs(x).max(initial=0))},{int(np.count_nonzero(np.diff(np.signbit(pcm))))}"


def _mapped(df: DataFrame, source: str, fields: list[T.StructField], work) -> DataFrame:
    """``df`` with further columns: ``work`` makes them, as lists, from a list of the values of ``source``. Columns of these
    names are replaced. Batches are cut by the bytes of ``source``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    (given,) = common.fresh(df, "given")
    own = df.select(F.col(f"`{source}`").cast("binary").alias(given), *[F.col(f"`{f.name}`") for f in kept])
    out = T.StructType([*kept, *fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for at in common.slices(batch.column(0), 2 << 20):
                part = batch.slice(*at)
                made = [pa.array(v, arrow.field(len(kept) + i).type) for i, v in enumerate(work(part.column(0).to_pylist()))]
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(part.columns[1:], arrow)), *made], schema=arrow)

    return common.bounded(own).mapInArrow(run, out)


def to_media(df: DataFrame, bytes_col: str, media_col: str = "media", rate: int = 8000, codec: str = MULAW) -> DataFrame:
    """``df`` with ``media_col``: its bytes (null: null) as a file. A column of that name is replaced."""
    return _mapped(df, bytes_col, [T.StructField(media_col, T.BinaryType())], lambda values: [[None if v is None else wav(v, rate, codec) for v in values]])


def _read(media: bytes | None):
    try:
        return None if media is None else unwav(media)
    except ValueError:
        return None


def to_pcm(df: DataFrame, media_col: str = "media", pcm_col: str = "pcm", payload_col: str | None = None, level_col: str | None = None, to: int = 16000) -> DataFrame:
    """``df`` with ``pcm_col``: a file's samples as 16-bit PCM at ``to`` Hz; with ``payload_col`` the bytes that the file stores, and
    with ``level_col`` how loud they are under each codec. Null, or no such file: null. Columns of these names are replaced.

    ADPCM blocks of all rows of a batch are decoded together.
    """
    fields = [T.StructField(name, kind) for name, kind in ((pcm_col, T.BinaryType()), (payload_col, T.BinaryType()), (level_col, T.StringType())) if name]

    def adpcm_of(files) -> dict[int, np.ndarray]:
        """The samples of those files that are ADPCM, or of all if levels are asked for."""
        out: dict[int, np.ndarray] = {}
        by_block: dict[int, list[int]] = {}
        for i, f in enumerate(files):
            if f and (f[2] == ADPCM or level_col):
                by_block.setdefault(f[3] if f[2] == ADPCM else BLOCK, []).append(i)
        for block, rows in by_block.items():
            counts = [len(files[i][0]) // block for i in rows]
            decoded = adpcm_blocks(np.frombuffer(b"".join(files[i][0][: n * block] for i, n in zip(rows, counts)), np.uint8).reshape(-1, block))
            ends = np.cumsum([0, *counts])
            out |= {i: decoded[a:b].reshape(-1) for i, a, b in zip(rows, ends, ends[1:])}
        return out

    def work(values):
        files = [_read(v) for v in values]
        adpcm = adpcm_of(files)
        pcm, levels = [], []
        for i, f in enumerate(files):
            if f is None:
                pcm.append(None)
                levels.append(None)
                continue
            data = np.frombuffer(f[0], np.uint8)
            own = resample(adpcm[i] if f[2] == ADPCM else expand(data, f[2]), f[1], to)
            pcm.append(own.astype("<i2").tobytes())
            if level_col:
                levels.append(f"{f[2]}{to}:{level(own)};alaw:{level(alaw_table()[data])};adpcm:{level(adpcm[i])}")
        return [pcm] + [[f and f[0] for f in files]] * bool(payload_col) + [levels] * bool(level_col)

    return _mapped(df, media_col, fields, work)


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its text as a mu-law file (``to_media``), read back and expanded (``to_pcm``): sizes, digests and what the
    sound is like, the CRC of its resampled PCM last."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias(common.ID), text.alias("own")).withColumn("n_bytes", F.octet_length("own").cast("long"))
    whole = F.greatest(F.ceil(F.col("n_bytes") / BLOCK) * BLOCK, F.lit(BLOCK)).cast("int")
    rows = rows.select(common.ID, "n_bytes", F.rpad("own", whole, F.lit(b"\0")).alias("own"))
    back = to_pcm(to_media(rows, "own").drop("own"), payload_col="payload", level_col="levels")
    return back.select(
        F.col(common.ID).alias(id_col),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", "levels", F.concat(F.lit("pcm:"), F.lower(F.hex(F.crc32("pcm"))))).alias("feature"),
    )


def op8_media(spark, sf_dir: str) -> DataFrame:
    """Every document as telephony audio."""
    return stored(common.table(spark, sf_dir, "documents"))
