"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV files, expanded to resampled PCM (operator 1).

Mu-law and A-law samples expand by tables of 256 values built from the rules of G.711. ADPCM samples depend on the one
before within their block only, so numpy decodes the k-th sample of all blocks of a batch at once.

Resampling is linear interpolation in whole numbers; to a lower rate the samples pass a windowed-sinc low-pass first, so
that what the new rate can't hold is not folded back.

The resampled samples are stored without loss, but not twice what can be told: at twice the rate every second sample is the mean of
its neighbours, so the others are stored, and what the second ones differ from that mean where they do. Each codec's samples
have a column of their own, as samples of one kind compress better together. What is read back are all samples.

Defined results: a null payload is an empty one; bytes after the last whole ADPCM block are no samples; a file that is
no WAV file of these codecs raises ValueError; rows with one id or a null id, and repeated rows, each stay a row; a text
of any length is one file, and files are expanded about 2 MB at a time; an empty table gives no rows. Columns other than
id and text are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import ready, stored

RATE = 8000
#: WAV format tags.
ALAW, MULAW, ADPCM = 6, 7, 0x11
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "ima_adpcm"}
#: Bytes of an ADPCM block: four of header, then two samples a byte.
BLOCK = 36
#: The step sizes and index changes of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
INDEX_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


@lru_cache(1)
def mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = ((((u & 0x0F) << 3) + 0x84) << (u >> 4 & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


@lru_cache(1)
def alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    segment, low = a >> 4 & 7, (a & 0x0F) << 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 (n, samples) of uint8 (n, bytes of a block); the low half of a byte comes first."""
    n, size = blocks.shape
    out = np.empty((2 * (size - 4) + 1, n), np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (size - 4)):
        nibble = (data[k >> 1] >> 4 if k & 1 else data[k >> 1] & 15).astype(np.int32)
        step = STEPS[index]
        change = step >> 3
        change += np.where(nibble & 4, step, 0)
        change += np.where(nibble & 2, step >> 1, 0)
        change += np.where(nibble & 1, step >> 2, 0)
        value += np.where(nibble & 8, -change, change)
        np.clip(value, -32768, 32767, out=value)
        index += INDEX_CHANGES[nibble]
        np.clip(index, 0, 88, out=index)
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def wav(payload: bytes, codec: int, rate: int = RATE) -> bytes:
    """A mono WAV file with payload as it is for its samples."""
    if codec == ADPCM:
        per_block = 2 * (BLOCK - 4) + 1
        form = struct.pack("<HHIIHHHH", codec, 1, rate, rate * BLOCK // per_block, BLOCK, 4, 2, per_block)
        samples = len(payload) // BLOCK * per_block
    else:
        form = struct.pack("<HHIIHHH", codec, 1, rate, rate, 1, 8, 0)
        samples = len(payload)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples)
    body += b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def open_wav(media: bytes) -> tuple[int, int, memoryview]:
    """Codec, rate and payload."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, codec, rate = 12, None, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            if codec not in NAMES:
                raise ValueError(f"codec {codec}")
            return codec, rate, memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@lru_cache(8)
def low_pass(rate: int, to: int) -> np.ndarray:
    """Whole numbers that add up to 2^15: a sinc cut off at half of `to`, under a Hamming window."""
    half = 8 * -(-rate // to)
    k = np.arange(-half, half + 1)
    taps = np.sinc(k * to / rate) * (0.54 + 0.46 * np.cos(np.pi * k / half))
    whole = np.round(taps / taps.sum() * (1 << 15)).astype(np.int64)
    whole[half] += (1 << 15) - whole.sum()
    return whole


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """pcm by linear interpolation in whole numbers, rounded down; the first and last sample are held."""
    if rate == to or not len(pcm):
        return pcm
    x = pcm.astype(np.int64)
    if to < rate:
        taps = low_pass(rate, to)
        x = np.clip(np.convolve(np.pad(x, len(taps) // 2, "edge"), taps, "valid") >> 15, -32768, 32767)
    place = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    left, part = place // to, place % to
    y = np.append(x[1:], x[-1])
    return ((x[left] * (to - part) + y[left] * part) // to).astype(np.int16)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 576) -> DataFrame:
    """Each text's UTF-8 bytes, filled with 255 to a positive multiple of unit, as the payload of a WAV file: a stored table (doc_id, n_bytes, media).

    The codec follows from the payload's checksum, so the column holds all three, and equal texts are equal files.
    """
    ready(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, files = [], []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                sizes.append(len(raw))
                payload = raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\xff")
                files.append(wav(payload, (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(files, pa.binary())})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(source.mapInArrow(make, "doc_id long, n_bytes long, media binary"), "media", **_WRITER)


def expand(files: list[bytes]) -> list[tuple[int, memoryview, int, np.ndarray]]:
    """Codec, payload, rate and int16 samples of each file; the ADPCM blocks of all of them are decoded together."""
    opened = [open_wav(x) for x in files]
    counts = [len(p) // BLOCK if codec == ADPCM else 0 for codec, _, p in opened]
    blocks = b"".join(p[: n * BLOCK] for (_, _, p), n in zip(opened, counts, strict=True))
    decoded = decode_adpcm(np.frombuffer(blocks, np.uint8).reshape(-1, BLOCK))
    out, at = [], 0
    for (codec, rate, payload), n in zip(opened, counts, strict=True):
        if codec == ADPCM:
            pcm = decoded[at : at + n].reshape(-1)
            at += n
        else:
            pcm = (mulaw_table() if codec == MULAW else alaw_table())[np.frombuffer(payload, np.uint8)]
        out.append((codec, payload, rate, pcm))
    return out


def feature(codec: int, pcm: np.ndarray) -> str:
    """Whole numbers alone, so that the same samples give the same string anywhere."""
    x = pcm.astype(np.int32)
    energy = int(np.dot(x.astype(np.float64), x)) // max(1, len(x))  # sums of whole numbers under 2^53 are exact
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    peak = int(max(-x.min(), x.max())) if len(x) else 0
    return f"codec={NAMES[codec]};samples={len(pcm)};peak={peak};energy={energy};crossings={crossings}"


def packed(pcm: np.ndarray) -> tuple[bytes, bytes | None]:
    """16-bit samples as every second one, and the differences of the others from the mean of their neighbours (rounded down; the last sample is held), None where there are none."""
    even, odd = pcm[::2].astype(np.int32), pcm[1::2].astype(np.int32)
    rest = odd - ((even + np.append(even[1:], even[-1:])) >> 1)[: len(odd)]
    return even.astype("<i2").tobytes(), rest.astype("<i4").tobytes() if rest.any() or len(odd) != len(even) else None


def unpacked(even: bytes, rest: bytes | None) -> np.ndarray:
    """The samples that packed() took; without differences there are as many second samples as first ones."""
    first = np.frombuffer(even, "<i2").astype(np.int32)
    mean = (first + np.append(first[1:], first[-1:])) >> 1
    second = mean if rest is None else (more := np.frombuffer(rest, "<i4")) + mean[: len(more)]
    out = np.empty(len(first) + len(second), "<i2")
    out[::2], out[1::2] = first, second
    return out


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_crc32 long"


def features(media: DataFrame, to_rate: int = 16000, with_pcm: bool = False) -> DataFrame:
    """Digests and features of stored files; with_pcm adds the resampled 16-bit samples as packed() gives them: a column for each codec, and rest."""
    ready(media.sparkSession)

    def slices(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
        held, size, first = [], 0, 0
        for k, x in enumerate(batch.column(2)):
            held.append(x.as_py())
            size += len(held[-1])
            if size > most:
                yield first, held
                held, size, first = [], 0, k + 1
        if held:
            yield first, held

    def pieces(codec: int, raw: bytes) -> list[bytes | None]:
        if not with_pcm:
            return []
        even, rest = packed(np.frombuffer(raw, "<i2"))
        return [*(even if codec == c else None for c in NAMES), rest]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, files in slices(batch):
                rows = []
                for file, (codec, payload, rate, pcm) in zip(files, expand(files), strict=True):
                    raw = resample(pcm, rate, to_rate).astype("<i2").tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature(codec, pcm), len(raw), zlib.crc32(raw), *pieces(codec, raw)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=False)]
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(files)), batch.column(1).slice(first, len(files)), *columns], names)

    schema = _FEATURES + ("".join(f", pcm_{c} binary" for c in (*NAMES.values(), "rest")) if with_pcm else "")
    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, schema)


#: How tables of samples are written: level and bytes of a page.
_WRITER = {"parquet.compression.codec.zstd.level": 12, "parquet.page.size": 8 << 20}


def store_pcm(media: DataFrame, to_rate: int = 16000) -> DataFrame:
    """features() with pcm, the resampled samples, from a stored table; pcm_bytes and pcm_crc32 are taken from what is read back."""
    whole = stored(features(media, to_rate, with_pcm=True).drop("pcm_bytes", "pcm_crc32"), "pcm", **_WRITER)
    packs = [f"pcm_{c}" for c in NAMES.values()]
    others = [c for c in whole.columns if not c.startswith("pcm_")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Some MB at a time, so that what is unpacked is bounded.
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("even")), 0).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.append(np.flatnonzero(np.diff(sizes >> 22, prepend=0)), [0, batch.num_rows]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                raw = [unpacked(x.as_py(), y.as_py()).tobytes() for x, y in zip(part.column("even"), part.column("rest"), strict=True)]
                columns = [pa.array(map(len, raw), pa.int64()), pa.array(map(zlib.crc32, raw), pa.int64()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *columns], [*others, "pcm_bytes", "pcm_crc32", "pcm"])

    held = whole.select(*others, F.coalesce(*packs).alias("even"), F.col("pcm_rest").alias("rest"))
    return held.mapInArrow(read, f"{_FEATURES}, pcm binary")


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as a telephony WAV file, read back and expanded to stored PCM."""
    return store_pcm(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("pcm")


QUERIES = {"op1_telephony": op1_telephony}
ORACLES: dict[str, str] = {}
