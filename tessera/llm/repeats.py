"""Repeated windows of long sequences: the machinery of the two substring operators.

Documents are dealt into blocks of bounded size by the hash of their id and text. A window is ``width`` consecutive units (bytes
or words) of one document; its anchor is the k-gram of least hash in it, leftmost first. Equal windows have equal
anchors at equal offsets, so a window can only repeat where its anchor does. That gives two exchanges instead of a
shuffle of all windows:

1. each block sends the distinct hashes of its anchors (about 2 / (width - k + 2) of all positions) to buckets dealt by
   hash, and gets back one bit for each: whether another block has it;
2. what the windows of repeated anchors need to be compared is sent to buckets, and each block learns which of its
   windows repeat.

Whatever occurs often in a block is sent once, so a passage that a third of all documents share costs a bucket one entry
for each block. The blocks' texts are shuffled once; later steps read the same shuffle files (a reused exchange).

Hashes are salted: a random number of each run goes to all its tasks and enters, behind a non-linear mix, before any unit
does, so no text can be made to collide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from secrets import randbits

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import input_bytes

#: Bytes of input files in a block, and in what a bucket is made from.
BLOCK_BYTES, BUCKET_BYTES = 750_000, 2_500_000
#: Units that are hashed at once; longer sequences are cut with overlap. Positions must fit in POSITION_BITS.
PART_UNITS, POSITION_BITS = 1_000_000, 24

BLOBS = "bucket long, block long, kind int, data binary"
REPLIES = "block long, bucket long, kind int, data binary"

#: Estimates from here on are Spark's stand-in for not knowing.
UNKNOWN = 1 << 60

#: A random number for each byte, from a fixed seed.
BYTE_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


_salt = np.uint64(0)


def new_salt() -> int:
    """A random number for the hashes of a run; every task of the run takes it by ``use_salt``."""
    return randbits(64)


def use_salt(salt: int) -> None:
    global _salt
    _salt = np.uint64(salt)


def salted(x: np.ndarray) -> np.ndarray:
    """Hashes of numbers under the salt; different numbers have different ones."""
    return scramble(scramble(x ^ _salt) + _salt)


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= _MIX
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of sequences from those of their two halves, of which the first is salted: only who knows it can make sums equal."""
    x = a * _ODD
    x += b
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of the sequence (salted codes of 64 bits, or bytes), from windows of 1, 2, 4, ... times the least length.

    Bytes are taken eight at a time; where ``width`` is no multiple of that, the last eight of a window count twice.
    """
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size, most, first = 1, width, codes
    if codes.dtype == np.uint8:
        if width < 8:
            first = salted(BYTE_CODES)[codes]
        else:
            size, most, first = 8, width - width % 8, scramble(np.ndarray((len(codes) - 7,), "<u8", codes, strides=(1,)) ^ _salt)
    power, out, done = first, None, 0
    while True:
        if most & size:
            out = power[:n] if out is None else combine(out, power[done : done + n])
            done += size
        if done == most:
            break
        power = combine(power[:-size], power[size:])
        size *= 2
    if most < width:
        out = combine(out, first[width - 8 : width - 8 + n])
    return out.copy() if out.base is codes else out


def hashes_at(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of a few windows of bytes, those that start at ``at``; not the ones of ``window_hashes``."""
    if width < 8 or not len(at):
        return window_hashes(data, width)[at]
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = np.zeros(len(at), np.uint64)
    for start in [*range(0, width - 7, 8), width - 8]:
        out = combine(out, scramble(eight[at + start] ^ _salt))
    return out


def anchors(codes: np.ndarray, sizes: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): the windows from first to last have the same anchor, whose k-gram has this hash.

    ``sizes`` are the documents' lengths; windows don't cross documents.
    """
    out = []
    for start, part in parts(sizes, width):
        out.append((start, _anchors(codes[start : start + int(part.sum())], part, width, k)))
    if not out:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    return tuple(np.concatenate([x[i] + (start if i else 0) for start, x in out]) for i in range(3))


def parts(sizes: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Start and document lengths of parts of at most PART_UNITS units; a longer document is cut with overlap."""
    start, part, used = 0, [], 0
    for n in sizes.tolist():
        if used and used + n > PART_UNITS:
            yield start, np.array(part)
            start, part, used = start + used, [], 0
        while n > PART_UNITS:
            yield start, np.array([PART_UNITS])
            step = PART_UNITS - width + 1
            start, n = start + step, n - step
        part.append(n)
        used += n
    if used:
        yield start, np.array(part)


def _anchors(codes: np.ndarray, sizes: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, w = len(codes), width - k + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return np.zeros(0, np.uint64), none, none
    hashes = window_hashes(codes, k)
    low = np.uint64((1 << POSITION_BITS) - 1)
    packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    padded = np.full(-(-len(packed) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(packed)] = packed
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
    least = np.minimum(behind[: n - width + 1], ahead[w - 1 : n - width + w])
    place = (least & low).astype(np.int64)
    fits = np.zeros(n + 1, np.int32)  # windows that stay in their document
    ends = np.cumsum(sizes)
    begins = ends - sizes
    long = sizes >= width
    fits[begins[long]] += 1
    np.add.at(fits, ends[long] - width + 1, -1)
    valid = np.cumsum(fits)[: n - width + 1] > 0
    at = np.flatnonzero(valid)
    if not len(at):
        return np.zeros(0, np.uint64), none, none
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (np.diff(at) > 1)
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    return hashes[place[first]], first, last


def to_planes(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which compresses well."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes() if len(numbers) else b""


def from_planes(data: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(kind).ravel() if n else np.zeros(0, kind)


def pack(*columns: np.ndarray | bytes) -> bytes:
    """Columns of numbers or bytes as one compressed blob."""
    import zstandard

    bodies = [c if isinstance(c, bytes) else to_planes(c) for c in columns]
    head = np.array([len(bodies), *map(len, bodies)], np.int64).tobytes()
    return zstandard.compress(head + b"".join(bodies), 1)


def unpack(blob: bytes, *kinds: type | None) -> list:
    """The columns of a blob; None gives the bytes."""
    import zstandard

    data = zstandard.decompress(blob)
    sizes = np.frombuffer(data, np.int64, len(kinds), 8).tolist()
    out, at = [], 8 * (len(kinds) + 1)
    for kind, size in zip(kinds, sizes, strict=True):
        body = data[at : at + size]
        out.append(body if kind is None else from_planes(body, kind, size // np.dtype(kind).itemsize))
        at += size
    return out


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (count of them) for each pair."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and the indexes of its entries, in their order."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(buckets[part[0]]), part


def counts_for(docs: DataFrame, text: str) -> tuple[int, int]:
    """Numbers of blocks and buckets, in proportion to the input; a table without an estimate is measured."""
    size = input_bytes(docs)
    if size >= UNKNOWN:
        size = (docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0) // 2
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // BLOCK_BYTES)), max(least, -(-size // BUCKET_BYTES))


def blocked(docs: DataFrame, doc_id: str, text: str, blocks: int) -> DataFrame:
    """(block, __id, __text) of all documents; rows that share an id, or have none, are dealt by their texts."""
    return docs.select(F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(blocks)).alias("block"), F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"))


def ordered(block: pd.DataFrame) -> tuple[np.ndarray, list[bytes]]:
    """Ids and UTF-8 texts of a block, by id (null first), then text, so that all steps see one order."""
    texts = [(t or "").encode("utf-8") for t in block["__text"]]
    ids = [None if pd.isna(i) else int(i) for i in block["__id"]]
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    return np.array([ids[i] for i in order], object), [texts[i] for i in order]


def numeric(ids: np.ndarray) -> np.ndarray:
    """Ids as numbers; null is the least."""
    return np.array([np.iinfo(np.int64).min if i is None else i for i in ids], np.int64)


class Sequences:
    """What an operator makes of a block's texts: codes of the units and the documents' lengths in units."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        self.codes, self.sizes = codes, sizes


def distinct_anchors(seq: Sequences, width: int, k: int) -> tuple[np.ndarray, ...]:
    """(hash, first, last) of the runs of windows, and the distinct hashes with their counts and places."""
    hashes, first, last = anchors(seq.codes, seq.sizes, width, k)
    distinct, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    return hashes, first, last, distinct, inverse, counts


#: Bytes of a hash that tell the hashes of a bucket apart; a chance equality only costs work.
SENT = 5


def send_hashes(distinct: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """For each bucket the indexes and the upper bytes, byte plane by byte plane, of its hashes (sorted ones)."""
    for b, at in by_bucket((distinct % np.uint64(buckets)).astype(np.int64)):
        yield b, at, np.ascontiguousarray(distinct[at].view(np.uint8).reshape(-1, 8).T[8 - SENT :]).tobytes()


def _received(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SENT, 8), np.uint8)
    out[:, 8 - SENT :] = np.frombuffer(data, np.uint8).reshape(SENT, -1).T
    return out.view(np.uint64).ravel()


def senders(blobs: pd.DataFrame) -> tuple[list[int], list[np.ndarray]]:
    """The blocks that sent hashes to a bucket, and for each hash how many blocks sent it."""
    blocks, each = blobs["block"].tolist(), [_received(d) for d in blobs["data"]]
    _, inverse, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    return blocks, np.split(counts[inverse], np.cumsum([len(e) for e in each])[:-1])


def common_entries(bucket: int, blobs: pd.DataFrame, kind: int) -> pd.DataFrame:
    """For the blocks that sent hashes to a bucket, a bit for each hash: whether another block sent it."""
    rows = [(b, bucket, kind, np.packbits(n > 1).tobytes()) for b, n in zip(*senders(blobs), strict=True) if (n > 1).any()]
    return pd.DataFrame(rows, columns=["block", "bucket", "kind", "data"])


def find_repeats(
    texts: DataFrame,
    buckets: int,
    width: int,
    k: int,
    sequences: Callable[[list[bytes]], Sequences],
    send: Callable[[int, np.ndarray, Sequences, tuple], list[tuple[int, int, bytes]]],
    compare: Callable[[list[tuple[int, int, bytes]]], list[tuple[int, int, bytes]]],
    finish: Callable[[np.ndarray, list[bytes], Sequences, list[tuple[int, bytes]]], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Run the exchanges.

    send(block, ids, sequences, (hash, first, last) of repeated anchors) gives (bucket, kind, blob);
    compare([(block, kind, blob)]) of one bucket gives (block, kind, blob) for the blocks;
    finish(ids, texts, sequences, [(kind, blob)]) makes the rows of a block.
    """

    salt = new_salt()

    def announce(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        use_salt(salt)
        _, data = ordered(block)
        distinct = distinct_anchors(sequences(data), width, k)[3]
        rows = [(b, key[0], 0, sent) for b, _, sent in send_hashes(distinct, buckets)]
        return pd.DataFrame(rows, columns=["bucket", "block", "kind", "data"])

    def common(key: tuple, blobs: pd.DataFrame) -> pd.DataFrame:
        return common_entries(key[0], blobs, 0)

    def propose(key: tuple, block: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "block", "kind", "data"]
        if not len(block):
            return pd.DataFrame([], columns=columns)
        use_salt(salt)
        ids, data = ordered(block)
        seq = sequences(data)
        hashes, first, last, distinct, inverse, counts = distinct_anchors(seq, width, k)
        repeated = counts > 1
        answer = dict(zip(replies["bucket"].tolist(), replies["data"], strict=True))
        for b, at in by_bucket((distinct % np.uint64(buckets)).astype(np.int64)):
            if b in answer:
                repeated[at] |= np.unpackbits(np.frombuffer(answer[b], np.uint8), count=len(at)).astype(bool)
        keep = repeated[inverse]
        rows = [(b, key[0], kind, blob) for b, kind, blob in send(key[0], ids, seq, (hashes[keep], first[keep], last[keep]))]
        return pd.DataFrame(rows, columns=columns)

    def judge(key: tuple, blobs: pd.DataFrame) -> pd.DataFrame:
        use_salt(salt)
        rows = compare(list(zip(blobs["block"].tolist(), blobs["kind"].tolist(), blobs["data"], strict=True)))
        return pd.DataFrame([(b, key[0], kind, blob) for b, kind, blob in rows], columns=["block", "bucket", "kind", "data"])

    def conclude(key: tuple, block: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame()
        use_salt(salt)
        ids, data = ordered(block)
        return finish(ids, data, sequences(data), list(zip(replies["kind"].tolist(), replies["data"], strict=True)))

    shared = texts.groupBy("block").applyInPandas(announce, BLOBS).groupBy("bucket").applyInPandas(common, REPLIES)
    found = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(propose, BLOBS).groupBy("bucket").applyInPandas(judge, REPLIES)
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(conclude, schema)
