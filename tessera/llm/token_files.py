"""Token ids of a corpus as binary files: frequency-ranked ids in a byte-aligned variable-length code.

A file holds consecutive documents in ascending order of id. Its ids are replaced by their rank in the corpus (most
frequent first, ties by id), a rank takes 1 to 4 bytes, and the lengths lie apart in control bytes, two bits a rank and four ranks
a byte. Decoding looks control bytes up in a table of 256 rows of lengths and gathers the bytes with array operations.

A file, all numbers little-endian: eight bytes ``TOKENS01``; int64 numbers of documents, of ids, of ids in all files
before, and of segments; for each document its id (int64), whether it has one (one byte), its number of ids (int64);
for each segment three int64 (ranks, control bytes, data bytes), then the control bytes and the data. A line end closes
the file. Folders ``part=000000``, ``part=000001``, ... give the files' order; ``ranks`` beside them has the id of each rank.

Tokens are those of the ``tokenizers`` library. For byte-level BPE a text is first cut into the pieces of its public
pre-tokenizer pattern; the library encodes each piece not met before, once. A worker remembers ``REMEMBERED`` pieces, then
keeps those it met twice. The cut is made here only where all characters are of common kinds, for which the pattern is
exact; other texts are cut before spaces alone, which the pattern never crosses. Other tokenizers get whole texts.

Texts are encoded once and written, compressed, as rows of many documents. Bounds between files are quantiles of the ids; rows
of an id that spans files are dealt among them by the CRC-32 of their ids, in its order. Each task sends what it has for
a file as one compressed row, so no text is shuffled; one task makes a file, with a memory of some 40 bytes an id.

Null and empty texts give the end id alone. Null document ids come first. Rows with one id are in order of the CRC-32 of
their ids, then length; equal rows are interchangeable. Ids are read as longs. Reruns write the same files.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, discard, materialize, release_memory, shared_dir
from tessera.llm.repeats import by_bucket, pack, ranges, unpack
from tessera.llm.substring_dedup import Numbers
from tessera.llm.token_counts import byte_alphabet

#: Ids of a file, where that gives as many files as the session has shuffle partitions, and ids of a segment.
FILE_IDS, SEGMENT = 1 << 22, 1 << 20
#: Bytes of text that are encoded at once, and pieces that a worker remembers.
BATCH_BYTES, REMEMBERED = 4 << 20, 500_000
MAGIC = b"TOKENS01"

#: Characters that are letters, digits, white space, or none of these in every version of the Unicode tables.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ʯΑ-ΡΣ-ϡЀ-ҁҊ-ԯא-תء-غف-يぁ-ゖァ-ヺ一-龥가-힣"
_BLANK = r" \t\n\r\x0b\x0c"
_MARK = r"!-/:-@\[-`{-~¡-©«-±´¶-¸»¿×÷‐-‧‰-⁞"
#: The pattern of byte-level BPE for texts of these characters.
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
#: Before a space that no white space precedes.
BREAK = re.compile(r"(?<=\S)(?= )")

#: White space of any kind; parts that white space bounds, or with characters that the pattern above leaves out; in RE2's notation.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
RARE = f"^$|^[{SPACE}]|[{SPACE}]$|[^{_LETTER}0-9{_MARK}{_BLANK}]"

#: Lengths of the four ranks of a control byte.
LENGTHS = np.array([[1 + (c >> 2 * j & 3) for j in range(4)] for c in range(256)], np.int64)


def encode(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data of 32-bit numbers."""
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = more
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    size = more + np.int64(1)
    start = np.cumsum(size) - size
    data = np.empty(int(size.sum()), np.uint8)
    data[start] = ranks
    for k in range(1, int(more.max(initial=0)) + 1):
        longer = np.flatnonzero(more >= k)
        data[start[longer] + k] = ranks[longer] >> np.uint32(8 * k)
    return control, data


def decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` numbers of control bytes and data."""
    size = LENGTHS[control].ravel()[:n]
    start = np.cumsum(size) - size
    out = data[start].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        out[longer] |= data[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Encoder:
    """The tokenizer of a file, with the pieces and units that it met."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        pre, model, added = spec["pre_tokenizer"] or {}, spec["model"], spec["added_tokens"]
        plain = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
        self.cuts = model["type"] == "BPE" and not model.get("dropout") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"] and plain
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        #: Texts that can't be split at each space.
        self.alone = "|".join([f"[{SPACE}] ", *(re.escape(t["content"]) for t in added)])
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.forget()

    def forget(self) -> None:
        self.pieces, self.uses, self.lists = Numbers(), np.zeros(0, np.int64), Lists()

    def keep_frequent(self) -> None:
        """Forget the pieces that were met once."""
        often = np.flatnonzero(self.uses > 1)
        if len(often) > REMEMBERED // 2:
            return self.forget()
        names, old = list(self.pieces), self.lists
        self.forget()
        for i in often.tolist():
            self.pieces[names[i]]
        self.uses = np.ones(len(often), np.int64)
        self.lists.append(*old.get(often))
        self.lists.settle()

    def cut(self, text: str) -> list[str]:
        """Pieces of a text that are encoded by themselves; NUL stands before those that the library has to cut itself."""
        if not self.cuts:
            return ["\0" + text]
        if self.special and self.special.search(text):
            between, found = self.special.split(text), [*self.special.findall(text), ""]
            return [p for part, token in zip(between, found, strict=True) for p in (*(self.common(part) if part else ()), token and "\0" + token) if p]
        return self.common(text)

    def common(self, text: str) -> list[str]:
        found = PIECE.findall(text)
        if len("".join(found)) == len(text):
            return found
        out = []
        for unit in BREAK.split(text):
            found = PIECE.findall(unit)
            out += found if len("".join(found)) == len(unit) else ["\0" + unit]
        return out

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """The library's ids of each piece: of its model alone where the cut is made."""
        tokenize, letters = self.library.model.tokenize, self.letters
        # Printable ASCII but the space stands for itself.
        spelled = [p.replace(" ", letters[32]) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(letters) for p in pieces]
        out = [None if p[0] == "\0" else [t.id for t in tokenize(q)] for p, q in zip(pieces, spelled, strict=True)]
        whole = [i for i, ids in enumerate(out) if ids is None]
        if whole:
            for i, e in zip(whole, self.library.encode_batch_fast([pieces[i][1:] for i in whole], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def met(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the pieces of all texts end to end, and how many each text has.

        Most texts are split at each space; what stands between them is cut once, with the space before it. The first
        part of a text has none, and texts with white space before a space or added tokens are cut by themselves.
        """
        column = pa.array([t or "" for t in texts], pa.large_string())
        alone = pc.match_substring_regex(column, self.alone).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        split = pc.split_pattern(column.filter(pa.array(~alone)), " ")
        words = split.flatten().dictionary_encode()
        rare = pc.match_substring_regex(words.dictionary, RARE).to_numpy(zero_copy_only=False)
        names, codes = words.dictionary.to_numpy(zero_copy_only=False), words.indices.to_numpy()
        parts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        heads = np.cumsum(parts) - parts

        # Units: those of common characters, cut in one go (only their first pieces start with a space), then all others.
        pieces = PIECE.findall(" " + " ".join(names[~rare].tolist())) if not rare.all() else []
        opens = np.flatnonzero(np.fromiter((p[0] == " " for p in pieces), bool, len(pieces)))
        others = [self.common(" " + n) for n in names[rare].tolist()]
        others += [self.common(names[c]) for c in codes[heads].tolist()]
        others += [self.cut(texts[i]) if texts[i] else [] for i in np.flatnonzero(alone).tolist()]
        size = np.concatenate([np.diff(opens, append=len(pieces)), np.array(list(map(len, others)), np.int64)])
        pieces += chain.from_iterable(others)
        numbers = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))

        # Which units each text has.
        unit = np.empty(len(names), np.int64)
        unit[~rare], unit[rare] = np.arange((~rare).sum()), (~rare).sum() + np.arange(rare.sum())
        many = np.ones(len(texts), np.int64)
        many[~alone] = parts
        first = np.cumsum(many) - many
        units = np.empty(int(many.sum()), np.int64)
        units[ranges(first[~alone], parts)] = unit[codes]
        units[first[~alone]] = len(names) + np.arange(len(parts))
        units[first[alone]] = len(names) + len(parts) + np.arange(alone.sum())
        upto = np.append(0, np.cumsum(size[units]))
        return numbers[ranges((np.cumsum(size) - size)[units], size[units])], upto[first + many] - upto[first]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and their numbers."""
        if len(self.pieces) > REMEMBERED:
            self.keep_frequent()
        met, sizes = self.met(texts)
        known = len(self.lists.size)
        fresh = list(islice(self.pieces, known, None))
        for k in range(0, len(fresh), 1000):
            self.lists.add(self.encode(fresh[k : k + 1000]))
        self.uses = np.bincount(met, minlength=len(self.pieces)) + np.pad(self.uses, (0, len(fresh)))
        ids, each = self.lists.get(met)
        upto = np.concatenate([[0], np.cumsum(each)])
        edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return ids, np.diff(upto[edges])


class Lists:
    """Lists of numbers end to end."""

    def __init__(self) -> None:
        self.flat, self.size, self.waiting = np.zeros(0, np.int32), np.zeros(0, np.int64), []

    def append(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.waiting.append((flat, size))

    def add(self, lists: list[list[int]]) -> None:
        self.append(np.array(list(chain.from_iterable(lists)), np.int32), np.array(list(map(len, lists)), np.int64))

    def settle(self) -> None:
        """Lay out the lists that were added."""
        if self.waiting:
            flat, size = zip(*self.waiting, strict=True)
            self.flat, self.size, self.waiting = np.concatenate([self.flat, *flat]), np.concatenate([self.size, *size]), []
            self.first = np.cumsum(self.size) - self.size

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Some lists end to end, and their lengths."""
        self.settle()
        if not len(numbers):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        size = self.size[numbers]
        return self.flat[ranges(self.first[numbers], size)], size


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _with_end(ids: np.ndarray, size: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists with the end id behind each."""
    out = np.full(len(ids) + len(size), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size)] = ids
    return out, size + 1


def checksums(ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of each list as little-endian 32-bit numbers."""
    data, end = ids.astype("<u4").tobytes(), np.cumsum(size) * 4
    return np.array([zlib.crc32(data[a:b]) for a, b in zip((end - 4 * size).tolist(), end.tolist(), strict=True)], np.int64)


def encoded(docs: DataFrame, vocabulary: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """(ids, sizes, crcs, tokens): rows of many documents; tokens is a compressed blob, null ids are the least long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary)
        for batch in batches:
            for ids, texts in bounded(batch.column(0), batch.column(1), BATCH_BYTES):
                tokens, size = _with_end(*known(texts), end_id)
                numbers = ids.fill_null(np.iinfo(np.int64).min)
                each = [pa.array([x], pa.list_(pa.int64())) for x in (numbers.to_pylist(), size, checksums(tokens, size))]
                yield pa.RecordBatch.from_arrays([*each, pa.array([pack(tokens)], pa.binary())], ["ids", "sizes", "crcs", "tokens"])
        release_memory()

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(make, "ids array<long>, sizes array<long>, crcs array<long>, tokens binary")


def ranked_ids(rows: DataFrame) -> np.ndarray:
    """The ids that occur, most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                n = np.bincount(unpack(blob, np.uint32)[0])
                total = np.pad(total, (0, max(0, len(n) - len(total))))
                total[: len(n)] += n
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["id", "n"])

    counts = rows.select("tokens").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # no more rows than the vocabulary
    return counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)


def place(ids: np.ndarray, crcs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The file of each document; an id that equals several bounds spans the files between them."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    return low + (crcs * (high - low + 1) >> 32)


def file_bytes(ids: np.ndarray, known: np.ndarray, size: np.ndarray, ranks: np.ndarray, before: int) -> bytes:
    """A file of documents in their order."""
    segments = [encode(ranks[a : a + SEGMENT]) for a in range(0, len(ranks), SEGMENT)]
    counts = [[min(SEGMENT, len(ranks) - i * SEGMENT), len(c), len(d)] for i, (c, d) in enumerate(segments)]
    head = np.array([len(ids), len(ranks), before, len(segments)], "<i8").tobytes()
    table = [ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), size.astype("<i8").tobytes(), np.array(counts, "<i8").tobytes()]
    return b"".join([MAGIC, head, *table, *(x.tobytes() for pair in segments for x in pair)])


def parse_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Documents' ids, whether they have one, their numbers of ids; the ranks of all; and the ids in files before."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    n, total, before, segments = np.frombuffer(data, "<i8", 4, 8).tolist()
    at = 40
    ids = np.frombuffer(data, "<i8", n, at)
    known = np.frombuffer(data, np.uint8, n, at + 8 * n).astype(bool)
    size = np.frombuffer(data, "<i8", n, at + 9 * n)
    counts = np.frombuffer(data, "<i8", 3 * segments, at + 17 * n).reshape(-1, 3).tolist()
    at += 17 * n + 24 * segments
    ranks, done = np.empty(total, np.uint32), 0
    for m, control, body in counts:
        ranks[done : done + m] = decode(np.frombuffer(data, np.uint8, control, at), np.frombuffer(data, np.uint8, body, at + control), m)
        at, done = at + control + body, done + m
    return ids, known, size, ranks, before


def write_tokens(docs: DataFrame, vocabulary: str, path: str | None = None, *, end_id: int, doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> str:
    """Write the token ids of all texts, ``end_id`` behind each; returns the folder. Without a path it is one in the shared folder."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = materialize(encoded(docs, vocabulary, end_id, doc_id, text))
    by_rank = ranked_ids(rows)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    ranks = spark.sparkContext.broadcast(rank_of)  # as long as the vocabulary

    every = rows.select(F.explode(F.arrays_zip("ids", "sizes")).alias("d")).select("d.*")
    total = every.agg(F.sum("sizes")).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_ids))
    shares = [i / files for i in range(1, files)]
    cuts = every.agg(F.percentile_approx("ids", shares, max(10_000, 10 * files)).alias("b")).first()["b"] if shares else None
    bounds = spark.sparkContext.broadcast(np.array(cuts or [], np.int64))  # a number for each file

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(bounds.value) + 1, np.int64)
        for batch in batches:
            ids, sizes, crcs = (c.flatten().to_numpy() for c in batch.columns)
            np.add.at(sums, place(ids, crcs, bounds.value), sizes)
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(sums[hit])], ["file", "n"])

    held = rows.select("ids", "sizes", "crcs").mapInArrow(measure, "file long, n long").groupBy("file").agg(F.sum("n").alias("n")).collect()  # a row for each file
    before, start = {}, 0
    for file, n in sorted((r["file"], r["n"]) for r in held):
        before[file] = start
        start += n

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, crcs, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, sizes, crcs = (np.array(x, np.int64) for x in (ids, sizes, crcs))
                coded = ranks.value[unpack(blob, np.uint32)[0]]
                first = np.cumsum(sizes) - sizes
                rows = [(file, pack(ids[at], sizes[at], crcs[at], coded[ranges(first[at], sizes[at])])) for file, at in by_bucket(place(ids, crcs, bounds.value))]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["file", "data"])
        release_memory()

    def build(key: tuple, blobs: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(b, np.int64, np.int64, np.int64, np.uint32) for b in blobs["data"]]
        ids, sizes, crcs, coded = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort([sizes, crcs, ids])
        first = np.cumsum(sizes) - sizes
        body = file_bytes(ids[order], ids[order] != np.iinfo(np.int64).min, sizes[order], coded[ranges(first[order], sizes[order])], before[key[0]])
        release_memory()
        return pd.DataFrame({"part": [f"{key[0]:06d}"], "value": [body]})

    made = rows.mapInArrow(deal, "file long, data binary").groupBy("file").applyInPandas(build, "part string, value binary")
    made.select("part", F.col("value").cast("string").alias("value")).write.partitionBy("part").text(f"{path}/files")
    table = spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(by_rank)), "id": by_rank.astype(np.int64)}), "rank long, id long")
    table.coalesce(1).write.parquet(f"{path}/ranks")
    discard(rows)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document: ``start`` ids of all documents lie before it, ids are little-endian unsigned 32-bit integers."""
    table = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")["id"].to_numpy("<u4")  # no more rows than the vocabulary
    by_rank = spark.sparkContext.broadcast(table)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                ids, known, size, ranks, before = parse_file(content.as_py())
                tokens = by_rank.value[ranks].tobytes()
                end = np.cumsum(size)
                for a in range(0, len(ids), 1000):
                    part = slice(a, a + 1000)
                    bodies = pa.array([tokens[4 * x : 4 * y] for x, y in zip((end - size)[part].tolist(), end[part].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part], mask=~known[part]), pa.array((before + end - size)[part]), pa.array(size[part]), bodies], ["doc_id", "start", "n_tokens", "ids"])
        release_memory()

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(f"{path}/files")
    return files.select("content").mapInArrow(split, "doc_id long, start long, n_tokens long, ids binary")
