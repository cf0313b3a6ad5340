"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the distinct shingles of ``width`` words (A-Z lower-cased, split at ASCII white space; with fewer
words the whole sequence is one shingle; without words it is empty and links with nothing). Two documents link when
100 * |A and B| >= ``percent`` * |A or B|. Sets are compared as 64-bit shingle hashes, which only meet within a pair; they
are salted by a random number of each run, so no text can be made to collide.

1. Documents with equal sets (128-bit digest and size) become one class; only its least id goes on.
2. A linked document shares at least o = ceil(percent * n / 100) of its n shingles. Blocks of documents exchange hashes
   of the n - o + 1 first in hash order; who meets nobody there is done. The others exchange all shingles, and go on if
   o of them occur elsewhere.
3. Shingles are put in order of rising frequency (numbers of blocks). Each document is verified against three leaders, the most central
   documents (highest mean log-frequency) that have its rarest, middle or most frequent prefix shingle. That joins
   groups of near copies at a cost in proportion to their size.
4. Two sets of sizes p and q that link share c >= a = ceil(percent * (p + q) / (100 + percent)) shingles, and at least l
   of them (l <= c) among the first p - a + l of one and the first q - a + l of the other: the l-th common one has a - l
   more behind it in both. For each document l is chosen from ``LEVELS`` by estimated cost: entries of other documents
   met in its prefix at that length, plus the verification of those that can be met l times. A pair of different
   components is verified if it shares as many prefix shingles as the smaller l of the two asks.
5. Links give components; equal sets rejoin their class.

No step lists the pairs of a group that leaders have joined, and none drops candidates. Ids are read as longs. Rows that
share an id are one document of the join, with the set of the one whose (size, hash of the text) is least; a row keeps its own
n_shingles. Blocks are dealt by id and text, so no id fills one. Null ids link with nothing: their component_id is null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, join_classes, materialize, release_memory
from tessera.llm.components import components
from tessera.llm.repeats import BLOBS, REPLIES, by_bucket, common_entries, counts_for, new_salt, scramble, send_hashes, senders, use_salt, window_hashes
from tessera.llm.words import word_codes

#: Numbers of prefix shingles that a pair may be asked to share, and the cost of verifying a shingle in entries met.
LEVELS, VERIFY_COST = (1, 2, 4), 0.1
#: Probes of a leader in a task.
SPREAD_ROWS = 512
#: Bytes of text that are hashed at once; a longer text is hashed alone.
HASHED_BYTES = 2_000_000


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    lower = [(t or "").encode("utf-8").lower() for t in texts]  # of bytes, lower() only changes A-Z
    out, start, size = [], 0, 0
    for i, t in enumerate(lower):
        if size and size + len(t) > HASHED_BYTES:
            out += _shingle_sets(lower[start:i], width)
            start, size = i, 0
        size += len(t)
    return out + _shingle_sets(lower[start:], width)


def _shingle_sets(lower: list[bytes], width: int) -> list[np.ndarray]:
    seq = word_codes(lower)
    ends = np.cumsum(seq.sizes)
    marks = window_hashes(seq.codes, width)
    short = {n: scramble(window_hashes(seq.codes, n) + np.uint64(n)) for n in set(seq.sizes[seq.sizes < width].tolist()) if n}
    out = []
    for n, at in zip(seq.sizes.tolist(), (ends - seq.sizes).tolist(), strict=True):
        if n >= width:
            out.append(np.unique(marks[at : at + n - width + 1]))
        else:
            out.append(short[n][at : at + 1] if n else np.zeros(0, np.uint64))
    return out


def within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def needed(n: np.ndarray | int, percent: int):
    """Shingles of a set of n that a linked set must share."""
    return -(-np.asarray(n) * percent // 100)


def digest(texts: pd.Series, width: int) -> pd.DataFrame:
    sets = shingle_sets(list(texts), width)
    mix = [scramble(s * np.uint64(0xD6E8FEB86659FD93)) for s in sets]
    return pd.DataFrame({"n": [len(s) for s in sets], "x": [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets], "y": [int(np.bitwise_xor.reduce(m).astype(np.int64)) if len(m) else 0 for m in mix]})


def _block_sets(block: pd.DataFrame, chosen: dict[int, int], width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and sets of the chosen documents of a block, by id; ``chosen`` has the hash of each one's text."""
    own = [chosen.get(i) == h for i, h in zip(block["__id"].tolist(), block["__hash"].tolist(), strict=True)]
    pick = block[np.array(own, bool)].drop_duplicates("__id").sort_values("__id", kind="stable")
    return pick["__id"].to_numpy(np.int64), shingle_sets(list(pick["__text"]), width)


def _announce(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a block's sets, and whether two of them have it."""
    distinct, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
    return distinct, counts > 1


def _answered(distinct: np.ndarray, twice: np.ndarray, buckets: int, replies: pd.DataFrame) -> np.ndarray:
    """The hashes of ``distinct`` that occur in another set."""
    repeated = twice.copy()
    answer = dict(zip(replies["bucket"].tolist(), replies["data"], strict=True))
    for b, at in by_bucket((distinct % np.uint64(buckets)).astype(np.int64)):
        if b in answer:
            repeated[at] |= np.unpackbits(np.frombuffer(answer[b], np.uint8), count=len(at)).astype(bool)
    return distinct[repeated]


def _frequencies(bucket: int, blobs: pd.DataFrame, kind: int) -> pd.DataFrame:
    """For the blocks that sent hashes to a bucket, a byte for each hash: 0, or 8 * log2 of the number of blocks that did."""
    rows = [(b, bucket, kind, np.minimum(255, np.rint(8 * np.log2(n))).astype(np.uint8).tobytes()) for b, n in zip(*senders(blobs), strict=True) if (n > 1).any()]
    return pd.DataFrame(rows, columns=["block", "bucket", "kind", "data"])


def candidate_sets(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str, width: int, percent: int, salt: int) -> DataFrame:
    """(doc, n, shingles, prefix, score) of the chosen documents of which enough shingles occur in others; of the shingles those that do.

    prefix has the first of them in order of frequency (of blocks; the same everywhere), then hash, as far as a level may
    ask; score is the mean log-frequency of the document's shingles.
    """
    blocks, buckets = counts_for(docs, text)
    dealt = F.pmod(F.xxhash64("__id", "__hash"), F.lit(blocks)).alias("block")
    row = docs.select(F.col(doc_id).cast("long").alias("__id"), F.xxhash64(text).alias("__hash"), F.col(text).alias("__text")).where("__id IS NOT NULL")
    texts = row.select(dealt, "__id", "__hash", "__text")
    named = chosen.select(F.col("doc").alias("__id"), F.col("text_hash").alias("__hash"))
    ids = named.select(dealt, F.col("__id").alias("bucket"), F.lit(-1).alias("kind"), F.expr("unhex(lpad(hex(__hash), 16, '0'))").alias("data"))

    def prefix(sets: list[np.ndarray]) -> list[np.ndarray]:
        return [s[: len(s) - int(needed(len(s), percent)) + 1] for s in sets]

    def load(block: pd.DataFrame, told: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
        use_salt(salt)
        own = told[told["kind"] == -1]
        hashes = np.frombuffer(b"".join(own["data"]), ">i8").tolist()
        return _block_sets(block, dict(zip(own["bucket"].tolist(), hashes, strict=True)), width)

    def blobs(key: tuple, distinct: np.ndarray) -> pd.DataFrame:
        rows = [(b, key[0], 0, sent) for b, _, sent in send_hashes(distinct, buckets)]
        return pd.DataFrame(rows, columns=["bucket", "block", "kind", "data"])

    def first(key: tuple, block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return blobs(key, _announce(prefix(load(block, told)[1]))[0])

    def survivors(block: pd.DataFrame, told: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
        own, sets = load(block, told)
        heads = prefix(sets)
        hit = _answered(*_announce(heads), buckets, told[told["kind"] == 1])
        stay = [i for i, h in enumerate(heads) if within(h, hit).any()]
        return own[stay], [sets[i] for i in stay]

    def second(key: tuple, block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return blobs(key, _announce(survivors(block, told)[1])[0])

    def last(key: tuple, block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        own, sets = survivors(block, told)
        distinct, twice = _announce(sets)
        level = np.zeros(len(distinct), np.uint8)
        replies = told[told["kind"] == 2]
        answer = dict(zip(replies["bucket"].tolist(), replies["data"], strict=True))
        for b, at in by_bucket((distinct % np.uint64(buckets)).astype(np.int64)):
            if b in answer:
                level[at] = np.frombuffer(answer[b], np.uint8)
        rows = []
        for i, s in zip(own.tolist(), sets, strict=True):
            at = np.searchsorted(distinct, s)
            kept = twice[at] | (level[at] > 0)
            s_kept, frequency, least = s[kept], level[at][kept], int(needed(len(s), percent))
            if len(s_kept) >= least:
                order = np.lexsort([s_kept, frequency])[: len(s_kept) - least + LEVELS[-1]]
                rows.append((i, len(s), np.sort(s_kept.astype(np.int64)), s_kept[order].astype(np.int64), float(frequency.sum()) / 8 / len(s)))
        release_memory()
        return pd.DataFrame(rows, columns=["doc", "n", "shingles", "prefix", "score"])

    def met(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return common_entries(key[0], own, 1)

    def counted(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return _frequencies(key[0], own, 2)

    def exchange(ask, told: DataFrame, reply) -> DataFrame:
        return texts.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(ask, BLOBS).groupBy("bucket").applyInPandas(reply, REPLIES)

    told = ids.select("block", "bucket", "kind", "data")
    once = told.unionByName(exchange(first, told, met))
    twice = once.unionByName(exchange(second, once, counted))
    return texts.groupBy("block").cogroup(twice.groupBy("block")).applyInPandas(last, "doc long, n long, shingles array<long>, prefix array<long>, score double")


def place_bound(percent: int, level: int) -> Column:
    """The largest partner that can still share ``level`` shingles up to this place of a set's order (see link_sets)."""
    return F.expr(f"{100 + percent} * (n - place + {level}) div {percent} - n")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Rows carry spread and salt: those of a frequent b are dealt to ``spread`` tasks."""
    a = sets.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    b = sets.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    copies = pairs.select("b", "spread").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("spread") - 1)))
    near = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    linked = F.expr(f"100 * common >= {percent} * (n_a + n_b - common)")
    both = pairs.join(a, "a").join(copies.join(b, "b"), ["b", "spread", "salt"]).where(near)
    return both.withColumn("common", F.size(F.array_intersect("s_a", "s_b"))).where(linked).select("a", "b")


def ordered_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, doc, n, place, at, first, score): the longest prefixes that a level may ask for.

    place counts from 1, with shingles of one set only before all others; at leaves those out; first is the last ``at`` of
    the prefix of level 1.
    """
    one = sets.select("doc", "n", "score", F.size("shingles").cast("long").alias("shared"), F.posexplode("prefix").alias("pos", "shingle")).withColumn("at", F.col("pos") + F.lit(1).cast("long"))
    return one.select("shingle", "doc", "n", (F.col("at") + F.col("n") - F.col("shared")).alias("place"), "at", F.expr(f"shared - ceil(n * {percent} / 100.0D) + 1").alias("first"), "score")


def leader_links(prefix: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of each document with leaders: of the sets with its rarest, middle and most frequent prefix shingle the most central."""
    own = prefix.where("at <= first")
    leader = own.groupBy("shingle").agg(F.max_by("doc", F.struct("score", "doc")).alias("b"), F.count("*").alias("probes"))
    probe = own.where("at = 1 OR at = first OR at = (first + 1) div 2").select("shingle", F.col("doc").alias("a"))
    spread = F.ceil(F.col("probes") / SPREAD_ROWS)
    asked = probe.join(leader, "shingle").where("a <> b").groupBy("a", "b").agg(F.max(spread).alias("spread"))
    return verify(asked.withColumn("salt", F.pmod(F.xxhash64("a"), "spread")), sets, percent)


def candidates(prefix: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """(a, b): documents of different components that share as many prefix shingles as their level asks."""
    placed = prefix.join(label.select(F.col("node").alias("doc"), "component"), "doc")
    for level in LEVELS:
        placed = placed.withColumn(f"reach_{level}", place_bound(percent, level))
    # For each shingle the least set and the farthest reaches, of two components: those of the others, for each entry.
    far = [f"reach_{level}" for level in LEVELS]
    grouped = placed.groupBy("shingle", "component").agg(F.min("n").alias("n"), *(F.max(c).alias(c) for c in far))
    best = grouped.groupBy("shingle").agg(F.min(F.struct("n", "component")).alias("n_1"), *(F.max(F.struct(c, "component")).alias(f"{c}_1") for c in far), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    other = lambda c: F.when(F.col("component") != F.col(f"{c}_1.component"), F.col(c))
    second = grouped.join(best, "shingle").groupBy("shingle").agg(F.min(other("n")).alias("n_2"), *(F.max(other(c)).alias(f"{c}_2") for c in far))
    bounds = best.join(second, "shingle").drop("lo", "hi")
    entries = placed.join(bounds, "shingle")
    others = lambda c: F.when(F.col("component") == F.col(f"{c}_1.component"), F.col(f"{c}_2")).otherwise(F.col(f"{c}_1.{c}"))
    least = F.expr(f"ceil(n * {percent} / 100.0D)")
    for level in LEVELS:
        usable = (F.col(f"reach_{level}") >= F.greatest(others("n"), least)) & (F.col("n") <= others(f"reach_{level}")) & (least >= level)
        entries = entries.withColumn(f"in_{level}", usable)
    deepest = F.col(f"in_{LEVELS[0]}")
    for level in LEVELS[1:]:
        deepest = deepest | F.col(f"in_{level}")
    marks = [f"in_{level}" for level in LEVELS]
    entries = materialize(entries.where(deepest).select("shingle", "doc", "n", "place", "component", *marks))
    # The estimate: entries met at a level, and their share that can be met often enough and is then verified.
    lists = entries.groupBy("shingle").agg(*(F.count_if(m).alias(f"f_{m}") for m in marks))
    met = entries.join(lists, "shingle").groupBy("doc", "n").agg(*(F.sum(F.when(F.col(m), F.col(f"f_{m}") - 1)).alias(m) for m in marks))
    costs = [F.struct((F.coalesce(F.col(f"in_{v}"), F.lit(float("inf"))) * (1 + F.col("n") * VERIFY_COST / v)).alias("cost"), F.lit(v).alias("level")) for v in LEVELS]
    chosen = met.select("doc", F.array_min(F.array(*costs)).getField("level").alias("level"))
    posted = materialize(entries.join(chosen, "doc").where(" OR ".join(f"level = {v} AND in_{v}" for v in LEVELS)).select("shingle", "doc", "n", "place", "component", "level"))
    a, b = (posted.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("doc", "n", "place", "component", "level"))) for s in "ab")
    alpha = f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}"
    reached = " AND ".join(f"place_{s} <= n_{s} - {alpha} + least(level_a, level_b)" for s in "ab")
    fits = F.expr(f"component_a < component_b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND {reached}")
    shared = a.join(b, "shingle").where(fits).groupBy(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).agg(F.count("*").alias("common"), F.min(F.least("level_a", "level_b")).alias("asked"))
    found = materialize(shared.where("common >= asked").select("a", "b"))
    discard(entries, posted)
    return found


def link_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets: the components of their links."""
    prefix = materialize(ordered_prefixes(sets, percent))
    label = materialize(components(sets.select(F.col("doc").alias("node")), leader_links(prefix, sets, percent)))
    pairs = candidates(prefix, label, percent)
    found = verify(pairs.select("a", "b", F.lit(1).cast("long").alias("spread"), F.lit(0).cast("long").alias("salt")), sets, percent)
    name = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    links = materialize(found.join(name("a"), "a").join(name("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct())
    ends = links.select(F.col("a").alias("node")).union(links.select("b"))
    joined = components(ends, links).where("component < node").select(F.col("node").alias("component"), F.col("component").alias("least"))
    size = label.groupBy("component").agg(F.count("*").alias("members"))
    whole = join_classes(label, joined.join(size, "component"), ["component"], "members")
    return whole.select("node", F.coalesce("least", "component").alias("component"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id is the least id reachable by links, itself included."""

    salt = new_salt()

    @F.pandas_udf("n long, x long, y long")
    def digests(texts: pd.Series) -> pd.DataFrame:
        use_salt(salt)
        return digest(texts, width)

    made = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"), digests(F.col(text)).alias("d")).select("doc", "text_hash", "d.n", "d.x", "d.y")
    every = materialize(made)
    each = materialize(every.where("doc IS NOT NULL").groupBy("doc").agg(F.min(F.struct("n", "text_hash", "x", "y")).alias("d")).select("doc", "d.*").where("n > 0"))
    keys = ["n", "x", "y"]
    classes = materialize(each.groupBy(*keys).agg(F.min("doc").alias("head"), F.count("*").alias("members")).where("members > 1"))
    member = materialize(join_classes(each, classes, keys, "members").select("doc", "text_hash", F.coalesce("head", "doc").alias("head")))
    chosen = member.where("doc = head").select("doc", "text_hash")
    sets = materialize(candidate_sets(docs, chosen, doc_id, text, width, percent, salt))
    discard(each, classes)
    label = materialize(link_sets(sets, percent))
    discard(sets)
    copies = member.groupBy("head").agg(F.count("*").alias("members"))
    moved = materialize(label.where("component <> node").select(F.col("node").alias("head"), "component").join(copies, "head"))
    placed = join_classes(member, moved, ["head"], "members").select("doc", F.coalesce("component", "head").alias("component"))
    numbered = every.where("doc IS NOT NULL").join(placed, "doc", "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))
    out = numbered.unionByName(every.where("doc IS NULL").select("doc", "n", F.lit(None).cast("long").alias("component")))
    return out.select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that link to a smaller id; rows without id stay."""
    key = options.get("doc_id", "doc_id")
    gone = near_duplicates(docs, **options).where(F.col("component_id") != F.col(key)).select(F.col(key).alias("__gone")).distinct()
    return docs.join(gone, docs[key] == F.col("__gone"), "left_anti")
