"""The methods inside the operators against slow versions, and their edge cases."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import jaccard_join, native_queries, registry, words
from tessera.llm.common import join_classes, shared_dir
from tessera.llm.decontaminate import decontaminate, find_contained
from tessera.llm.fingerprints import compare_edits
from tessera.llm.jaccard_join import keep_one, near_duplicates
from tessera.llm.language import identify
from tessera.llm.mixing import mix, plan_mix
from tessera.llm.repeats import hashes_at, window_hashes
from tessera.llm.secrets import scan_secrets
from tessera.llm.sharding import assign_shards
from tessera.llm.substring_dedup import least_below_nodes, prefix_groups, remove_repeated_passages, subtree
from tessera.llm.suffix_dedup import longest_previous_factors, remove_repeats
from tessera.llm.text_queries import vocabulary
from tessera.llm.token_counts import count_tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rate long, block long, doc string, shingle string, __text string"


def corpus(spark, texts):
    """Documents with columns whose names operators use."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 777, 5, 8, "x", "y", "z") for i, t in texts], SCHEMA)


def some_words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


# ---- hashes


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=120), st.integers(1, 40))
def test_window_hashes_tell_windows_apart(data, width):
    raw = np.frombuffer(data, np.uint8)
    for found in (window_hashes(raw, width), window_hashes(raw.astype(np.uint64) + np.uint64(1), width), hashes_at(raw, np.arange(max(0, len(raw) - width + 1)), width)):
        windows = [data[i : i + width] for i in range(len(data) - width + 1)]
        assert len(found) == len(windows) and len(set(zip(windows, found.tolist(), strict=True))) == len(set(windows)) == len(set(found.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\x0b é\x85\xa0", max_size=60), max_size=6))
def test_word_codes_equal_split(texts):
    data = [t.encode() for t in texts]
    seq, every = words.word_codes(data), [w for t in data for w in t.split()]
    assert seq.sizes.tolist() == [len(t.split()) for t in data]
    assert len(set(zip(every, seq.codes.tolist(), strict=True))) == len(set(every)) == len(set(seq.codes.tolist()))


def test_words_of_long_texts(monkeypatch):
    text = " ".join(some_words(500, 1) + ["x" * 9000, "x" * 9001, "x" * 9000]).encode()
    whole = words.word_codes([text, b"", text]).codes
    monkeypatch.setattr(words, "PIECE", 100)
    again = words.word_codes([text, b"", text])
    assert whole.tolist() == again.codes.tolist() and again.sizes.tolist() == [503, 0, 503]
    assert whole[500] == whole[502] != whole[501]


def patterned(n):
    """A text of two letters, and its complement, that sums of powers of one odd number can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_patterned_words_differ(spark):
    one, two = patterned(2048)
    rest = some_words(30, 2)
    docs = corpus(spark, [(1, " ".join([one, *rest[:8]])), (2, " ".join([two, *rest[:8]])), (3, one), (4, two)])
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {i: i for i in (1, 2, 3, 4)}
    docs = corpus(spark, [(1, " ".join([one, *rest[:12]])), (2, " ".join([two, *rest[:12]]))])
    assert all(not r.spans for r in remove_repeated_passages(docs).collect())
    cut = {r.doc_id: len(r.kept) for r in remove_repeats(corpus(spark, [(1, one), (2, two)]), width=2048).collect()}
    assert cut == {1: 2048, 2: 2048}


# ---- 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_longest_previous_factors(units):
    n = len(units)
    levels = [(2, [tuple(units[i : i + 2]) for i in range(n)]), (5, [tuple(units[i : i + 5]) for i in range(n)])]
    keys = [(np.array([hash((size, t)) for t in tuples], np.int64), size) for size, tuples in levels]
    previous, following = longest_previous_factors(keys, [np.arange(n)])

    def slow(i, others):
        return max([size for size, tuples in levels for j in others if tuples[j] == tuples[i]], default=0)

    assert previous.tolist() == [slow(i, range(i)) for i in range(n)]
    assert following.tolist() == [slow(i, range(i + 1, n)) for i in range(n)]


def test_long_texts(spark):
    passage = some_words(60, 3)
    long = some_words(160_000, 4) + passage + some_words(160_000, 5)
    docs = corpus(spark, [(1, " ".join(long)), (2, " ".join(["start", *passage, "end"])), (3, "x" * 1_200_000)])
    found = {r.doc_id: r for r in remove_repeated_passages(docs).collect()}
    assert found[1].spans == [] and [(s.start, s.end) for s in found[2].spans] == [(1, 61)] and found[3].n_words == 1
    cut = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert len(cut[3].kept) == 0 and cut[1].n_bytes - len(cut[1].kept) in range(len(" ".join(passage)), len(" ".join(passage)) + 3)
    sets = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert sets[1].n_shingles == len({tuple(long[i : i + 5]) for i in range(len(long) - 4)}) and sets[3].n_shingles == 1


# ---- 6


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=4, max_size=80), st.integers(1, 12), st.data())
def test_subtrees(units, most, data):
    ids, width = np.array(units), 4
    at = np.arange(len(ids) - width + 1)
    owner = np.array(data.draw(st.lists(st.integers(0, 5), min_size=len(at), max_size=len(at))))
    groups = list(prefix_groups(ids, at, most, width))
    assert sorted(np.concatenate(groups).tolist()) == at.tolist()
    window = lambda i: tuple(ids[i : i + width].tolist())
    assert all(len(g) <= most or len({window(i) for i in g}) == 1 for g in groups)
    assert len({window(i) for i in at}) == sum(len({window(i) for i in g}) for g in groups)
    for g in groups:
        order, common = subtree(ids, g, width, 2)
        shown = [window(i) for i in g[order]]
        assert shown == sorted(shown)
        for a, b, c in zip(shown, shown[1:], common[1:].tolist(), strict=False):
            assert c == next((j for j in range(width) if a[j] != b[j]), width)
        least = least_below_nodes(order, common, owner[g], width)
        assert least.tolist() == [min(owner[j] for j in g if window(j) == window(i)) for i in g]


# ---- 8


@pytest.mark.parametrize("cost", [0.0, 1e9])
def test_levels_lose_no_link(spark, monkeypatch, cost):
    monkeypatch.setattr(jaccard_join, "VERIFY_COST", cost)
    rng, texts = random.Random(9), []
    for family in range(6):
        base = some_words(rng.choice([6, 30, 80]), 50 + family)
        for i in range(25):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(6)}"
            texts.append((family * 100 + i, " ".join(own)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in texts}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id: r.component_id for r in near_duplicates(corpus(spark, texts)).collect()} == label


def test_join_of_hot_classes(spark):
    rows = spark.range(30_000).selectExpr("if(id < 25000, 0L, id) AS k", "id")
    classes = rows.groupBy("k").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1 OR k % 2 = 0")
    found = join_classes(rows, classes, ["k"], "n")
    assert found.count() == 30_000 and found.where("k = 0 AND least <> 0 OR k % 2 = 1 AND least IS NOT NULL").count() == 0


@pytest.mark.parametrize("name", ["op3_suffix_dedup", "op6_substring_dedup", "op8_jaccard_join"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    found = registry.queries()[name](spark, SF).toPandas()[list(want.columns)]
    assert Counter(found.itertuples(index=False, name=None)) == Counter(want.itertuples(index=False, name=None))


# ---- 1


def test_items_and_documents_that_share_ids(spark):
    one, two = some_words(30, 20), some_words(26, 21)
    docs = corpus(spark, [(1, " ".join(one)), (1, " ".join(two)), (1, " ".join(two)), (2, " ".join(one + two)), (3, " ".join(one[:16]))])
    items = spark.createDataFrame([(7, " ".join(one)), (7, " ".join(two)), (7, " ".join(two)), (8, " ".join(one))], "item_id long, text string")
    found = Counter((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in find_contained(docs, items).collect())
    assert found == Counter([(1, 7, 26, 26), (1, 7, 22, 22), (1, 8, 26, 26), (2, 7, 26, 26), (2, 7, 22, 22), (2, 8, 26, 26)])
    assert [r.doc_id for r in decontaminate(docs, items).collect()] == [3]


# ---- 2


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _hash(*parts):
    """Spark's xxhash64 of strings, longs (int) and ints ((int, 4))."""
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else (p % (1 << 64)).to_bytes(8, "little") if isinstance(p, int) else p[0].to_bytes(4, "little")
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return _signed(seed)


def slow_fingerprint(text, k=3):
    own = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    kmers = [tuple(own[i : i + k]) for i in range(max(1, len(own) - k + 1))] if own else []
    seen, numbered = Counter(), []
    for at, kmer in enumerate(kmers):
        numbered.append((_hash(_hash(*kmer) >> 30, (seen[kmer], 4)) >> 30, at))
        seen[kmer] += 1
    parts = {}
    for h, at in sorted(numbered):
        parts.setdefault(h >> 28, []).append((h, at))
    out = []
    for part, least in sorted(parts.items()):
        chosen = [h for h, at in sorted(least[:2], key=lambda x: x[1])]
        out.append(((part & 63) << 34) | ((_hash(*chosen) % (1 << 64)) >> 30))
    return out


def test_fingerprints_equal_a_slow_version(spark):
    texts = [(1, None), (2, ""), (3, "one"), (4, "a b"), (5, "a b c " * 40), (6, " ".join(some_words(300, 30))), (7, "\n x\ty  z é 日本 "), (8, " ".join(some_words(2000, 31)))]
    found = {r.doc_id: r for r in compare_edits(corpus(spark, texts)).collect()}
    for i, t in texts:
        assert list(found[i].tuples) == slow_fingerprint(t) and list(found[i].edited_tuples) == slow_fingerprint(found[i].edited)
    assert list(found[8].next_tuples) == slow_fingerprint(None)


# ---- 5, 9, 10


def test_mix_keeps_clashing_columns(spark):
    docs = corpus(spark, [(1, "a b c"), (2, None), (3, "d e")])
    assert {(r["size"], r["rate"]) for r in mix(docs).collect()} == {(777, 5)} and mix(docs).columns == docs.columns
    assert {r["size"] for r in plan_mix(docs).collect()} == {3, 0, 2}


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, t, lang) for i in range(12) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"))], "doc_id long, text string, lang string")
    model = vocabulary("piece_bpe_32k.model")
    rows = identify(docs.union(docs), model).collect()
    assert len(rows) == 48 and all(r.lang_pred == r.lang for r in rows)
    same = docs.withColumn("text", F.lit("xyz xyz"))
    assert {r.lang_pred for r in identify(same, model).collect()} == {"de"}
    assert identify(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("limit", [20_000, 100_000])
def test_shards_match_sql_where_they_split(spark, limit):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(native_queries.ORACLES["op10_extendible_sharding"].replace(str(native_queries.SHARD_LIMIT), str(limit))).df()
    found = assign_shards(spark.read.parquet(f"{SF}/documents.parquet"), limit=limit).select("doc_id", "shard_id").toPandas()
    assert len(set(want.shard_id)) > 3 and dict(found.itertuples(index=False)) == dict(want[["doc_id", "shard_id"]].itertuples(index=False))


# ---- 4, 7: long texts, empty tables, repeated rows


def test_tokens_of_one_long_piece(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    texts = [(1, "ab" * 60_000), (1, "ab" * 60_000), (2, None)]
    n = len(Tokenizer.from_file(path).encode(texts[0][1], add_special_tokens=False).ids)
    assert Counter((r.doc_id, r.n_tokens) for r in count_tokens(corpus(spark, texts), path).collect()) == Counter([(1, n), (1, n), (2, 0)])
    assert count_tokens(corpus(spark, texts).limit(0), path).count() == 0


def test_secrets_of_a_long_text(spark):
    text = "filler words " * 100_000 + "token = abcdef123456" + " more" * 100_000
    rows = scan_secrets(corpus(spark, [(1, text), (1, text)])).collect()
    assert [[(s.kind, s.start) for s in r.secrets] for r in rows] == [[("assign", 1_300_000)]] * 2
    assert scan_secrets(corpus(spark, [(1, text)]).limit(0)).count() == 0


# ---- the pipeline


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, name, stage):
    text = " ".join(some_words(40, 60))
    docs = corpus(spark, [(1, text), (1, text), (None, text), (None, None), (2, None), (3, ""), (4, " ".join(some_words(900, 61)))])
    out = stage(spark, docs, SF)
    kept = Counter(r.doc_id for r in out.collect())
    assert set(docs.columns) <= set(out.columns) and kept[4] >= 1
    if name in ("near_duplicates", "benchmark_leaks", "shards"):
        assert kept == Counter([1, 1, None, None, 2, 3, 4])
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_copies_that_the_pipeline_drops(spark):
    text = " ".join(some_words(40, 62))
    assert sorted(r.doc_id for r in keep_one(corpus(spark, [(5, text), (3, text), (9, text + " more"), (7, "else")])).collect()) == [3, 7]


def test_shared_folder_must_be_named_on_a_cluster(spark):
    assert shared_dir(spark)

    class Elsewhere:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Elsewhere()

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())
