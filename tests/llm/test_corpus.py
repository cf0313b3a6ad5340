"""Periodic runs, token files and ranked search against slow versions, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import corpus_queries, periodic_runs, ranked_search, registry, token_files
from tessera.llm.periodic_runs import find_runs, maximal_runs
from tessera.llm.ranked_search import radix_order, rank_documents
from tessera.llm.text_queries import vocabulary
from tessera.llm.token_files import Encoder, decode, encode, read_tokens, write_tokens

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use or return.
SCHEMA = "doc_id long, text string, lang string, n_words long, runs string, collapsed string, rank int, score long, start long, ids string, part string, item long, doc string"


def corpus(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1, "r", "c", 2, 3, 4, "i", "p", 5, "d") for i, t in texts], SCHEMA)


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op13_ranked_search"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    assert sorted(map(repr, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


# ---- periodic runs


def slow_runs(words, least, times):
    """Every maximal stretch of every period; of equal stretches the smallest."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def slow_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(rng):
    n = rng.choice([0, 1, 5, 40, 150])
    words = [rng.randrange(rng.choice([1, 2, 3, 60])) for _ in range(n)]
    if n > 20 and rng.random() < 0.7:
        a, p = rng.randrange(n // 2), rng.randint(1, 9)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n - rng.randint(0, 9))] + words[n - 4 :]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_a_slow_search(seed):
    rng = random.Random(seed)
    for _ in range(80):
        docs = [periodic(rng) for _ in range(rng.randint(0, 5))]
        least, times = rng.choice([(24, 3), (4, 2), (6, 2), (6, 3)])
        sizes = np.array([len(d) for d in docs], np.int64)
        start, end, period = maximal_runs(np.array([w for d in docs for w in d], np.int64), sizes, least, times)
        want = [(s + off, s + off + n, q) for d, off in zip(docs, (np.cumsum(sizes) - sizes).tolist(), strict=True) for s, n, q in slow_runs(d, least, times)]
        assert sorted(zip(start.tolist(), end.tolist(), period.tolist(), strict=True)) == sorted(want)


def test_smaller_halves_are_few():
    """n log n leaves in all, also for a text of one word, whose tree is a path."""
    n = 4096
    suffixes = periodic_runs.Suffixes(np.zeros(n, np.int64), np.array([n]))
    assert suffixes.common.tolist() == list(range(n))
    assert sum(len(x[0]) for x in periodic_runs.smaller_halves(suffixes.common)) <= n * math.log2(n)


def test_find_runs_edges(spark):
    rng = random.Random(3)
    long = "x y z " * 40_000
    texts = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "a " * 23), (5, "a " * 24), (6, "a b " * 12 + "c"), (6, "a b " * 12 + "c"), (None, "k " * 30), (7, long), (8, "é " * 25 + "½")]
    texts += [(20 + i, " ".join(f"w{x}" for x in periodic(rng))) for i in range(40)]
    got = find_runs(corpus(spark, texts)).collect()
    plain = lambda r: sorted((x["start"], x["length"], x["period"]) for x in r["runs"])
    want = []
    for i, t in texts:
        words = (t or "").split()
        runs = [(0, len(words), 3)] if t == long else slow_runs(words, 24, 3)
        want.append((i, len(words), runs, slow_collapse(words, runs)))
    assert sorted(map(repr, ((r["doc_id"], r["n_words"], plain(r), r["collapsed"]) for r in got))) == sorted(map(repr, want))
    empty = find_runs(corpus(spark, []))
    assert empty.columns == ["doc_id", "n_words", "runs", "collapsed"] and empty.count() == 0


def test_strongest_run_is_compared_exactly(spark):
    runs = "array(named_struct('start', 1L, 'length', 300000001L, 'period', 100000000L), named_struct('start', 9L, 'length', 300000002L, 'period', 100000000L), named_struct('start', 10L, 'length', 600000004L, 'period', 200000000L))"
    assert spark.range(1).select(corpus_queries.strongest(runs).alias("r")).first()["r"]["start"] == 9


def test_planted_periods(spark):
    texts = [(i, " ".join(f"w{j}" for j in range(i % 37 + (i % 5) * 20))) for i in range(200)] + [(None, "a b"), (None, None)]
    for row in corpus_queries.with_planted_period(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        text = dict(texts[:-2]).get(row["doc_id"]) if row["doc_id"] is not None else row["text"]
        words, h = (text or "").split(), zlib.crc32(str(row["doc_id"]).encode())
        if row["doc_id"] is not None and h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            text = " ".join(w if i < a else words[a + (i - a) % p] for i, w in enumerate(words))
        assert row["text"] == text


# ---- token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=40))
def test_byte_code_round_trip(numbers):
    ranks = np.array(numbers, np.uint32)
    control, data = encode(ranks)
    assert len(control) == -(-len(ranks) // 4)
    assert len(data) == sum(max(1, (x.bit_length() + 7) // 8) for x in numbers)
    assert decode(control, data, len(ranks)).tolist() == numbers


_PIECES = ["a", "b", " ", "  ", "\n", "\n\n", " \n", "\t", "'s", "'", "é", "½", "Ⅷ", "1", "23", ".", "!?", "<|endoftext|>", "<|", "\x85", "\xa0", " ", "\x1c", "中", "🙂", "the", "​", "\r\n", "_", "×", "Ω"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    rng = random.Random(4)
    texts = ["".join(rng.choice(_PIECES) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [None, "", "x" * 3000, "abc, " * 2000]
    own, library = Encoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    for k in range(0, len(texts), 1000):
        ids, size = own(texts[k : k + 1000])
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts[k : k + 1000]]
        assert size.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_encoder_cuts_a_word_once(monkeypatch):
    """Common words of a batch reach the pattern once, whatever their number; texts that can't be split at spaces are cut whole."""
    own, library = Encoder(vocabulary("byte_bpe_50k.json")), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = ["alpha beta, 12's\n" * 3, " alpha beta ", "alpha  beta", "a\xa0 b", "beta\n gamma", "x ", " ", "\u2028", "é 中🙂 ½", "x<|endoftext|> y", "\0 \0a \x1c b", "a\x1c b", None] + ["alpha beta"] * 500
    cut, pattern = [], token_files.PIECE
    monkeypatch.setattr(token_files, "PIECE", type("Watched", (), {"findall": lambda self, t: cut.append(t) or pattern.findall(t)})())
    ids, size = own(texts)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert size.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert sum(t.count("beta") for t in cut) < 20


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 10)
    own, library = Encoder(vocabulary("byte_bpe_50k.json")), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for k in range(5):
        text = " ".join(f"word{k}x{j}" for j in range(30))
        assert own([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def stored(spark, docs, **options):
    path = write_tokens(docs, vocabulary("byte_bpe_50k.json"), end_id=2, **options)
    rows = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"]) for r in read_tokens(spark, path).collect()]
    return path, sorted(rows, key=lambda r: r[1])


def test_token_files_edges(spark):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(5)
    texts = [(None, "null one"), (None, None), (None, "null two"), (5, "five"), (5, "five again"), (5, "five"), (-3, "minus"), (2**62, ""), (7, "w " * 50_000), (8, "a<|endoftext|>b")]
    texts += [(rng.randrange(10**6), " ".join(rng.choice(["alpha", "beta", "gamma,", "é"]) for _ in range(rng.randrange(60)))) for _ in range(300)]
    path, rows = stored(spark, corpus(spark, texts), file_ids=2000)
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in texts)
    assert Counter((i, tuple(x)) for i, _, x, _ in rows) == want
    assert [r[1] for r in rows] == np.cumsum([0, *(r[3] for r in rows[:-1])]).tolist()
    assert [r[0] for r in rows] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i or 0))
    files = spark.read.format("binaryFile").load(f"{path}/files").select("content", "part")
    assert files.count() > 10 and all(bytes(r["content"][:8]) == token_files.MAGIC for r in files.collect())
    ranks = [r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    often = Counter(t for _, _, x, _ in rows for t in x)
    assert ranks == sorted(often, key=lambda t: (-often[t], t))
    assert stored(spark, corpus(spark, []))[1] == []


def test_token_files_hot_ids(spark):
    """A third of the rows without an id spread over files, in one order at every run."""
    texts = [(None, f"row {i} of many") for i in range(3000)] + [(i, "other words here") for i in range(6000)] + [(4, "same")] * 500
    docs = corpus(spark, texts).repartition(7)
    first, second = stored(spark, docs, file_ids=4000), stored(spark, docs.repartition(5), file_ids=4000)
    assert first[1] == second[1] and len(first[1]) == len(texts)
    sizes = [r["length"] for r in spark.read.format("binaryFile").load(f"{first[0]}/files").select("length").collect()]
    assert max(sizes) < sum(sizes) / 5


def test_op12_equals_the_library(spark):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_queries.op12_token_files(spark, SF).collect()}
    docs, start = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())), 0
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


# ---- ranked search


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**50), max_size=50))
def test_radix_order_is_stable(keys):
    keys = np.array(keys, np.int64)
    assert radix_order(keys).tolist() == np.argsort(keys, kind="stable").tolist()


def slow_ranking(docs, items, k):
    terms = lambda t: [w.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    own = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in own:
            m = 10 + (90 * sum(c.values()) * n) // total if total else 10
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w])
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(rows)[:k])]
    return sorted(map(repr, out))


def ranked(spark, docs, items, **options):
    found = rank_documents(corpus(spark, docs).repartition(5), spark.createDataFrame(items, "item_id string, text string"), **options)
    return sorted(map(repr, (tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect())))


def test_ranking_equals_a_slow_one(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "A", "a", "a_b", "x\x7fy", "中文"]
    make = lambda most: " ".join(rng.choice(words) for _ in range(rng.randrange(most)))
    docs = [(i, make(30)) for i in range(150)] + [(None, make(30)), (None, None), (3, ""), (151, "!?"), (152, "W1 " * 60_000)] + [(400 + i, "w1 w2 w3") for i in range(30)] + [(500, "w1 w2 w3")] * 4
    items = [(f"q{i}", make(8)) for i in range(12)] + [("q1", "w1 w1 w2"), ("none", None), ("odd", "unknown ..."), (None, "w5 w6")]
    want = slow_ranking(docs, items, 10)
    assert ranked(spark, docs, items) == want
    monkeypatch.setattr(ranked_search, "SLICE_BYTES", 60)
    monkeypatch.setattr(ranked_search, "GROUPED", 2)
    assert ranked(spark, docs, items) == want


def test_ranking_of_nothing(spark):
    assert ranked(spark, [], [("q", "w")]) == [] and ranked(spark, [(1, "w")], []) == []
    assert rank_documents(corpus(spark, [(1, "w")]), spark.createDataFrame([(1, "w", 9)], "item_id long, text string, doc_id long")).columns == ["item_id", "rank", "doc_id", "score"]


def test_long_texts_are_split_between_terms(monkeypatch):
    monkeypatch.setattr(ranked_search, "PIECE", 7)
    text = ("Abcdefghijk lm, " * 9).encode()
    assert [t for part in ranked_search.terms(text) for t in part] == re.findall(rb"[a-z]+", text.lower())


def test_accumulation_in_small_parts(monkeypatch):
    """Results do not depend on how many entries are sorted at once."""
    import pyarrow as pa

    items = ranked_search.Items([b"a b c", b"c d", b""])
    texts = [b"a b c d"] * 5 + [b"c c", b"", b"d a"]
    rows = []
    for most in (1, 3, 10**6):
        monkeypatch.setattr(ranked_search, "ENTRIES", most)
        best = ranked_search.Best(items.n_items, 4)
        ranked_search.accumulate(items, np.arange(1, 5) * 100, 7, 24, pa.array(range(8), pa.int64()), texts, best)
        rows.append(sorted(best.rows()))
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 8
