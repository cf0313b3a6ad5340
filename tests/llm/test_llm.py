"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import registry
from tessera.llm.components import components
from tessera.llm.decontaminate import decontaminate, find_contained
from tessera.llm.fingerprints import compare_edits, likeness
from tessera.llm.jaccard_join import keep_one, near_duplicates
from tessera.llm.language import Pieces, fit, forward, identify, word_scores
from tessera.llm.mixing import mix, plan_mix
from tessera.llm.repeats import anchors
from tessera.llm.secrets import base_spans, link, redact, scan_secrets, scan_text, weak_spans
from tessera.llm.sharding import assign_shards
from tessera.llm.substring_dedup import remove_repeated_passages
from tessera.llm.suffix_dedup import remove_repeats
from tessera.llm.text_queries import vocabulary
from tessera.llm.token_counts import count_tokens, machine

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, block long, doc string"


def corpus(spark, texts):
    """Documents with columns whose names operators use inside."""
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 7, 8, "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def words(n, seed=0, kinds=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def sample():
    base = words(120, 1)
    near = base[:60] + ["changed"] + base[61:]
    passage = words(40, 2)
    long = words(6000, 3)
    texts = [None, "", "   \n", "one", "two words", " ".join(base), " ".join(base), " ".join(near), " ".join(words(50, 4) + passage), " ".join(passage + words(30, 5)), " ".join(long), "  ".join(w.upper() for w in base)]
    texts += ["ab" * 400, "x " * 300, "é" * 260 + " ß", " ".join(long[100:220] + words(20, 6)), " nbsp word"]
    return list(enumerate(texts)) + [(5, " ".join(base)), (None, " ".join(base))]


def by_row(rows):
    return Counter(map(tuple, rows))


# ---- 1


def test_decontamination(spark):
    item = words(30, 9)
    docs = corpus(spark, [(1, " ".join(words(3000, 10) + item + words(3000, 11))), (2, " ".join(item[:20])), (3, None), (4, ""), (5, ", ".join(w.upper() for w in item)), (6, " ".join(words(400, 12))), (5, ", ".join(item))])
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (4, " ".join(words(20, 13)))], "item_id long, text string")
    found = find_contained(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.containment) for r in found) == [(1, 1, 1.0), (5, 1, 1.0)]
    assert sorted(r.doc_id for r in decontaminate(docs, items).collect()) == [2, 3, 4, 6]
    assert decontaminate(docs, items).columns == docs.columns
    assert find_contained(docs.limit(0), items).count() == 0 and find_contained(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_decontaminate", "op5_mix_sources", "op10_extendible_sharding"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    found = registry.queries()[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(str, found.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


def test_decontamination_with_null_ids(spark):
    one, two = words(30, 9), words(30, 14)
    docs = corpus(spark, [(None, " ".join(words(300, 10) + one)), (None, " ".join(words(300, 11))), (None, None), (1, " ".join(two)), (2, " ".join(words(40, 12)))])
    items = spark.createDataFrame([(7, " ".join(one)), (None, " ".join(two)), (None, " ".join(words(20, 13)))], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.containment) for r in find_contained(docs, items).collect()}
    assert found == {(None, 7, 1.0), (1, None, 1.0)}
    left = decontaminate(docs, items).collect()
    assert sorted(str(r.doc_id) for r in left) == ["2", "None", "None"] and all(" ".join(one) not in (r.text or "") for r in left)


# ---- 2


def test_edits_and_fingerprints(spark):
    texts = sample()
    found = compare_edits(corpus(spark, texts)).collect()
    assert len(found) == len(texts)
    shown = [r for r in found if r.doc_id is not None and r.doc_id not in (4, 5)]
    order = {i: (t or "") for i, t in texts if i is not None}
    for r in shown:
        t, after = order[r.doc_id], order.get(r.doc_id + 1)
        q = len(t) // 4
        if after is not None:
            assert r.n_chars == len(t) and r.edited == t[: len(t) - q] + after[:q]
    same = defaultdict(set)
    for r in found:
        if r.doc_id is not None:
            same[order[r.doc_id]].add(tuple(r.tuples))
    assert all(len(v) == 1 for v in same.values())
    assert compare_edits(corpus(spark, []).limit(0)).count() == 0
    alone = compare_edits(corpus(spark, [(1, "a b c d e f g h")])).first()
    assert alone.edited == "a b c d e f a b" and alone.n_chars == 15


def test_fingerprints_see_order_and_repeats(spark):
    base = words(400, 20)
    swapped = base[200:] + base[:200]
    shuffled = random.Random(1).sample(base, len(base))
    rows = [(1, " ".join(base)), (2, " ".join(base[:-5])), (3, " ".join(swapped)), (4, " ".join(shuffled)), (5, "a b c " * 50), (6, "a b c " * 100)]
    got = {r.doc_id: r for r in compare_edits(corpus(spark, rows)).collect()}
    pairs = spark.createDataFrame([(a, b, got[a].tuples, got[b].tuples) for a, b in ((1, 1), (1, 2), (1, 3), (1, 4), (5, 6))], "a int, b int, x array<long>, y array<long>")
    near = {(r.a, r.b): r.v for r in pairs.select("a", "b", likeness(F.col("x"), F.col("y")).alias("v")).collect()}
    assert near[1, 1] == 1 and near[1, 2] > 0.8 and near[1, 4] < 0.1 and 0 < near[1, 3] < near[1, 2] and near[5, 6] < 1


# ---- 3 and 6


def plain_bytes(texts, width):
    data = [(t or "").encode() for _, t in texts]
    count = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - width + 1):
            if count[d[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append(bytes(np.frombuffer(d, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("width", [20, 200])
def test_suffix_dedup(spark, width):
    texts = sample()
    found = remove_repeats(corpus(spark, texts), width=width).collect()
    want = plain_bytes(texts, width)
    assert by_row((r.doc_id, r.n_bytes, bytes(r.kept)) for r in found) == by_row((i, len((t or "").encode()), k) for (i, t), k in zip(texts, want, strict=True))
    assert all(sum(s.end - s.start for s in r.spans) == r.n_bytes - len(r.kept) for r in found)


def test_suffix_dedup_keeps_the_first(spark):
    block = " ".join(words(60, 30))
    texts = [(3, "c" + block), (1, "a" + block), (2, "b" + block), (7, "d " * 300)]
    kept = {r.doc_id: bytes(r.kept).decode() for r in remove_repeats(corpus(spark, texts), keep="first").collect()}
    assert kept[1] == "a" + block and kept[2] == "b" and kept[3] == "c" and kept[7].startswith("d ")
    assert remove_repeats(corpus(spark, []).limit(0)).count() == 0


def test_substring_dedup(spark):
    texts = sample()
    least = {}
    for i, t in texts:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            least[key] = min(least.get(key, 10**9), -1 if i is None else i)
    want = []
    for i, t in texts:
        w, gone = (t or "").encode().split(), set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < (-1 if i is None else i):
                gone |= set(range(k, k + 13))
        want.append((i, len(w), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    found = remove_repeated_passages(corpus(spark, texts)).collect()
    assert by_row((r.doc_id, r.n_words, r.kept) for r in found) == by_row(want)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=5), st.integers(3, 8))
def test_equal_windows_share_their_anchor(docs, width):
    k = max(1, width - 3)
    codes = np.array([c + 1 for d in docs for c in d], np.uint64)
    sizes = np.array([len(d) for d in docs])
    hashes, first, last = anchors(codes, sizes, width, k)
    seen, covered = {}, set()
    for h, a, b in zip(hashes.tolist(), first.tolist(), last.tolist(), strict=True):
        for p in range(a, b + 1):
            covered.add(p)
            assert seen.setdefault(tuple(codes[p : p + width].tolist()), h) == h
    starts = np.cumsum(sizes) - sizes
    assert covered == {s + i for s, n in zip(starts.tolist(), sizes.tolist(), strict=True) for i in range(n - width + 1)}


# ---- 4


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "'", "s", "t", "re", "ll", "the", "Hello", "12", "!", "?!", "é", "日本", "🙂", "<|endoftext|>", " ", "a" * 300]), max_size=30).map("".join))
def test_token_counts_equal_the_library(text):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    global _tokenizer
    if "_tokenizer" not in globals():
        _tokenizer = Tokenizer.from_file(path)
    assert machine(path).count([None, text, "", text + text]).tolist() == [0, *(len(_tokenizer.encode(t, add_special_tokens=False).ids) for t in (text, "", text + text))]


def test_token_counts_of_documents(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = sample()
    found = count_tokens(corpus(spark, texts), path).collect()
    assert by_row((r.doc_id, r.n_tokens) for r in found) == by_row((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)


# ---- 5


def test_mix(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(words(rng.randint(0, 60), i))) for i in range(3000)]
    docs = corpus(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 7 == 1, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5)))
    rows = plan_mix(docs).collect()
    total = sum(r["size"] for r in rows)
    groups = defaultdict(list)
    for r in rows:
        assert r["size"] == len((dict(texts)[r.doc_id]).split()) and r.copies <= 2
        groups[r.source].append(r)
    assert abs(sum(g[0].target for g in groups.values()) - 1.5 * total) < 1e-6 * total
    for g in groups.values():
        assert g[0].target <= 2 * g[0].source_size + 1e-9
        assert abs(sum(r.copies * r["size"] for r in g) - g[0].target) < 0.15 * max(200, g[0].target)
    assert by_row((r.doc_id, r.copies) for r in rows) == by_row((r.doc_id, r.copies) for r in plan_mix(docs).collect())
    assert mix(docs).count() == sum(r.copies for r in rows) and mix(docs).columns == docs.columns
    assert plan_mix(corpus(spark, [(1, None), (None, "")])).select("copies").distinct().collect()[0][0] == 0
    assert plan_mix(docs.limit(0)).count() == 0


# ---- 7


BASE = [
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]+"),
]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "api_key", "apikey", "=", ": ", " ", '"', "'", "abc", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "é", "user=bob ", "https://h.example/x ", "\n"]), max_size=25).map("".join))
def test_base_secrets_equal_their_patterns(text):
    want = [("assign", *m.span()) for m in BASE[0].finditer(text) if len(m[2]) >= 6]
    want += [("access", *m.span()) for m in BASE[1].finditer(text) if len(m[0]) >= 20]
    want += [("hex", *m.span()) for m in BASE[2].finditer(text) if len(m[0]) >= 24]
    assert sorted(base_spans(text)) == sorted(want)
    assert set(want) <= set(scan_text(text, 240))


def test_weak_parts_need_company():
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
    far = "filler words " * 60
    assert len(key) == 40 and scan_text(key, 240) == []
    both = f"user = alice {key} https://db.example.com"
    assert {s[0] for s in scan_text(both, 240)} == {"id", "key", "endpoint"}
    assert scan_text(f"user = alice {far} {key}", 240) == []

    def slow(base, weak, scope):
        meets = lambda a, kinds: any(b[0] in kinds and b[1] < a[2] + scope and b[2] > a[1] - scope for b in base + weak)
        need = {"key": [("access", "id")], "id": [("assign", "hex", "key")], "endpoint": [("access", "id"), ("assign", "hex", "key")]}
        taken = {b[1:] for b in base}
        return sorted(set(base) | {w for w in weak if w[1:] not in taken and all(meets(w, k) for k in need[w[0]])})

    rng = random.Random(4)
    for _ in range(50):
        text = " ".join(rng.choice([key, "user: bobby", "https://a.example", "filler " * rng.randint(1, 30), "token=abcdef123", "login=carol"]) for _ in range(12))
        base, weak = base_spans(text), weak_spans(text)
        weak = [w for w in weak if w[1:] not in {b[1:] for b in base}]
        assert sorted(link(base, weak, 100)) == slow(base, weak, 100)


def test_secrets_of_documents(spark):
    docs = corpus(spark, [(1, None), (2, ""), (3, 'é token = "0123456789abcdef0123456789abcdef"'), (3, "x")])
    found = {(r.doc_id, len(r.secrets)) for r in scan_secrets(docs).collect()}
    assert found == {(1, 0), (2, 0), (3, 2), (3, 0)}
    assert [r.text for r in redact(docs).orderBy("doc_id").collect()][:2] == [None, ""]
    assert "0123" not in "".join(r.text or "" for r in redact(docs).collect())


# ---- 8


def slow_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(s), label[i]) for i, s in sets.items()}


def test_jaccard_join(spark):
    rng = random.Random(8)
    base, texts = words(90, 40), [(i, t) for i, t in sample() if i is not None][:-1]
    for i in range(100, 160):  # a chain of copies, each an edit of an earlier one
        base = list(base) if i % 7 else words(90, i)
        base[rng.randrange(len(base))] = f"e{i}"
        texts.append((i, " ".join(base)))
    docs = corpus(spark, texts)
    want = slow_components(texts)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert found == want
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_jaccard_join_edges(spark):
    again = corpus(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F"), (3, None), (4, None)])
    rows = by_row((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(again).collect())
    assert rows == by_row([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 2, 1), (3, 0, 3), (4, 0, 4)])
    assert near_duplicates(again.limit(0)).count() == 0


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(50)], "node long")
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 41), (41, 40), (45, 45)], "a long, b long")
    found = {r.node: r.component for r in components(nodes, links).collect()}
    assert found == {i: 0 if i <= 30 else 40 if i in (40, 41) else i for i in range(50)}


# ---- 9


def test_forward_sums_all_segmentations():
    names = ["▁", "a", "b", "ab", "▁a", "ba", "aba"]
    pieces, prob = Pieces(names), np.random.default_rng(0).uniform(0.1, 1, (len(names), 2))

    def slow(text, j):
        return 1.0 if not text else sum(prob[i, j] * slow(text[len(p) :], j) for i, p in enumerate(names) if text.startswith(p))

    for word in ("a", "ab", "aba", "bab", "abababab"):
        found = pieces.spans(["▁" + word])[0]
        for j in range(2):
            assert np.isclose(forward(found, prob)[-1, 0, j] / 24.0 ** (len(word) + 1), slow("▁" + word, j))
    assert np.isfinite(word_scores(pieces, prob, ["zzz", "a" * 500])).all()


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "12 34 !!", "de"), (10**6 + 2, "", None)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").union(odd)
    rows = identify(both, vocabulary("piece_bpe_32k.model")).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id >= 10**6)
    held = [r for r in rows if r.held_out and r.doc_id < 10**6]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    none = identify(odd, vocabulary("piece_bpe_32k.model")).collect()
    assert {r.lang_pred for r in none} <= {"und", "de", "en"}


def test_long_runs_are_learned_whole():
    counts = pd.DataFrame([("aa", "a" * 48 + "b" * 48, 5)], columns=["lang", "word", "n"])
    pieces = Pieces(["a", "b", "▁a"])
    prob = fit(pieces, counts, ["aa"])[:, 0]
    assert prob[1] > 0.3


def test_pipeline_keeps_texts_without_labels(spark):
    docs = corpus(spark, [(1, "some words"), (2, None), (3, "12 34"), (4, "中文")]).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()) == [1, 4]


# ---- 10


def test_sharding(spark):
    rng = random.Random(5)
    texts = [(i, "x" * rng.randint(0, 400)) for i in range(800)] + [(900, "y" * 5000), (901, None), (None, ""), (7, "z" * 3000), (7, "z" * 3000)]
    shards = defaultdict(list)
    for r in assign_shards(corpus(spark, texts), limit=4000).collect():
        assert len(r.shard_id) == r.shard_bits
        shards[r.shard_id].append((r.doc_id, len((r.text or "").encode())))
    assert sum(map(len, shards.values())) == len(texts)
    for members in shards.values():
        assert sum(b for _, b in members) <= 4000 or len({i for i, _ in members}) == 1
    ids = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(ids, ids[1:], strict=False))
    assert assign_shards(corpus(spark, texts), limit=10**9).select("shard_id").distinct().collect()[0][0] == ""
    assert assign_shards(corpus(spark, []).limit(0), limit=10).count() == 0


def test_sharding_of_deep_buckets(spark):
    rows = assign_shards(corpus(spark, [(i, "x" * 50) for i in range(3000)]), limit=60).collect()
    assert Counter(r.shard_id for r in rows).most_common(1)[0][1] == 1


# ---- the pipeline


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    numbers = []
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF).cache()
        numbers.append(out.count())
        if name != "shards":
            assert out.columns == docs.columns
        docs = out
    assert numbers[1] <= numbers[0] and numbers[2] <= numbers[1] and numbers[4] == numbers[3]
    assert p.run(spark, SF).count() == numbers[4]


def test_digests(spark):
    row = registry.queries()["op2_order_minhash"](spark, SF).orderBy("doc_id").first()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 2").collect()}
    q = len(docs[0]) // 4
    assert row.edited_sha256 == hashlib.sha256((docs[0][: len(docs[0]) - q] + docs[1][:q]).encode()).hexdigest()
