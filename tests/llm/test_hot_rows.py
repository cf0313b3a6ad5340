"""Hash collisions, letters, and rows that share an id or have none, at numbers where quadratic work or one large group would show."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import repeats, words
from tessera.llm.fingerprints import compare_edits
from tessera.llm.jaccard_join import near_duplicates
from tessera.llm.language import identify, split_words
from tessera.llm.mixing import plan_mix
from tessera.llm.substring_dedup import remove_repeated_passages
from tessera.llm.suffix_dedup import remove_repeats
from tessera.llm.text_queries import vocabulary
from tessera.llm.token_counts import Machine

#: Pairs of words whose halves differ such that a fixed linear step gives both one hash.
PAIRS = [("mntyadvy<;sa#![!", "djtiarte![!!^s(#"), ("wvibuvle3\\^0M0Z0", "lqlujpux000f0v0g")]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("pair", PAIRS)
def test_made_words_do_not_collide(spark, pair):
    for salt in (0, 1, 2**63):
        repeats.use_salt(salt)
        codes = words.word_codes([" ".join(pair).encode()]).codes
        assert codes[0] != codes[1]
        raw = np.frombuffer("".join(pair).encode(), np.uint8)
        assert repeats.window_hashes(raw, 16)[0] != repeats.window_hashes(raw, 16)[16]
    repeats.use_salt(0)
    around = [f"w{i}" for i in range(12)]
    texts = [" ".join([*around[:6], word, *around[6:]]) for word in pair]
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, list(enumerate(texts)))).collect()}
    assert found == {0: 0, 1: 1}
    cut = remove_repeated_passages(docs(spark, list(enumerate(texts)))).collect()
    assert all(not r["spans"] for r in cut)


def test_words_of_a_block_are_compared(monkeypatch):
    """Where every window has one hash, words still tell the passages apart."""
    import pandas as pd

    from tessera.llm import substring_dedup as D

    texts = [b"a b c d e f g h i j k l m", b"a b c d e f g h i j k l n", b"a b c d e f g h i j k l m"]
    caught = {}
    monkeypatch.setattr(D, "find_repeats", lambda *args: caught.update(send=args[5], finish=args[7]))
    monkeypatch.setattr(D, "counts_for", lambda *args: (1, 1))
    monkeypatch.setattr(D, "blocked", lambda *args: None)
    monkeypatch.setattr(D, "window_hashes", lambda codes, width: np.zeros(max(0, len(codes) - width + 1), np.uint64))
    D.remove_repeated_passages(None)
    seq, ids = D._sequences(texts), np.array([0, 1, 2], object)
    first = np.array([0, 13, 26])
    (_, _, blob), = caught["send"](0, ids, seq, (np.zeros(3, np.uint64), first, first))
    assert D.unpack(blob, np.int64, np.int32, np.int64, None)[0].tolist() == [0, 13]
    rows = caught["finish"](ids, texts, seq, [])
    assert isinstance(rows, pd.DataFrame) and rows["kept"].tolist() == [texts[0].decode(), texts[1].decode(), ""]


def test_salts_differ_by_run_and_results_do_not(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(60)) for _ in range(40)]
    table = docs(spark, [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts[:9])])
    for operator in (near_duplicates, remove_repeated_passages):
        assert sorted(map(repr, operator(table).collect())) == sorted(map(repr, operator(table).collect()))
    assert repeats.new_salt() != repeats.new_salt()


def test_letters_are_those_of_the_category(spark):
    assert split_words("½ ² Ⅷ ①") == [] and split_words("a½b ²C") == ["a", "b", "c"] and split_words("Été_9x") == ["été", "x"]
    rows = [(i, "the cat and the dog", "en") for i in range(8)] + [(20 + i, "der hund und die katze", "de") for i in range(8)] + [(50, "½ ² ①", None), (51, "½ the ②", None)]
    found = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), vocabulary("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found.where("doc_id >= 50").collect()}
    assert got[50] == ("und", 0.0) and got[51][0] == "en"


def test_rows_without_id_are_sampled_and_mixed_as_others(spark):
    rows = [(None, f"w{i} " * 40, "en", "s") for i in range(3000)] + [(i, "x " * 40, "en", "t") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = plan_mix(table.drop("lang")).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"))
    assert all(abs(r["taken"] - r["target"]) < 0.1 * r["target"] for r in taken.collect())


#: 20,000 equal rows, and 20,000 rows without an id.
EQUAL = [(7, "six equal words in a row")] * 20_000
NULL_IDS = [(None, f"some words of row {i} and no id") for i in range(20_000)]


@pytest.mark.parametrize("rows", [EQUAL, NULL_IDS], ids=["equal", "null"])
@pytest.mark.parametrize("operator", [compare_edits, remove_repeats, remove_repeated_passages, near_duplicates])
def test_many_rows_of_one_id(spark, operator, rows):
    others = [(100 + i, f"text {i} of its own with words") for i in range(50)]
    began = time.monotonic()
    assert operator(docs(spark, rows + others).repartition(8)).count() == len(rows) + 50
    assert time.monotonic() - began < 60


def test_equal_rows_keep_their_neighbours(spark):
    rows = [(1, "one two three four")] * 4 + [(2, "five six seven eight")] * 3 + [(3, None)]
    got = sorted((r["doc_id"], r["edited"]) for r in compare_edits(docs(spark, rows)).collect())
    a, b = "one two three four", "five six seven eight"
    edit = lambda own, following: own[: len(own) - len(own) // 4] + following[: len(own) // 4]
    assert got == sorted([(1, edit(a, a))] * 3 + [(1, edit(a, b))] + [(2, edit(b, b))] * 2 + [(2, edit(b, "")), (3, "")])


def test_blocks_are_dealt_by_text(spark):
    blocks = repeats.blocked(docs(spark, NULL_IDS), "doc_id", "text", 64).groupBy("block").count().collect()
    assert len(blocks) == 64 and max(r["count"] for r in blocks) < 1000


def test_maps_of_chunks_compose_in_few_rounds():
    rng = random.Random(2)
    machine, library = Machine(vocabulary("byte_bpe_50k.json")), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    text = "".join(rng.choice("abcdefghij") for _ in range(256 * 200))
    assert machine.count([text]).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]
    assert machine.rounds <= 9
    texts = ["a" * n for n in (255, 256, 257, 511, 512, 513, 3000)] + ["é" * 900, "x " + "y" * 700 + " z" + "w" * 600 + "1" * 500, " " * 800, "\n" * 600 + "a" * 300]
    assert machine.count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
