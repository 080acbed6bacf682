import random

import pytest
import tiktoken

from cartalog.llm.tokenizer import PATTERN, VOCABULARIES, Encoder, decode, model_bytes, read_ranks, token_ids


@pytest.fixture(scope="module")
def entries():
    return read_ranks(folder=VOCABULARIES)


@pytest.fixture(scope="module")
def plain(entries):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: k for k, b in enumerate(entries)}, special_tokens={})


def test_random_texts_and_round_trip(entries, plain):
    rng = random.Random(3)
    ranges = [(32, 127), (0x80, 0x800), (0x4E00, 0x9FFF), (0x1F300, 0x1F700), (9, 14), (0x300, 0x370)]
    texts = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts += ["a" * 20_000, "<|endoftext|> it's", "\x00▁ a", " " * 500, "I'll've  x"]
    ids = Encoder(model_bytes(entries)).encode_batch(texts)
    assert [list(i) for i in ids] == [plain.encode_ordinary(t) for t in texts]
    assert [decode(list(i), entries) for i in ids] == texts


def test_fixed_results_for_nothing(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " ", 5), (3, " ", 5)], "doc_id int, text string, ids int")
    rows = token_ids(df, "doc_id", "text").collect()
    assert sorted((r["doc_id"], r["ids"]) for r in rows) == [(1, []), (2, []), (3, [220]), (3, [220])]
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0


def test_whole_table(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in token_ids(docs, "doc_id", "text").collect()}
    assert got == {k: plain.encode_ordinary(t) if t else [] for k, t in texts.items()}
