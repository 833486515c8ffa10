"""Ids against the tokenizer file as it is, added tokens in texts included."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from statweave.llm import packing, tokens, training_order

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "文字 <|endoftext|> ü", "<|endoftext|", "plain Latin, ñandú", "", "  two  spaces\n\n"]


@pytest.fixture(scope="module")
def plain():
    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: fresh.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_file(plain):
    encode = tokens.encoder()
    for text in TEXTS:
        assert encode(text).tolist() == plain(text)
    assert 50256 in plain(TEXTS[0])


def test_packing_and_shards_hold_them(spark, plain, folder):
    documents = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in packing.cut(documents, with_ids=True).collect():
        assert np.frombuffer(bytes(r.ids), dtype="<u4").tolist() == [*plain(TEXTS[r.doc_id]), 2]
    for r in training_order.training_order(documents, 64).collect():
        assert np.frombuffer(bytes(r.ids), dtype="<u2").tolist()[: r.n_ids] == [*plain(TEXTS[r.doc_id]), 2]


def test_index_agrees_with_the_placed_rows(spark, folder, monkeypatch):
    monkeypatch.setattr(training_order, "SHARD_SEQUENCES", 20)
    monkeypatch.setattr(training_order, "FLUSH_BYTES", 3000)
    documents = spark.createDataFrame([(i, "lorem ipsum dolor " * (i % 40)) for i in range(200)], "doc_id long, text string").repartition(3)
    encoded = training_order.written(training_order.encode(documents, 16))
    placed = training_order.placed(encoded, 16).drop("ids").collect()
    assert sorted(placed) == sorted(training_order.index(encoded, 16).collect())
    assert [r.slot for r in placed] == list(range(len(placed))) and len(placed) > 500
