"""Ids of the token file against a tokenizer as the library loads it."""

import numpy as np
from tokenizers import Tokenizer

from tidewake.llm import token_file
from tidewake.llm.common import scratch
from tidewake.llm.queries import tokenizer_path

TEXTS = ["a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|> é<|endoftext|>日本", "<|endoftext", "<|endoftext|><|endoftext|>", "plain words"]


def test_added_tokens_become_their_ids(spark):
    path, own = scratch(spark, "test-added"), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    assert len(own.encode(TEXTS[0], add_special_tokens=False).ids) == 3
    token_file.write_tokens(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), tokenizer_path("word_bpe_49k.json"), path, 2)
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in token_file.read_tokens(spark, path).collect()}
    assert got == {i: [*own.encode(t, add_special_tokens=False).ids, token_file.END_ID] for i, t in enumerate(TEXTS)}
