import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.helpers import ODD, empty_docs, odd_docs
from turnwise.llm.tokens import PieceCounter, byte_batches, count_tokens

JSON = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "Word", " ", "  ", "\n", "\t", " ", "é", "'s", "1", "<|endoftext|>", "!", "\x85", "\x1c", "漢", "😀", ".", "\r\n", "\x00"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def test_parts_add_up_to_the_count_of_the_whole(tokenizer):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(20_000)]

    def encode(batch):
        return [len(e) for e in tokenizer.encode_batch(batch, add_special_tokens=False)]

    assert PieceCounter(encode, 1000, True).counts(texts) == encode(texts)


def test_batches_are_balanced_by_bytes():
    batches = list(byte_batches(["ab", "é" * 4, "c" * 50, "d"], 10))
    assert batches == [["ab", "é" * 4], ["c" * 50], ["d"]]


def test_odd_rows(spark, tokenizer):
    rows = count_tokens(odd_docs(spark), JSON, limit=3).collect()
    assert [r.doc_id for r in rows] == [r[0] for r in ODD]
    for row, odd in zip(rows, ODD):
        text = odd[1] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 3)


def test_empty_table(spark):
    result = count_tokens(empty_docs(spark), JSON)
    assert result.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and result.count() == 0


def test_sentencepiece_file(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = count_tokens(odd_docs(spark), path, safe_spaces=False).collect()
    assert [r.n_tokens for r in rows] == [len(model.encode(odd[1] or "")) for odd in ODD]
