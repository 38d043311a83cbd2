"""Runs are strung together for the tokenizer and parted again."""

import random

import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from partlens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def _words(n, letters, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices(letters, k=draw.randint(1, 14))) for _ in range(n)]


def test_words_of_letters_are_not_given_to_the_tokenizer_one_by_one():
    encoder = packing.WordEncoder(PATH)
    encoder._tokenizer = Counting(encoder._tokenizer)
    text = " ".join(_words(20_000, "abcdefghijklmnopqrstuvwxyzéüασ", 1))
    ids, starts = encoder.encode(pa.array([text]))
    assert ids.tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert starts.tolist() == [0, len(ids)]
    assert encoder._tokenizer.texts < 200


def test_odd_words_are_parted_where_the_tokenizer_parts_them():
    odd = "aZ9İΣςﬁ½ͅ中가가Ǻ\u0085  \x1c\x1f\x00'<|>_-.,ำǅⅠ"
    texts = [" ".join(_words(3_000, odd, seed)) for seed in range(3)]
    ids, starts = packing.WordEncoder(PATH).encode(pa.array(texts))
    whole = Tokenizer.from_file(PATH)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
