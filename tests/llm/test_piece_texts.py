"""Packed ids of many texts are put back at once; words of letters need no pattern."""

import public_tokenizers
import sentencepiece

from partlens.llm import sentencepieces

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_texts_are_put_back_together_at_once():
    table = sentencepieces.Table.load(PIECES)
    fold = sentencepieces.local_fold(table)
    texts = ["a word, then  more", "", "漢字 ß\x01 é", "x" * 300, "", "tail "]
    packed = [b"".join(map(fold, table.words(t))) for t in texts]
    back = sentencepieces.decoded(table)
    assert back(packed) == texts
    assert back([]) == [] and back([b"", b""]) == ["", ""]


def test_words_of_letters_are_not_split(monkeypatch):
    table = sentencepieces.Table.load(PIECES)
    words = ["word", "Straße", "漢字", "é"]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = {i: p for p, i, _ in table.pieces}
    monkeypatch.setattr(sentencepieces.re, "split", None)
    assert [table.words(w) for w in words] == [["▁" + w] for w in words]
    assert all("".join(pieces.get(i, "") for i in model.encode(w)).startswith("▁") for w in words)
