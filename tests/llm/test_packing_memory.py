"""What the packing's encoder holds beside the ids."""

import tracemalloc

import pyarrow as pa
import public_tokenizers

from partlens.llm import packing


def test_ids_are_put_together_without_an_index_per_token():
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = pa.array([("zqxjkvwpbzqfxjhkvwcp" * 3 + " ") * 1000] * 10)
    ids, starts = encoder.encode(texts)
    tracemalloc.start()
    again, _ = encoder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (again == ids).all() and starts[-1] == len(ids) > 100_000
    assert peak < 8 * len(ids)
