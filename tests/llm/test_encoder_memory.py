"""The encoder's working memory does not follow the size of an Arrow batch."""

import tracemalloc

import public_tokenizers

from codestrata.llm.bpe import ByteLevelEncoder


def test_a_batch_is_encoded_in_shares():
    encoder = ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = [f"w{i}x" for i in range(500)]
    texts = [" ".join(words[(i * 7 + j) % 500] for j in range(300)) for i in range(2000)] + ["", "one"]
    want = [e for t in texts[::97] for e in encoder._ids([t])]
    encoder.encode(texts[:2])
    tracemalloc.start()
    got = encoder.encode(texts)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert got[::97] == want and got[-2:] == [b"", encoder._ids(["one"])[0]]
    assert peak - held < 20 << 20
