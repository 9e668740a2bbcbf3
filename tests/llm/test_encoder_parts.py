"""Parts that the encoder's table does not hold: few go through the whole tokenizer, and frequent ones stay known."""

import numpy as np
import public_tokenizers

from stacksmith.llm import packing


def _encoder() -> packing.WordIds:
    return packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))


def _ids(encode: packing.WordIds, text: str) -> list[int]:
    data = text.encode()
    return encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist()


def test_mixed_parts_are_encoded_as_words():
    rng = np.random.default_rng(1)
    signs = list("abzAZ09.,!$%&'()*+-/:;<=>?@[]^_`{|}~\"#\\éÉßÿÞ×÷µªº²­\tĀı…") + ["<|endoftext|>", "'ll", "<|", "|>", "é"]
    parts = ["".join(rng.choice(signs, rng.integers(1, 9))) for _ in range(3000)] + ["foo###", "1.2.3.4", "(Über)", "a-b_c=7"]
    encode = _encoder()
    whole, slow = encode._encode, []
    encode._encode = lambda some: slow.extend(some) or whole(some)
    ids, begin, size = encode._encode_parts([p.encode() for p in parts])
    want = [e.ids for e in encode.tokenizer.encode_batch(parts, add_special_tokens=False)]
    assert [ids[b:b + n].tolist() for b, n in zip(begin, size)] == want
    assert not {"foo###", "1.2.3.4", "(Über)", "a-b_c=7"} & set(slow)


def test_parts_of_one_slot_do_not_push_each_other_out(monkeypatch):
    monkeypatch.setattr(packing, "SLOTS", 2)
    encode = _encoder()
    frequent = _ids(encode, "the")
    calls, parts = [], encode._encode_parts
    encode._encode_parts = lambda some: calls.append(some) or parts(some)
    for word in ("fox", "bird", "stone"):
        assert _ids(encode, f"the {word}") == frequent + encode.tokenizer.encode(word, add_special_tokens=False).ids
    assert calls == [[b"fox"], [b"bird"], [b"stone"]]
