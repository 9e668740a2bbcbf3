"""What Python workers hold between stages and batches."""

import gc

import pyarrow as pa

from stacksmith.llm import packing
from stacksmith.llm import text as T


def _tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_encoder_is_let_go_by_text_steps_of_other_stages(spark):
    path = _tokenizer()

    def held():
        return sum(isinstance(o, packing.WordIds) for o in gc.get_objects())

    def encode(batches):
        for batch in batches:
            encoder = packing.encoder(path)
            assert encoder is packing.encoder(path)
            yield pa.record_batch([pa.array([held()] * len(batch), pa.int64())], names=["n"])

    def scan(batches):
        for batch in batches:
            list(T.slices(batch.column(0)))
            yield pa.record_batch([pa.array([held()] * len(batch), pa.int64())], names=["n"])

    texts = spark.range(4, numPartitions=1).selectExpr("cast(id as string) as text")
    assert [r.n for r in texts.mapInArrow(encode, "n long").collect()] == [1] * 4
    for _ in range(4):  # whichever worker gets the task
        assert [r.n for r in texts.mapInArrow(scan, "n long").collect()] == [0] * 4


def test_temporaries_of_a_slice_are_small():
    texts = pa.array(["some words of a text that is not long"] * 40_000)
    rows = 0
    for lo, hi, buf, offs in T.slices(texts):
        assert lo == rows and len(offs) == hi - lo + 1 and len(buf) <= 1 << 18
        rows = hi
    assert rows == len(texts)
