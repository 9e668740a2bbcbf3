"""Pieces of one id and equal pieces, a third of all rows and more."""

import collections

from stacksmith.llm import packing


def test_equal_pieces_and_one_id_fill_sequences_once(spark):
    rows = [(7, 0, 0, 100, 5)] * 9000 + [(7, 0, 0, 100, i) for i in range(500)] + [(None, 0, 0, 100, None)] * 3 + [(i, 0, 0, 1 + i % 300, i) for i in range(2000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(7)
    got = packing.pack(pieces, 2048).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == collections.Counter(rows)
    ends = collections.defaultdict(list)
    for r in got:
        ends[r.sequence_id].append((r.offset, r.length))
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    plan = packing.plan_lengths(dict(collections.Counter(r[3] for r in rows)), 2048)
    assert len(ends) == sum(times for _, times in plan)
    again = packing.pack(pieces.repartition(3), 2048).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))
