"""What a worker holds while trees are cut and read."""

import tracemalloc

import pyarrow as pa
import pytest

from factloom.operators import chunks
from factloom.types import CorruptionError


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_hashes_are_taken_of_few_keys_at_a_time():
    keys = [b"%090d" % i for i in range(100_000)]
    assert peak(lambda: chunks.boundary_keys(keys)) < 60  # MB; all at once took 400
    assert (chunks.gear_hashes(keys[:9000]) == [chunks.gear_hashes([k])[0] for k in keys[:9000]]).all()


def test_partitions_are_cut_as_streams():
    """A long partition gives the chunks that it gives in one piece, and what is sent at a time doesn't grow with it."""
    rows = [(i // 90_000, b"%07d" % i) for i in range(100_000)]
    batches = [pa.RecordBatch.from_arrays([pa.array([p for p, _ in x], pa.int32()), pa.array([k for _, k in x]), pa.array([k for _, k in x])], ["_part", "key", "value"]) for x in (rows[i : i + 7000] for i in range(0, len(rows), 7000))]
    left, many = chunks.passages(chunks.boundary_keys([k for p, k in rows if p == 0]))
    cutter = chunks._Cutter(0, chunks.WIDTH, {0: 0, 1: int(left[0])}, {0: 0, 1: int(many[0])}, False)
    sent = list(cutter.pieces(iter(batches)))
    assert len(sent) > 9 and max(len(b.column("entries").flatten()) for b in sent) < chunks.SENT_ENTRIES + 2 * chunks.MAX_ENTRIES
    pieces: dict[int, list[bytes]] = {}
    for b in sent:
        for number, whole, addr, entries in zip(b.column("chunk").to_pylist(), b.column("whole").to_pylist(), b.column("addr").to_pylist(), chunks._entry_lists(b.column("entries"))):
            assert addr == (chunks.chunk_address(chunks.encode_chunk(0, entries)) if whole else None)
            pieces.setdefault(number, []).extend(k for k, _ in entries)
    ends = [x + 1 for x in chunks._cuts(chunks.boundary_keys([k for _, k in rows]), 0)]
    assert [pieces[i] for i in sorted(pieces)] == [[k for _, k in rows[a:b]] for a, b in zip([0, *ends], [*ends, len(rows)]) if a < b]


class Rows:
    """Stands for the frames of a chunk table and keeps the function given to mapInArrow."""

    columns, schema = ["level", "first", "addr", "entries"], ""

    def join(self, *_):
        return self

    select = join
    distinct = join

    def mapInArrow(self, function, _):
        self.function = function
        return self


def test_chunks_are_checked_one_at_a_time():
    keys = [b"%060d" % i for i in range(256)]
    column = chunks._entry_column(keys * 800, keys * 800, [256] * 800)
    addr = chunks.chunk_address(chunks.encode_chunk(0, list(zip(keys, keys))))

    def read(addrs):
        batch = pa.RecordBatch.from_arrays([pa.array([0] * 800, pa.int32()), pa.array([keys[0]] * 800), pa.array(addrs), column], Rows.columns)
        return list(chunks.ChunkTable(None, Rows()).get(Rows()).function(iter([batch])))

    assert peak(lambda: read([addr] * 800)) < 10  # MB; the batch as rows takes over 100
    with pytest.raises(CorruptionError):
        read([addr] * 799 + [bytes(32)])
