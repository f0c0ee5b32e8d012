"""Memory of the Python workers: tables and texts are worked on in small slices."""

import tracemalloc

import numpy as np
import pyarrow as pa

from loglattice.llm import piece_codec, simhash_golay


def test_index_table_is_filled_in_slices():
    tracemalloc.start()
    table = simhash_golay.index_table()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert table.shape == (1 << 22,) and table.dtype == np.int16
    assert peak < table.nbytes + 8_000_000


def test_encoder_holds_few_texts_at_a_time():
    texts = [f"word{i % 50} " + "plain text é " * 150 for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array([None if i == 7 else str(i) for i in range(4000)]), pa.array(texts)], names=["id", "text"])
    encode = piece_codec.encoder(piece_codec.MODEL, True)
    first = next(encode(iter([batch.slice(0, 9)])))
    assert first.column("id").to_pylist()[7] is None and first.column("decoded").to_pylist() == texts[:9]
    assert [len(i) for i in first.column("ids").to_pylist()] == first.column("n_tokens").to_pylist()
    tracemalloc.start()
    rows = sum(part.num_rows for part in encode(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4000 and peak < batch.nbytes / 2
