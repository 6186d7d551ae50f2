"""Windows of words kept as stretches."""

import numpy as np
import pyarrow as pa

from sevfold.llm import suffixes, textkernel as K


def test_windows_are_kept_as_stretches_of_places():
    class Shared:
        value = np.full(suffixes.BITMAP // 64, np.iinfo(np.uint64).max, dtype=np.uint64)

    words = " ".join(f"w{i}" for i in range(30))
    batch = pa.RecordBatch.from_pydict({"doc_id": [7, 8, 9], "text": [words, "short", words]})
    rows = [r for b in suffixes._windows(Shared, 12)(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["pos"], len(r["hashes"])) for r in rows] == [(7, 0, 19), (9, 0, 19)] and rows[0]["hashes"] == rows[1]["hashes"]
    piece = next(K.pieces(batch.column("text")))
    hashes = K.window_hashes(K.words(piece, K.ALNUM).hashes, 12)[:19].view(np.int64)
    assert rows[0]["hashes"] == hashes.tolist()
