import numpy as np
import pyarrow as pa

from spanloom.llm import quality_classifier as q


def test_statistics_are_counted_half_a_megabyte_at_a_time(monkeypatch):
    texts = [f"some Words {i} of a line!\n" * (i % 40 * 10) for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(texts))), pa.array(texts)], names=["label", "text"])
    assert batch.column(1).nbytes > 1 << 20
    whole, sizes, counted = q.statistics(batch.column(1)), [], q.statistics
    monkeypatch.setattr(q, "statistics", lambda c: (sizes.append(sum(len(x.as_py()) for x in c)), counted(c))[1])
    got = pa.Table.from_batches(q._measured(iter([batch]))).to_pandas()[q.NAMES].to_numpy()
    assert max(sizes) <= 1 << 19 and np.array_equal(got, whole)
