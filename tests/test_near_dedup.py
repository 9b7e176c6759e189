import pyarrow as pa

from rankwell.llm import near_dedup as N


def test_tasks_hold_few_texts_of_a_batch_and_lose_none():
    texts = [None if i % 7 == 0 else " ".join(f"w{(i * k) % 53}" for k in range(i % 40)) for i in range(2 * N.SLICE + 3)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "same": [str(i) for i in range(len(texts))], "text": texts})
    out = list(N._sign(5)(iter([batch, batch.slice(0, 0)])))
    assert max(map(len, out)) <= N.SLICE
    whole = pa.Table.from_batches(out).to_pydict()
    assert whole["doc_id"] == list(range(len(texts)))
    one_by_one = pa.Table.from_batches([b for i in range(len(texts)) for b in N._sign(5)(iter([batch.slice(i, 1)]))]).to_pydict()
    assert whole == one_by_one
