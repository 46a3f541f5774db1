"""op1 writes shards of token ids, not of text."""

import numpy as np

from crossweave.llm import bpe, queries, token_output

FOLDER = "/root/testdata/sf0.001"


def test_op1_shards_hold_the_ids(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    layout = token_output.id_layout(path)
    assert layout.width == 2
    manifest = queries.op1_token_shards(spark, FOLDER).collect()
    folder = "file://" + manifest[0].path.rsplit("/", 1)[0]
    records = list(token_output.read_slots(folder, 0, sum(r.n_rows for r in manifest), layout))
    order = token_output.Permutation(len(records), layout.key)
    stream = np.frombuffer(b"".join(records[s] for s in order.slots(np.arange(len(records)))), "<u2")
    texts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    end = int.from_bytes(layout.end, "little")
    want = np.concatenate([[*np.frombuffer(x, "<u4"), end] for x in bpe.Encoder(path).encode([(t or "").encode() for t in texts])])
    assert {len(x) for x in records} == {2048 * 2}
    assert (stream[: len(want)] == want).all() and set(stream[len(want) :].tolist()) <= {end}
