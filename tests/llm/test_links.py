"""Embedding links: slices meet once and a vector is sent once for each slice."""

import numpy as np

from ledgerloom.llm import embeddedup


def test_slices_lose_no_link_and_send_a_vector_once_for_each(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 48))
    x = np.float32(centres[rng.integers(0, 40, 400)] + rng.normal(size=(400, 48)) * rng.uniform(0.2, 0.45, size=(400, 1)))
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    assert 400 < linked.sum() < 400 * 40
    monkeypatch.setattr(embeddedup, "TASK", 100)
    got = {r.vec_id: r.n_links for r in embeddedup.vector_links(table).collect()}
    assert got == {i: int(linked[i].sum()) - 1 for i in range(400)}
    sent, joined = spark.sparkContext.accumulator(0), embeddedup._joined
    monkeypatch.setattr(embeddedup, "_joined", lambda frame, cosine: (sent.add(len(frame)), joined(frame, cosine))[1])
    embeddedup.vector_links(table).count()
    assert sent.value == 400 * 4
