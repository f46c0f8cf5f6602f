"""Links between groups larger than a neighbour list."""

import numpy as np

from tremolite.llm import embedding_dedup


def test_groups_beyond_full_lists_link(spark):
    """Two groups larger than a list, nearer inside than to each other: links between them stand in no list of nearest."""
    rng = np.random.default_rng(4)
    a = np.zeros(64)
    a[0] = 1.0
    b = a * 0.965 + np.eye(64)[1] * np.sqrt(1 - 0.965 ** 2)
    x = np.concatenate([g + rng.normal(0, 0.0125, (150, 64)) for g in (a, b)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & ~np.eye(300, dtype=bool)
    inner, cross = (x @ x.T)[:150, :150], near[:150, 150:]
    assert cross.any() and np.sort(inner, 1)[:, -41].min() > (x @ x.T)[:150, 150:].max()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert all(got[i]["_emb_component"] == 0 for i in range(300))
    assert [got[i]["_emb_links"] for i in range(300)] == near.sum(1).tolist()
