"""The registered approximate search finds nine in ten of the exact neighbours, with less than all pairs compared."""

import numpy as np

from evispark import catalog
from evispark.catalog.search_queries import ANN, vectors
from evispark.operators import search as S

SF = "/root/testdata/sf0.01"


def test_registered_search_reaches_its_recall(spark):
    catalog.load()
    found = catalog.QUERIES["ann_bucketed"](spark, SF)
    r = S.recall_against(found, S.top_k(*vectors(spark, SF), k=5)).first()
    assert r["found_hits"] >= 0.9 * r["exact_hits"] > 0


def test_fewer_pairs_than_all(spark):
    e = np.array([r[0] for r in vectors(spark, SF)[0].select("embedding").collect()], float)
    planes = np.random.default_rng(7).standard_normal((e.shape[1], ANN["bands"] * ANN["bits"]))
    sig = ((e @ planes) > 0).reshape(len(e), ANN["bands"], ANN["bits"]) @ (1 << np.arange(ANN["bits"]))
    assert sum((np.unique(band, return_counts=True)[1] ** 2).sum() for band in sig.T) < len(e) ** 2
