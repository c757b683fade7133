"""Language models of very many languages and very long texts keep their bounds."""

import random
import resource

import numpy as np
from conftest import prose

from stumpline.llm import ppm_language


def test_sixty_four_languages_keep_the_bounds(spark):
    """64 languages with alphabets of their own: the table and the sample stay below their bounds, and texts are told apart."""
    rng = random.Random(1)
    rows = []
    for k in range(64):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz\u00e9\u00e8\u00f6\u00fc\u00df\u00f1\u00e5", 9)
        words = ["".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(60)]
        rows += [(k * 100 + i, " ".join(rng.choices(words, k=120)), f"l{k:02d}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    model = ppm_language.train(df.filter("doc_id % 100 < 20"), "doc_id", "text", "lang")
    assert len(model.names) == 64 and model.cost.nbytes <= ppm_language.TABLE * 1.1
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 1000  # MB of the driver's Python
    out = ppm_language.identify(df.filter("doc_id % 100 >= 20"), model).join(df, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.95


def test_only_long_texts_are_there(spark):
    """Texts above an eighth of the sample's bytes are trained on by their beginning."""
    rows = [(k, " ".join(prose(k, 4000, 50) if k % 2 else [w[::-1] + "q" for w in prose(k, 4000, 50)]), "ab"[k % 2]) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ppm_language.train(df, "doc_id", "text", "lang", max_bytes=40_000)
    assert model.names == ["a", "b"]
    assert all(r.lang_pred == "ab"[r.doc_id % 2] for r in ppm_language.identify(df, model).collect())
