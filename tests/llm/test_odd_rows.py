"""Repeated rows, null ids, hot keys and planted passages: what every operator and stage makes of them."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose
from helpers import SF
from pyspark.sql.functions import lit as spark_lit
from test_dedup import bytes_brute, got

import corpus_pipeline
from stumpline.llm import catalog, entropy_mix, exact_dedup, fingerprint_index, jaccard_join, ppm_language, preference_format, pu_quality, sentencepiece_codec, suffix_dedup, telephony_audio

LONG = " ".join(prose(21, 90))
NEAR = " ".join([*prose(21, 88), "other", "end"])
ROWS = [
    (1, LONG, "en", "a"), (1, LONG, "en", "a"), (1, "another text of the same id", "en", "a"), (None, LONG, "en", None), (None, NEAR, None, "a"), (2, NEAR, "en", "b"), (3, None, "fr", "b"), (3, "", None, None),
    (None, None, None, None), (4, "les mots de cette phrase", "fr", "b"), (5, "12 34", "fr", "b"), (6, "x" * 300_000, "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, len(r[1] or ""), "clash") for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, size string")
    return df.repartition(4)


def counted(rows):
    return Counter(map(tuple, rows))


def test_suffixes_of_odd_rows(odd):
    want = bytes_brute([(i, t) for i, t, _, _ in ROWS], 400)
    assert got(suffix_dedup.suffix_dedup(odd), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_passages_longer_and_shorter_than_the_window(spark):
    """Passages of 51 to 60 words: those of 400 bytes or more go, all of them; shorter ones are not op3's, by its window."""
    rng = random.Random(8)
    rows, planted = [], []
    for k in range(40):
        words = [f"p{k}" + "".join(rng.choice("abcdefgh") for _ in range(rng.choice((2, 4, 6)))) for _ in range(51 + k % 10)]
        passage = " ".join(words)
        ids = [len(rows), len(rows) + 1]
        for _ in ids:
            rows.append((len(rows), f"{' '.join(prose(3000 + len(rows), 60))} {passage} {' '.join(prose(6000 + len(rows), 60))}"))
        planted.append((ids, len(passage)))
    out = {r.doc_id: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    long = [(ids, n) for ids, n in planted if n >= 400]
    assert 5 <= len(long) <= 35  # both kinds are there
    for ids, n in planted:
        for i in ids:
            assert out[i].n_removed >= n if n >= 400 else out[i].n_removed in (0, *range(400, n + 12))
    assert {i for i, r in out.items() if r.n_removed} <= {i for ids, n in planted for i in ids if n + 2 >= 400}
    cut = {r.doc_id: r.n_removed for r in fingerprint_index.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(cut[ids[1]] >= 51 and cut[ids[0]] == 0 for ids, _ in planted)  # op5's window of 50 words has them all


def test_near_copies_of_odd_rows(odd):
    rows = counted(jaccard_join.similar_sets(odd).collect())
    n, m = 86, 86
    assert rows == counted([(1, n, 1)] * 2 + [(1, 2, 1), (None, n, 1), (None, m, 1), (2, m, 1), (3, 0, 3), (3, 0, 3), (None, 0, None), (4, 1, 4), (5, 1, 5), (6, 1, 6)])
    kept = counted((r.doc_id, r.text) for r in jaccard_join.keep_one_of_each(odd).collect())
    assert kept == counted([(1, LONG)] * 2 + [(1, ROWS[2][1]), (3, None), (3, ""), (None, None), (4, ROWS[9][1]), (5, "12 34"), (6, ROWS[11][1])])


def test_hot_ids_and_texts(spark):
    """A third of all rows share one id, another third one text: classes are as with ids of their own."""
    rows = [(7, " ".join(prose(k, 30))) for k in range(60)] + [(100 + k, LONG) for k in range(60)] + [(1000 + k, " ".join(prose(500 + k, 30))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    comp = {(r.doc_id, r.component_id) for r in jaccard_join.similar_sets(df).collect()}
    assert comp == {(7, 7), *((100 + k, 100) for k in range(60)), *((1000 + k, 1000 + k) for k in range(60))}
    exact = exact_dedup.exact_dedup(df).collect()
    assert sum(r.kept for r in exact) == 121 and {r.keep_id for r in exact if r.group_size == 60} == {159}


def test_one_model_row_by_row(spark, odd):
    """Language, quality, pieces, audio and mixing treat repeated rows and null ids one by one."""
    model = ppm_language.train(odd, "doc_id", "text", "lang")
    said = ppm_language.identify(odd, model).collect()
    assert len(said) == len(ROWS) and counted((r.doc_id, r.lang_pred == "und") for r in said) == counted((i, not any(c.isalpha() for c in t or "")) for i, t, _, _ in ROWS)
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, 0)], "doc_id long, quality int")
    scores = pu_quality.quality(odd, pu_quality.train(odd, labels)).collect()
    assert Counter(r.doc_id for r in scores) == Counter(i for i, *_ in ROWS) and all(0 <= r.score <= 1 for r in scores)
    ids = sentencepiece_codec.token_digests(odd, sentencepiece_codec.load(spark)).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in ids) == Counter((i, len((t or "").encode())) for i, t, _, _ in ROWS) and all(r.round_trip for r in ids)
    audio = telephony_audio.audio_digests(telephony_audio.encode_audio(telephony_audio.payloads(odd, "doc_id", "text"), ["doc_id", "n_bytes"], "payload", "tag")).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in audio) == Counter((i, len((t or "").encode())) for i, t, _, _ in ROWS)
    mix = entropy_mix.mix_rates(odd).collect()
    assert Counter((r.doc_id, r.size) for r in mix) == Counter((i, len((t or "").encode().split())) for i, t, _, _ in ROWS)


def test_stages_on_odd_rows(spark, odd):
    """Every stage keeps its columns and drops only what its decision drops."""
    stages = dict(corpus_pipeline.STAGES)
    row = lambda r: (r.doc_id, r.text)
    named = counted(map(row, stages["language ID"](spark, odd, "").collect()))
    assert named == counted((i, t) for i, t, _, _ in ROWS if any(c.isalpha() for c in t or ""))
    unique = counted(map(row, stages["exact dedup"](spark, odd, "").collect()))
    assert set(unique.values()) == {1} and {t or "" for _, t in unique} == {t or "" for _, t, _, _ in ROWS} and len(unique) == len({t or "" for _, t, _, _ in ROWS})
    for name in ("n-gram Jaccard join", "mixing sources"):
        out = stages[name](spark, odd, "")
        assert out.columns == odd.columns and {row(r) for r in out.collect()} <= {(i, t) for i, t, _, _ in ROWS}
    for name, stage in stages.items():
        assert stage(spark, odd.limit(0), "").count() == 0, name


def test_gradient_is_that_of_the_risk():
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (60, 4)), rng.normal(0, 1, (90, 4))
    for prior in (0.3, 0.95):  # of the second the negatives' risk is below zero
        model = pu_quality.PUModel(p.astype(np.float32), u[:0].astype(np.float32), prior)
        model.weights[2] = rng.normal(0, 1, 16)
        model.weights[3] = np.array(0.0)
        if prior > 0.5:
            model.weights[0], model.weights[2] = rng.normal(0.5, 0.1, (4, 16)), rng.normal(0.3, 0.02, 16)

        def risk():
            g = lambda x: np.tanh(x @ model.weights[0] + model.weights[1]) @ model.weights[2] + model.weights[3]
            loss = lambda z: np.log1p(np.exp(-z)).mean()
            negative = loss(-g(u)) - prior * loss(-g(p))
            return (prior * loss(g(p)) + negative if negative >= 0 else -negative), negative

        assert (risk()[1] < 0) == (prior > 0.5)
        for w, g in zip(model.weights, model.gradient(p, u), strict=True):
            flat = w.reshape(-1)
            for i in range(0, flat.size, max(1, flat.size // 5)):
                was, step = flat[i], 1e-6
                flat[i] = was + step
                up = risk()[0]
                flat[i] = was - step
                down = risk()[0]
                flat[i] = was
                assert abs((up - down) / (2 * step) - np.reshape(g, -1)[i]) < 1e-4


def test_prior_without_negatives():
    rng = np.random.default_rng(4)
    for share in (0.2, 0.6, 0.9):
        p = rng.normal(2, 1, (3000, 5)).astype(np.float32)
        u = np.concatenate((rng.normal(2, 1, (int(6000 * share), 5)), rng.normal(-2, 1, (6000 - int(6000 * share), 5)))).astype(np.float32)
        assert abs(pu_quality.estimated_prior(p, u) - share) < 0.05


def test_features_are_those_of_plain_python():
    texts = ["Hello, hello WORLD! 123\nnew line | x", "a a a a", "tail."]
    names = list(pu_quality.CLASSES)
    for t, row in zip(texts, pu_quality.features(pa.array(texts)), strict=True):
        raw, words, lines = t.encode(), t.encode().split(), t.encode().split(b"\n")
        share = {n: sum(b in set(pu_quality.CLASSES[n]) for b in raw) / len(raw) for n in ("upper", "digit", "bar", "bang")}
        for n, v in share.items():
            assert abs(row[names.index(n)] - v) < 1e-6
        low = [w.lower() for w in words]
        rest = row[len(names) :]
        want = [np.log1p(len(raw)), np.log1p(len(words)), np.mean([len(w) for w in words]), np.std([len(w) for w in words]), sum(a == b for a, b in zip(low, low[1:], strict=False)) / len(words)]
        assert np.allclose(rest[:5], want, atol=1e-5)
        assert abs(rest[10] - len(set(low)) / len(words)) < 1e-6 and abs(rest[11] - Counter(low).most_common(1)[0][1] / len(words)) < 1e-6 and abs(rest[12] - np.log1p(len(lines))) < 1e-6


def test_audio_query_recomputed(spark):
    """media, PCM and features of the query by a plain reading of the formats."""
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = Counter()
    for r in catalog.queries()["op8_telephony_audio"](spark, SF).limit(60).collect():
        text = docs[r.doc_id]
        payload = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
        tag = (7, 6, 0x11)[zlib.crc32(payload) % 3]
        file = telephony_audio.wave(tag, 8000, payload)
        assert file.endswith(payload) and (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        if tag == 0x11:
            pcm = telephony_audio.decode_adpcm(np.frombuffer(payload, np.uint8).reshape(-1, 64)).reshape(-1).astype(float)
        else:
            pcm = (telephony_audio.MULAW_PCM if tag == 7 else telephony_audio.ALAW_PCM)[np.frombuffer(payload, np.uint8)].astype(float)
        out = np.empty(2 * len(pcm), "<i2")
        out[::2], out[1::2] = pcm, np.rint((pcm + np.append(pcm[1:], pcm[-1])) / 2)
        wide = out.astype(np.int64)
        assert (r.pcm_bytes, r.pcm_sha256) == (out.nbytes, hashlib.sha256(out.tobytes()).hexdigest())
        zero = int(((wide[1:] < 0) != (wide[:-1] < 0)).sum())
        assert r.feature == f"{telephony_audio.NAMES[tag]};8000>16000;n={len(out)};peak={np.abs(wide).max()};rms={np.sqrt((wide**2).mean()):.3f};zc={zero}"
        seen[tag] += 1
    assert len(seen) == 3


def test_pairs_too_large_stay_in_turns(spark):
    rows = [(0, 0, "user", "q"), (1, 0, "user", "q"), (0, 1, "assistant", "y" * 500), (1, 1, "assistant", "n"), (2, 0, "user", "s"), (3, 0, "user", "s")]
    parts = preference_format.preference_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    pairs = {r.pair_id: r for r in preference_format.assembled(parts, max_chars=200).collect()}
    assert pairs[0].prompt is None and pairs[0].chosen_mask is None and pairs[0].n_turns == 3 and pairs[1].prompt and pairs[1].chosen == ""


CLASHES = [
    "__key", "__copies", "__copy", "__kept", "__tid", "__at", "__row", "__file", "__index", "_metadata", "__metadata", "__ID", "file_at", "row_at", "k", "a", "b", "comp", "size", "copies", "tid", "sig", "token", "first", "keep", "digest",
    "lang_pred", "score", "rate", "target", "group_size", "kept", "with.dot", "with`tick",
]


def test_stages_with_clashing_names(spark, odd, tmp_path):
    """A column for every internal name: each stage returns all of them as they were."""
    df = odd.drop("size").select("*", *(spark_lit(f"{n}!").alias(n) for n in CLASHES))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for docs in (df, spark.read.parquet(str(tmp_path / "documents.parquet"))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            rows = out.collect()
            assert rows, name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
                assert all(tuple(r)[5:] == tuple(f"{n}!" for n in CLASHES) for r in rows), name
