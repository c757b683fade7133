"""Language ID, quality, SentencePiece, audio, preference formatting, mixing, and the pipeline."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, rows_of, rows_of_sql
from pyspark.sql import functions as F

from stumpline.llm import catalog, entropy_mix, ppm_language, preference_format, pu_quality, sentencepiece_codec, telephony_audio


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    assert rows_of(catalog.queries()[name](spark, SF)) == rows_of_sql(duck, catalog.oracle_sql()[name])


# -- language --------------------------------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalog.queries()["op2_ppm_language"](spark, sf).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) > 0.97 * len(held)


def test_language_code_lengths_are_ppm():
    """The tables give what counting contexts by hand gives."""
    texts = {"x": [b"abracadabra abracadabra"] * 4, "y": [b"zyzzyva zyzzyva"] * 4}
    model = ppm_language.PPMModel(texts)
    ctx = {}
    for t in texts["x"]:
        s = b"\0" * 4 + t
        for i in range(4, len(s)):
            for k in range(5):
                ctx.setdefault(s[i - k : i], Counter())[s[i]] += 1

    def p(before, symbol):
        total = 0.0 if before else None
        seen = ctx.get(before, Counter())
        n, d = sum(seen.values()), len(seen)
        if seen[symbol]:
            return seen[symbol] / (n + d)
        lower = p(before[1:], symbol) if total is not None else 1 / model.width
        return d / (n + d) * lower if n else lower

    word = b"abracad"
    s = b"\0" * 4 + word
    want = -sum(np.log2(p(s[i - 4 : i], s[i])) for i in range(4, len(s)))
    data = np.frombuffer(word, np.uint8)
    assert abs(model.bits(data, np.array([0, len(word)]))[0, 0] - want) < 1e-3


def ppm_plain(model, texts, word):
    """Bits of `word` by counting in plain Python: a context that the model does not keep counts as its longest kept suffix."""
    kind = model.kind
    number = lambda c: sum(int(x) * model.width**i for i, x in enumerate(reversed(c)))
    kept = [set(k.tolist()) for k in model.kept]
    coded = lambda t: [0] * 4 + [int(kind[b]) for b in t]
    seen = {}
    for t in texts:
        s = coded(t)
        for i in range(4, len(s)):
            for k in range(5):
                seen.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1

    def p(context, symbol):
        while number(context) not in kept[len(context)]:
            context = context[1:]
        here = seen.get(context, Counter())
        n, d = sum(here.values()), len(here)
        if here[symbol]:
            return here[symbol] / (n + d)
        below = p(context[1:], symbol) if context else 1 / model.width
        return d / (n + d) * below if n else below

    s = coded(word)
    return -sum(np.log2(p(tuple(s[i - 4 : i]), s[i])) for i in range(4, len(s)))


@pytest.mark.parametrize(("pairs", "nodes"), [(30, 150), (300, 1200), (2000, 40_000)])  # pruned hard, pruned, whole
def test_language_code_lengths_on_real_texts(spark, pairs, nodes):
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text and r.lang]
    texts = {}
    for r in rows[:80]:
        texts.setdefault(r.lang, []).append(r.text.encode()[:1500])
    model = ppm_language.PPMModel(texts, pairs, nodes)
    words = [r.text.encode()[:300] for r in rows[80:90]] + ["Ünïcödé ☃ 123".encode()]
    data, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
    got = model.bits(data, at)
    for i, w in enumerate(words):
        for j, n in enumerate(model.names):
            assert abs(got[i, j] - ppm_plain(model, texts[n], w)) < 1e-3 * max(1, got[i, j])


def test_small_languages_keep_their_contexts():
    rng = np.random.default_rng(2)
    large = [bytes(rng.choice(list(b"abcdefgh "), 20_000).tolist()) for _ in range(5)]
    model = ppm_language.PPMModel({"large": large, "small": [b"xyzzy zyx " * 40]}, pairs=20, nodes=60)
    assert model.predict(pa.array(["xyzzy xyzzy zyx", "abba hegde"]))[0] == ["small", "large"]
    assert len(set(model.kept[2].tolist()) & {int(model.kind[a]) * model.width + int(model.kind[b]) for a, b in (b"xy", b"yz", b"zz", b"zy")}) == 4


def test_language_sample_is_bounded(spark, docs):
    df = spark.createDataFrame([(i, "word " * (10 if i else 10_000), "en") for i in range(50)], "doc_id long, text string, lang string")
    taken = []
    kept, ppm_language.PPMModel = ppm_language.PPMModel, lambda texts: taken.append(texts)
    try:
        ppm_language.train(df, "doc_id", "text", "lang", max_bytes=2000)
    finally:
        ppm_language.PPMModel = kept
    assert 0 < sum(map(len, taken[0]["en"])) < 2600


def test_language_odd_rows(docs, empty, corpus):
    model = ppm_language.train(docs, "doc_id", "text", "lang")
    rows = {r.doc_id: r for r in ppm_language.identify(docs, model).collect()}
    for i, t in corpus:
        assert (rows[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert {r.lang_pred for r in ppm_language.identify(docs, ppm_language.train(empty, "doc_id", "text", "lang")).collect()} == {"und"}
    kept = ppm_language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for _, t in corpus)
    assert ppm_language.keep_identified(empty).count() == 0


# -- quality ---------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = catalog.queries()["op7_pu_quality"](spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(truth[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for t, s in held if t == 1], [s for t, s in held if t == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_quality_on_few_rows_and_without_marks(spark):
    """At sf0.01 bad rows fall below the threshold, and many of them by their wording alone."""
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in catalog.queries()["op7_pu_quality"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    told = lambda label: [r.predicted for r in rows if truth[r.doc_id] == label]
    assert np.mean(told(0)) < 0.1 and np.mean(told(1)) > 0.95
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = pu_quality.train(docs.filter(learn), labels.filter(learn))
    bare = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\s.,]", "").alias("text")
    some = docs.join(labels, "doc_id").select("doc_id", "quality", bare)
    below = {r.quality: r.share for r in pu_quality.quality(some, model).join(labels, "doc_id").groupBy("quality").agg(F.avg((F.col("score") < 0.3).cast("int")).alias("share")).collect()}
    assert below[0] > 0.5 and below[1] < 0.05


def test_wording_knows_letters_only():
    plain, loud = pu_quality.wording(pa.array(["The end of it\nall", "", None, "ab"])), pu_quality.wording(pa.array(["THE!! END, of*** (it)\nall", "?!", "1", "AB"]))
    assert (plain == loud).all() and (plain[1] == 0).all() and np.allclose((plain[0] ** 2).sum(), 2)
    words, threes = (plain[0][i * pu_quality.BUCKETS :][: pu_quality.BUCKETS] ** 2 for i in (0, 1))
    assert abs(words.max() * 5 - round(words.max() * 5)) < 1e-5 and abs(threes.min()) == 0 and plain[3][pu_quality.BUCKETS :].sum() == 0


def test_quality_odd_rows(spark, docs, empty, corpus):
    labels = spark.createDataFrame([(20, 1), (20, 0), (21, 1), (22, None)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        rows = pu_quality.quality(docs, pu_quality.train(docs, some)).collect()
        assert len(rows) == len(corpus) and all(0 <= r.score <= 1 for r in rows)
    assert pu_quality.quality(empty, pu_quality.train(empty, labels)).count() == 0
    x = pu_quality.features(pa.array([None, "", "a b\na b", "A!! B!!"]))
    assert np.isfinite(x).all() and (x[0] == x[1]).all()


def test_risk_stays_non_negative():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(2, 1, (400, 3)).astype(np.float32), rng.normal(-2, 1, (400, 3)).astype(np.float32)
    model = pu_quality.PUModel(pos, np.concatenate((pos[:200], neg[:200])), 0.5, steps=600, batch=256)
    assert model.score(pos).mean() > 0.9 and model.score(neg).mean() < 0.1


# -- SentencePiece ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    return sentencepiece_codec.load(spark)


def test_pieces_are_the_library_s(spark, docs, corpus, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    encoded = sentencepiece_codec.encode(docs, model)
    for r in encoded.collect():
        assert r.ids == library.encode(dict(corpus)[r.doc_id] or "")
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(encoded, model).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in corpus)
    for r in sentencepiece_codec.token_digests(docs, model).collect():
        ids = library.encode(dict(corpus)[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
        assert r.round_trip == ("▁" not in (dict(corpus)[r.doc_id] or ""))


def test_random_pieces(model):
    import random

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    rng = random.Random(5)
    vocabulary = [t.decode() for t in model.text if t and t.isascii()] + ["é", "ß", "☃", "\U0001f389"]
    texts = ["".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9))) for _ in range(2000)]
    ids, at = model.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library.encode(texts)


def test_no_rows(empty, model):
    assert sentencepiece_codec.encode(empty, model).count() == 0 == sentencepiece_codec.token_digests(empty, model).count()


# -- audio -----------------------------------------------------------------------------------------------------------


def test_tables_and_adpcm_by_the_sample():
    assert (telephony_audio.MULAW_PCM[0xFF], telephony_audio.MULAW_PCM[0x80], telephony_audio.MULAW_PCM[0x00]) == (0, 32124, -32124)
    assert (telephony_audio.ALAW_PCM[0xD5], telephony_audio.ALAW_PCM[0x55], telephony_audio.ALAW_PCM[0xAA]) == (8, -8, 32256)
    blocks = np.random.default_rng(1).integers(0, 256, (5, 64)).astype(np.uint8)
    blocks[:, 2] %= 100
    got = telephony_audio.decode_adpcm(blocks)
    for b, row in zip(blocks.tolist(), got.tolist(), strict=True):
        value = int.from_bytes(bytes(b[:2]), "little", signed=True)
        index, want = min(b[2], 88), [value]
        for byte in b[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(telephony_audio.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                want.append(value)
        assert row == want


@pytest.mark.parametrize("tag", [telephony_audio.MULAW, telephony_audio.ALAW, telephony_audio.ADPCM])
def test_files_keep_their_payload(docs, empty, tag):
    media = telephony_audio.encode_audio(docs, "doc_id", "text", tag)
    pcm = {r.doc_id: r for r in telephony_audio.decode_audio(media, "doc_id", "media").collect()}
    for r in media.collect():
        file = np.frombuffer(r.media, np.uint8)
        found, rate, a, b = telephony_audio.parse_wave(file)
        assert (found, rate) == (tag, 8000)
        samples = (b - a) // 64 * 121 if tag == telephony_audio.ADPCM else b - a
        assert len(pcm[r.doc_id].pcm) == 4 * samples and pcm[r.doc_id].rate == 16000
    assert telephony_audio.decode_audio(telephony_audio.encode_audio(empty, "doc_id", "text", tag), "doc_id", "media").count() == 0


def test_audio_query_on_whole_texts(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = {}
    for r in catalog.queries()["op8_telephony_audio"](spark, SF).collect():
        text = docs[r.doc_id]
        payload = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert seen.setdefault(text, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


# -- preferences -----------------------------------------------------------------------------------------------------


def test_preferences(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "alone"), (4, 0, "user", "q"), (4, 1, None, None), (5, 0, "user", "q"), (5, 1, None, None),
        (None, 0, "user", "lost"), (6, None, "user", "n"), (7, None, "user", "n"), (6, 3, "a", "x"), (6, 3, "a", "x"), (7, 3, "a", "x"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, split string")
    parts = preference_format.preference_turns(df)
    pairs = {r.pair_id: r for r in preference_format.assembled(parts).collect()}
    assert pairs[0].prompt == "<|user|>\nhi<|end|>\n" and pairs[0].chosen.startswith("<|assistant|>\nyes") and pairs[0].rejected == "<|assistant|>\nno<|end|>\n"
    assert [(m.length, m.loss) for m in pairs[0].chosen_mask] == [(len("<|assistant|>\nyes<|end|>\n"), 1), (len("<|user|>\nmore<|end|>\n"), 0)]
    assert pairs[1].prompt == "" and pairs[1].chosen == "<|user|>\nalone<|end|>\n" and pairs[1].rejected == ""
    assert pairs[2].chosen == pairs[2].rejected == "" and pairs[2].prompt.count("<|end|>") == 2
    assert pairs[None].chosen == "<|user|>\nlost<|end|>\n" and pairs[3].prompt.count("<|end|>") == 2 and pairs[3].chosen.count("<|end|>") == 1
    assert preference_format.preference_turns(df.limit(0)).count() == 0


# -- mixing ----------------------------------------------------------------------------------------------------------


def check_mix(rows, share=1.5, limit=2.0):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    target, left, free = {}, share * sum(sizes.values()), dict(zip(names, [entropy_mix.WEIGHTS[i % 3] for i in range(len(names))], strict=True))
    while free:
        over = [s for s in free if left * free[s] / sum(free.values()) > limit * sizes[s]]
        for s in over or list(free):
            target[s] = limit * sizes[s] if over else left * free[s] / sum(free.values())
        if not over:
            break
        for s in over:
            left -= target[s]
            del free[s]
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) <= 1e-6 * max(1, target[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s] + 1


def test_mix(spark, docs, empty):
    rows = entropy_mix.mix_rates(docs).collect()
    check_mix(rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, entropy_mix.mix_rates(docs.repartition(3)).collect()), key=repr)
    copies = {r.doc_id: r.copies for r in rows}
    assert Counter(r.doc_id for r in entropy_mix.mix(docs).collect()) == {k: v for k, v in copies.items() if v}
    assert entropy_mix.mix_rates(empty).count() == 0 == entropy_mix.mix(empty).count()
    check_mix(entropy_mix.mix_rates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect())


def test_mix_of_one_size_and_repeated_rows(spark):
    """Very many rows of one size are salted; repeated and null keys are rounded one by one."""
    rows = [(i % 97 if i % 5 else None, "a b c" if i % 3 else None, "s") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for cell_rows in (7, 50_000):
        sized = df.selectExpr("doc_id", "source", "if(text is null, 0L, 3L) as size", "1.5D as rate")
        out = entropy_mix.rounded(sized, "source", "size", "rate", "doc_id", cell_rows).collect()
        assert len(out) == 600 and abs(sum(r.copies * r.size for r in out) - 1.5 * sum(r.size for r in out)) <= 3 and {r.copies for r in out} == {1, 2}
    check_mix(entropy_mix.mix_rates(df).collect())


def test_targets_that_contradict(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("b", "x", 40)], "s string, l string, t long")
    with pytest.raises(ValueError, match="no balance"):
        entropy_mix.balance(cells, ["s", "l"], "t", {"s": {"a": 60.0, "b": 40.0}, "l": {"x": 45.0}}, iterations=5)


def test_overlapping_constraints(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 40), ("b", "y", 20)], "s string, l string, t long")
    lam = entropy_mix.balance(cells, ["s", "l"], "t", {"s": {"a": 60.0, "b": 40.0}, "l": {"x": 45.0, "y": 55.0}})
    rate = lambda s, l: np.exp(lam["s"][s] + lam["l"][l])
    assert abs(10 * rate("a", "x") + 30 * rate("a", "y") - 60) < 1e-5 and abs(10 * rate("a", "x") + 40 * rate("b", "x") - 45) < 1e-5


# -- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark, docs, corpus, tmp_path):
    import sentencepiece
    from test_dedup import sets_brute

    import corpus_pipeline

    path = str(tmp_path / "documents.parquet")
    docs.drop("digest").withColumnRenamed("n", "n_chars").write.parquet(path)
    rows = Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    lettered = [(i, t) for i, t in corpus if any(c.isalpha() for c in t or "")]
    last = {t: i for i, t in lettered}
    unique = [(i, t) for i, t in lettered if last[t] == i]
    one = {i for i, _, c in sets_brute(unique) if i == c}
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    want = {(i, len(library.encode(t))) for i, t in unique if i in one}
    assert set(rows) <= want and set(rows.values()) <= {1, 2}
    left = docs.filter(docs.doc_id.isin(*one))
    assert rows == {(r.doc_id, dict(want)[r.doc_id]): r.copies for r in entropy_mix.mix_rates(left).collect() if r.copies}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(path), str(tmp_path)).columns == spark.read.parquet(path).columns, name
