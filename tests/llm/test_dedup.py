"""Exact, substring, suffix and near-duplicate operators against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from stumpline.llm import exact_dedup, fingerprint_index, jaccard_join, suffix_dedup
from stumpline.llm.components import components
from stumpline.llm.shared import word_bounds

sha = lambda b: hashlib.sha256(b).hexdigest()


def got(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("digest_bytes", [32, 1])  # one byte: digests clash, bytes decide
def test_exact(docs, corpus, digest_bytes):
    groups = {}
    for i, t in corpus:
        groups.setdefault(t or "", []).append(i)
    want = [(i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), sha((t or "").encode())) for i, t in corpus]
    for broadcast in (0, 10**6):
        assert got(exact_dedup.exact_dedup(docs, digest_bytes=digest_bytes, broadcast_rows=broadcast), "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert sorted(r.doc_id for r in exact_dedup.keep_unique(docs).collect()) == sorted(max(g) for g in groups.values())


def test_exact_state_goes_on(spark, docs, corpus):
    index = exact_dedup.DedupState(spark)
    content = exact_dedup.located(docs, ["doc_id", "text"])
    for _ in range(2):
        index.add(content, "doc_id", "text")
    assert {r.group_size % 2 for r in index.state().collect()} == {0}


def test_exact_repeated_ids_and_nulls(spark, empty):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None), (2, "")], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(df).collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 2 and {r.keep_id for r in rows if r.group_size == 3} == {1}
    assert exact_dedup.exact_dedup(empty).count() == 0 == exact_dedup.keep_unique(empty).count()


def words_brute(corpus, window):
    first, out = {}, []
    split = [(i, (t or "").encode().split()) for i, t in corpus]
    for i, w in split:
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), len(w) - len(kept), sha(b" ".join(kept))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 4])
def test_substrings(docs, corpus, batches):
    assert got(fingerprint_index.substring_dedup(docs, batches=batches, max_runs=2), "n_words", "n_removed", "kept_sha256") == words_brute(corpus, 50)


def test_substrings_of_none(spark, empty):
    assert fingerprint_index.substring_dedup(empty).count() == 0
    df = spark.createDataFrame([(3, None), (None, "x " * 80), (5, "x " * 80), (5, "x " * 80)], "doc_id long, text string")
    rows = fingerprint_index.substring_dedup(df).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in rows) == [(-1, 80, 0), (3, 0, 0), (5, 80, 80), (5, 80, 80)]


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_substrings_shared_with_texts_without_id(spark, broadcast):
    words = lambda a, b: [f"w{k}" for k in range(a, b)]
    texts = [(None, words(0, 80)), (None, words(1000, 1070)), (3, words(200, 230) + words(10, 75)), (4, words(1000, 1060) + words(300, 310)), (5, words(400, 470))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string").repartition(3)
    index = fingerprint_index.FingerprintIndex(spark)
    cut = {r.n_removed for r in index.add(df, "doc_id", "text", broadcast).collect()} - {0}
    index.remove()
    assert cut == {65, 60}
    want = sorted(words_brute([(i if i is not None else -1, " ".join(w)) for i, w in texts], 50), key=repr)
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in fingerprint_index.substring_dedup(df).collect()), key=repr) == want


def ordered_brute(batches, window):
    """(batch, doc_id, n_words, n_removed): an earlier batch counts as earlier whatever its ids, then the smaller doc_id."""
    split = [((b, i), (t or "").encode().split()) for b, rows in enumerate(batches) for i, t in rows]
    first = {}
    for at, w in sorted(split, key=lambda x: x[0]):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), at)
    out = []
    for at, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < at:
                gone[k : k + window] = [True] * window
        out.append((*at, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out)


@pytest.mark.parametrize("max_runs", [1, 3])
def test_closed_index_takes_a_further_batch(spark, corpus, tmp_path, max_runs):
    words = lambda a, b: " ".join(f"v{k}" for k in range(a, b))
    # Batch 1 and 2 share a passage; 3 has it again and one that only batch 0 has; ids of batch 3 are smaller than all.
    extra = [[(900, words(0, 200))], [(901, words(500, 640))], [(902, "q " + words(510, 600))], [(-5, words(520, 590) + " r " + words(20, 90)), (-4, words(0, 200))]]
    rows = [corpus[k::5] + (extra[k] if k < 4 else []) for k in range(4)]
    home, got_ = f"file://{tmp_path}/index", []
    for k, batch in enumerate(rows):
        index = fingerprint_index.FingerprintIndex(spark, max_runs=max_runs, home=home)  # opened again for each batch
        assert len(index.state["batches"]) == k and all(len(index.state[kind]) <= max_runs for kind in fingerprint_index.KINDS)
        out = index.add(spark.createDataFrame(batch, "doc_id long, text string"), "doc_id", "text", 0 if k % 2 else 20_000)
        got_ += [(k, r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()]
        index.close()
    assert sorted(got_) == ordered_brute(rows, 50)


def test_batch_that_died_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    text = " ".join(f"u{k}" for k in range(80))
    docs = lambda i: spark.createDataFrame([(i, text)], "doc_id long, text string")
    index = fingerprint_index.FingerprintIndex(spark, home=f"file://{tmp_path}/index")
    with monkeypatch.context() as m:
        m.setattr(index, "_commit", lambda state: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            index.add(docs(1), "doc_id", "text")
    index = fingerprint_index.FingerprintIndex(spark, home=f"file://{tmp_path}/index")
    assert [r.n_removed for r in index.add(docs(2), "doc_id", "text").collect()] == [0]
    stale = fingerprint_index.FingerprintIndex(spark, home=f"file://{tmp_path}/index")
    assert [r.n_removed for r in index.add(docs(3), "doc_id", "text").collect()] == [80]
    with pytest.raises(RuntimeError, match="another writer"):
        stale.add(docs(4), "doc_id", "text")
    with pytest.raises(ValueError, match="windows of 50"):
        fingerprint_index.FingerprintIndex(spark, window=40, home=f"file://{tmp_path}/index")
    index.close()


def test_history_is_met_without_a_shuffle(spark, tmp_path):
    index = fingerprint_index.FingerprintIndex(spark, home=f"file://{tmp_path}/index")
    for k in range(2):
        index.add(spark.createDataFrame([(k, " ".join(f"t{j}" for j in range(k * 40, k * 40 + 120)))], "doc_id long, text string"), "doc_id", "text")
    for kind, keys in fingerprint_index.KINDS.items():
        a, b = index._runs(kind)
        plan = a.select(*keys).join(b.select(*keys).hint("merge"), list(keys))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.close()


def bytes_brute(corpus, window):
    seen, out = {}, []
    raw = [(i, (t or "").encode()) for i, t in corpus]
    for _, b in raw:
        for k in range(len(b) - window + 1):
            seen[b[k : k + window]] = seen.get(b[k : k + window], 0) + 1
    for i, b in raw:
        step = np.zeros(len(b) + 1, int)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                step[k] += 1
                step[k + window] -= 1
        gone = np.cumsum(step)[: len(b)] > 0
        out.append((i, len(b), int(gone.sum()), len(suffix_dedup.runs(gone)[0]), sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "hot"), [(400, 50_000), (96, 50_000), (400, 1)])  # hot 1: the exact way for frequent anchors
def test_suffixes(docs, corpus, window, hot):
    assert got(suffix_dedup.suffix_dedup(docs, window=window, hot=hot, chunk=20_000), "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_brute(corpus, window)


def test_suffixes_of_none(empty):
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_difference_cover():
    assert (suffix_dedup.SHIFT >= 0).all()
    rng = np.random.default_rng(0)
    part = rng.integers(0, 3, 700).astype(np.uint8)
    text = np.concatenate([part, rng.integers(0, 3, 300).astype(np.uint8), part, part[:500]])
    order, _ = suffix_dedup.CoverSuffixes(text).sort_buckets(np.arange(len(text)), np.zeros(len(text), np.int64))
    raw = text.tobytes()
    padded = [raw[k : k + suffix_dedup.DEPTH].ljust(suffix_dedup.DEPTH, b"\0") for k in range(len(raw))]
    ranked = [padded[k] for k in order]
    assert ranked == sorted(padded)


def sets_brute(corpus):
    sets, parent = {}, {}
    for i, t in corpus:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted(((i, len(sets[i]), root(i)) for i in ids), key=repr)


@pytest.mark.parametrize(("rounds", "block", "broadcast"), [(4, 512, 10**6), (0, 512, 0), (0, 7, 0)])  # without stars the trees find all; 7: blocks
def test_near_copies(docs, corpus, rounds, block, broadcast):
    assert got(jaccard_join.similar_sets(docs, rounds=rounds, block=block, broadcast_rows=broadcast), "n_shingles", "component_id") == sets_brute(corpus)


def test_near_copies_of_none(spark, empty, docs, corpus):
    assert jaccard_join.similar_sets(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c"), (1, "A B c"), (2, None), (None, "q q q q q q q q")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_join.similar_sets(df).collect()} == {(1, 1), (2, 2), (None, None)}
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, _, c in sorted(sets_brute(corpus)) if i == c]


@pytest.mark.parametrize(("rounds", "broadcast"), [(4, 10**6), (0, 0)])
def test_near_copies_of_texts_without_id(spark, rounds, broadcast):
    words = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    # 1 and 2 link through a text without id only; two texts without id link with each other only; 7 is two texts.
    rows = [(1, words(0, 100)), (None, words(10, 110)), (2, words(20, 120)), (None, words(500, 600)), (None, words(505, 605)), (3, words(900, 980)), (7, words(2000, 2100)), (7, words(3000, 3100)), (8, words(2003, 2103)), (9, words(3003, 3103))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.similar_sets(df, rounds=rounds, broadcast_rows=broadcast).collect()), key=repr)
    assert got == sorted([(1, 1), (None, 1), (2, 1), (None, None), (None, None), (3, 3), (7, 7), (7, 7), (8, 7), (9, 7)], key=repr)


def test_tree_prunes_nothing_that_links():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 60, 80, dtype=np.uint64)) for _ in range(12)]
    sets += [np.unique(np.append(s[: len(s) - rng.integers(0, 30)], rng.integers(0, 1 << 60, 5, dtype=np.uint64))) for s in sets for _ in range(6)]
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    bits, size = jaccard_join.bitmaps(np.concatenate(sets), at), np.diff(at)
    group, comp = np.zeros(len(sets), int), np.arange(len(sets))
    for side in (None, np.arange(len(sets)) % 2):
        x, y = jaccard_join.tree_pairs(group, size, comp, bits, side, most=64)
        found = {frozenset(p) for p in zip(x.tolist(), y.tolist(), strict=True)}
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 7 * both >= 3 * (size[i] + size[j]) and (side is None or side[i] != side[j]):
                    assert frozenset((i, j)) in found
        assert len(found) < len(sets) ** 2 / 3


def test_scaled_bitmaps_drop_only_what_cannot_link():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 63, 9000, dtype=np.uint64)
    other = rng.integers(1, 1 << 63, 9000, dtype=np.uint64)
    sets = [base, np.concatenate((base[:8000], other[:1000])), np.concatenate((base[:2000], other[:7000])), base[:100], base[:90]]
    scaled, size = [jaccard_join.scaled_bitmap(x) for x in sets], np.array([len(x) for x in sets])
    assert np.array_equal(np.stack([jaccard_join.folded(b, jaccard_join.BITS // 8) for b in scaled]), jaccard_join.bitmaps(np.concatenate(sets), np.concatenate(([0], np.cumsum(size)))))
    x, y = np.array([0, 0, 1, 3]), np.array([1, 2, 2, 4])
    assert jaccard_join.overlap_enough(scaled, size, x, y).tolist() == [True, False, False, True]


def test_stars_end_where_they_close_little(spark, monkeypatch):
    """Pairs that all share one passage: a round of stars finds the pair of its pivot alone, the trees find the others."""
    passage = " ".join(f"p{k}" for k in range(60))
    corpus = []
    for k in range(30):
        own = " ".join(f"w{k}x{j}" for j in range(40))
        corpus += [(2 * k, f"{passage} {own}"), (2 * k + 1, f"{passage} {own} end")]
    rounds, opened = [], []
    monkeypatch.setattr(jaccard_join, "_stars", lambda rows, seed, scratch, f=jaccard_join._stars: rounds.append(seed) or f(rows, seed, scratch))
    monkeypatch.setattr(jaccard_join, "_open_rows", lambda *a, f=jaccard_join._open_rows: opened.append(1) or f(*a))
    found = jaccard_join.similar_sets(spark.createDataFrame(corpus, "doc_id long, text string"))
    assert got(found, "n_shingles", "component_id") == sets_brute(corpus)
    assert len(rounds) == len(opened) <= 2


def test_trees_give_fewer_links_than_sets(spark, monkeypatch):
    """Near copies that no star has joined: the links to joined components do not grow with the square of their number."""
    counts = {}
    for n in (20, 60):
        corpus = [(k, " ".join(f"w{j}" for j in range(120)) + f" end{k}") for k in range(n)]
        monkeypatch.setattr(jaccard_join, "components", lambda links, *a, n=n, **k: counts.update({n: links.count()}) or components(links, *a, **k))
        found = jaccard_join.similar_sets(spark.createDataFrame(corpus, "doc_id long, text string"), rounds=0)
        assert got(found, "n_shingles", "component_id") == sets_brute(corpus)
    assert counts == {20: 19, 60: 59}


def test_sets_with_one_common_passage_do_not_meet(spark, monkeypatch):
    """Documents that share a passage and nothing else leave no token for the stars and trees to compare; near copies do."""
    passage = " ".join(f"p{k}" for k in range(34))
    corpus = [(k, f"{passage} " + " ".join(f"w{k}x{j}" for j in range(60 + k))) for k in range(40)]
    corpus += [(100 + k, t + " end") for k, t in corpus[:5]]
    met = {}
    monkeypatch.setattr(jaccard_join, "_links", lambda rows, *a, f=jaccard_join._links: met.update({r.sig: r.n for r in rows.groupBy("sig").count().withColumnRenamed("count", "n").collect()}) or f(rows, *a))
    found = jaccard_join.similar_sets(spark.createDataFrame(corpus, "doc_id long, text string"))
    assert got(found, "n_shingles", "component_id") == sets_brute(corpus)
    assert len(met) == 10


def test_the_rarest_shared_token_stays_in_both(spark):
    """Each set leaves out common tokens, and two sets that link still meet, whatever the others have."""
    rng = np.random.default_rng(6)
    base = [rng.permutation(3000)[: rng.integers(2, 160)] for _ in range(12)]
    sets = []
    for k in range(150):
        s = base[k % 12]
        sets.append({int(x) for x in s[rng.random(len(s)) < 0.93]} | {int(x) for x in rng.integers(0, 3000, len(s) // 15)} | {0})
    rows, have = [], {}
    for k, s in enumerate(sets):
        for x in sorted(s)[: int(jaccard_join.prefix_length(np.array(len(s))))]:
            have.setdefault(x, []).append(k)
    rows = [(x, k, len(sets[k]), len(own)) for x, own in have.items() if len(own) > 1 for k in own]
    left = {}
    for r in jaccard_join._rare_tokens(spark.createDataFrame(rows, "token long, sig long, size int, sets long")).collect():
        left.setdefault(r.sig, set()).add(r.token)
    linked = [(i, j) for i in range(150) for j in range(i) if 7 * len(sets[i] & sets[j]) >= 3 * (len(sets[i]) + len(sets[j]))]
    assert len(linked) > 100 and all(left[i] & left[j] for i, j in linked)
    assert sum(map(len, left.values())) < len(rows) / 2


def test_words_of_any_length_have_their_own_hash():
    words = [b"a", b"a\0", b"\0", b"ab", b"abcdefgh", b"abcdefgh\0", b"abcdefghi", b"abcdefghabcdefgh", b"q" * 256, b"q" * 257, b"q" * 258, b"q" * 600]
    data = b" ".join([*words, *words])
    start, end, _ = word_bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    hashes = jaccard_join.word_hashes(np.frombuffer(data, np.uint8), start, end).tolist()
    assert hashes[: len(words)] == hashes[len(words) :] and len(set(hashes)) == len(words)


def test_joined_components_are_dropped_from_the_walk():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 1 << 60, 100, dtype=np.uint64)) for _ in range(3)]
    sets = [np.unique(np.append(base[k % 3][rng.permutation(100)[:92]], rng.integers(0, 1 << 60, 4, dtype=np.uint64))) for k in range(90)]
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    group, joined, tried = np.zeros(90, int), jaccard_join.Joined(np.arange(1000, 1090)), []

    def links(x, y):
        tried.extend(zip(x.tolist(), y.tolist(), strict=True))
        return np.array([jaccard_join.overlap(sets[a], sets[b]) for a, b in zip(x, y, strict=True)], bool)

    walk = jaccard_join.tree_walk(group, np.diff(at), joined.label, jaccard_join.bitmaps(np.concatenate(sets), at), most=64)
    pairs = next(walk, None)
    while pairs is not None:
        try:
            pairs = walk.send(joined.settle(*pairs, links))
        except StopIteration:
            break
    assert [joined.label[k] for k in range(90)] == [k % 3 for k in range(90)] and len(tried) < 90 * 6
    a, b = joined.edges()
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted((1000 + k % 3, 1000 + k) for k in range(3, 90))


def test_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 105), (105, 103), (7, 7)]
    out = {r.id: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in range(61)}, 100: 100, 103: 100, 105: 100}


def test_components_after_few_passes(spark):
    """Labels that are cut short join connected ids only, and repeats change nothing."""
    links = [(k, k + 1) for k in range(60)] + [(100, 105), (105, 103), (103, 105), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    whole = {r.id: r.comp for r in components(df).collect()}
    assert {r.id: r.comp for r in components(df, repeats=False).collect()} == whole
    short = {r.id: r.comp for r in components(df, repeats=False, passes=1).collect()}
    assert short != whole and set(short) == set(whole) and all(whole[i] == whole[c] <= c <= i for i, c in short.items())


def test_shingles_of_a_column():
    hashes, at = jaccard_join.shingle_sets(pa.array(["a b c d e f", "A b c d e F", None, "a b", "a b c d e f a b c d e f"]))
    assert np.diff(at).tolist() == [2, 2, 0, 1, 6] and hashes[at[0] : at[1]].tolist() == hashes[at[1] : at[2]].tolist()
