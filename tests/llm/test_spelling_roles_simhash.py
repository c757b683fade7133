"""Spelling variants, conversation repair and SimHash against brute force and plain walks."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import prose
from helpers import SF

from stumpline.llm import role_grammar, simhash_variants, spelling_variants
from stumpline.llm.shared import Scratch

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


# Spelling variants


def counted_words(rows, damage=97):
    n = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    """Whether one insertion, deletion or replacement leads from a to b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_brute(rows):
    n = counted_words(rows)
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def spelled(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def variant_texts():
    rng = random.Random(5)
    base = ["harbour", "colour", "mississippi", "straße", "éclair", "naïveté", "aaaaa", "aaaaaa", "abcde", "abcdef"]
    rows = [(None, "Harbour harbour"), (None, None), (1, ""), (1, ""), (2, "日本語 Colour—colour×colour÷ ÀÉÎ"), (3, "x" * 6000 + " " + "y" * 6000)]
    for i in range(400):
        said = []
        for _ in range(30):
            w = rng.choices(base, range(len(base), 0, -1))[0]
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                p, c = rng.randrange(len(w)), rng.choice("aeosß\xff\xd7")
                w = rng.choice((w[:p] + w[p + 1 :], w[:p] + c + w[p:], w[:p] + c + w[p + 1 :]))
            said.append(rng.choice((w, w.capitalize(), w.upper())))
        rows.append((i, rng.choice((" ", "1", ", ")).join(said)))
    return rows


def test_variants_as_by_brute_force(spark):
    rows = variant_texts()
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n long").repartition(5)
    want = variants_brute(rows)
    got = spelled(spelling_variants.spelling_variants(df))
    assert len(got) == len(set(got)) and set(got) == want
    assert any(root != form and form for _, form, root, *_ in want)  # chains are there
    small = spelling_variants.spelling_variants(df, filter_bits=1 << 15)  # a filter that lets nearly all pass changes nothing
    assert set(spelled(small)) == want


def test_variants_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = variants_brute([(r.doc_id, r.text) for r in df.limit(40).collect()])
    assert set(spelled(spelling_variants.spelling_variants(df.limit(40)))) == want


def test_every_neighbour_once():
    letters = np.frombuffer(b"abc\xff", np.uint8)
    for w in (b"a", b"aab", b"cabba", b"\xffaa\xff"):
        found = [bytes(x) for _, out in spelling_variants.neighbours(np.frombuffer(w, np.uint8)[None, :], letters, lambda h: np.ones(h.shape, bool)) for x in out]
        want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + bytes([c]) + w[i + k :] for i in range(len(w) + 1) for c in letters for k in (0, 1) if i + k <= len(w)}
        assert len(found) == len(set(found)) and set(found) == want - {w}


def test_runs_across_parts(monkeypatch):
    text = b"abc defgh, " * 50 + b"z" * 100 + b" end"
    for size in (1, 7, 64, 10_000):
        monkeypatch.setattr(spelling_variants, "READ", size)
        assert list(itertools.chain(*spelling_variants.runs(text))) == re.findall(rb"[a-z]+", text)


def test_long_words_stay_whole(spark):
    """Words of 30000 letters: their neighbourhood is made in parts."""
    w = "".join(random.Random(1).choices("ab", k=30_000))
    rows = [(1, " ".join([w] * 8)), (2, " ".join([w[:-1]] * 3)), (3, " ".join([w[:100] + "b" + w[100:]] * 4))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.word: r for r in spelling_variants.spelling_variants(df, damage=0).collect()}
    assert len(out) == 3 and out[w].form is None and out[w].n_near == 2 and all(out[x].form == w for x in out if x != w)


def test_no_words(spark):
    schema = "doc_id long, text string"
    assert spelling_variants.spelling_variants(spark.createDataFrame([], schema)).collect() == []
    assert spelling_variants.spelling_variants(spark.createDataFrame([(1, None), (2, ""), (None, "two words")], schema)).collect() == []


# Conversations


def damage(rows, modulus=20):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % modulus
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def told(rows):
    """Faults of the sorted rows of one conversation: (gaps, blank, duplicate, truncated, illegal), and each row's fault."""
    turns = {r[1] for r in rows if r[1] is not None}
    seen, fault = set(), []
    for _, _, role, text in rows:
        said = BLANK.findall(text)
        fault.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1][-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal), fault


def cheapest(rows, fault):
    """(cost, audit, lines) by trying all edits, inserts bounded by two in a row: exponential, for short conversations."""
    fits = re.compile("(s?(ua)+)?")
    best = None
    for kinds in itertools.product("DKua", repeat=len(rows)):
        if any(k != "D" and f in ("blank", "duplicate") for k, f in zip(kinds, fault, strict=True)):
            continue
        cost = sum({"D": 2, "K": 0}.get(k, 1) + (5 if f == "truncated" and k != "D" else 0) for k, f in zip(kinds, fault, strict=True))
        if best and cost > best[0]:
            continue
        for inserts in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            total = cost + 5 * sum(map(len, inserts))
            if best and total > best[0]:
                continue
            letters, lines, initials = "I" * len(inserts[0]), [f"{role_grammar.ROLES[c]}:" for c in inserts[0]], inserts[0]
            for (_, _, role, text), k, more in zip(rows, kinds, inserts[1:], strict=True):
                letters += {"D": "D", "K": "K"}.get(k, "R") + "I" * len(more)
                if k != "D":
                    initials += role[:1] if k == "K" else k
                    lines.append(f"{role if k == 'K' else role_grammar.ROLES[k]}:{text}")
                initials += more
                lines += [f"{role_grammar.ROLES[c]}:" for c in more]
            if fits.fullmatch(initials) and len(initials) == sum(1 for x in letters if x != "D") and (best is None or (total, letters) < best[:2]):
                best = (total, letters, lines)
    return best


def sha(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def walked(rows, fault):
    """(cost, audit, lines) by a shortest path over (row, state), one conversation at a time, of any length."""
    best = {0: (0, "", ())}

    def put(layer, state, cost, audit, lines):
        if state not in layer or (cost, audit) < layer[state][:2]:
            layer[state] = (cost, audit, lines)

    def inserted(layer):
        for _ in range(3):
            for (state, initial), after in role_grammar.NEXT.items():
                if initial != "s" and state in layer:
                    cost, audit, lines = layer[state]
                    put(layer, after, cost + 5, audit + "I", (lines, f"{role_grammar.ROLES[initial]}:"))
        return layer

    inserted(best)
    for (_, _, role, text), f in zip(rows, fault, strict=True):
        layer = {}
        for state, (cost, audit, lines) in best.items():
            put(layer, state, cost + 2, audit + "D", lines)
            if f not in ("blank", "duplicate"):
                more = 5 if f == "truncated" else 0
                for (s, initial), after in role_grammar.NEXT.items():
                    if s == state and initial == role[:1]:
                        put(layer, after, cost + more, audit + "K", (lines, f"{role}:{text}"))
                    if s == state and initial != "s":
                        put(layer, after, cost + 1 + more, audit + "R", (lines, f"{role_grammar.ROLES[initial]}:{text}"))
        best = inserted(layer)
    cost, audit, lines = min((best[s] for s in (0, 3) if s in best), key=lambda x: x[:2])
    out = []
    while lines:
        lines, line = lines
        out.append(line)
    return cost, audit, out[::-1]


def by_conversation(rows, changed, solve):
    out = {}
    after = {}
    for r in changed(rows):
        after.setdefault(r[0], []).append(r)
    for conv in {r[0] for r in rows}:
        own = sorted(after.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        numbers, fault = told(own)
        cost, audit, lines = solve(own, fault)
        out[conv] = (*numbers, cost, audit, sha(lines))
    return out


def repairs(df):
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in columns) for r in rows}
    assert len(out) == len(rows)
    return out


def chats(seed, n, most, roles=("user", "assistant", "system", "tool", None, "", "usher"), texts=("Hello.", "Yes!", "cut off", "", " \t", None, "Why? ", "a.\n", "b!\x85")):
    rng = random.Random(seed)
    return [(conv if conv else None, rng.choice((t, t, t, None, t // 2)), rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts)) for conv in range(n) for t in range(rng.randrange(most + 1))]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "e") for r in rows], "conv_id long, turn long, role string, text string, block long, edit string").repartition(5)


def test_repairs_are_the_cheapest(spark):
    rows = chats(3, 120, 4)
    plain = lambda rows: [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = by_conversation(rows, plain, cheapest)
    assert by_conversation(rows, plain, walked) == want
    got = repairs(role_grammar.repaired_digests(role_grammar.conversation_rows(conversations(spark, rows))))
    assert got == want
    # No insert is cheapest at these costs: it and its partner can go for less.  The passes hold inserts all the same.
    assert {x for v in want.values() for x in v[6]} == set("DKR")


def test_repairs_of_damaged_conversations(spark):
    rows = chats(4, 300, 12)
    want = by_conversation(rows, damage, walked)
    df = role_grammar.conversation_rows(conversations(spark, rows))
    assert repairs(role_grammar.repaired_digests(df, role_grammar.damaged)) == want
    assert repairs(role_grammar.repaired_digests(df, role_grammar.damaged, block=3)) == want  # cut into blocks


def test_one_conversation_has_most_rows(spark):
    """A conversation of 3000 turns, many of them alike, in blocks of 64."""
    rows = [(9, t // 3 - 200 if t % 5 else None, ("user", "assistant", "system")[t % 7 % 3], ("Said.", f"Said {t}.", f"cut {t}")[t % 3]) for t in range(3000)] + chats(6, 40, 6)
    want = by_conversation(rows, damage, walked)
    got = repairs(role_grammar.repaired_digests(role_grammar.conversation_rows(conversations(spark, rows)), role_grammar.damaged, block=64))
    assert got == want


def test_repaired_rows_fit_the_grammar(spark):
    rows = chats(8, 60, 9)
    with Scratch(spark) as scratch:
        lines, summary = role_grammar.repair(role_grammar.conversation_rows(conversations(spark, rows)), scratch, 4)
        got, audits = {}, {r.conv_id: r.audit for r in summary.collect()}
        for r in sorted(lines.collect(), key=lambda r: (r.block is not None, r.block or 0, r.place)):
            got.setdefault(r.conv_id, []).append(r)
    for conv, own in got.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own))
        assert "".join(r.edit for r in own) == audits[conv].replace("D", "")
        assert all((r.turn, r.text) == (None, "") for r in own if r.edit == "I")


def test_repairs_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repairs(role_grammar.op12_role_grammar(spark, SF)) == by_conversation(rows, damage, walked)


def test_no_conversations(spark):
    assert repairs(role_grammar.repaired_digests(role_grammar.conversation_rows(conversations(spark, [])), role_grammar.damaged)) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repairs(role_grammar.repaired_digests(role_grammar.conversation_rows(conversations(spark, [(gone, 0, "user", "Hello.")])), role_grammar.damaged))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", sha([]))}


# SimHash


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))


def linked_brute(ids_and_prints, distance=4):
    prints = sorted({p for _, p in ids_and_prints})
    top = {p: p for p in prints}

    def root(p):
        while top[p] != p:
            p = top[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= distance:
            top[root(a)] = root(b)
    least = {}
    for i, p in ids_and_prints:
        if i is not None:
            least[root(p)] = min(least.get(root(p), i), i)
    return Counter((i, f"{p:016x}", least.get(root(p))) for i, p in ids_and_prints)


def prints_of(df):
    return Counter((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect())


def test_simhash_as_by_brute_force(spark, docs, corpus, monkeypatch):
    want = linked_brute([(i, simhash(t)) for i, t in corpus])
    assert prints_of(simhash_variants.near_duplicates(docs)) == want
    assert any(i != c for i, _, c in want)


def test_shingles_in_parts(monkeypatch):
    texts = [b"", b"one", b"One two\tthree\nFOUR five", b" ".join(b"w%d" % i for i in range(300)), b"\x20\x0d", b"a b c d"]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    h, first = simhash_variants.shingle_hashes(data, at)
    for size in (1, 50, 1 << 18):
        monkeypatch.setattr(simhash_variants, "COUNTED", size)
        assert simhash_variants.majority(h, first).tolist() == [simhash(t.decode()) for t in texts]


def test_odd_simhash_rows(spark):
    rows = [(None, None), (None, ""), (7, " \t"), (7, " \t"), (3, "one two"), (3, "ONE  two"), (1, " ".join(prose(1, 50))), (None, " ".join(prose(2, 50)))]
    df = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, fp long, a string").repartition(3)
    assert prints_of(simhash_variants.near_duplicates(df)) == linked_brute([(i, simhash(t)) for i, t in rows])
    assert simhash_variants.near_duplicates(df.limit(0)).collect() == []


def clusters(seed):
    """Chains and clouds of fingerprints, among them many that share segments but are no links."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(300)]
    for centre in out[:6]:
        cloud = [centre]
        for _ in range(250):
            x = rng.choice(cloud)
            for bit in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << bit
            cloud.append(x)
        out += cloud
    return [*out, *(out[0] & ~0x1FFFFF | rng.getrandbits(20) for _ in range(200)), *(rng.getrandbits(42) for _ in range(200)), 0, 1, 31, (1 << 64) - 1, 1 << 63]


@pytest.mark.parametrize("distance", [1, 3, 4, 5])
def test_links_of_fingerprints(spark, distance):
    """Every component of all links, whatever the blocks."""
    prints = list(enumerate(clusters(distance)))
    want = {(i, c) for i, _, c in linked_brute(prints, distance)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in sorted({p for _, p in prints})]
    df = spark.createDataFrame(signed, "fp long").repartition(4)
    for block in (7, 4096):
        with Scratch(spark) as scratch:
            found = {tuple(r) for r in simhash_variants.links(df, distance, block, scratch).collect()}
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= distance for a, b in found)
        top = {p: p for _, p in prints}

        def root(p):
            while top[p] != p:  # noqa: B023
                p = top[p]  # noqa: B023
            return p

        for a, b in found:
            top[root(a & (1 << 64) - 1)] = root(b & (1 << 64) - 1)
        least = {}
        for i, p in prints:
            least[root(p)] = min(least.get(root(p), i), i)
        assert {(i, least[root(p)]) for i, p in prints} == want


def test_prints_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_variants.op13_simhash_variants(spark, SF).collect())
    assert out == linked_brute([(i, simhash(t)) for i, t in rows])
