"""Byte and word windows, suffix order and SimHash against plain Python."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from coterie.llm import prefix_free, simhash, substrings, suffix_dedup, windows
from coterie.llm.components import components

SCHEMA = "doc_id long, text string, size int, th int, k string, kept string, starts string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, 2, "k", None, "s") for i, t in rows], SCHEMA)


def odd_rows():
    rng = random.Random(1)
    words = ["le", "la", "é", "漢字", "x" * 30, "of", "the"]
    base = " ".join(rng.choice(words) for _ in range(400))
    rows = [(1, base), (2, base), (2, base), (2, "other " + base[:700]), (3, None), (4, ""), (5, " \n\t "), (6, "a" * 3000), (7, base[300:900] + " tail"), (None, base[100:600]), (None, None), (8, "xy" * 2000 + base), (9, base.replace("la", "LA"))]
    return rows


def brute_bytes(rows, window):
    """By (doc_id or lowest, hash order doesn't matter here): marks bytes of strings that start earlier; equal rows are one document."""
    docs = sorted({(-1 if i is None else i, t) for i, t in rows}, key=lambda r: (r[0], 0))
    seen, out = set(), {}
    groups = {}
    for i, t in docs:
        groups.setdefault(i, []).append(t)
    assert all(len(g) == 1 for g in groups.values())
    for i, t in docs:
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            if w in seen:
                hit[k : k + window] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        out[i] = (len(b), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed, window, gram", [(0, 20, 6), (1, 24, 9), (2, 100, 32)])
def test_suffix_dedup_is_exact(spark, seed, window, gram):
    rng = random.Random(seed)
    alphabet = "ab" if seed == 0 else "abcdefgh é\n"
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(25)]
    rows = [(i, "".join(rng.choice(pool)[rng.randint(0, 20) :] for _ in range(rng.randint(0, 4)))) for i in range(60)]
    rows += [(100, "z" * 500), (101, None), (102, "zz" * 90), (103, "")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.suffix_dedup(table(spark, rows), window, gram).collect()}
    assert got == brute_bytes(rows, window)


def test_suffix_dedup_edges(spark):
    rows = [r for r in odd_rows() if r[1] is None or not r[1].startswith("other")]
    got = suffix_dedup.suffix_dedup(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_removed, r.n_spans))
    # a null id comes first, so document 1 loses what it shares with it; both rows of document 2 fare alike
    assert len(by_id[2]) == 1 and next(iter(by_id[2]))[0] == next(iter(by_id[2]))[1]
    assert by_id[4] == {(0, 0, 0)} and by_id[3] == {(0, 0, 0)}
    assert by_id[6] == {(3000, 2999, 1)}
    assert suffix_dedup.suffix_dedup(table(spark, [])).count() == 0
    left = suffix_dedup.deduplicated(table(spark, rows))
    assert left.columns == table(spark, rows).columns
    assert {r.doc_id for r in left.where("k = 'k'").collect()} >= {1, 3, 4, 5, None}
    assert 2 not in {r.doc_id for r in left.collect()}


@pytest.mark.parametrize("parts", [1, 5])
def test_repeated_rows_are_one_document(spark, parts):
    rng = random.Random(31)
    long = lambda: "".join(rng.choice("abcdefgh ") for _ in range(400))
    only, nulls, shared = long(), long(), long()
    rows = [(50, only), (50, only), (None, nulls), (None, nulls), (60, shared), (60, shared), (61, "head " + shared), (61, "head " + shared), (70, "y" * 300), (70, "y" * 300)]
    got = {}
    for r in suffix_dedup.suffix_dedup(table(spark, rows).repartition(parts)).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, bytes(r.kept).decode()))
    assert got == {50: [(400, 0, only)] * 2, None: [(400, 0, nulls)] * 2, 60: [(400, 0, shared)] * 2, 61: [(405, 400, "head ")] * 2, 70: [(300, 299, "y")] * 2}
    assert sorted(r.text for r in suffix_dedup.deduplicated(table(spark, rows).repartition(parts)).where("doc_id = 50").collect()) == [only] * 2


@pytest.mark.parametrize("seed", range(3))
def test_suffix_order(seed):
    rng = np.random.default_rng(seed)
    texts = [bytes(rng.choice(list(b"abc\x00\xff"), rng.integers(12, 60))) for _ in range(40)]
    texts += [t[:12] + t[3:] for t in texts[:20]] + [b"a" * 60, b"a" * 45]
    text, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    parse = prefix_free.Parse(text, sizes)
    one, two = windows.Rolling(text), windows.Rolling(text, windows.BASES[1])
    places = np.concatenate([parse.begins[s] + np.arange(len(t) - 11) for s, t in enumerate(texts)])
    owner = np.searchsorted(parse.begins + sizes, places, "right")
    order = parse.order(places, 12, lambda lo, hi: (one.ranges(lo, hi), two.ranges(lo, hi)))
    heads = [text[p : min(p + 12, parse.begins[s] + sizes[s])].tobytes() for p, s in zip(places[order], owner[order])]
    assert heads == sorted(heads)


def brute_words(rows, window):
    docs = [WORDS.findall(t or "") for _, t in rows]
    count = {}
    for w in docs:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            count[s] = count.get(s, 0) + 1
    out = []
    for (i, _), w in zip(rows, docs):
        hit = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                hit[k : k + window] = [True] * window
        out.append((i, len(w), sum(hit), " ".join(x for x, h in zip(w, hit) if not h)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, gram", [(35, 10), (6, 3)])
def test_substring_dedup_is_exact(spark, window, gram):
    rng = random.Random(5)
    rows = odd_rows()
    rows += [(20 + i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 80)))) for i in range(30)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.substring_dedup(table(spark, rows), window, gram).collect()), key=str)
    assert got == brute_words(rows, window)
    assert substrings.substring_dedup(table(spark, [])).count() == 0


def complementary(length):
    """Two strings of two letters whose sums of powers modulo 2^64 are the same for every base, from 1,024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(length)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("length", [1024, 2048, 4096])
def test_words_of_cancelling_letters_differ(spark, length):
    shared = " ".join(f"w{i}" for i in range(34))
    rows = [(i, f"{shared} {x}") for i, x in enumerate(complementary(length))] + [(2, "a " + shared), (3, "b " + shared)]
    assert {r.doc_id: r.n_removed for r in substrings.substring_dedup(table(spark, rows)).collect()} == {0: 0, 1: 0, 2: 0, 3: 0}


def test_window_keys_of_cancelling_words_differ():
    one, two = (windows.word_units([" ".join(x).encode()])[0] for x in complementary(2048))
    assert windows.window_keys(one, 2048)[0] != windows.window_keys(two, 2048)[0]
    units = np.random.default_rng(0).integers(0, 9, 300).astype(np.uint64)
    for window in (1, 2, 3, 7, 35, 64, 299, 300):
        keys, seen = windows.window_keys(units, window), {}
        assert len(keys) == 301 - window
        for i, k in enumerate(keys.tolist()):
            assert seen.setdefault(tuple(units[i : i + window].tolist()), k) == k
        assert len(set(seen.values())) == len(seen)
    assert len(windows.window_keys(units[:5], 8)) == 0


def test_word_hashes():
    rng = random.Random(3)
    words = ["x" * n for n in range(1, 40)] + ["xxxxxxxAxxxxxxxA", "xxxxxxxaxxxxxxxa", "xxxxxxxaxxxxxxxA", "xxxxxxxAxxxxxxxa", "\0", "\0\0", "a", "a\0", "\0a"]
    words += ["".join(rng.choice("abAB") for _ in range(rng.randint(1, 20))) for _ in range(20_000)]
    lanes, sizes = windows.word_lanes([" ".join(words[:5000]).encode(), b"", " \n".join(words[5000:]).encode()])
    assert sizes.tolist() == [5000, 0, len(words) - 5000]
    for k in (0, 1):
        of = {}
        assert all(of.setdefault(w, h) == h for w, h in zip(words, lanes[:, k].tolist())) and len(set(of.values())) == len(of)
    assert not (lanes[:, 0] == lanes[:, 1]).any()
    one = windows.word_lanes([words[20].encode()])[0]
    assert (one[0] == lanes[20]).all()  # wherever a word stands


def test_rows_without_ids_stay_apart(spark):
    n = 100_000
    df = spark.range(n).repartition(8).selectExpr("cast(null as long) as doc_id", "array_join(transform(sequence(1, 36), k -> concat(cast(id as string), '-', k)), ' ') as text")
    twice = df.union(spark.createDataFrame([(None, " ".join(f"7-{k}" for k in range(1, 36)))], "doc_id long, text string"))
    got = {(r.n_words, r.n_removed): r["count"] for r in substrings.substring_dedup(twice).groupBy("n_words", "n_removed").count().collect()}
    assert got == {(36, 0): n - 1, (36, 35): 1, (35, 35): 1}


def hot_rows(n, seed=0):
    """Texts around one line, which holds the anchor of many windows; some share more than the line."""
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice("abcdefghijklmnop ") for _ in range(k))
    line, rows = "one line that very many texts have in common, word by word", []
    edge = noise(30)
    for i in range(n):
        rows.append((i, noise(rng.randint(0, 150)) + (edge if i % 7 == 0 else "") + line + (edge[:20] if i % 5 == 0 else "") + noise(rng.randint(0, 150))))
    return rows


@pytest.mark.parametrize("hot", [3, 40, 10**9])
def test_hot_anchors_give_the_same(spark, hot):
    rows = hot_rows(150) + [(500 + i, t) for i, t in hot_rows(20)] + [(600, "z" * 400)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.suffix_dedup(table(spark, rows), hot=hot).collect()}
    assert got == brute_bytes(rows, 100)


def test_hot_anchors_are_split(spark):
    docs = windows.keyed(spark.createDataFrame(hot_rows(4000, 1), "doc_id long, text string").repartition(6))

    def most_in_a_part(hot):
        sent, n = suffix_dedup.contexts(docs, hot=hot)
        sizes = [0] * n
        for r in sent.where("anchor is not null").select("part", "anchor").collect():
            sizes[r.part] += len(r.anchor) // 8
        return max(sizes) / sum(sizes), n

    share, n = most_in_a_part(500)
    assert n == 4 and share < 0.35
    assert most_in_a_part(10**9)[0] > share


def test_equal_hashes_are_not_equal_strings():
    text = np.frombuffer(b"abcabdabcab", np.uint8)
    begins, size = np.array([0, 3, 6, 9]), np.array([3, 3, 3, 2])
    same, zero = np.zeros(4, np.uint64), np.zeros(4, np.int64)
    keep, drop = suffix_dedup.earliest(same, same, np.arange(4), zero, zero, text, begins, size)
    assert keep.tolist() == [True, True, False, True] and drop.tolist() == [False, False, True, False]


def test_partitions_follow_the_text(spark):
    docs = windows.keyed(spark.createDataFrame([(1, "a" * 1000), (2, None)], "doc_id long, text string"))
    assert windows.text_bytes(docs) == 1000 and windows.partitions_for(docs, 1000) == 4
    assert windows.partitions_for(docs, 100 * windows.PART_BYTES + 1) == 101
    assert windows.text_bytes(docs.where("false")) == 0


def test_sketch_never_underestimates():
    rng = np.random.default_rng(0)
    keys = windows.finished(rng.integers(0, 3000, 20_000).astype(np.uint64))
    one, two = windows.Sketch(1 << 12), windows.Sketch(1 << 12)
    one.add(keys)
    two.add(keys[:7000])
    two.add(keys[7000:])
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    assert (one.estimate(keys) >= np.minimum(n[at], 255)).all()
    assert (one.cells == two.cells).all()


def plain_fingerprint(text, width):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps, ids, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            r = find(i)
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_against_all_pairs(spark):
    rng = random.Random(3)
    rows = odd_rows()
    for i in range(60):
        w = [rng.choice("abcdefghij") for _ in range(rng.choice([1, 2, 5, 40]))]
        rows.append((100 + i, " ".join(w)))
        rows.append((200 + i, " ".join(w[:-1] + ["Q"])))
    got = sorted(((r.doc_id, r.fp.hex(), r.component_id) for r in simhash.near_duplicates(table(spark, rows), width=3).collect()), key=str)
    fps = [plain_fingerprint(t, 3) for _, t in rows]
    ids = [i for i, _ in rows]
    want = sorted(zip(ids, [f"{f:016x}" for f in fps], plain_classes(fps, ids, 3)), key=str)
    assert got == want
    assert simhash.near_duplicates(table(spark, []), width=3).count() == 0


def test_bit_sliced_links_of_planted_prints():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    close = base[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    prints = np.unique(np.concatenate([base, close]))[:, None]
    for radius in (1, 3, 9):
        a, b = simhash.links_within(prints, radius, np.arange(64), block=256, chunk=64)
        fps = [int(x) for x in prints[:, 0]]
        want = plain_classes(fps, list(range(len(fps))), radius)
        label = list(range(len(fps)))
        for i, j in zip(a.tolist(), b.tolist()):
            assert bin(fps[i] ^ fps[j]).count("1") <= radius
            x, y = label[i], label[j]
            label = [min(x, y) if v in (x, y) else v for v in label]
        assert label == want


def test_large_buckets_are_cut_without_loss(spark):
    rng = np.random.default_rng(4)
    low = rng.choice(1 << 12, 900, replace=False).astype(np.uint64)  # all share 52 bits
    fps = np.unique(low)[:, None]
    df = spark.createDataFrame([(bytearray(x.astype(">u8").tobytes()),) for x in fps], "fp binary")
    links = simhash.linked(df, simhash.pigeonhole_tables(len(fps), 3), 1, 3, len(fps), bucket_rows=100)
    roots = {bytes(r.node): bytes(r.root) for r in components(links).collect()}
    ints = [int(x) for x in fps[:, 0]]
    want = plain_classes(ints, ints, 3)
    got = [int.from_bytes(roots.get(x.to_bytes(8, "big"), x.to_bytes(8, "big")), "big") for x in ints]
    assert got == want


def test_pigeonhole_tables_cover_every_pair():
    for n in (10, 1 << 23, 1 << 33):
        tables = simhash.pigeonhole_tables(n, 3)
        rng = random.Random(n)
        for _ in range(300):
            changed = set(rng.sample(range(64), 3))
            assert any(not changed & set(t.tolist()) for t in tables)


def test_near_copies_by_similarity(spark):
    rng = random.Random(9)
    rows, similar = [], {}
    for i in range(150):
        w = ["w%d" % rng.randint(0, 5000) for _ in range(rng.randint(60, 300))]
        v = list(w)
        for k in rng.sample(range(len(w)), max(1, len(w) // (100 if i % 3 else 25))):
            v[k] = "changed%d" % rng.randint(0, 1 << 30)
        sets = [{tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (w, v)]
        similar[i] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(i, " ".join(w)), (1000 + i, " ".join(v)), (2000 + i, " ".join(w[: len(w) // 2] + ["n%d_%d" % (i, j) for j in range(len(w))]))]
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, rows), similarity=0.8).collect()}
    near = [i for i, s in similar.items() if s >= 0.8]
    assert len(near) > 70 and sum(classes[1000 + i] == i for i in near) >= 0.95 * len(near)
    far = [i for i, s in similar.items() if s < 0.7]
    assert len(far) > 20 and sum(classes[1000 + i] == i for i in far) <= 0.05 * len(far)
    assert all(classes[2000 + i] == 2000 + i and classes[i] == i for i in range(150))  # a half in common is not a copy


def test_similarity_is_decided_exactly(spark):
    rng = random.Random(21)
    rows, similar = [], {}
    for i in range(300):
        w = ["w%d" % rng.randint(0, 1 << 30) for _ in range(404)]
        # runs of changed words: 400 shingles, n + 4 of them changed, (396 - n) / (404 + n) in common
        n, at = (40, 41, 44, 50)[i % 4], rng.randint(4, 300)
        v = w[:at] + ["c%d" % rng.randint(0, 1 << 30) for _ in range(n)] + w[at + n :]
        sets = [{tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (w, v)]
        similar[i] = (len(sets[0] & sets[1]), len(sets[0] | sets[1]))
        rows += [(i, " ".join(w)), (1000 + i, " ".join(v))]
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, rows), similarity=0.8).collect()}
    near = [i for i, (both, all_) in similar.items() if 10 * both >= 8 * all_]
    assert len(near) == 75 and sum(classes[1000 + i] == i for i in near) >= 73
    assert all(classes[1000 + i] == 1000 + i for i in similar if i not in near)


@pytest.mark.parametrize("lot", [1, 7, 256])
def test_exact_links_of_chains(lot):
    # what lies within the radius but is not similar must not hide links that are
    rng = random.Random(22)
    bases = [["b%d_%d" % (k, i) for i in range(80)] for k in range(6)]
    texts = []
    for i in range(120):
        w = list(bases[i % 6])
        for k in rng.sample(range(80), rng.randint(0, 4)):
            w[k] = "c%d" % rng.randint(0, 1 << 30)
        texts.append(" ".join(w).encode())
    prints = simhash.fingerprints_of(texts, 5, 32, True)
    sets = [{tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (t.split() for t in texts)]
    a, b = simhash.links_within(prints, 2048, np.arange(2048), block=64, chunk=16, similar=simhash.Shingles(texts, 5, 0.8).similar, lot=lot)
    got, want = list(range(120)), list(range(120))
    pairs = [(i, j) for i in range(120) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    for label, links in ((got, zip(a.tolist(), b.tolist())), (want, pairs)):
        for i, j in links:
            x, y = label[i], label[j]
            label[:] = [min(x, y) if v in (x, y) else v for v in label]
    assert 6 < len(set(want)) < 100 and got == want


@pytest.mark.parametrize("seed, size", [(0, 12), (1, 40)])
def test_large_classes_are_cut_without_loss(spark, seed, size):
    # two clouds of near copies, chains, and strangers, all under one key, with parts far smaller
    rng = random.Random(seed)
    fresh = lambda n: ["c%d" % rng.randint(0, 1 << 40) for _ in range(n)]
    texts, clouds = [], [fresh(120), fresh(120)]
    for i in range(90):
        w = list(clouds[i % 3 == 0])
        for k in rng.sample(range(120), rng.randint(0, 3)):
            w[k] = fresh(1)[0]
        texts.append(w)
    for _ in range(4):  # each is similar to the one before alone
        w = fresh(100)
        for _ in range(6):
            texts.append(w)
            w = w[9:] + fresh(9)
    texts += [fresh(60) for _ in range(20)]
    rng.shuffle(texts)
    texts = [" ".join(w) for w in texts]
    prints = simhash.fingerprints_of([t.encode() for t in texts], 5, 32, True)
    rows = [(i.to_bytes(8, "big"), bytearray(p.astype(">u8").tobytes()), 0, 7, t) for i, (p, t) in enumerate(zip(prints, texts))]
    keyed = spark.createDataFrame([(bytearray(a), b, t, k, x) for a, b, t, k, x in rows], "fp binary, print binary, t int, key long, text string")
    sets = [{tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    links = simhash.class_links(keyed, 32, simhash.radius_of(0.8, 32, 5.0), 0.8, 5, size)
    roots = {int.from_bytes(bytes(r.node), "big"): int.from_bytes(bytes(r.root), "big") for r in components(links).collect()}
    assert [roots.get(i, i) for i in range(len(texts))] == label
    assert len(set(label)) > 20 and max(label.count(x) for x in set(label)) > 30


def test_recall_by_bands(spark):
    """Lone pairs from just at the similarity on, against what is decided by comparing all pairs."""
    rng = random.Random(33)
    rows, similar = [], {}
    for i in range(900):
        n = rng.choice([150, 400, 800])
        w = ["w%d" % rng.randint(0, 1 << 30) for _ in range(n + 4)]
        wanted = 0.8 + 0.2 * ((i % 90) + 0.01) / 90
        run = max(0, int((n - 4 * wanted - n * wanted) / (1 + wanted)))  # a run of changed words changes run + 4 shingles
        at = rng.randint(4, n - run)
        v = w[:at] + ["c%d" % rng.randint(0, 1 << 30) for _ in range(run)] + w[at + run :]
        sets = [{tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (w, v)]
        similar[i] = (len(sets[0] & sets[1]), len(sets[0] | sets[1]))
        rows += [(i, " ".join(w)), (10_000 + i, " ".join(v))]
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, rows), similarity=0.8).collect()}
    bands = {}
    for i, (both, whole) in similar.items():
        if 10 * both >= 8 * whole:
            bands.setdefault(min(3, int((both / whole - 0.8) / 0.05)), []).append(classes[10_000 + i] == i)
        else:
            assert classes[10_000 + i] == 10_000 + i
    assert sorted(bands) == [0, 1, 2, 3] and all(len(x) > 100 for x in bands.values())
    assert all(np.mean(x) >= 0.97 for x in bands.values()), {k: np.mean(x) for k, x in bands.items()}


def test_probability_of_a_lone_pair():
    """The product of what can lose a pair of just the similarity: the tables and the two radii."""
    p = simhash.differing(0.8)
    for n in (10**4, 10**6, 10**8):
        tables = simhash.random_tables(n, 0.8, 4, 0.995)
        lost = np.prod([1 - (1 - p) ** len(t) for t in tables])
        within = lambda bits, radius: sum(math.exp(math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(p) + (bits - k) * math.log(1 - p)) for k in range(radius + 1))
        product = (1 - lost) * within(256, simhash.radius_of(0.8, 4, 3.0)) * within(2048, simhash.radius_of(0.8, 32, 5.0))
        assert product > 0.99


def test_keep_one(spark):
    rows = odd_rows()
    kept = simhash.keep_one(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    got = kept.collect()
    texts = [r.text for r in got]
    assert sum(t is not None and t == odd_rows()[0][1] for t in texts) == 1
    assert len([t for t in texts if not (t or "").split()]) == 1  # texts without words are one class
    assert {r.doc_id for r in got} >= {1, 6}
    assert simhash.keep_one(table(spark, [])).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (101, 102), (100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(links.where("a > 1000")).count() == 0
