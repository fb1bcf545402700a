"""Operators on whole tables against brute force: duplicates, benchmark windows, the language model, the classifier."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearwell.llm import classifier, interpolation, pivots, simhash, suffix_trees, templates
from clearwell.llm.components import components
from clearwell.llm.suffix_trees import digests, without_repeats
from clearwell.llm.words import symbols

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def smallest(nodes, links):
    """Smallest node reachable from each."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_random_links(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest({x for pair in links for x in pair}, links)
    assert got == {n: want[n] for n in got} and set(got) >= {x for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- substring deduplication --------------------------------------------------------
def brute_dedup(rows):
    first = {}
    for i, text in rows:
        w = words(text)
        for s in range(len(w) - 49 if i is not None else 0):
            key = tuple(w[s : s + 50])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        covered = [False] * len(w)
        for s in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[s : s + 50])] < i:
                covered[s : s + 50] = [True] * 50
        kept = " ".join(x for x, c in zip(w, covered, strict=True) if not c)
        out.append((i, len(w), sum(covered), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(spark):
    rng = random.Random(1)
    passages = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(70)) for _ in range(3)]
    noise = lambda n: " ".join(str(rng.randint(0, 99999)) for _ in range(n))
    rows = [
        (10, f"{noise(20)} {passages[0]} {noise(9)}"), (3, passages[0]), (3, passages[0]), (7, f"{passages[1]} {passages[1]}"), (7, f"x {passages[1]}"), (None, passages[1]),
        (9, None), (11, ""), (12, passages[0]), (13, "a " * 300), (14, "a " * 80 + passages[2]), (2, "b c " * 60 + passages[2][:200]), (30, "b c " * 60), (31, "z\x1cy " * 55), (1, "z\x1cy\t" * 52),
        *[(100 + i, f"{noise(5)} {passages[2]} {noise(5)}") for i in range(40)],
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sha string, n_words int")
    want = brute_dedup(rows)
    for most in (10**6, 5):  # one prefix length, and all of them
        assert sorted(map(tuple, suffix_trees.deduplicate(df, most=most).collect()), key=str) == want
    assert suffix_trees.deduplicate(df.limit(0)).count() == 0


def test_kept_texts_and_removed_spans(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a  b {passage}"), (2, f"x {passage}\ty {passage} z"), (3, f"a b {passage}"), (3, "short"), (4, "short"), (None, passage), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [
        (1, 62, [], f"a b {passage}"), (2, 123, [(1, 61), (62, 122)], "x y z"), (3, 62, [(0, 62)], ""), (3, 1, [], "short"), (4, 1, [], "short"),
        (None, 60, [], passage), (5, 0, [], ""),
    ]
    for most_ids in (1_000_000, 0):  # broadcast, and by shuffle
        got = suffix_trees.without_repeats(df, most_ids=most_ids).collect()
        assert sorted(((r["doc_id"], r["n_words"], [tuple(s) for s in r["removed"]], r["kept"]) for r in got), key=str) == sorted(want, key=str)


# --- vectors ------------------------------------------------------------------------
def test_vector_links(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    rows = [(i, (centres[i % 60] + rng.normal(size=32) * 0.12 * (i % 3)).tolist()) for i in range(400)]
    rows += [(1000 + i, centres[0].tolist()) for i in range(30)] + [(2000, (centres[1] * 5).tolist()), (2001, None), (2002, [0.0] * 32), (2003, [float("nan")] * 32), (2004, [None] + [1.0] * 31), (2005, [])]
    rows += [(2006, centres[2].tolist()[:16]), (2007, centres[2].tolist()[:16]), (2008, [float("inf")] + [1.0] * 31)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n_links int")
    sound = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(sound)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] >= 0.95]
    count = Counter(x for pair in links for x in pair)
    component = smallest([i for i, _ in rows], links)
    for block in (4096, 16):  # whole lists, and lists split into blocks
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivots.link_vectors(df, block=block).collect()}
        missed = sum(count[i] for i, _ in rows) - sum(g[0] for g in got.values())
        assert len(got) == len(rows) and 0 <= missed <= 0.02 * sum(count.values())
        assert all(got[i][0] <= count[i] for i, _ in rows)
        assert sum(got[i][1] != component[i] for i, _ in rows) <= 4
        assert all(k == (c == i) for i, (_, c, k) in got.items())
    assert pivots.link_vectors(df.limit(0)).count() == 0


def test_vector_links_of_a_large_group_of_noisy_copies(spark):
    rng = np.random.default_rng(11)
    centre = rng.normal(size=64)
    group = centre + rng.normal(size=(2500, 64)) * 0.21
    vectors = np.concatenate([group, rng.normal(size=(5000, 64))])
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = units @ units.T >= 0.95
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    want = (close.sum(axis=1) - 1).tolist()
    component = smallest(range(len(vectors)), np.argwhere(np.triu(close, 1)).tolist())
    for block in (4096, 700):  # a ball in one block, and in pairs of blocks
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.link_vectors(df, block=block).collect()}
        missed = sum(want) - sum(g[0] for g in got.values())
        assert sum(want) > 1_000_000 and 0 <= missed <= 0.001 * sum(want)
        assert all(got[i][0] <= n for i, n in enumerate(want)) and sum(got[i][1] != component[i] for i in got) <= 4


def test_vectors_of_a_length_without_a_pivot_link(spark):
    rng = np.random.default_rng(12)
    rare = rng.normal(size=5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(3000)] + [(9000 + i, (rare + i * 0.01).tolist()) for i in range(3)]
    got = {r["vec_id"]: r["n_links"] for r in pivots.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), most_pivots=2).collect()}
    assert [got[9000 + i] for i in range(3)] == [2, 2, 2]


# --- SimHash ------------------------------------------------------------------------
def brute_fingerprint(text):
    import xxhash

    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rng = random.Random(8)
    base = [[rng.choice(["tion", "ing", "the", "Of", "é"]) + str(rng.randint(0, 300)) for _ in range(rng.randint(1, 120))] for _ in range(40)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        b = list(b)
        b[rng.randrange(len(b))] = "changed"
        rows += [(100 + i, " ".join(b)), (200 + i, " ".join(base[i]).upper() if i % 2 else " ".join(base[i]))]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "one"), (304, "one two")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, fingerprint int")
    prints = {i: brute_fingerprint(t) for i, t in rows}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    component = smallest(prints, links)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (f"{prints[i]:016x}", component[i]) for i in prints}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_hamming_balls_find_every_near_fingerprint(spark):
    rng = random.Random(6)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(4):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r["a"], r["b"]) for r in simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fingerprint long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want


# --- benchmark ----------------------------------------------------------------------
QUESTION = "If Anna buys 12 apples for 30 dollars and Bert buys 12 pears how much does Anna pay in total"


def test_decontamination(spark):
    bench = spark.createDataFrame([(7, QUESTION), (8, "the quick brown fox jumps over the lazy dog again"), (9, None), (10, "too short")], "item_id long, text string")
    texts = {
        1: "x y z. if Carla buys 17 apples for 45 euros, and Dora buys 17 pears how much does Carla pay in total? yes",
        2: "If Carla buys 17 apples for 45 euros and Dora buys 18 pears how much does Elsa pay in total, Fred buys",
        3: None, 4: "", 5: f"before {QUESTION} after", 6: QUESTION.upper(), 11: "THE QUICK brown fox - jumps over the lazy dog, again!", 12: "the quick brown fox jumps over nothing at all today", 13: "too short",
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(5, texts[5], "x")], "doc_id long, text string, item_ids string")
    kinds = {(r["doc_id"], r["item_id"]): r["kind"] for r in templates.leaks(df, bench).collect()}
    assert kinds[1, 7] == "reparameterised" and kinds[5, 7] == "verbatim" and kinds[6, 7] == "verbatim" and kinds[11, 8] == "verbatim"
    rows = templates.decontaminate(df, bench).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([*texts, 5])
    flagged = {r["doc_id"]: r["item_ids"] for r in rows if r["contaminated"]}
    assert {i for i in flagged if i not in (2,)} == {1, 5, 6, 11}
    assert templates.decontaminate(df, bench.limit(0)).where("contaminated").count() == 0
    assert templates.decontaminate(df.limit(0), bench).count() == 0


def test_short_capitalised_and_numeric_items_are_found(spark):
    numeric = "2 4 8 16 32 64 128 and 256"
    bench = spark.createDataFrame([(7, QUESTION), (8, "What is 17*24?"), (9, numeric), (10, "Ottawa"), (11, "?!")], "item_id long, text string")
    texts = {
        1: f"x {QUESTION.title()} y", 2: "they ask: what is 17 * 24, and why", 3: "what is 18 * 24", 4: f"so {numeric} then", 5: "3 5 9 17 33 65 129 and 257",
        6: "capital: OTTAWA.", 7: QUESTION.title().replace("Anna", "Carla"), 8: "nothing at all", 9: "?!",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in templates.leaks(df, bench, shortest=1).collect()}
    assert got == {(1, 7): "verbatim", (2, 8): "verbatim", (4, 9): "verbatim", (6, 10): "verbatim"}
    assert {r["item_id"] for r in templates.leaks(df, bench).collect()} == {7, 8, 9}


def test_inconsistent_slots_are_no_leak(spark):
    item = "Anna saw Bert and Anna met Bert while Anna told Bert that Anna likes Bert more than Bert likes Anna"
    other = "Carl saw Dora and Emil met Fred while Gina told Hans that Ines likes Jens more than Karl likes Lena"
    same = item.replace("Anna", "Carl").replace("Bert", "Dora")
    df = spark.createDataFrame([(1, other), (2, same)], "doc_id long, text string")
    got = [(r["doc_id"], r["kind"]) for r in templates.leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()]
    assert got == [(2, "reparameterised")]


# --- language model -----------------------------------------------------------------
def test_interpolated_model(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 60))).title()) for i in range(300)] + [(500, None), (501, ""), (3, "W1 W2"), (502, "unseen1 unseen2")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, score int")
    part_of = lambda i: {2: 2, 6: 1}.get(zlib.crc32(str(i).encode()) % 7, 0)
    fold = classifier.fold(7)
    part = F.when(fold == 2, 2).when(fold == 6, 1).otherwise(0)
    tokens = [(i, [*words((t or "").lower()), "\n"]) for i, t in rows]
    learned = Counter(w for i, ws in tokens if part_of(i) != 2 for w in ws)
    n, kinds = sum(learned.values()), len(learned)
    want = sorted((i, len(ws), sum(learned[w] > 0 for w in ws), n, round(sum(math.log10((learned[w] + 1) / (n + kinds + 1)) for w in ws), 6)) for i, ws in tokens)
    got = interpolation.score_texts(df, part, grid=1e-4).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    pairs = Counter((a, b) for i, ws in tokens if part_of(i) != 2 for a, b in zip(["<"] + ws, ws, strict=False))
    before = Counter(a for a, _ in pairs.elements())
    alone = Counter((a, b) for i, ws in tokens if part_of(i) == 0 for a, b in zip(["<"] + ws, ws, strict=False))
    alone_before, alone_words = Counter(a for a, _ in alone.elements()), Counter(w for i, ws in tokens if part_of(i) == 0 for w in ws)
    size = sum(alone_words.values())
    grid = []
    for i, ws in tokens:
        if part_of(i) == 1:
            for a, b in zip(["<"] + ws, ws, strict=False):
                c = alone_before[a]
                grid.append((interpolation.bucket(np.array([c]))[0], alone[a, b] / max(1, c), alone_words[b] / size, 1 / (kinds + 1), 1))
    weights = interpolation.learn_weights(np.array(grid, dtype=float))
    model = {}
    for i, ws in tokens:
        total = 0.0
        for a, b in zip(["<"] + ws, ws, strict=False):
            w = weights[interpolation.bucket(np.array([before[a]]))[0]]
            total += math.log10(w[0] * pairs[a, b] / max(1, before[a]) + w[1] * learned[b] / n + w[2] / (kinds + 1))
        model[i, len(ws)] = total
    for r in got:
        assert r["score"] == pytest.approx(model[r["doc_id"], r["n_tokens"]], rel=1e-3)
    held_out = [r for r in got if part_of(r["doc_id"]) == 2 and r["n_tokens"] > 5]
    assert sum(r["score"] for r in held_out) > sum(r["base_score"] for r in held_out) - 30
    assert interpolation.score_texts(df.limit(0), part).count() == 0
    unlearned = interpolation.score_texts(df.limit(3), F.lit(2)).collect()
    assert all(r["base_score"] == 0 and r["train_tokens"] == 0 for r in unlearned)


def test_expectation_maximisation_prefers_what_predicts():
    grid = np.array([[5, 0.5, 0.01, 0.001, 900], [5, 0.0, 0.02, 0.001, 100], [1, 0.0, 0.01, 0.001, 50]])
    weights = interpolation.learn_weights(grid)
    assert weights[5, 0] > 0.8 and weights[1, 0] < 0.01 and np.allclose(weights.sum(axis=1), 1)


# --- classifier ---------------------------------------------------------------------
def test_quality_classifier(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["the", "stion", "hand", "where", "ing"]) for _ in range(80))
    bad = lambda: " ".join(rng.choice(["the", "stion", "hand"]) + rng.choice(["%%%", "###"]) for _ in range(80))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(240)]
    docs = spark.createDataFrame([(*r, 3) for r in [*rows, (900, None), (901, ""), (902, "x" * 50_000), (1, rows[1][1])]], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(240)] + [(1, None, 0), (None, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    space = classifier.fit(docs, labels, usable=classifier.fold(3) != 1, sample=100)
    assert len(space.labels) <= 101
    got = classifier.score(docs, space).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held_out = [r for r in got if r["doc_id"] < 240 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 != 0) for r in held_out]) >= 0.9
    kept = classifier.accepted(docs, space)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["score"] >= 0.5}
    nothing = classifier.fit(docs, labels.limit(0), usable=F.lit(True))
    assert {r["score"] for r in classifier.score(docs, nothing).collect()} == {0.5}
    assert classifier.score(docs.limit(0), space).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark):
    """Parts of an item in several rows of one id are no leak, and a clean row beside a leaking one stays."""
    item = "the quick brown fox jumps over the lazy dog again and then it sleeps under a tall tree"
    words = item.split()
    parts = [" ".join(words[i : i + 7]) + f" end{i}" for i in (0, 3, 6, 9, 11)]
    bench = spark.createDataFrame([(8, item)], "item_id long, text string")
    rows = [(None, p) for p in parts] + [(5, p) for p in parts] + [(6, f"so {item} it goes"), (6, "nothing of it here"), (None, f"and {item}"), (None, None), (7, item), (7, item)]
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, of int, item_id string")
    got = Counter((r["doc_id"], r["contaminated"]) for r in templates.decontaminate(docs, bench).collect())
    assert got == Counter({(None, False): 6, (None, True): 1, (5, False): 5, (6, True): 1, (6, False): 1, (7, True): 2})
    kept = templates.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([r for r in rows if item not in (r[1] or "")])
    assert templates.without_leaks(docs, bench.limit(0)).count() == len(rows) and templates.without_leaks(docs.limit(0), bench).count() == 0


def test_long_words_that_sums_do_not_tell_apart(spark):
    """A word of 2,048 letters and its complement, of which polynomial sums modulo 2**64 are equal."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    assert len(set(symbols(f"{word} {other} {word}".encode()).tolist())) == 2
    shared = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{shared} {word}"), (2, f"{shared} {other}"), (3, f"{shared} {word}")], "doc_id long, text string")
    removed = {r["doc_id"]: r["n_removed"] for r in digests(without_repeats(docs)).collect()}
    assert removed == {1: 0, 2: 0, 3: 50}


def test_the_fit_is_bounded_where_ids_repeat(spark):
    """Thousands of rows of one id are one labelled row, and their order does not matter."""
    rows = [(1, f"good text {i % 7} of words") for i in range(3000)] + [(i, f"bad {i} !!") for i in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 12)] + [(1, 1)], "doc_id long, quality int")
    space = classifier.fit(docs.repartition(5), labels, F.lit(True), sample=6)
    assert len(space.labels) <= 6
    whole = classifier.fit(docs.repartition(3), labels, F.lit(True), sample=100)
    assert len(whole.labels) == 11 and whole.labels.sum() == 1
