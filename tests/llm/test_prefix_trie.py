"""The prefix trie against a plain trie of whole sequences."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from clearwell.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, name int"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def _key(role, text):
    return f"{len(role)}:{role}{text}"


def _sequences(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            key = _key(role or "", text or "")
            found[conv].append((turn is not None, turn or 0, hashlib.sha256(key.encode()).digest(), key, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    return {c: [(k, w) for *_, k, w in sorted(x)] for c, x in found.items()}


def _rebuilt(sequences):
    return {c: sequences.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + own[h:] for c, own in sequences.items()}


def _brute(sequences):
    members, words = defaultdict(list), {}
    for c, sequence in sequences.items():
        for d in range(len(sequence) + 1):
            key = tuple(k for k, _ in sequence[:d])
            members[key].append(c)
            words[key] = sequence[d - 1][1] if d else 0
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    rows = []
    for key, convs in members.items():
        below, todo = [], [key]
        while todo:
            below.append(todo.pop())
            todo += children[below[-1]]
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(key))
        rows.append((
            min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), len(children[key]), sum(not children[k] for k in below),
            sum((len(members[k]) - 1) * words[k] for k in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def _got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def _random(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), convs):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", None])
            text = rng.choice(["a b", "a  b c", "", None, "x", "y\nz w"])
            rows.append((c, rng.choice([t, t, t, None, 0]), role, text))
    rows += [(2000, t, "user", f"w {t % 3}") for t in range(70)] + [(2001, t, "user", f"w {t % 3}") for t in range(70)] + [(2003, t, "user", f"w {t % 3}") for t in range(50)]
    rows += [(None, 1, "user", "left out"), rows[0], rows[0]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt_trie_equals_brute_force(spark, seed):
    rows = _random(seed)
    found = pt.prefix_trie(*pt.shared_openings(pt.turns(_frame(spark, rows).repartition(3))))
    assert _got(found) == _brute(_rebuilt(_sequences(rows)))


def test_turns_are_counted_across_tasks(spark):
    """One conversation holds most rows, and ties have one order."""
    rows = [(7, t // 2, "user", str(t)) for t in range(3000)] + [(c, 0, "user", "x") for c in range(30)]
    found = defaultdict(list)
    for r in pt.turns(_frame(spark, rows).repartition(4)).collect():
        found[r["conv"]].append((r["pos"], bytes(r["digest"])))
    want = {c: [(i + 1, hashlib.sha256(k.encode()).digest()) for i, (k, _) in enumerate(x)] for c, x in _sequences(rows).items()}
    assert {c: sorted(x) for c, x in found.items()} == want


def test_trie_of_plain_sequences_with_empty_and_equal_ones(spark):
    sequences = {5: "abcde", 3: "abcde", 9: "abc", 1: "", 4: "", 12: "xbc", 2: "a" * 33}
    rows = [(c, i + 1, k.encode(), len(k)) for c, s in sequences.items() for i, k in enumerate(s)]
    found = pt.prefix_trie(spark.createDataFrame(rows, "conv long, pos long, digest binary, words long"), spark.createDataFrame([(c, len(s)) for c, s in sequences.items()], "conv long, length long"))
    assert _got(found) == _brute({c: [(k, 1) for k in s] for c, s in sequences.items()})


def test_only_empty_sequences_and_none(spark):
    nothing = spark.createDataFrame([], "conv long, pos long, digest binary, words long")
    lengths = spark.createDataFrame([(3, 0), (1, 0)], "conv long, length long")
    assert _got(pt.prefix_trie(nothing, lengths)) == [(1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,3").hexdigest())]
    assert _got(pt.prefix_trie(nothing, lengths.limit(0))) == []
    assert _got(pt.prefix_trie(*pt.shared_openings(pt.turns(_frame(spark, []))))) == []


def test_ids_of_large_groups_are_hashed_in_ranges(spark):
    ids = random.Random(3).sample(range(-500, 5000), 900)
    rows = [(0, 0, c) for c in ids] + [(1, 0, 5)]
    found = pt.joined_ids_sha256(spark.createDataFrame(rows, "name long, depth long, conv long"), ["name", "depth"], chunk=100)
    want = {0: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), 1: hashlib.sha256(b"5").hexdigest()}
    assert {r["name"]: r["ends_sha256"] for r in found.collect()} == want
