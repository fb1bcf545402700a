"""Tokenizer alignment and token files against plain versions over whole texts."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from clearwell.llm import alignment, token_files
from clearwell.llm.library_bpe import PieceEncoder, byte_letters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")

TEXTS = [
    None, "", " ", "a", " a", "a ", "a  b", "a\tb", "one.\nTwo  three", "naïve café, größe.", "日本語 テキスト 12,345", "<|endoftext|> x", "x <|endoftext|>",
    "under▁score and more", "  hard space", "emoji 🙂🙃 end", "it's we'll I'd", "﻿mark \x00 zero", "a\r\nb \n c", "é combining", "<0x41> <s> </s>",
    "the the the the", "the the the the", "x" * 3000, " ".join(["longer words repeat"] * 400), "ﬁ ligature Ǆ Ω ß ŉ", "tail.  ", "... ,,, !!", "ok.", "ok,", "a.b.c",
]


def _rows(texts):
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def _brute(texts, tokenizers):
    """Groups and links of whole texts, one after the other, without pieces."""
    a, b = tokenizers
    byte = {c: i for i, c in enumerate(byte_letters())}
    found, counts = [], Counter()
    for text in texts:
        if not text:
            found.append(None)
            continue
        whole = f" {text}".encode()
        ids = [a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)]
        raw = [
            [bytes(byte[c] for c in a.id_to_token(i)) for i in ids[0]],
            [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]],
        ]
        if any(b"".join(x) != whole for x in raw):
            found.append(None)
            continue
        spans = []
        for side in raw:
            at, out = 0, []
            for x in side:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        text_of = lambda side, low, high: ",".join(str(i) for i, (s, _) in zip(ids[side], spans[side], strict=True) if low <= s < high)
        groups = ";".join(f"{text_of(0, low, high)}|{text_of(1, low, high)}" for low, high in zip([0, *cuts], cuts, strict=False)) if len(whole) < 4000 else None
        links, first = [], 0
        for i, (s, e) in zip(ids[0], spans[0], strict=True):
            while spans[1][first][1] <= s:
                first += 1
            for j, (s2, _) in zip(ids[1][first:], spans[1][first:], strict=True):
                if s2 >= e:
                    break
                links.append((i, j))
        counts.update(links)
        found.append((len(ids[0]), len(ids[1]), len(cuts), links, groups))
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    result = []
    for one in found:
        if one is None:
            result.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, groups = one
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups is not None else None
        result.append((n_a, n_b, n_groups, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return result


def _check(spark, texts, tokenizers, **options):
    docs = spark.createDataFrame(_rows(texts), "doc_id long, text string").withColumn("block", F.lit("clash")).withColumn("n_a", F.lit("clash"))
    rows = alignment.align_counts(docs.repartition(3), A, B, **options).collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in rows}
    assert len(rows) == len(texts)
    for i, want in enumerate(_brute(texts, tokenizers)):
        assert got[i][:6] == want[:6], (i, texts[i])
        if want[6] is not None:
            assert got[i][6] == want[6], (i, texts[i])


def test_alignment_equals_whole_texts(spark, tokenizers):
    _check(spark, TEXTS, tokenizers)


def test_alignment_of_random_texts_in_small_blocks(spark, tokenizers):
    rng = random.Random(5)
    letters = ["a", "b", "e", "th", "er", "ing", " ", " ", "  ", "\n", ".", ",", "é", "ß", "日", "▁", "'s", "7", " ", "🙂"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    _check(spark, texts, tokenizers, block=500)


def test_alignment_of_null_and_repeated_ids_and_of_nothing(spark, tokenizers):
    docs = spark.createDataFrame([(None, "the cat"), (None, "the cat"), (1, "the dog"), (1, None)], "doc_id long, text string")
    rows = alignment.align_counts(docs, A, B).collect()
    want = dict(zip(["the cat", "the dog"], [_brute(["the cat", "the cat", "the dog"], tokenizers)[i] for i in (0, 2)], strict=True))
    assert sorted((r["doc_id"] or -1, *tuple(r)[1:]) for r in rows) == sorted([(-1, *want["the cat"])] * 2 + [(1, *want["the dog"]), (1, 0, 0, 0, 0, 0, 0, "")])
    assert alignment.align_counts(docs.limit(0), A, B).count() == 0


def test_terminals_of_long_chains():
    """Two offset tilings form one chain, which doubling walks in a few rounds."""
    n = 5000
    a = np.arange(n + 1) * 2
    b = np.concatenate(([0], np.arange(n) * 2 + 1, [2 * n]))
    label = alignment.terminals(a[:-1], a[1:], b[:-1], b[1:])
    assert set(label.tolist()) == {n - 1}


def test_pair_counts_sum_over_blocks(spark, tokenizers):
    texts = [t for t in TEXTS if t and len(t) < 100]
    docs = spark.createDataFrame(_rows(texts), "doc_id long, text string").repartition(4)
    _, blocks = alignment.align(docs, A, B, block=40)
    want = Counter(x for one in _links(texts, tokenizers) for x in one)
    rows = alignment.pair_counts(blocks).collect()
    assert {(r["a"], r["b"]): r["total"] for r in rows} == dict(want)
    assert all(r["best"] == (r["total"] == max(n for (_, j), n in want.items() if j == r["b"])) for r in rows)


def _links(texts, tokenizers):
    a, b = tokenizers
    byte = {c: i for i, c in enumerate(byte_letters())}
    for text in texts:
        ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        of_a = [i for i in ids_a for _ in bytes(byte[c] for c in a.id_to_token(i))]
        of_b = [i for i in ids_b for _ in (b"x" if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())]
        if len(of_a) != len(of_b) or "▁" in text:
            continue
        at_a = np.repeat(np.arange(len(ids_a)), [len(bytes(byte[c] for c in a.id_to_token(i))) for i in ids_a])
        at_b = np.repeat(np.arange(len(ids_b)), [1 if b.is_byte(i) else len(b.id_to_piece(i).replace("▁", " ").encode()) for i in ids_b])
        yield [(ids_a[x], ids_b[y]) for x, y in sorted(set(zip(at_a.tolist(), at_b.tolist(), strict=True)))]


# --- token files --------------------------------------------------------------------
def _ids(texts):
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    return [a.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def _written(spark, tmp_path, rows, schema="doc_id long, text string", **options):
    docs = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs.repartition(3), path, A, **options)
    return path


def test_token_files_round_trip(spark, tmp_path):
    rows = _rows(TEXTS)
    path = _written(spark, tmp_path, random.Random(1).sample(rows, len(rows)), files=4)
    got = sorted(token_files.read_tokens(spark, path).collect())
    start = 0
    for row, ids in zip(got, _ids(TEXTS), strict=True):
        assert (row["start"], row["n_tokens"], row["ids"]) == (start, len(ids), ids)
        start += len(ids)
    crcs = {r["doc_id"]: r["ids_crc32"] for r in token_files.crc32_of(token_files.read_tokens(spark, path)).collect()}
    assert crcs == {i: zlib.crc32(np.array(ids, "<u4").tobytes()) for i, ids in enumerate(_ids(TEXTS))}


def test_pieces_get_the_library_s_ids():
    encoder = PieceEncoder(A)
    pieces = ["word", "Größe,", "x.", "..", "ok,", "é", "it's", "日本", "A1", "ŉ", "ɏ", "mid.dle", "."]
    flat, sizes = encoder.pieces(pieces)
    ends = sizes.cumsum().tolist()
    assert [flat[i:j].tolist() for i, j in zip([0, *ends], ends, strict=False)] == [encoder.text(f" {p}") for p in pieces]
    assert [len(x) for x in encoder.pieces([])] == [0, 0]
    pieces += ["\nWord,", "\n", "\nañb", "\n3.", "\n\nx"]
    ids, start, size = encoder.coded(pieces, lines=True)
    assert [ids[i : i + n].tolist() for i, n in zip(start, size, strict=True)] == [encoder.text(p if p[0] == "\n" else f" {p}") for p in pieces]


def test_ids_of_texts_with_little_room_for_pieces():
    rng = random.Random(8)
    letters = ["a", "b", "th", "er", " ", " ", " ", "  ", "\n", ".", "é", "\u00a0", "\u2003", "\x1c", "\x85", "日", "<|endoftext|>", "'s", "7"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(600)] + TEXTS
    known = token_files._Ids(A, room=50)
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        assert [x.tolist() for x in known.texts(pa.array(part, pa.string()))] == [x[:-1] for x in _ids(part)]
    assert len(known.place) < 2000


def test_pieces_that_differ_in_marks_are_kept_once():
    """A word is merged once, whatever marks follow it; marks, line feeds and other scripts have the library's ids."""
    known = token_files._Ids(A)
    text = "x " + " ".join(w + m for w in ("Größe", "word", "ñu") for m in ("", ".", ",", "!", '")', "...", "?!", "]", "--", "`"))
    assert [x.tolist() for x in known.texts(pa.array([text, None, ""]))] == [x[:-1] for x in _ids([text, None, ""])]
    assert len(known.place) == 5  # the words and the first pieces of the texts
    rng = random.Random(9)
    words = ["a", "Ab", "zzyzx", "Größe", "日本", "ŉ", "7", "it's", "don", "x1", "", "é"]
    runs = ["", "", ".", ",", "...", "'", "--", "!?", '")', "[]", "\\", "~", "—", "s", "\n", "\n\n", "@x.com", "_", "^`", "…"]
    texts = [" ".join(rng.choice(["", "", "\n", "("]) + rng.choice(words) + rng.choice(runs) for _ in range(rng.randrange(30))) for _ in range(1500)]
    for room in (40, 10_000):
        known = token_files._Ids(A, room=room)
        for i in range(0, len(texts), 300):
            part = pa.array(texts, pa.string()).slice(i, 300)
            assert [x.tolist() for x in known.texts(part)] == [x[:-1] for x in _ids(texts[i : i + 300])]
    assert [len(x) for x in token_files._Ids(A).texts(pa.array(["<|endoftext|>", None, ""], pa.string()))] == [1, 0, 0]


def test_token_files_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "b"), (None, "a"), (3, "same"), (3, "same"), (3, None), (1, "one two")]
    path = _written(spark, tmp_path, [(*r, "clash", 1) for r in rows], "doc_id long, text string, ids string, part int", files=3)
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 3, 3, 3]
    assert got[0]["start"] == 0 and all(x["start"] + x["n_tokens"] == y["start"] for x, y in zip(got, got[1:], strict=False))
    assert Counter(tuple(r["ids"]) for r in got) == Counter(map(tuple, _ids([t for _, t in rows])))


def test_token_files_of_an_empty_table(spark, tmp_path):
    path = _written(spark, tmp_path, [])
    assert token_files.read_tokens(spark, path).count() == 0
    assert token_files.crc32_of(token_files.read_tokens(spark, path)).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert token_files.read_range(spark, path, 0, 10).count() == 0


def test_token_files_ranges(spark, tmp_path):
    path = _written(spark, tmp_path, _rows(TEXTS), files=5)
    flat = [i for ids in _ids(TEXTS) for i in ids]
    for first, stop in [(0, 10), (7, 8), (100, 2500), (0, len(flat)), (len(flat), len(flat) + 5)]:
        parts = token_files.read_range(spark, path, first, stop).orderBy("start").collect()
        assert [i for r in parts for i in r["ids"]] == flat[first:stop]
        assert not parts or parts[0]["start"] == first


def test_token_files_layout_and_selective_reads(spark, tmp_path):
    """Dictionary pages for ids, delta pages for numbers, a page index, and several pages and row groups of the set size."""
    rng = random.Random(2)
    rows = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(60))) for i in range(3000)]
    path = _written(spark, tmp_path, rows, files=1, row_group=64 << 10, page=8 << 10, page_rows=100)
    file = next((tmp_path / "tokens" / "tokens").glob("*.parquet"))
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups > 2
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["offset"].encodings
    ids = next(c for name, c in columns.items() if name.startswith("ids"))
    assert "RLE_DICTIONARY" in ids.encodings and ids.has_offset_index
    assert columns["doc_id"].has_column_index
    plan = token_files.read_tokens(spark, path, F.col("doc_id") == 1500, tokens=False)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1500)" in plan
    assert "ids:array" not in plan.split("Physical Plan")[-1].split("ReadSchema")[1].split("\n")[0]
    one = token_files.read_tokens(spark, path, F.col("doc_id") == 1500).collect()
    assert len(one) == 1 and one[0]["ids"] == _ids([rows[1500][1]])[0]
