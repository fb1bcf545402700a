"""Ids of pieces by a byte-level BPE file of the ``tokenizers`` library."""

from __future__ import annotations

import codecs
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters of which every version of the Unicode tables says so.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ɏ]+"
#: ASCII marks, but for the apostrophe of contractions.
_SIGNS = r"[!-&(-/:-@\[-`{-~]+"
_WORD, _SIGNED, _LINE = rf"^{_LETTERS}[.,]?$", rf"^{_LETTERS}{_SIGNS}$", rf"^\n{_LETTERS}(?:{_SIGNS})?$"
_MARKS = ".,"
_SIGN = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # the characters of _SIGNS
_RUN = re.compile(_SIGNS)
_JOINED = 1000  # words that are given to the library as one string


def byte_letters() -> list[str]:
    """The character that a byte-level vocabulary writes for each of the 256 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class PieceEncoder:
    """Encodes pieces that follow a space, each as if it stood alone.

    A piece of letters is one pre-token under any byte-level pattern, and marks
    behind it another. Such words are written in the vocabulary's
    letters here and joined by line breaks, so that the library's merges need no
    search for pre-tokens, which is most of its work on rare words. Other pieces
    go through the whole tokenizer, as do all pieces where the file has a
    normaliser, a post-processor or another pre-tokenizer. ``special``: whether
    special strings in texts are special tokens.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import Split

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.whole.encode_special_tokens = not special
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()] if special else []
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        before, model = parts.get("pre_tokenizer") or {}, parts["model"]
        self.direct = (
            model.get("type", "BPE") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not parts.get("normalizer") and not parts.get("post_processor")
        )
        letters = byte_letters()
        self.space, self.shown = letters[0x20], "".join(letters[:10] + ["\n"] + letters[11:])  # line feeds part words here
        self.feed = self.text("\n")
        if self.direct:
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            self.words = Tokenizer(BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))  # each word comes once
            self.words.pre_tokenizer = Split("\n", "removed")
            tokens = self.whole.get_vocab(with_added_tokens=False)
            self.letters = np.zeros(max(tokens.values(), default=-1) + 1, np.int64)  # of each id
            self.letters[list(tokens.values())] = [len(t) for t in tokens]

    def text(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def coded(self, pieces: list[str], lines: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in any order, and for a space and each piece where its ids begin and how many there are.

        With ``lines`` a piece that begins with a line feed has no space before it.
        """
        texts, array = np.array(pieces, object), pa.array(pieces, pa.string())
        found = lambda pattern: pc.match_substring_regex(array, pattern).to_numpy(zero_copy_only=False)
        kind = np.full(len(pieces), 4)
        if self.direct:
            kind[found(_SIGNED)] = 2
            word = found(_WORD)
            kind[word] = pc.string_is_ascii(array).to_numpy(zero_copy_only=False)[word]
            if lines and len(self.feed) == 1:
                kind[found(_LINE)] = 3
        order = np.argsort(kind, kind="stable")
        kinds = np.split(order, np.cumsum(np.bincount(kind, minlength=5))[:-1])
        take = lambda k: texts[kinds[k]].tolist()
        parts = [self._words(take(0), ascii=False), self._words(take(1), ascii=True), self._words(take(2), ascii=False, runs=True)]
        ids, sizes = self._words([p[1:] for p in take(3)], ascii=False, lead="", runs=True)
        parts.append((np.insert(ids, np.cumsum(sizes) - sizes, self.feed), sizes + 1) if len(sizes) else (ids, sizes))
        others = [p if lines and p[:1] == "\n" else f" {p}" for p in take(4)]
        rest = [x.ids for x in self.whole.encode_batch_fast(others, add_special_tokens=False)]
        parts.append((np.array([x for one in rest for x in one], np.int64), np.array([len(x) for x in rest], np.int64)))
        size = np.empty(len(pieces), np.int64)
        start = np.empty(len(pieces), np.int64)
        sizes = np.concatenate([p[1] for p in parts])
        size[order], start[order] = sizes, np.cumsum(sizes) - sizes
        return np.concatenate([p[0] for p in parts]), start, size

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and each piece, one after the other, and how many each has."""
        ids, start, size = self.coded(pieces)
        ends = np.cumsum(size)
        return ids[np.repeat(start - (ends - size), size) + np.arange(len(ids))], size

    def parted(self, pieces: pa.StringArray) -> tuple[pa.StringArray, pa.BooleanArray]:
        """Pieces without the marks behind their letters, and whether a piece is of letters and marks. A line feed may come first."""
        if not self.direct:
            return pieces, pa.array(np.zeros(len(pieces), bool))
        feed = r"\n?" if len(self.feed) == 1 else ""
        word = pc.match_substring_regex(pieces, rf"^{feed}{_LETTERS}(?:{_SIGNS})?$")
        return pc.if_else(word, pc.utf8_rtrim(pieces, _SIGN), pieces), word

    def parts(self, parts: pa.StringArray, word: pa.BooleanArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`coded` for parts that :meth:`parted` gave: ids in any order, where those of each begin and how many there are."""
        word = word.to_numpy(zero_copy_only=False)
        order = np.argsort(~word, kind="stable")
        words, others = parts.filter(pa.array(word)), parts.filter(pa.array(~word)).to_pylist()
        ids, sizes = self._letters(words) if len(words) else (np.empty(0, np.int64), np.empty(0, np.int64))
        rest = [x.ids for x in self.whole.encode_batch_fast([p if p[:1] == "\n" else f" {p}" for p in others], add_special_tokens=False)]
        sizes = np.concatenate((sizes, np.array([len(x) for x in rest], np.int64)))
        size, start = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        size[order], start[order] = sizes, np.cumsum(sizes) - sizes
        return np.concatenate((ids, np.array([x for one in rest for x in one], np.int64))), start, size

    def marks(self, run: str) -> list[int]:
        """The ids of marks behind letters."""
        return self.words.encode(run, add_special_tokens=False).ids

    def _letters(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        feed = pc.starts_with(words, "\n")
        lines = pc.binary_join_element_wise(pc.if_else(feed, "", " "), pc.utf8_ltrim(words, "\n"), "\n", "")
        ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
        data, cuts = memoryview(lines.buffers()[2]), [*ends[:-1:_JOINED].tolist(), int(ends[-1])]
        batch = [codecs.charmap_decode(data[a : b - 1], "strict", self.shown)[0] for a, b in zip(cuts, cuts[1:], strict=False)]
        flat = np.concatenate([np.array(x.ids, np.int64) for x in self.words.encode_batch_fast(batch, add_special_tokens=False)])
        # A byte is one letter of the vocabulary, and a line's last byte is its line feed.
        upto = np.searchsorted(np.cumsum(self.letters[flat]), np.cumsum(np.diff(ends) - 1)) + 1
        sizes, at = np.diff(upto, prepend=0), np.flatnonzero(feed.to_numpy(zero_copy_only=False))
        if len(at):
            flat = np.insert(flat, (upto - sizes)[at], self.feed)
            sizes[at] += 1
        return flat, sizes

    def _words(self, words: list[str], ascii: bool, lead: str = " ", runs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        batch, length = [], []
        for i in range(0, len(words), _JOINED):
            part = words[i : i + _JOINED]
            joined = lead + f"\n{lead}".join(part)
            shown = joined.replace(" ", self.space) if ascii else codecs.charmap_decode(joined.encode(), "strict", self.shown)[0]
            length += map(len, part if ascii else shown.split("\n"))
            if runs:
                shown = _RUN.sub(r"\n\g<0>", shown)
            else:
                for mark in _MARKS:  # one, at a word's end
                    shown = shown.replace(mark, "\n" + mark)
            batch.append(shown)
        ids = [np.array(x.ids, np.int64) for x in self.words.encode_batch_fast(batch, add_special_tokens=False)]
        flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
        # The tokens of a word are those that end with or before its last letter.
        ends = np.searchsorted(np.cumsum(self.letters[flat]), np.cumsum(np.array(length, np.int64) + (len(lead) if ascii else 0))) + 1
        return flat, np.diff(ends, prepend=0)

    def vocabulary(self) -> list[bytes]:
        """The bytes of each id."""
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        tokens = self.whole.get_vocab(with_added_tokens=False)
        found = [b""] * (max(tokens.values(), default=-1) + 1)
        for token, i in tokens.items():
            found[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        return found
