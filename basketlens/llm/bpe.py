"""Token ids of whole texts by a public word-level BPE vocabulary of the tokenizers library.

Encoding a text equals encoding its pieces between white space one after the
other, if the vocabulary's normaliser and splitter never look across white
space; ``check`` tests that for the vocabulary in use.  A step encodes each
distinct piece once and gathers the ids with numpy.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from basketlens.llm.common import Words, held, ragged, string_hashes

#: Distinct pieces of which a worker remembers the ids; beyond it a piece is simply encoded again.
MEMO_PIECES = 200_000
_JOIN = 400


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts; pieces are remembered up to MEMO_PIECES."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.full = Tokenizer.from_file(path)
        vocab = self.full.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.lower = self._check()
        # what is remembered: two hashes of a piece, sorted by the first, and its place in ``flat``
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(4096, np.uint32), 0

    def _check(self) -> bool:
        """True if pieces can be encoded one by one (else whole texts are)."""
        probe = ["The cat, sat. It's 12 dogs'été áb ***x", "ÉCOLE naïve. ÀÿÞ, <|endoftext|>z 你好"]
        ids = lambda t: self.full.encode(t, add_special_tokens=False).ids
        letters = [w for p in probe for w in p.split() if w.rstrip(".,").isalpha()]
        return all(ids(p) == [i for w in p.split() for i in ids(w)] == ids(p.replace(" ", " \n\t")) for p in probe) and all(
            ids(w + c) == ids(w.lower()) + ids(c) for w in letters if w.isalpha() for c in ".,")

    def _words(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and their number of words of letters: encoded in long lines, cut where a word's last token stands."""
        lines = [words[i:i + _JOIN] for i in range(0, len(words), _JOIN)]
        flat: list[np.ndarray] = []
        size: list[np.ndarray] = []
        for many, e in zip(lines, self.full.encode_batch_fast([" ".join(line) for line in lines], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(many):
                ids, cut = self._each(many)
            flat.append(ids[:cut[-1]])
            size.append(np.diff(cut, prepend=0))
        return flat, size

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are encoded by themselves, and where each ends."""
        got = [e.ids for e in self.full.encode_batch_fast(pieces, add_special_tokens=False)]
        end = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(end[-1])), end

    @staticmethod
    def _stems(pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct stems, and the codes of each piece's stem and of its final stop or comma (-1: none).

        Only Latin-1 letters, for which lower case is one letter for one and composition changes
        nothing, with one stop or comma at most, are taken apart; other pieces are stems as they are.
        """
        simple = pc.match_substring_regex(pieces, "^[A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{FF}]+[.,]?$")
        stem = pc.if_else(simple, pc.utf8_lower(pc.utf8_rtrim(pieces, ".,")), pieces)
        last = pc.if_else(simple, pc.utf8_slice_codeunits(pieces, -1), "")
        enc = pa.concat_arrays([stem, pa.array([".", ","], stem.type)]).dictionary_encode()
        codes = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        second = np.full(len(pieces), -1, np.int64)
        second[pc.equal(last, ".").to_numpy(zero_copy_only=False)] = codes[-2]
        second[pc.equal(last, ",").to_numpy(zero_copy_only=False)] = codes[-1]
        return enc.dictionary, codes[:-2], second

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, start and length of each piece."""
        key, check = string_hashes(pieces, 1), string_hashes(pieces, 2)
        slot = np.searchsorted(self.key, key)
        old = slot < len(self.key)
        old[old] = (self.key[slot[old]] == key[old]) & (self.check[slot[old]] == check[old])
        new = np.flatnonzero(~old)
        words = pieces.take(pa.array(new)).to_pylist()
        letters = np.fromiter(map(str.isalpha, words), bool, len(words))
        new = np.concatenate([new[letters], new[~letters]])
        parts, sizes_ = self._words([w for w in words if w.isalpha()])
        rest = [w for w in words if not w.isalpha()]
        if rest:
            ids, end = self._each(rest)
            parts.append(ids)
            sizes_.append(np.diff(end, prepend=0))
        size = np.concatenate(sizes_) if sizes_ else np.zeros(0, np.int64)
        flat = np.concatenate([self.flat[:self.used], *parts])
        starts, sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        starts[old], sizes[old] = self.start[slot[old]], self.size[slot[old]]
        starts[new], sizes[new] = self.used + np.cumsum(size) - size, size
        self._remember(key[new], check[new], flat[self.used:], size)
        return flat, starts, sizes

    def _remember(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        take = np.flatnonzero(size <= 64)[:max(0, MEMO_PIECES - len(self.key))]
        if not len(take):
            return
        lens = size[take]
        add = ids[ragged((np.cumsum(size) - size)[take], lens)]
        if len(self.flat) < self.used + len(add):
            self.flat = np.resize(self.flat, 2 * (self.used + len(add)))
        self.flat[self.used:self.used + len(add)] = add
        key = np.concatenate([self.key, key[take]])
        by = np.argsort(key, kind="stable")
        self.key, self.check = key[by], np.concatenate([self.check, check[take]])[by]
        self.start = np.concatenate([self.start, self.used + np.cumsum(lens) - lens])[by]
        self.size = np.concatenate([self.size, lens])[by]
        self.used += len(add)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each (null: none)."""
        if not self.lower:
            got = [np.array(e.ids, np.uint32) for e in self.full.encode_batch_fast(
                pc.fill_null(text.cast(pa.string()), "").to_pylist(), add_special_tokens=False)]
            return (np.concatenate(got) if got else np.zeros(0, np.uint32)), np.fromiter(map(len, got), np.int64, len(got))
        words = Words(text)
        stems, first, second = self._stems(words.distinct)
        flat, start, size = self.pieces(stems)
        # each piece is one stem, or a stem and a stop or comma
        parts = np.empty(2 * len(words.codes), np.int64)
        parts[0::2], parts[1::2] = first[words.codes], second[words.codes]
        count = size[first] + np.where(second >= 0, size[second], 0)
        parts = parts[parts >= 0]
        ids = flat[ragged(start[parts], size[parts])]
        per_row = np.bincount(words.rows(), count[words.codes], len(words.counts)).astype(np.int64)
        return ids, per_row


def encoder(path: str) -> Encoder:
    return held(("bpe", path), lambda: Encoder(path))
