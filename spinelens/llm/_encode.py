"""Piecewise encoding with a tokenizers file: each distinct piece of a text is encoded once.

A text is cut where the tokenizer can never join two sides, so the pieces' results add up to the
whole text's. Pieces repeat heavily; a bounded dictionary per Python worker keeps their results.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable
from itertools import islice

import numpy as np

#: Entries of a dictionary of results; the older half, with the frequent pieces, stays when full.
CACHE_ENTRIES = 1 << 19
#: Longer pieces are encoded each time and not kept.
CACHE_PIECE = 64
#: A run of white space belongs to what follows it: byte-level tokenizers of this kind never join a
#: visible character with white space after it.
BEFORE_SPACE = re.compile(r"\s*\S+|\s+")
#: Python counts these as white space and the tokenizers' patterns do not; such texts stay whole.
ODD_SPACE = re.compile("[\x1c-\x1f]")

_tokenizers: dict[str, object] = {}


def load(path: str):
    """A worker's tokenizer, loaded once, on one thread: Spark runs one task per core."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _tokenizers[path] = tokenizer
    return _tokenizers[path]


def special_strings(path: str) -> list[str]:
    return [t.content for t in load(path).get_added_tokens_decoder().values()]


class Memo:
    """Results by piece, at most ``entries`` of them; ``encode`` maps a list of pieces to their results."""

    def __init__(self, encode: Callable[[list], Iterable], batch_bytes: int, entries: int = CACHE_ENTRIES):
        self.encode, self.batch_bytes, self.entries = encode, batch_bytes, entries
        self.known: dict = {}

    def _batches(self, pieces: list):
        batch, size = [], 0
        for piece in pieces:
            if batch and size + len(piece) > self.batch_bytes:
                yield batch
                batch, size = [], 0
            batch.append(piece)
            size += len(piece)
        if batch:
            yield batch

    def learn(self, pieces: list) -> dict:
        """Results of pieces not known yet, encoded in batches of about ``batch_bytes``."""
        out = {}
        for batch in self._batches(pieces):
            out.update(zip(batch, self.encode(batch), strict=True))
        short = {p: v for p, v in out.items() if len(p) <= CACHE_PIECE}
        if len(self.known) + len(short) > self.entries:
            self.known = dict(islice(self.known.items(), self.entries // 2))
        for piece, value in short.items():
            if len(self.known) >= self.entries:
                break
            self.known[piece] = value
        return out


_BYTES = {}


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level alphabets: printable bytes stand for themselves, the others for U+0100 onward."""
    if not _BYTES:
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        spare = 256
        for byte in range(256):
            if byte in plain:
                _BYTES[chr(byte)] = byte
            else:
                _BYTES[chr(spare)] = byte
                spare += 1
    return _BYTES


class RankedWords:
    """Ids of white-space separated words by a word-end BPE file, through a rank table.

    A merge list and a rank table give the same ids for every word if each multi-symbol entry of
    the vocabulary encodes to itself: whatever tiles an entry's span exactly was merged inside the
    span only, so its last two parts are the listed pair. Entries that the merge list cannot reach
    are left out of the table; ``tests/llm`` checks both. Words with characters past U+00FF, where
    Unicode tables of the libraries may differ, control characters or special strings go through
    the tokenizer itself.
    """

    PLAIN = re.compile("[\x21-\x7e\xa1-\xac\xae-\xff]+")
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    END, STOP = "\x00", "\x01"

    def __init__(self, path: str):
        import regex
        import tiktoken

        self.tokenizer = load(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        suffix, vocab, symbols = model["end_of_word_suffix"], model["vocab"], _byte_of_symbol()

        def raw(token: str) -> bytes:
            body = token.removesuffix(suffix) if token.endswith(suffix) else token
            return bytes(symbols[c] for c in body) + (b"\0" if token.endswith(suffix) else b"")

        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        reachable = self.reachable(path, merged)
        ranks = {bytes([b]): b for b in range(256)}
        self.ids = np.zeros(512 + len(merged), dtype="<u4")
        for symbol, byte in symbols.items():
            self.ids[byte] = vocab[symbol]
            self.ids[256 + byte] = vocab[symbol + suffix]
            if byte > 1:
                ranks[bytes([byte, 0])] = 256 + byte
        for i, token in enumerate(merged):
            if token in reachable and raw(token).find(b"\0", 0, -1) < 0:
                ranks.setdefault(raw(token), 512 + i)
                self.ids[512 + i] = vocab[token]
        self.specials = special_strings(path)
        self.encoding = tiktoken.Encoding(
            "words", pat_str=f"[^{self.END}{self.STOP}]+{self.END}|{self.STOP}",
            mergeable_ranks=ranks, special_tokens={})
        self.parts = regex.compile(self.PARTS)

    @staticmethod
    def reachable(path: str, tokens: list[str]) -> set[str]:
        """Vocabulary entries that their own text encodes to (by the model, without splitting)."""
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model["end_of_word_suffix"]
        whole = BPE(vocab=model["vocab"], merges=pairs, end_of_word_suffix=suffix)
        inner = BPE(vocab=model["vocab"], merges=pairs)
        return {t for t in tokens
                if len(whole.tokenize(t.removesuffix(suffix)) if t.endswith(suffix) else inner.tokenize(t)) == 1}

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [bool(self.PLAIN.fullmatch(t)) and not ("<|" in t and any(s in t for s in self.specials))
                 for t in texts]
        joined = "".join([f"{t} {self.STOP} " for t, p in zip(texts, plain) if p]).lower()
        marked = self.parts.sub(rf"\g<0>{self.END}", joined).replace(self.STOP + self.END, self.STOP)
        ranks = np.array(self.encoding.encode_ordinary(marked.replace(" ", "")), dtype=np.int64)
        stops = np.flatnonzero(ranks == 1).tolist()
        ids, out, start = self.ids[ranks], iter(stops), 0
        other = [t for t, p in zip(texts, plain) if not p]
        slow = iter(self.tokenizer.encode_batch_fast(other, add_special_tokens=False) if other else ())
        results = []
        for p in plain:
            if p:
                stop = next(out)
                results.append(ids[start:stop].tobytes())
                start = stop + 1
            else:
                results.append(np.array(next(slow).ids, dtype="<u4").tobytes())
        return results
