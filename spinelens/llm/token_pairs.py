"""Two tokenizers' ids of one text, cut where tokens of both end.

A text is cut before white space where neither vocabulary can join the two sides, so both encodings
and the alignment are those of its pieces. Pieces repeat; a bounded table per worker keeps them.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from spinelens.llm import _encode

#: Entries and characters of a worker's table; beyond either it starts anew.
TABLE_ENTRIES = 400_000
TABLE_CHARS = 1 << 25
#: New pieces encoded together.
LEARNED = 20_000
SPACE = "▁"
#: The published pattern of byte-level files, a fixed value: it equals the one that the tokenizers library has built in.
GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """Ids of a byte-level BPE file (tokenizers); special strings inside texts are plain text.

    Pieces of plain characters go, many at a time, through a rank table if the file's merges make its ids in order: a
    merge list and ranks then give the same ids. The other pieces go through the tokenizer.
    """

    #: Characters on whose class the libraries' Unicode tables agree.
    PLAIN = re.compile("[ \t\n\r\x21-\x7e\xa1-\xac\xae-\xff]*[\x21-\x7e\xa1-\xac\xae-\xff]")
    JOINED = 1000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        symbols = _encode._byte_of_symbol()
        n = self.tokenizer.get_vocab_size()
        self.raw = [b""] * n
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.raw[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.raw[i] = token.content.encode()
        self.size = np.array([len(r) for r in self.raw], np.int64)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in described["model"]["merges"]]
        vocab, cut = described["model"]["vocab"], described["pre_tokenizer"]
        self.ranked = None
        if (cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and described["normalizer"] is None
                and [vocab[m] for m in merges] == list(range(256, 256 + len(merges)))):
            self.ranked = tiktoken.Encoding("pieces", pat_str=GPT_PATTERN, special_tokens={}, mergeable_ranks={
                self.raw[i]: i for t, i in vocab.items() if i < 256 + len(merges)})

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has. Texts begin with white space."""
        joined = self.ranked is not None
        plain = [i for i, t in enumerate(texts) if joined and self.PLAIN.fullmatch(t)]
        parts, counts = [], np.zeros(len(texts), np.int64)
        spans = []
        for lo in range(0, len(plain), self.JOINED):
            some = plain[lo : lo + self.JOINED]
            ids = np.array(self.ranked.encode_ordinary("".join([texts[i] for i in some])), np.int64)
            ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(texts[i].encode()) for i in some]), "right")
            counts[some] = np.diff(np.r_[0, ends])
            parts.append(ids)
            spans.extend(some)
        rest = sorted(set(range(len(texts))) - set(plain)) if len(plain) < len(texts) else []
        for lo in range(0, len(rest), self.JOINED):
            some = rest[lo : lo + self.JOINED]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in some], add_special_tokens=False)]
            counts[some] = [len(x) for x in found]
            parts.append(np.array([x for ids in found for x in ids], np.int64))
            spans.extend(some)
        flat = np.concatenate([np.zeros(0, np.int64), *parts])
        if not rest:
            return flat, counts
        spans = np.array(spans)
        first = np.empty(len(texts), np.int64)
        first[spans] = np.cumsum(counts[spans]) - counts[spans]
        at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(flat))
        return flat[at], counts


class Pieces:
    """Ids of a sentencepiece model that puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.raw = [
            bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(names)]
        texts = [p.replace(SPACE, " ") for i, p in enumerate(names) if not self.model.is_byte(i)]
        #: White space that some entry holds after another character: no text is cut before it.
        self.inner = {c for p in texts for before, c in zip(p, p[1:]) if c.isspace() and (not before.isspace() or before == " " != c)}
        self.alone = self.model.piece_to_id(SPACE)
        self.size = np.array([len(r) for r in self.raw], np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has, of texts that begin with white space: the model's own first
        space is the text's, or goes."""
        ids = self.model.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        found = [[self.alone] if t == " " else x if t[0] == " " else x[1:] for t, x in zip(texts, ids, strict=True)]
        counts = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts


class Aligner:
    """Alignment of whole texts through a table of pieces."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        n_a, n_b = len(self.a.raw), len(self.b.raw)
        # every id with what follows it: in its group, at the end of A's part, at the group's end
        self.names = [*(f"{i}," for i in range(n_a)), *(f"{i}|" for i in range(n_a)),
                      *(f"{i}," for i in range(n_b)), *(f"{i};" for i in range(n_b))]
        inner = "".join(map(re.escape, sorted(self.b.inner)))
        glue = rf"(?:[{inner}]\s*\S*)*" if inner else ""
        self.cuts = None if " " in self.b.inner else re.compile(rf"\s*\S+{glue}|\s+")
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []  # each group ends with ";"
        self.shape = np.zeros((1 << 12, 3), np.int32)  # ids of A (-1: an encoding does not give the piece back), of B, links
        self.first = np.zeros(1 << 12, np.int64)
        self.links = np.zeros((1 << 14, 2), np.int32)

    def pieces(self, text: str) -> list[str]:
        text = " " + text
        if self.cuts is None or _encode.ODD_SPACE.search(text):
            return [text]
        return self.cuts.findall(text)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Table numbers of the pieces of texts, none for texts that an encoding does not give back.

        New pieces are encoded together. A text with a piece that does not come back is judged as a whole.
        """
        def known(pieces: list[list[str]]) -> list[np.ndarray]:
            new: dict[str, None] = {}
            for found in pieces:
                new.update(dict.fromkeys([p for p in found if p not in self.number]))
            fresh = list(new)
            for lo in range(0, len(fresh), LEARNED):
                self._learn(fresh[lo : lo + LEARNED])
            return [np.fromiter(map(self.number.__getitem__, found), np.int64, len(found)) for found in pieces]

        out = known([self.pieces(t) if t else [] for t in texts])
        for i, found in enumerate(out):
            if (self.shape[found, 0] < 0).any():
                (found,) = known([[" " + texts[i]]])
                out[i] = found[:0] if self.shape[found[0], 0] < 0 else found
        return out

    def _comes_back(self, side, ids: np.ndarray, counts: np.ndarray, wanted: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Which pieces are the joined bytes of their ids."""
        if np.array_equal(np.add.reduceat(np.r_[side.size[ids], 0], np.cumsum(counts) - counts) * (counts > 0), sizes) and (
                b"".join(map(side.raw.__getitem__, ids.tolist())) == b"".join(wanted)):
            return np.ones(len(wanted), bool)
        ends, ids = np.cumsum(counts).tolist(), ids.tolist()
        return np.array([b"".join(map(side.raw.__getitem__, ids[lo:hi])) == want
                         for want, lo, hi in zip(wanted, [0, *ends], ends)])

    def _learn(self, new: list[str]) -> None:
        wanted = [p.encode() for p in new]
        sizes = np.array([len(w) for w in wanted], np.int64)
        (a, a_n), (b, b_n) = self.a(new), self.b(new)
        fit = self._comes_back(self.a, a, a_n, wanted, sizes) & self._comes_back(self.b, b, b_n, wanted, sizes)
        if not fit.all():
            a, b = a[np.repeat(fit, a_n)], b[np.repeat(fit, b_n)]
            a_n, b_n, sizes = a_n * fit, b_n * fit, sizes * fit
        a_ends, b_ends = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        at = np.searchsorted(b_ends, a_ends)  # no id is empty, so ends are distinct
        a_last = b_ends[at] == a_ends if len(b_ends) else np.zeros(len(a_ends), bool)
        common = a_ends[a_last]
        b_last = np.zeros(len(b_ends), bool)
        b_last[at[a_last]] = True
        links = np.stack([a[a_last], b[b_last]], axis=1)
        # groups in order, in each A's ids before B's
        group = np.r_[2 * np.searchsorted(common, a_ends), 2 * np.searchsorted(common, b_ends) + 1]
        n_a, n_b = len(self.a.raw), len(self.b.raw)
        named = np.r_[a + n_a * a_last, b + 2 * n_a + n_b * b_last][np.argsort(group, kind="stable")]
        names = list(map(self.names.__getitem__, named.tolist()))
        ends = np.cumsum(a_n + b_n).tolist()
        per_piece = np.diff(np.searchsorted(common, np.r_[0, np.cumsum(sizes)], "right"))
        size, n_links = len(self.groups), int(self.first[len(self.groups)])
        self._room(size + len(new), n_links + len(links))
        self.groups.extend(["".join(names[lo:hi]) for lo, hi in zip([0, *ends], ends)])
        self.number.update(zip(new, range(size, size + len(new))))
        self.chars += sum(map(len, new))
        self.shape[size : size + len(new)] = np.stack([np.where(fit, a_n, -1), b_n, per_piece], axis=1)
        self.first[size + 1 : size + 1 + len(new)] = n_links + np.cumsum(per_piece)
        self.links[n_links : n_links + len(links)] = links

    def _room(self, entries: int, links: int) -> None:
        while entries + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.shape = np.concatenate([self.shape, np.zeros_like(self.shape)])
        while links > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])

    def joined(self, numbers: np.ndarray) -> str:
        """The groups of a text."""
        return "".join(map(self.groups.__getitem__, numbers.tolist()))[:-1]

    def links_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links (rows of ids) of table numbers in order, and how many each has."""
        counts = self.first[numbers + 1] - self.first[numbers]
        total = int(counts.sum())
        at = np.repeat(self.first[numbers] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(total)
        return self.links[at].astype(np.int64), counts

    def full(self) -> bool:
        return len(self.groups) > TABLE_ENTRIES or self.chars > TABLE_CHARS


_aligners: dict[tuple[str, str], Aligner] = {}


def load(a_path: str, b_path: str) -> Aligner:
    """A worker's aligner, kept between tasks."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]
