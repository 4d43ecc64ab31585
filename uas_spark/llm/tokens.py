"""Encoding whole texts with a public tokenizer inside Spark tasks."""

from __future__ import annotations

import os
import sys
import types
from itertools import chain, islice

import numpy as np

END_ID = 1
# A piece of Latin-1 letters (one pre-token in any case) may end in a run of these (one more).
_MARKS = ".,;:!?%&*#$|"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class _Index(dict):
    """Numbers keys in order of first sight."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class WordEncoder:
    """Token ids of whole texts, with a memory of words.

    For tokenizers that drop white space and never join characters across it (their normalizer
    may fold case and compose characters): then a text's ids are the ids of its pieces between
    blanks, one after another, and each distinct piece is encoded once. The memory is emptied
    when it holds ``most`` pieces, which bounds it and changes no result.
    """

    def __init__(self, path: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task per core
        from tokenizers import Tokenizer
        self.tok, self.most = Tokenizer.from_file(path), most
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        self.specials = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(self.specials).lower()
        ends = [i for w, i in self.tok.get_vocab().items() if w.endswith("</w>")]
        self.ends_word = np.zeros(max(ends, default=0) + 1, bool)
        self.ends_word[ends] = True
        self._empty()

    def _empty(self) -> None:
        self.index = _Index()
        self.done, self.n_ids = 0, 0
        self.ids = np.empty(1 << 16, np.uint32)  # of piece k: ids[first[k]:first[k] + size[k]]
        self.first = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def _keep(self, which: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.n_ids:self.n_ids + len(ids)] = ids
        self.first[which] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[which] = sizes
        self.n_ids += len(ids)

    def _learn(self) -> None:
        """Encode the pieces seen since the last call; plain words go many to a call."""
        new = b"\n".join(islice(self.index, self.done, None)).decode("utf-8", "replace").split("\n")
        while self.done + len(new) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        rest = []
        for at in range(0, len(new), 1024):
            which, words, marks = [], [], []
            for k, p in enumerate(new[at:at + 1024], self.done + at):
                w = p.rstrip(_MARKS)
                if w.isalpha() and len(w) < 200 and (w.isascii() or max(w) <= "ÿ"):
                    which.append(k)
                    n = len(p) - len(w)
                    marks.append(1 if n else 0)
                    words.append(f"{w} {p[-n:]}" if n else p)
                else:
                    rest.append(k)
            if not which:
                continue
            ids = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            stop = np.flatnonzero(self.ends_word[np.minimum(ids, len(self.ends_word) - 1)]) + 1
            last = np.cumsum(1 + np.array(marks)) - 1  # the pre-token that ends each piece
            if len(stop) == last[-1] + 1:
                self._keep(np.array(which), ids, np.diff(stop[last], prepend=0))
            else:
                rest += which
        for at in range(0, len(rest), 4096):
            ks = rest[at:at + 4096]
            found = [e.ids for e in self.tok.encode_batch_fast([new[k - self.done] for k in ks],
                                                               add_special_tokens=False)]
            self._keep(np.array(ks), np.fromiter(chain.from_iterable(found), np.uint32),
                       np.array([len(f) for f in found]))
        self.done += len(new)

    def encode(self, texts: list[bytes], end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets): text i has ids[offsets[i]:offsets[i + 1]], ``end_id`` last."""
        pieces, counts = [], np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            # the strings of special tokens are matched as written, so such texts keep their case
            low = t.lower()
            if self.mark in low and any(s in t or s.lower() in low for s in self.specials):
                low = t
            p = low.replace(b"\n", b" ").split(b" ")
            counts[i] = len(p)
            pieces.append(np.fromiter(map(self.index.__getitem__, p), np.int64, len(p)))
        if len(self.index) > self.done:
            self._learn()
        at = np.concatenate(pieces) if pieces else np.empty(0, np.int64)
        size = self.size[at]
        through = np.cumsum(size)
        src = np.arange(through[-1] if len(through) else 0) + np.repeat(self.first[at] - (through - size), size)
        flat = self.ids[src]
        stop = np.concatenate([[0], through])[np.cumsum(counts)] if len(texts) else np.empty(0, np.int64)
        if end_id is not None:
            flat = np.insert(flat, stop, end_id)
            stop = stop + np.arange(1, len(texts) + 1)
        if len(self.index) > self.most:
            self._empty()
        return flat, np.concatenate([[0], stop]).astype(np.int64)


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker process. Spark reuses workers from task to task, and the
    words it has met stay known; a module of its own holds it, as task functions come by value."""
    kept = sys.modules.setdefault("_word_encoders", types.ModuleType("_word_encoders"))
    if path not in vars(kept):
        setattr(kept, path, WordEncoder(path))
    return getattr(kept, path)
