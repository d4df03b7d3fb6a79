"""Token ids from the tokenizers library, with what it found for a piece of text remembered.

A text is cut only where the tokenizer's own splitting cuts as well, so the ids of the text are
those of its pieces, one after the other.  Pieces that are plain words are encoded by the library
many at a time; whatever is out of the ordinary goes to the library whole.  So does every text with
the content of an added token, such as ``<|endoftext|>``, which the library looks for before it splits.
"""

from __future__ import annotations

import os
from itertools import chain, compress, repeat

import numpy as np

from .common import lasting

MOST_PIECES = 600_000   # that a worker remembers; beyond them only those that came again stay
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"   # ASCII signs but for the apostrophe, which some words contain


def vocabulary(name_or_path: str) -> str:
    """A file by path, or the place of a public vocabulary by name."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


class Encoder:
    """ids of whole texts; one per Python worker and vocabulary, see ``encoder``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        # looked for in the normalized text, which no piece can be held against: nothing is cut then
        self.folded = any(t.normalized for t in added)
        # word ends are tokens of their own kind; else a leading blank belongs to the word
        self.word_ends = self.library.model.end_of_word_suffix is not None
        vocab = self.library.get_vocab(with_added_tokens=False)
        mark = np.zeros(max(self.library.get_vocab(with_added_tokens=True).values()) + 1, bool)
        suffix = self.library.model.end_of_word_suffix
        for token, i in vocab.items():
            mark[i] = token.endswith(suffix) if self.word_ends else token.startswith("Ġ")
        self.mark = mark
        capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        # no word of letters may hold an added token in small letters only
        self.folds = self.library.normalizer is not None and self.library.normalizer.normalize_str(capitals) == capitals.lower() \
            and not any(c.strip().isalpha() for c in self.added)
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}   # piece -> its place in starts and lengths
        self.flat = np.zeros(1 << 20, np.int32)
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.again = np.zeros(1 << 16, bool)   # places that were met after they were learned
        self.used = 0
        self._put([""], np.zeros(0, np.int32), np.zeros(1, np.int64))

    def _thin(self) -> None:
        """Forget the pieces that came once only, or all if that is not enough."""
        kept = np.flatnonzero(self.again[:len(self.places)])
        kept = kept[kept > 0]
        if 2 * len(kept) > MOST_PIECES:
            return self.forget()
        ids, lengths = self._gather(kept)
        pieces = list(compress(self.places, self.again[:len(self.places)].tolist()))
        self.forget()
        self._put([p for p in pieces if p], ids, lengths)

    def _put(self, new: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember pieces whose ids stand in ``ids`` one after the other."""
        n = len(self.places)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(new) > len(self.starts):
            self.starts, self.lengths, self.again = (np.concatenate([x, np.zeros_like(x)])
                                                     for x in (self.starts, self.lengths, self.again))
        self.flat[self.used:self.used + len(ids)] = ids
        self.lengths[n:n + len(new)] = lengths
        self.starts[n:n + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.places.update(zip(new, range(n, n + len(new))))

    def _library_ids(self, text: str) -> np.ndarray:
        # as encode(), without the places in the text
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _special(self, text: str) -> bool:
        """Whether the library may find an added token in the text."""
        return self.folded or any(c in text for c in self.added)

    def _put_whole(self, new: list[str]) -> None:
        for piece in new:
            ids = self._library_ids(piece)
            self._put([piece], ids, np.array([len(ids)]))

    def _put_words(self, words: list[str]) -> None:
        """Words of letters only, encoded many as one text, which the marked tokens part again."""
        for a in range(0, len(words), 4000):
            some = words[a:a + 4000]
            text = " ".join(some) if self.word_ends else "".join(some)
            if self._special(text):
                self._put_whole(some)
                continue
            ids = self._library_ids(text)
            at = np.flatnonzero(self.mark[ids])
            edges = np.concatenate([[0], at + 1]) if self.word_ends else np.concatenate([at, [len(ids)]])
            if len(at) == len(some) and edges[0] == 0 and edges[-1] == len(ids):
                self._put(some, ids, np.diff(edges))
            else:
                self._put_whole(some)

    def _gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the pieces at ``place``, one after the other, and the number of ids of each."""
        starts, lengths = self.starts[place], self.lengths[place]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)], lengths

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of distinct ``pieces``, none of which is known.

        A piece is mostly a word with signs behind it; no tokenizer of this kind joins the two.
        """
        words, whole, signed, folded = {}, {}, [], {}
        known, word_ends, folds = self.places, self.word_ends, self.folds
        special = self._special("\0".join(pieces))   # of none, if not of all together
        for piece in pieces:
            body = piece.rstrip(_SIGNS)
            core = body[1:] if not word_ends and body[:1] == " " else body
            # some letters fold to more than letters
            if not (core.isalpha() and (core.isascii() or core.lower().isalpha())) or special and self._special(piece):
                whole[piece] = None
                continue
            tail = piece[len(body):]
            if body not in known:
                # without a mark of its own at the front a word cannot be told from the one before
                kind = words if word_ends or body is not core else whole
                if folds and core.isascii() and (low := body.lower()) != body:   # has the ids of the word in small letters
                    folded[body] = low
                    if low not in known:
                        kind[low] = None
                else:
                    kind[body] = None
            if tail:
                if tail not in known:
                    whole[tail] = None
                signed.append((piece, body, tail))
        self._put_whole(list(whole))
        self._put_words(list(words))
        if folded:
            ids, lengths = self._gather(np.fromiter(map(known.__getitem__, folded.values()), np.int64, len(folded)))
            self._put(list(folded), ids, lengths)
        signed = [x for x in signed if x[0] not in known]
        if signed:
            place = np.fromiter((known[part] for x in signed for part in x[1:]), np.int64, 2 * len(signed))
            ids, lengths = self._gather(place)
            self._put([x[0] for x in signed], ids, lengths.reshape(-1, 2).sum(axis=1))

    def _cut(self, text: str) -> list[str]:
        if self._special(text):
            return [text]
        blanks = text.replace("\n", " ").split(" ")
        if self.word_ends:   # blanks are dropped by the tokenizer itself
            return blanks
        # without blanks in a row, at an end or of another kind, both ways of splitting agree
        if "\0" in text or text.split() != blanks:
            return [text]
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        if len(self.places) > MOST_PIECES:
            self._thin()
        cut = [self._cut(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = list(chain.from_iterable(cut))
        place = np.fromiter(map(self.places.get, flat, repeat(-1)), np.int64, len(flat))
        new_here = place < 0
        self.again[place[~new_here]] = True
        missed = np.flatnonzero(new_here).tolist()
        if missed:
            new = [flat[i] for i in missed]
            self._learn(list(dict.fromkeys(new)))
            place[missed] = [self.places[p] for p in new]
        ids, lengths = self._gather(place)
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(upto)


def encoder(name_or_path: str) -> Encoder:
    """The worker's encoder of a vocabulary; it outlives the task, as its memory is worth keeping."""
    path = vocabulary(name_or_path)
    if path not in lasting:
        lasting[path] = Encoder(path)
    return lasting[path]
