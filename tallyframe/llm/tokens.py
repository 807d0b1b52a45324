"""Token ids of whole texts by a public tokenizer file, with a cache of the pieces between spaces.

Both public BPE files split a text before every single space, so the text between two spaces gets the same ids alone as in
place. Pieces repeat far more than texts do; a bounded cache of pieces makes the library's own work small. Arrow cuts the texts of a
group, numbers their distinct pieces and lays the ids end to end, so Python sees a piece once a group. A text that holds
the string of an added token (like `<|endoftext|>`) goes to the library whole, which gives such a string its own id."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of letters that no normal form changes, runs of common marks, line ends: units that both files' pre-tokenizers keep apart.
_UNITS = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+| ?[.,;:!?#*$%&|<>]+|\n")
_CUT = re.compile(r"(?<=\S)(?= )")
GROUP_CHARS = 2 << 20  # texts of a group, one at least
_LATIN = "".join(map(chr, range(256)))
_loaded: dict[tuple, TokenIds] = {}


class TokenIds:
    """Ids as little-endian unsigned 16-bit bytes where the vocabulary allows it, else 32-bit (`dtype`)."""

    def __init__(self, path: str, space_joins: bool, cache_pieces: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)  # letters too many only cost a whole encoding
        self.space_joins, self.cache_pieces = space_joins, cache_pieces
        normal = self.tokenizer.normalizer
        self.folds = normal is not None and normal.normalize_str(_LATIN) == normal.normalize_str(_LATIN.lower())  # letter case is dropped
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        shown = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.begins = np.array([t.startswith("\u0120") for t in shown])  # a space, as byte-level files show it
        self.ends = np.array([t.endswith("</w>") for t in shown])
        self.line_end = self.tokenizer.token_to_id("\u010a")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> None:
        """Ids of distinct pieces not known yet. The cache has two generations: what was not asked for during a whole one is forgotten."""
        known, older = self.known, self.older
        made, rest, units = [], [], set()
        for piece in pieces:
            if piece in older:
                known[piece] = older[piece]
                continue
            own = _UNITS.findall(piece)
            if own and len(own[0]) == len(piece):
                units.add(piece)
            elif own and sum(map(len, own)) == len(piece) and "\n\n" not in piece:
                made.append(piece)
                made.append(own)
                units.update(own)
            else:
                rest.append(piece)
        for unit in units:
            if unit in older:
                known[unit] = older[unit]
        units = units.difference(known)
        self.learn_words([u for u in units if u[-1].isalpha()])
        rest += [u for u in units if not u[-1].isalpha()]
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[piece] = array(self.code, e.ids).tobytes()
        get = known.__getitem__
        for piece, own in zip(made[::2], made[1::2]):
            known[piece] = b"".join(map(get, own))

    def learn_words(self, words: list[str]) -> None:
        """Words are encoded in long lists; where one ends is seen from the ids."""
        for spaced in (True, False):
            some = [w for w in words if (w[0] == " ") is spaced]
            for i in range(0, len(some), 1000):
                part = some[i : i + 1000]
                if self.space_joins:
                    ids = self.ids("".join(part) if spaced else "\n".join(part))
                    cut = np.flatnonzero(self.begins[ids] if spaced else ids == self.line_end)
                    begin = cut if spaced else np.append(0, cut + 1)
                    end = np.append(cut[1:], len(ids)) if spaced else np.append(cut, len(ids))
                else:
                    ids = self.ids(" ".join(part))
                    end = np.flatnonzero(self.ends[ids]) + 1
                    begin = np.append(0, end[:-1])
                if len(begin) != len(part):
                    raise ValueError("the tokenizer file does not keep these words apart")
                data, size = ids.tobytes(), self.dtype.itemsize
                for w, b, e in zip(part, (begin * size).tolist(), (end * size).tolist()):
                    self.known[w] = data[b:e]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def plain(self, text: str) -> str:
        """The text in small letters where that gives the same ids: characters that normal forms never join, of a file that drops case."""
        if self.folds:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
            return text.lower()
        return text

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= GROUP_CHARS):
                size += len(texts[to])
                to += 1
            yield from self.group(texts[at:to])
            at = to

    def group(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) > self.cache_pieces:
            self.older, self.known = self.known, {}
        whole = [bool(self.added.search(t)) for t in texts]
        rows = pa.array(["" if w else self.plain(t) for w, t in zip(whole, texts)], pa.large_string())
        if self.space_joins:  # a cut before every space, but only behind other characters where spaces or the mark itself may be doubled
            odd = {i: _CUT.split(t) for i, t in enumerate(texts) if not whole[i] and ("  " in t or "\0" in t)}
            if odd:
                rows = pa.array(["" if w or i in odd else t for i, (w, t) in enumerate(zip(whole, texts))], pa.large_string())
            cut = pc.split_pattern(pc.replace_substring(rows, " ", "\0 "), "\0")
        else:
            odd, cut = {}, pc.split_pattern(rows, " ")
        coded = cut.values.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(list(set(pieces).union(*odd.values()).difference(self.known)))
        get = self.known.__getitem__
        laid = pa.array(list(map(get, pieces)), pa.large_binary()).take(coded.indices)
        bounds = np.frombuffer(laid.buffers()[1], np.int64)[: len(laid) + 1][cut.offsets.to_numpy()].tolist()
        data = memoryview(laid.buffers()[2] or b"")
        for i, text in enumerate(texts):
            yield self.ids(text).tobytes() if whole[i] else b"".join(map(get, odd[i])) if i in odd else bytes(data[bounds[i] : bounds[i + 1]])


def token_ids(path: str, space_joins: bool) -> TokenIds:
    """One per Python worker and file. `space_joins`: a space belongs to the word behind it (byte-level files); else white space is dropped."""
    key = (path, space_joins)
    if key not in _loaded:
        _loaded[key] = TokenIds(path, space_joins)
    return _loaded[key]


def forget() -> None:
    """Free the tokenizers of this worker and their caches: workers are used again by later stages, which need the memory."""
    _loaded.clear()
