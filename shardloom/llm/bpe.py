"""Byte-pair encoding from a vocabulary file: merge queue, prefix counts, decoding.

A :class:`ByteBpe` lives once in each Python worker. Text is cut into chunks, each a word with the
one space before it; what a chunk becomes doesn't depend on its neighbours, so a chunk's result is
kept and used again. The memory is emptied when it holds ``CACHE`` chunks, which changes no result.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np

CACHE = 400_000
#: A space that is followed by white space or by the end: then chunks aren't independent.
_JOINED_SPACE = re.compile(r" (?:\s|\Z)")
#: Texts of these characters only are cut by the pattern below as the ByteLevel pre-tokenizer cuts them.
_LATIN = re.compile(r"[\n -~À-ÖØ-öø-ɏ]*\Z")
_LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+")
_PLACE = 32
_MASK = (1 << _PLACE) - 1


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Byte-level BPE of a ``tokenizers`` file with a ByteLevel pre-tokenizer."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        data = json.loads(spec)
        self.alphabet = byte_alphabet()
        vocab = data["model"]["vocab"]
        raw = {token: bytes(self.alphabet[c] for c in token) for token in vocab}
        self.id_of = {raw[t]: i for t, i in vocab.items()}
        self.bytes_of: dict[int, bytes] = {i: raw[t] for t, i in vocab.items()}
        self.rank = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(data["model"]["merges"])}
        self.made = [vocab[a + b] for a, b in data["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"] if t["special"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.text_of = [b""] * (max(self.bytes_of) + 1)
        for i, b in self.bytes_of.items():
            self.text_of[i] = b
        self.longest = max(map(len, self.id_of))
        self.byte_id = [self.id_of[bytes([b])] for b in range(256)]
        self._special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._pre = Tokenizer.from_str(spec).pre_tokenizer
        self._latin = data["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self._fits: dict[int, bool] = {}
        self._whole: dict[bytes, int] = {}
        self._dp: dict[bytes, list[int]] = {}
        self._ids: dict[bytes, tuple[int, ...]] = {}

    # -- pieces ---------------------------------------------------------------------------------

    def pieces(self, text: str) -> list[bytes]:
        """The pieces that merges never cross, by the file's own pre-tokenizer; for plain Latin text by an equal pattern, which is faster."""
        if self._latin and _LATIN.match(text):
            return [p.encode() for p in _LATIN_PIECES.findall(text)]
        return [bytes(map(self.alphabet.__getitem__, p)) for p, _ in self._pre.pre_tokenize_str(text)] if text else []

    def segments(self, text: str) -> list[str]:
        """Text and special strings in turn; odd positions are special strings."""
        return self._special_split.split(text) if self._special_split and "<|" in text else [text]

    # -- encoding by a queue of merges over a linked list ---------------------------------------

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece. The queue holds rank and left place in one integer; an entry is stale, and skipped, if the symbols now at its place have another rank."""
        n = len(piece)
        ids = list(map(self.byte_id.__getitem__, piece))
        if n == 1:
            return tuple(ids)
        rank, made = self.rank.get, self.made
        queue = [r << _PLACE | i for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        if not queue:
            return tuple(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            r, i = entry >> _PLACE, entry & _MASK
            j = after[i]
            if j < 0 or ids[i] < 0 or rank(ids[i] << 20 | ids[j]) != r:
                continue
            ids[i] = new = made[r]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(new << 20 | ids[k])) is not None:
                    push(queue, r << _PLACE | i)
            h = before[i]
            if h >= 0 and (r := rank(ids[h] << 20 | new)) is not None:
                push(queue, r << _PLACE | h)
        return tuple([i for i in ids if i >= 0])

    def piece_ids(self, piece: bytes) -> tuple[int, ...]:
        if (got := self._ids.get(piece)) is None:
            if len(self._ids) >= CACHE:
                self._ids.clear()
            got = self._ids[piece] = self.merge(piece)
        return got

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as the library gives them without added special tokens."""
        out: list[int] = []
        for k, part in enumerate(self.segments(text or "")):
            if k % 2:
                out.append(self.special[part])
            else:
                for piece in self.pieces(part):
                    out += self.piece_ids(piece)
        return np.array(out, dtype="<u4")

    def decode(self, ids) -> str:
        """Vocabulary strings put together; bytes that aren't UTF-8 become U+FFFD. Ids outside the vocabulary give nothing."""
        n = len(self.text_of)
        return b"".join(self.text_of[i] for i in ids if 0 <= i < n).decode("utf-8", "replace")

    # -- counts at every prefix -----------------------------------------------------------------

    def _stays(self, left: int, right: int) -> bool:
        """Whether the two tokens, put together, are encoded as themselves."""
        if len(self._fits) >= 4 * CACHE:
            self._fits.clear()
        got = self._fits[left << 20 | right] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == (left, right)
        return got

    def _alone(self, token: bytes) -> int:
        """Id of a vocabulary entry that is encoded as itself, else -1."""
        i = self.id_of[token]
        got = self._whole[token] = i if self.merge(token) == (i,) else -1
        return got

    def piece_counts(self, piece: bytes) -> list[int]:
        """counts[i] is the exact number of tokens of piece[:i].

        The last token of each prefix is the one token that ends there, is encoded as itself and stays
        beside the last token of the prefix that it leaves; its count is that prefix's plus one.
        """
        if (got := self._dp.get(piece)) is not None:
            return got
        last, counts = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        entries, whole, fits, longest = self.id_of, self._whole.get, self._fits.get, self.longest
        for end in range(1, len(piece) + 1):
            for start in range(end - 1, max(0, end - longest) - 1, -1):  # one start alone fits, and most tokens are short
                if (part := piece[start:end]) not in entries:
                    continue
                if (token := whole(part)) is None:
                    token = self._alone(part)
                if token < 0:
                    continue
                if start:
                    if (stays := fits(last[start] << 20 | token)) is None:
                        stays = self._stays(last[start], token)
                    if not stays:
                        continue
                last[end], counts[end] = token, counts[start] + 1
                break
        if len(self._dp) >= CACHE:
            self._dp.clear()
        self._dp[piece] = counts
        return counts

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Exact token count of text[:i] for every i from 0 to len(text).

        The pre-tokenizer cuts a shortened text as it cuts the whole one, but for two cases: a run of
        white space at the end is one piece, and a cut contraction is two.
        """
        out = [0]
        base = 0
        start, before = 0, ""
        for k, part in enumerate(self.segments(text or "")):
            if k % 2:  # a special string counts once it is whole; until then it is plain text after the part before it
                out += (start + self.prefix_counts(before + part[:-1])[len(before) + 1 :]).tolist() + [base + 1]
                base += 1
                continue
            spaces, spaces_base = b"", base
            start, before = base, part
            for piece in self.pieces(part):
                counts = self.piece_counts(piece)
                text_piece = piece.decode("utf-8", "replace")
                ends = np.cumsum([len(c.encode()) for c in text_piece]).tolist()
                own = [base + counts[e] for e in ends]
                if text_piece.isspace():
                    if not spaces:
                        spaces_base = base
                    run = self.piece_counts(spaces + piece)
                    own = [spaces_base + run[len(spaces) + e] for e in ends]
                    spaces += piece
                else:
                    if spaces and text_piece[0] == " ":
                        own[0] = spaces_base + self.piece_counts(spaces + b" ")[-1]
                    if text_piece[0] == "'" and len(text_piece) == 3:
                        own[1] = base + self._plain(text_piece[:2])
                    spaces = b""
                base += counts[-1]
                out += own
        return np.array(out, dtype=np.int32)

    def _plain(self, text: str) -> int:
        return sum(self.piece_counts(p)[-1] for p in self.pieces(text))

    def fit(self, text: str | None, budget: int) -> int:
        """Length in characters of the longest prefix with at most ``budget`` tokens. Counts can fall as a prefix grows, so the last such prefix is meant."""
        within = np.flatnonzero(self.prefix_counts(text) <= budget)
        return int(within[-1]) if len(within) else 0


_LOADED: dict[str, object] = {}


def loaded(kind, spec: str):
    """``kind(spec)``, made once in each Python worker and kept for its later tasks."""
    key = f"{kind.__name__}:{hash(spec)}"
    if key not in _LOADED:
        _LOADED[key] = kind(spec)
    return _LOADED[key]


class ChunkMemory(dict):
    """Chunk without its leading space -> what ``make(" " + chunk)`` gives."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str):
        if len(self) >= CACHE:
            self.clear()
        got = self[chunk] = self.make(" " + chunk)
        return got


def independent(text: str) -> bool:
    """Whether cutting before every space leaves chunks that are encoded alone as in the text: no special string, and no space before white space or the end."""
    return "<|" not in text and not _JOINED_SPACE.search(text)
