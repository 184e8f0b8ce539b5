"""Byte-pair encoding by a public merge list: the list, its lookahead, an encoder and a decoder.

The encoder is a transducer with bounded lookahead. A merge across a place needs its right part to
be intact, which another merge, of lower rank, can prevent by taking that part's right end, and so
on; ranks fall along such a chain, so the merge list itself bounds how far to the right the chain
can reach. Once that many bytes behind a token are known, the token is final and leaves the buffer.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import regex

#: Fixed value: the pattern that this family of tokenizers splits texts by before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"
#: Pieces kept with their ids by a worker; further ones are encoded each time they occur.
KEPT = 1 << 18


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: visible Latin-1 for itself, others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A merge list. tokens: the bytes of each id; rank: the rank of a pair of ids; made: the id by rank."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int]], made: list[int]):
        self.tokens, self.made = tokens, made
        by_bytes = {t: i for i, t in enumerate(tokens) if len(t) == 1}
        self.of_byte = [by_bytes[bytes([b])] for b in range(256)]
        self.rank = {a << 32 | b: r for r, (a, b) in reversed([*enumerate(merges)])}
        self.lookahead = lookahead(tokens, merges, made)
        longest = max(map(len, tokens))
        self.window = 2 * (self.lookahead + longest)

    @classmethod
    def from_json(cls, path: str = DEFAULT_PATH) -> Bpe:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        vocab = model["vocab"]
        tokens = [b""] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            if all(c in letters for c in text):
                tokens[i] = bytes(letters[c] for c in text)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return cls(tokens, [(vocab[a], vocab[b]) for a, b in pairs], [vocab[a + b] for a, b in pairs])

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merge of lowest rank, all its places from the left, until none applies."""
        if len(ids) > 128:
            return self._merge_long(ids)
        rank, none = self.rank, 1 << 60
        while len(ids) > 1:
            pairs = [rank.get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
            best = min(pairs)
            if best == none:
                break
            new, out, i, n = self.made[best], [], 0, len(ids)
            while i < n:
                if i < n - 1 and pairs[i] == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same, with the places of merges in a heap and the symbols in a linked list."""
        rank, n = self.rank, len(ids)
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank.get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = self.made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := rank.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i))
            if (p := before[i]) >= 0 and (x := rank.get(ids[p] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (x, p))
        return [x for x in ids if x >= 0]

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """The ids of one piece that comes in parts; keeps at most window bytes and a part."""
        buffer, of = b"", self.of_byte
        for part in chain(data, (None,)):
            buffer += part or b""
            while buffer and (part is None or len(buffer) >= self.window):
                whole = part is None and len(buffer) <= self.window
                here = buffer if whole else buffer[: self.window]
                final = len(here) if whole else len(here) - self.lookahead
                done = 0
                for i in self.merge([of[b] for b in here]):
                    if done + len(self.tokens[i]) > final:
                        break
                    done += len(self.tokens[i])
                    yield i
                buffer = buffer[done:]

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8", "replace")
        if len(data) <= self.window:
            return tuple(self.merge([self.of_byte[b] for b in data]))
        return tuple(self.stream(data[i : i + self.window] for i in range(0, len(data), self.window)))


def lookahead(tokens: list[bytes], merges: list[tuple[int, int]], made: list[int]) -> int:
    """How many bytes behind a place decide whether a merge goes across it.

    For merge r of u and v: the length of v, and the most that a chain of merges of falling rank can
    need, each starting with a token that stands at the right end within the former one's right part.
    """
    parts = {m: ab for ab, m in zip(merges, made)}
    most: dict[int, int] = {}  # left token -> what the merges so far that start with it need
    out = 0
    for a, v in merges:
        end, need = v, 0
        while True:
            need = max(need, most.get(end, 0))
            if end not in parts:
                break
            end = parts[end][1]
        need += len(tokens[v])
        most[a] = max(most.get(a, 0), need)
        out = max(out, need)
    return out


class Memo(dict):
    """piece -> ids, for the pieces met first; no result depends on it."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.bpe.piece(piece)
        if len(self) < KEPT and len(piece) <= 64:
            self[piece] = ids
        return ids


split = regex.compile(PATTERN).findall


class Decoder:
    """Text of ids that come one after another; bytes of a character not yet complete are held back."""

    def __init__(self, bpe: Bpe):
        self.tokens, self.state = bpe.tokens, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(self.tokens[i] for i in ids))

    def end(self) -> str:
        return self.state.decode(b"", True)


class Rounds:
    """Counts of symbols after merging, for many pieces at once.

    All pieces' symbols stand in one array. In each round adjacent pairs are joined with the sorted
    merge list, each piece's lowest-ranked merge is applied wherever it occurs in it, from the left,
    and pieces without a merge leave.
    """

    def __init__(self, bpe: Bpe):
        self.of = np.array(bpe.of_byte, dtype=np.int64)
        keys = np.fromiter(bpe.rank, dtype=np.int64, count=len(bpe.rank))
        ranks = np.fromiter(bpe.rank.values(), dtype=np.int64, count=len(bpe.rank))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        self.made = np.array(bpe.made, dtype=np.int64)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        out = sizes.copy()
        symbols = self.of[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        of = np.repeat(np.arange(len(pieces)), sizes)
        none = len(self.made)
        while len(symbols) > 1:
            inside = of[:-1] == of[1:]
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(inside & (self.keys[at] == key), self.ranks[at], none)
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            best = np.minimum.reduceat(np.r_[rank, none], starts)
            wide = np.repeat(best, np.diff(np.r_[starts, len(of)]))
            alive = wide < none
            hit = np.r_[rank == wide[:-1], False] & alive
            # Of places that overlap, as in a a a, every second one is taken, from the left.
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(hit, -1, place))
            hit &= run % 2 == 1
            symbols[hit] = self.made[wide[hit]]
            gone = np.r_[False, hit[:-1]]
            np.subtract.at(out, of[hit], 1)
            keep = alive & ~gone
            symbols, of = symbols[keep], of[keep]
        return out
