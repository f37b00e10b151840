"""Byte-pair merging of many words at once: each round merges every word's pair of the lowest rank, in all words.

The words lie end to end in one array of symbols, with the rank of each adjacent pair beside it. Merging changes only the pairs beside it, so only those
are looked up again. A pair made in a round has a higher rank than the round's, so merging all occurrences of a word's lowest pair together, from
the left and without overlaps, equals merging them one at a time.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.token_counts import byte_alphabet

SUFFIX = "</w>"
NO_RANK = (1 << 16) - 1
SLOTS_BITS = 18
U = np.uint64


class PairTable:
    """Pairs of symbols under 2**16 and their ranks under NO_RANK, each in one of two slots of its own."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        keys = first.astype(U) << U(16) | second.astype(U)
        rng = np.random.default_rng(1)
        for _ in range(100):
            self.factors = rng.integers(1 << 62, 1 << 63, 2, dtype=U) | U(1)
            if self.filled(keys):
                return
        raise ValueError("no table holds these pairs")

    def slots(self, keys: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            return [(keys * f >> U(64 - SLOTS_BITS)).astype(np.int64) for f in self.factors]

    def filled(self, keys: np.ndarray) -> bool:
        """Puts each key into one of its slots; a key that is pushed out goes to its other one."""
        one, other = self.slots(keys)
        holder = np.full(1 << SLOTS_BITS, -1)
        left, to = np.arange(len(keys)), one
        for _ in range(500):
            pushed = holder[to]
            holder[to] = left
            placed = holder[to] == left
            pushed_at, pushed = to[placed], pushed[placed]
            pushed_at, pushed = pushed_at[pushed >= 0], pushed[pushed >= 0]
            left = np.concatenate([left[~placed], pushed])
            at = np.concatenate([to[~placed], pushed_at])
            to = np.where(one[left] == at, other[left], one[left])
            if not len(left):
                self.table = np.where(holder >= 0, keys[holder] << U(16) | holder.astype(U), U((1 << 64) - 1))
                return True
        return False

    def known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's rank (or anything) and whether it has one."""
        a, b = (self.table[s] for s in self.slots(keys))
        one = a >> U(16) == keys
        return np.where(one, a, b) & U(NO_RANK), one | (b >> U(16) == keys)

    def ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        rank, known = self.known(first.astype(U) << U(16) | second.astype(U))
        return np.where(known, rank, U(NO_RANK)).astype(np.int32)


class WordMerges:
    """The merges of a byte-level vocabulary whose words end with SUFFIX, from the library's own description of it."""

    def __init__(self, spec: dict):
        model = spec["model"]
        ids = model["vocab"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != SUFFIX or model["continuing_subword_prefix"] or model["ignore_merges"] or model["dropout"] or len(model["merges"]) > NO_RANK or max(ids.values()) > NO_RANK:
            raise ValueError("not a vocabulary of merges of words that end with " + SUFFIX)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.inside = np.array([ids[c] for c in byte_alphabet()], np.int32)
        self.last = np.array([ids[c + SUFFIX] for c in byte_alphabet()], np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.table = PairTable(np.array([ids[a] for a, _ in pairs]), np.array([ids[b] for _, b in pairs]))

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (of one byte at least), little-endian unsigned 32-bit."""
        if not words:
            return []
        flat, size = self.merge(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))
        data, cuts = flat.tobytes(), (4 * np.cumsum(size)).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def merge(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that lie end to end, one at least: their ids end to end, and how many each has."""
        ends = np.cumsum(length)
        symbols = self.inside[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(length), dtype=np.int32), length)
        rank = np.full(len(symbols), NO_RANK, np.int32)  # of a symbol and the next of its word
        pair = np.flatnonzero(owner[:-1] == owner[1:])
        rank[pair] = self.table.ranks(symbols[pair], symbols[pair + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lens = np.diff(np.append(first, len(owner)))
            lowest = np.minimum.reduceat(rank, first)
            over = np.repeat(lowest == NO_RANK, lens)
            if over.any():
                done.append((owner[over], symbols[over]))
                left = ~over
                owner, symbols, rank = owner[left], symbols[left], rank[left]
                lowest, lens = lowest[lowest != NO_RANK], lens[lowest != NO_RANK]
                if not len(symbols):
                    break
            hit = rank == np.repeat(lowest, lens)
            # hits in a row are one symbol repeated: of those, each second one overlaps the one before
            at = np.flatnonzero(hit)
            if (np.diff(at) == 1).any():
                begins = np.append(True, np.diff(at) != 1)
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
                at = at[run % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            owner, symbols, rank = owner[keep], symbols[keep], rank[keep]
            at = place[at]
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            changed[np.maximum(at - 1, 0)] = True
            changed = np.flatnonzero(changed[:-1])
            whole = owner[changed] == owner[changed + 1]
            rank[at[at == len(symbols) - 1]] = NO_RANK
            rank[changed[~whole]] = NO_RANK
            changed = changed[whole]
            rank[changed] = self.table.ranks(symbols[changed], symbols[changed + 1])
        owners, found = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owners, kind="stable")
        return found[order].astype("<u4"), np.bincount(owners, minlength=len(length))
