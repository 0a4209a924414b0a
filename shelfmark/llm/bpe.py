"""Byte-pair tokens of a published vocabulary: exact counts at every prefix, and ids.

The vocabulary file is a parameter. Texts are cut into pre-tokens by the pattern of byte-level
tokenizers, and special strings of the file stand for one token each, as the library has it.
"""

from __future__ import annotations

import functools
import json
import struct

import numpy as np
import regex
import tiktoken

# Fixed value: the pre-token pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Entries of a worker's memory of words; when full it starts afresh.
REMEMBERED = 400_000


def _printable_bytes() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens by bytes, in the order of their merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        if held.get("normalizer") or held["pre_tokenizer"]["type"] != "ByteLevel" or held["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"not a byte-level vocabulary without a prefix space: {path}")
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        byte = _printable_bytes()
        self.ids = {
            bytes(byte[c] for c in t): i for t, i in held["model"]["vocab"].items() if t not in self.special
        }
        # bytes first, then tokens in the order of the merges that make them
        order = {bytes(byte[c] for c in t): None for t in byte}
        for m in held["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            order.setdefault(bytes(byte[c] for c in a + b))
        self.tokens = [b"", *order]  # number 0 stands before the first token
        self.rank = {t: i for i, t in enumerate(order, 1)}
        self.longest = max(map(len, self.rank))
        self.split_special = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None

    def encoder(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=self.ids, special_tokens=self.special)


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PrefixCounts:
    """Exact token counts of every prefix, by dynamic programming over pre-tokens.

    For each end of a pre-token's prefix the last token of its encoding is the one token that ends
    there and may follow the last token before it; two tokens may follow each other if their bytes
    together encode to just them. So the count at an end is the count before that token plus one,
    and one pass gives the counts at all ends. Many pre-tokens are taken through the pass together.
    """

    def __init__(self, path: str):
        self.vocabulary = held = vocabulary(path)
        self.encoder = held.encoder()
        self.pattern, self.blank = regex.compile(PATTERN), regex.compile(r"\s*")
        self.pretokens: dict[str, int] = {}
        self.units: dict[str, int] = {}
        # the pairs asked for so far, sorted, for many look-ups at once
        self.asked, self.said = np.zeros(0, np.int64), np.zeros(0, bool)
        # tokens read backwards as a tree: (node, byte) to node, and the token that a node completes
        nodes, tokens = {}, [0]
        for token, i in held.rank.items():
            at = 0
            for byte in reversed(token):
                at = nodes.setdefault(at << 8 | byte, len(nodes) + 1)
                if at == len(tokens):
                    tokens.append(0)
            tokens[at] = i
        keys = np.fromiter(nodes, np.int64, len(nodes))
        order = np.argsort(keys)
        self.steps, self.step_to = keys[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order]
        self.token_at = np.array(tokens)

    def _follows(self, pair: int) -> bool:
        two = [self.vocabulary.tokens[i] for i in (pair >> 32, pair & 0xFFFFFFFF)]
        merged = self.encoder._encode_single_piece(two[0] + two[1])  # byte-pair merges without the pattern
        return merged == [self.vocabulary.ids[t] for t in two if t]

    def _follow_many(self, pairs: np.ndarray) -> np.ndarray:
        if len(self.asked) >= REMEMBERED:  # before the look-up, so that all pairs of this call are known after it
            self.asked, self.said = self.asked[:0], self.said[:0]
        place = np.searchsorted(self.asked, pairs)
        place[place == len(self.asked)] = 0
        new = np.unique(pairs[self.asked[place] != pairs]) if len(self.asked) else np.unique(pairs)
        if len(new):
            said = np.fromiter(map(self._follows, new.tolist()), bool, len(new))
            keys = np.concatenate((self.asked, new))
            order = np.argsort(keys, kind="stable")
            self.asked, self.said = keys[order], np.concatenate((self.said, said))[order]
            place = np.searchsorted(self.asked, pairs)
        return self.said[place]

    def ends(self, piece: bytes) -> np.ndarray:
        """Token counts of piece[:0], piece[:1], ... of one pre-token's bytes."""
        return self.ends_many([piece])[0]

    def ends_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts at all ends of many pre-tokens, one after the other, and where each begins."""
        size = np.array([len(p) + 1 for p in pieces])
        start = np.cumsum(size) - size
        x = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64)
        inner = np.arange(len(x)) - np.repeat(start, size)  # bytes of the piece before this place
        where, length, token = [], [], []
        at = np.flatnonzero(inner > 0)
        node, back = np.zeros(len(at), np.int64), 1
        while len(at):
            key = node << 8 | x[at - back]
            step = np.searchsorted(self.steps, key)
            step[step == len(self.steps)] = 0
            go = self.steps[step] == key
            at, node = at[go], self.step_to[step[go]]
            full = self.token_at[node] > 0
            where.append(at[full])
            token.append(self.token_at[node[full]])
            length.append(np.full(len(where[-1]), back))
            more = inner[at] > back
            at, node, back = at[more], node[more], back + 1
        where, length, token = map(np.concatenate, (where, length, token))
        order = np.argsort(inner[where], kind="stable")
        where, length, token = where[order], length[order], token[order]
        level = inner[where]
        cut = np.append(np.flatnonzero(np.append(True, level[1:] != level[:-1])), len(level)).tolist() if len(level) else [0]
        last, count = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for s, e in zip(cut, cut[1:]):
            before = where[s:e] - length[s:e]
            ok = self._follow_many(last[before] << 32 | token[s:e])
            end = where[s:e][ok]
            last[end] = token[s:e][ok]
            count[end] = count[before[ok]] + 1
        return count, start

    def _learn(self, pieces: set[str]) -> None:
        """Count pre-tokens not met before."""
        new = [p for p in pieces if p not in self.pretokens]
        if len(self.pretokens) + len(new) > REMEMBERED:
            self.pretokens, new = {}, list(pieces)
        if new:
            held = [p.encode() for p in new]
            count, start = self.ends_many(held)
            self.pretokens.update(zip(new, count[start + [len(p) for p in held]].tolist()))

    def _plain(self, text: str) -> int:
        found = self.pattern.findall(text)
        self._learn(set(found))
        return sum(map(self.pretokens.__getitem__, found))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        return self.counts([text])[0]

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of whole texts.

        A blank and what stands up to the next one counts alike wherever it stands, so a worker
        remembers such words. Texts with longer runs of white space are cut by the pattern as a whole.
        """
        special = self.vocabulary.split_special
        split = [t.split(" ") if t and not (special and special.search(t)) else None for t in texts]
        met = set().union(*[u[1:] for u in split if u])
        if len(self.units) + len(met) > REMEMBERED:
            self.units = {}
        new = [u for u in met - self.units.keys() if u and not u[0].isspace() and not u[-1].isspace()]
        cut = [self.pattern.findall(" " + u) for u in new]
        self._learn(set().union(*cut))
        known = self.pretokens.__getitem__
        self.units.update((u, sum(map(known, c))) for u, c in zip(new, cut))
        out, get = [], self.units.get
        for text, units in zip(texts, split):
            if not text:
                out.append(0)
            elif units is None:
                parts = special.split(text)
                out.append(sum(self.counts(parts)) + len(parts) - 1)
            else:
                found = list(map(get, units[1:]))
                odd = None in found or units[0][-1:].isspace()
                out.append(self._plain(text) if odd else sum(found) + self._plain(units[0]))
        return out

    def prefixes(self, text: str | None) -> np.ndarray:
        """Tokens of text[:0], text[:1], ..., text: exact at every prefix, and not always rising."""
        text = text or ""
        split = self.vocabulary.split_special
        found = split.search(text) if split else None
        if found:
            # inside a special string its beginning is ordinary text that may join what precedes
            head = self._ordinary(text[: found.end() - 1])
            before = self._ordinary(text[: found.start()])[-1]
            return np.concatenate((head, before + 1 + self.prefixes(text[found.end() :])))
        return self._ordinary(text)

    def _chars(self, piece: str) -> np.ndarray:
        """Counts at the characters of one pre-token."""
        return self.ends(piece.encode())[np.cumsum([0] + [len(c.encode()) for c in piece])]

    def _ordinary(self, text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.int64)
        before = blank_from = blank_before = 0
        in_blank = False
        for m in self.pattern.finditer(text):
            s, e = m.span()
            piece = text[s:e]
            lead = self.blank.match(piece).end()
            if lead and not in_blank:
                blank_from, blank_before = s, before
            counts = self._chars(piece)
            out[s + 1 : e + 1] = before + counts[1:]
            if lead:
                # a prefix that ends in a run of white space has the whole run as one pre-token
                out[s + 1 : s + lead + 1] = blank_before + self._chars(text[blank_from : s + lead])[s - blank_from + 1 :]
            if piece[0] == "'" and len(piece) == 3 and piece[1].isalpha():
                out[s + 2] = before + self._plain("'") + self._plain(piece[1])
            in_blank = lead == len(piece)
            before += int(counts[-1])
        return out

    def truncate(self, text: str | None, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        at = np.flatnonzero(self.prefixes(text) <= budget)
        return (text or "")[: at[-1] if len(at) else 0]


@functools.lru_cache(2)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)


class Ids:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    Words between single blanks encode alike wherever they stand, so a worker remembers them; those
    it has not met yet are encoded together. Texts with longer runs of white space go whole.
    """

    def __init__(self, path: str):
        self.encoder = vocabulary(path).encoder()
        width = np.zeros(self.encoder.n_vocab, np.int64)
        for token, i in vocabulary(path).ids.items():
            width[i] = len(token)
        self.width, self.units = width, {}

    def forget(self) -> None:
        self.units = {}

    def _plain(self, text: str) -> bytes:
        found = self.encoder.encode(text, allowed_special="all")
        return struct.pack(f"<{len(found)}I", *found)

    def _learn(self, words: set[str]) -> None:
        if len(self.units) + len(words) > REMEMBERED:
            self.units = {}
        whole = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        if not whole:
            return
        ids = np.asarray(self.encoder.encode_to_numpy(" " + " ".join(whole), disallowed_special=()), "<u4")
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(w.encode()) + 1 for w in whole])) + 1
        held, at = ids.tobytes(), 0
        for w, end in zip(whole, (ends * 4).tolist()):
            self.units[w] = held[at:end]
            at = end

    def batch(self, texts: list[str | None]) -> list[bytes]:
        split = [t.split(" ") if t and not any(s in t for s in self.encoder.special_tokens_set) else None for t in texts]
        met = set().union(*[u[1:] for u in split if u])
        if new := met - self.units.keys():
            before = self.units
            self._learn(new)
            if self.units is not before:
                self._learn(met - self.units.keys())
        out, get = [], self.units.get
        for text, units in zip(texts, split):
            if not text:
                out.append(b"")
                continue
            found = list(map(get, units[1:])) if units and not units[0][-1:].isspace() else [None]
            out.append(self._plain(text) if None in found else self._plain(units[0]) + b"".join(found))
        return out


@functools.lru_cache(2)
def token_ids(path: str) -> Ids:
    return Ids(path)
