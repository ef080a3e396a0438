"""Byte-level BPE: a backtracking encoder in linear time, and its decoder.

Text is cut into the pretokens of the vocabulary's pattern, on whole batches of code
points. Each distinct pretoken is encoded once per batch (and kept between batches):
an Aho-Corasick automaton over the vocabulary finds the longest token at every byte;
tokens are taken greedily, a token is accepted after another only if the pair is
compatible (no merge of lower rank crosses or would have eaten its border), else the
next shorter prefix token is tried, else the encoder steps back and marks the place as
dead. The first path through is the result of applying the merges by rank. All
pretokens of a batch advance together in vector steps.

Decoding copies byte ranges out of one blob by an offset table.
"""

from __future__ import annotations

import base64
import itertools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserel.llm import textvec as tv
from tesserel.llm.keys import bounded

VOCABULARY = os.environ.get("TESSEREL_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
KEPT_WORDS = 400_000
_PAIR_SLOTS = 1 << 20
U64 = np.uint64


class Vocabulary:
    """The tables of one vocabulary; all of fixed size, made once on the driver."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        n = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * n
        for t, r in ranks.items():
            self.tokens[r] = t
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.offsets = np.r_[0, np.cumsum(self.size)]
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.shorter = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        for t, r in ranks.items():
            for k in range(len(t) - 1, 0, -1):
                if t[:k] in ranks:
                    self.shorter[r] = ranks[t[:k]]
                    break
            if len(t) > 1:
                parts = [t[i : i + 1] for i in range(len(t))]
                while len(parts) > 2:
                    low, at = r, -1
                    for i in range(len(parts) - 1):
                        x = ranks.get(parts[i] + parts[i + 1], r)
                        if x < low:
                            low, at = x, i
                    if at < 0:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if len(parts) == 2:
                    self.left[r], self.right[r] = ranks[parts[0]], ranks[parts[1]]
        whole = np.flatnonzero(self.left != np.arange(n))
        key = self.left[whole] << 32 | self.right[whole]
        order = np.argsort(key)
        self.pair, self.merged = key[order], whole[order]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of tokens."""
        return self.blob[tv.ragged(self.offsets[ids], self.size[ids])]


class Encoder:
    """Encodes batches; lives in a worker and keeps what it has encoded."""

    def __init__(self, vocab: Vocabulary) -> None:
        import ahocorasick

        self.v = vocab
        self.find = ahocorasick.Automaton()
        for r, t in enumerate(vocab.tokens):
            if t:
                self.find.add_word(t.decode("latin-1"), r)
        self.find.make_automaton()
        self.pair_key = np.full(_PAIR_SLOTS, -1, np.int64)
        self.pair_ok = np.zeros(_PAIR_SLOTS, bool)
        self.forget()

    def forget(self) -> None:
        self.known, self.first, self.count, self.ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE can leave token a followed by token b; looked up in, and added to, a table."""
        key = a << 32 | b
        slot = (tv.mix(key.view(U64)) & U64(_PAIR_SLOTS - 1)).astype(np.int64)
        ok = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            ok[new] = self._compatible(a[new], b[new])
            self.pair_ok[slot[new]] = ok[new]
            self.pair_key[slot[new]] = key[new]
            # two new pairs may want one slot: what it holds must be one of them, entirely
            lost = new[self.pair_key[slot[new]] != key[new]]
            if len(lost):
                self.pair_key[slot[lost]] = -1
        return ok

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        v = self.v
        ok = np.ones(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), 1 << 40)
        a, b = a.copy(), b.copy()
        while len(live):
            key = a << 32 | b
            at = np.minimum(np.searchsorted(v.pair, key), len(v.pair) - 1)
            bad = (v.pair[at] == key) & (v.merged[at] < limit)
            ok[live[bad]] = False
            # undo the later of the two merges; a token that is one byte leaves the other's to be undone
            la, lb = v.right[a], v.left[b]
            can_a, can_b = la != a, lb != b
            use_a = np.where(a > b, can_a, can_a & ~can_b)
            use_b = ~use_a & can_b
            limit = np.where(use_a, a, b + 1)
            a, b = np.where(use_a, la, a), np.where(use_b, lb, b)
            go = ~bad & (use_a | use_b)
            live, limit, a, b = live[go], limit[go], a[go], b[go]
        return ok

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts and token ids of each of ``words`` (none empty)."""
        v = self.v
        text = "Ā".join([w.decode("latin-1") for w in words])
        size = np.array([len(w) for w in words], np.int64)
        begin = np.r_[0, np.cumsum(size + 1)[:-1]]
        end = begin + size
        n = len(text)
        found = np.fromiter(itertools.chain.from_iterable(self.find.iter(text)), np.int64)
        stop, tok = found[::2], found[1::2]
        start = stop - v.size[tok] + 1
        longest = np.full(n + 1, -1, np.int64)
        order = np.argsort(v.size[tok], kind="stable")
        longest[start[order]] = tok[order]
        chosen, before = np.full(n + 2, -1, np.int64), np.full(n + 2, -1, np.int64)
        alive = np.ones(n + 2, bool)
        pos, live = begin.copy(), np.arange(len(words))
        cur = longest[pos]
        while len(live):
            to = pos + v.size[cur]
            prev = before[pos]
            ok = alive[to]
            ask = np.flatnonzero(ok & (prev >= 0))
            if len(ask):
                ok[ask] = self.compatible(chosen[prev[ask]], cur[ask])
            yes, no = np.flatnonzero(ok), np.flatnonzero(~ok)
            chosen[pos[yes]] = cur[yes]
            before[to[yes]] = pos[yes]
            pos[yes] = to[yes]
            cur[yes] = longest[to[yes]]
            less = v.shorter[cur[no]]
            back = no[less < 0]
            cur[no] = less
            alive[pos[back]] = False
            pos[back] = before[pos[back]]
            cur[back] = chosen[pos[back]]
            open_ = pos < end[live]
            if not open_.all():
                live, pos, cur = live[open_], pos[open_], cur[open_]
        # walk the chosen path back from every word's end
        marks = np.zeros(n + 2, bool)
        at, low = end.copy(), begin
        while len(at):
            at = before[at]
            marks[at] = True
            more = at > low
            at, low = at[more], low[more]
        place = np.flatnonzero(marks)
        count = np.searchsorted(place, end) - np.searchsorted(place, begin)
        return count, chosen[place].astype(np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens per document, all tokens in order, bytes, offsets) of a column of texts."""
        buf, offs = tv.utf8(column)
        start, end, first = pretokens(buf, offs)
        sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(tv.BYTE_KEYS[buf] * tv.powers(tv.BASE, len(buf)), out=sums[1:])
        h = tv.mix((sums[end] - sums[start]) * tv.powers(tv.UNBASE, len(buf) + 1)[start] + (end - start).astype(U64))
        u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        where = np.searchsorted(self.known, u)
        inside = np.minimum(where, max(len(self.known) - 1, 0))
        miss = self.known[inside] != u if len(self.known) else np.ones(len(u), bool)
        if miss.any():
            data = buf.tobytes()
            new = np.flatnonzero(miss)
            count, ids = self.encode_words([data[s:e] for s, e in zip(start[at[new]].tolist(), end[at[new]].tolist())])
            if len(self.known) + len(new) > KEPT_WORDS:
                keep = np.flatnonzero(~miss)
                k = inside[keep]
                old = self.ids[tv.ragged(self.first[k], self.count[k])]
                self.known, self.count, self.ids = u[keep], self.count[k], old
                self.first = np.cumsum(self.count) - self.count
            known = np.r_[self.known, u[new]]
            firsts = np.r_[self.first, len(self.ids) + np.cumsum(count) - count]
            counts = np.r_[self.count, count]
            order = np.argsort(known)
            self.known, self.first, self.count = known[order], firsts[order], counts[order]
            self.ids = np.r_[self.ids, ids]
        k = np.searchsorted(self.known, u)[inverse] if len(u) else np.zeros(0, np.int64)
        n = self.count[k]
        ids = self.ids[tv.ragged(self.first[k], n)]
        total = np.r_[0, np.cumsum(n)]
        return total[first[1:]] - total[first[:-1]], ids, buf, offs


_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, for every code point."""
    global _classes
    if _classes is None:
        kind = {"L": 1, "N": 2}
        _classes = np.array([kind.get(unicodedata.category(chr(c))[0], 3) for c in range(0x110000)], np.uint8)
        _classes[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return _classes


def pretokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first of each document and the total) of the pretokens, in bytes.

    The pattern: contractions ('s 't 're 've 'm 'll 'd); runs of letters, of numbers or
    of other signs, each with one space before it; white space, all but its last
    character if something follows.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    point = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    n = len(point)
    k = classes()[point]
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(lead, offs)] = True
    run = edge[:n].copy()
    run[1:] |= k[1:] != k[:-1]
    start = run.copy()
    # a run of signs after white space in the same document
    after = np.flatnonzero(run[1:] & ~edge[1:n] & (k[:-1] == 0)) + 1
    start[after - 1] = True
    start[after[point[after - 1] == 32]] = False
    quote = np.flatnonzero((point[:-1] == 39) & start[:-1] & (k[1:] == 1) & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        p = np.r_[point, np.zeros(2, np.uint32)]
        one, two = p[quote + 1], p[quote + 2]
        two = np.where(edge[np.minimum(quote + 2, n)], 0, two)
        short = np.isin(one, [115, 116, 109, 100])
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        for which, size in ((short, 2), (long, 3)):
            q = quote[which]
            start[q + 1] = False
            rest = q + size
            ok = rest < n
            rest = rest[ok]
            start[rest[(k[rest] == 1) & ~edge[rest]]] = True
    at = np.flatnonzero(start)
    begin = lead[at]
    return begin, np.r_[begin[1:], len(buf)], np.searchsorted(begin, offs)


_workers: dict[int, Encoder] = {}


def encoder(v: Vocabulary) -> Encoder:
    """The encoder that this worker keeps for ``v``."""
    enc = _workers.get(id(v))
    if enc is None:
        _workers.clear()
        enc = _workers[id(v)] = Encoder(v)
    return enc


def _encoded(vocab):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        enc = encoder(v)
        for batch in batches:
            for b in tv.slices(batch, "text", 2_000_000):
                n, ids, buf, offs = enc.encode(b.column("text"))
                back = v.decode(ids)
                same = np.ones(b.num_rows, bool)
                if not np.array_equal(back, buf):
                    ends = np.r_[0, np.cumsum(v.size[ids])][np.r_[0, np.cumsum(n)]]
                    same = np.array([np.array_equal(back[ends[i] : ends[i + 1]], buf[offs[i] : offs[i + 1]]) for i in range(b.num_rows)])
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n.astype(np.int32)), tv.lists(ids, n), pa.array(same)], ["id", "n_tokens", "tokens", "round_trip"])

    return run


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary.load(path)
    return _vocabularies[path]


def op5_bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) for every row of ``docs``.

    ``round_trip`` tells whether the decoded tokens are the text again. Null and empty
    texts have no tokens; the length of a text isn't limited; repeated rows are encoded
    each; null ids are kept; other columns are ignored.
    """
    vocab = bounded(docs).sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_encoded(vocab), f"id {kind}, n_tokens int, tokens array<int>, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from token lists; null lists give empty texts. Bytes that aren't UTF-8 are replaced."""
    vocab = tokens.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for b in batches:
            lists_ = b.column("tokens").fill_null([]) if b.column("tokens").null_count else b.column("tokens")
            offs = lists_.offsets.to_numpy().astype(np.int64)
            ids = lists_.values.to_numpy()[offs[0] : offs[-1]]
            data = v.decode(ids).tobytes()
            ends = np.r_[0, np.cumsum(v.size[ids])][offs - offs[0]]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([data[s:e].decode("utf-8", "replace") for s, e in zip(ends[:-1], ends[1:])], pa.string())], ["id", "text"])

    return tokens.select(F.col(id_col).alias("id"), F.col(tokens_col).cast("array<int>").alias("tokens")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
