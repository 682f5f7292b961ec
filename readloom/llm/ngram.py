"""Language-model scoring with bigram tries in Elias-Fano form.

Counts come from the training documents alone. Contexts are dealt to buckets by hash; a bucket merges what all blocks
of documents counted, builds its trie and answers the blocks, so no task holds the model of the whole corpus and
nothing is broadcast. A block sends each different word and bigram once, whatever its frequency.

A bucket's trie has two levels in one memory-mapped file: contexts in order of their hashes with Elias-Fano pointers to
their successors, and the successors as one Elias-Fano sequence. A successor is stored relative to its context, as the
rank of the word plus one more than the value that ends the context before, so the level rises and is no longer than
its ranks. A bigram is looked up by following the pointers of its context to a range, taking the range's base from the
value before it, and a successor search that must end inside the range. Each entry carries its discounted probability in
eight bits, and each context its back-off weight.

p(w | c) = max(n(c, w) - discount, 0) / n(c) + discount * types(c) / n(c) * p(w), with p(w) the add-half unigram
probability; an unseen context leaves p(w). It sums to one over the known words and one unknown word.

Rows without doc_id are left out; null and empty texts are one end token; repeated rows count as often as they occur.
With no training document every unigram probability is that of the unknown word, 1.
"""
from __future__ import annotations

import math
import mmap
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from readloom.llm import base as B
from readloom.llm.suffix import MESSAGE, message, pack, unpack

#: Hashes of the end and of the place before the first word; no word has them but by a collision of 64 bits.
END, BEGIN = np.uint64(0x0E0D0E0D0E0D0E0D), np.uint64(0xBE61BE61BE61BE61)
_48 = np.uint64((1 << 48) - 1)
_32 = np.uint64(32)


@dataclass(frozen=True)
class LmParams:
    discount: float = 0.75
    #: Quantisation: codes 1 to 255 stand for log10 values from -span to 0; code 0 is an absent entry.
    span: float = 9.0


def encode(value: np.ndarray, p: LmParams) -> np.ndarray:
    return (np.clip(np.rint(np.log10(np.maximum(value, 1e-300)) * (254 / p.span)), -254, 0) + 255).astype(np.uint8)


def decode(code: np.ndarray, p: LmParams) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((code.astype(np.float64) - 255) * (p.span / 254)), 0.0)


class EliasFano:
    """A rising sequence below `universe`: low bits packed, high bits in unary, with counts of zeros for each 64 bits."""

    def __init__(self, arrays: list[np.ndarray], n: int, low_bits: int):
        self.low, self.high, self.zeros = arrays
        self.ones = 64 * np.arange(len(self.zeros)) - self.zeros
        self.n, self.bits = n, low_bits

    @staticmethod
    def build(values: np.ndarray, universe: int) -> tuple[list[np.ndarray], int, int]:
        n = len(values)
        bits = max(0, int(math.log2(max(1, universe // max(1, n)))))
        v = values.astype(np.uint64)
        low = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        if bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            part = v & np.uint64((1 << bits) - 1)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        one = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (universe >> bits) + n + 2
        flags = np.zeros((size + 63) // 64 * 64, bool)
        flags[one] = True
        high = np.packbits(flags, bitorder="little").view("<u8")
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))])
        return [low, high, zeros], n, bits

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th one or zero (from 0) in the high bits."""
        before = self.ones if bit else self.zeros
        word = np.searchsorted(before, k, "right") - 1
        left = (k - before[word]).astype(np.uint64)
        bits = self.high[word] if bit else ~self.high[word]
        at = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.uint64)
            go = left >= count
            left -= np.where(go, count, np.uint64(0))
            bits = np.where(go, bits >> np.uint64(width), bits)
            at += np.where(go, width, 0)
        return word * 64 + at

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th value."""
        return ((self.select(i, 1) - i) << self.bits) | self.low_at(i).astype(np.int64)

    def low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[word] >> shift
        x |= np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return x & np.uint64((1 << self.bits) - 1)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value >= x, and whether it is x."""
        x = x.astype(np.uint64)
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        want = x & np.uint64((1 << self.bits) - 1)
        a = np.where(h > 0, self.select(np.maximum(h - 1, 0), 0) - h + 1, 0)
        b = self.select(h, 0) - h
        lo, hi = a.copy(), b.copy()
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            less = self.low_at(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
        hit = lo < b
        hit[hit] = self.low_at(lo[hit]) == want[hit]
        return lo, hit


class Trie:
    """Contexts and their successors, in one memory-mapped file that is gone when the trie is."""

    def __init__(self, context: np.ndarray, rank: np.ndarray, count: np.ndarray, n_contexts: int, p: LmParams):
        """Of train bigrams (context number, word rank, count), sorted."""
        sums = np.bincount(context, count, n_contexts)
        types = np.bincount(context, minlength=n_contexts)
        pointers, n0, b0 = EliasFano.build(np.concatenate([[0], np.cumsum(types)]), len(context) + 1)
        last = np.flatnonzero(np.diff(context, append=-1))  # the greatest rank of each context with successors
        base = np.zeros(n_contexts, np.int64)
        base[context[last]] = np.cumsum(rank[last] + 1) - rank[last] - 1
        level, n1, b1 = EliasFano.build(base[context] + rank, int((rank[last] + 1).sum()) + 1)
        self.end = int((rank[last] + 1).sum()) + 1
        share = encode(np.maximum(count - p.discount, 1e-12) / sums[context], p)
        backoff = np.where(types > 0, encode(p.discount * types / np.maximum(sums, 1), p), 255).astype(np.uint8)
        arrays = [*pointers, *level, share, backoff]
        self.file = tempfile.TemporaryFile()
        at = [0]
        for a in arrays:
            data = a.tobytes()
            self.file.write(data + b"\0" * (-len(data) % 8))
            at.append(at[-1] + len(data) + -len(data) % 8)
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), max(at[-1], 1), access=mmap.ACCESS_READ)
        v = [np.frombuffer(self.map, a.dtype, len(a), o) for a, o in zip(arrays, at)]
        self.pointers, self.level, self.share, self.backoff = EliasFano(v[:3], n0, b0), EliasFano(v[3:6], n1, b1), v[6], v[7]

    def lookup(self, context: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Code of each bigram, 0 where it is absent."""
        out = np.zeros(len(context), np.uint8)
        for i in range(0, len(context) if self.level.n else 0, 1 << 17):
            c, r = context[i:i + (1 << 17)], rank[i:i + (1 << 17)]
            a, b = self.pointers.access(c), self.pointers.access(c + 1)
            base = np.where(a > 0, self.level.access(np.maximum(a - 1, 0)) + 1, 0)
            want = np.minimum(base + r, self.end - 1)
            at, hit = self.level.successor(want)
            hit &= (at >= a) & (at < b) & (want == base + r)
            out[i:i + (1 << 17)][hit] = self.share[at[hit]]
        return out


class Block:
    """The different words and bigrams of a block's documents, in an order that only depends on the documents."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, buckets: int):
        hashes, sizes = [], []
        for i, j in B.slices(off):
            h, _, _, at = B.words(raw[off[i]:off[j]], off[i:j + 1] - off[i])
            n = np.diff(at)
            seq = np.full(len(h) + j - i, END)
            keep = np.ones(len(seq), bool)
            keep[np.cumsum(n + 1) - 1] = False
            seq[keep] = h
            hashes.append(seq)
            sizes.append(n + 1)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        seq = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        words, self.token = np.unique(np.concatenate([seq, [END, BEGIN]]), return_inverse=True)
        place = np.lexsort((words, words % np.uint64(buckets)))
        self.words = words[place]
        number = np.empty(len(words), np.int64)
        number[place] = np.arange(len(words))
        self.token = number[self.token]
        begin, self.token = self.token[-1], self.token[:-2]
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        if len(before):
            before[np.concatenate([[0], np.cumsum(self.sizes)[:-1]])] = begin
        self.before = before
        key = before.astype(np.uint64) << _32 | self.token.astype(np.uint64)
        # successors are sent by their low 48 bits, in that order
        self.key, self.pair = np.unique(key, return_inverse=True)
        self.bucket = (self.words % np.uint64(buckets)).astype(np.int64)

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = train[self.row]
        return np.bincount(self.token[t], minlength=len(self.words)), np.bincount(self.pair[t], minlength=len(self.key))


def send_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.runs(batches, "block"):
            key = table["block"].to_numpy()
            at = B.starts_of(key)
            for a, b in zip(at[:-1], at[1:]):
                part = table.slice(a, b - a)
                x = Block(*B.text_bytes(part["text"]), buckets)
                c, n = x.counts(~part["held_out"].to_numpy(zero_copy_only=False))
                context = (x.key >> _32).astype(np.int64)
                low = x.words[(x.key & np.uint64(0xFFFFFFFF)).astype(np.int64)] & _48
                edges = np.searchsorted(x.bucket, np.arange(buckets + 1))
                rows = []
                for k in range(buckets):
                    i, j = edges[k], edges[k + 1]
                    if i < j:
                        s, e = np.searchsorted(context, [i, j])
                        rows.append((k, int(key[a]), pack(x.words[i:j], c[i:j].astype(np.uint32), np.bincount(context[s:e] - i, minlength=j - i).astype(np.uint32), (low[s:e] >> _32).astype(np.uint16), (low[s:e] & np.uint64(0xFFFFFFFF)).astype(np.uint32), n[s:e].astype(np.uint32))))
                if rows:
                    yield message(rows)
    return run


def answer(p: LmParams):
    """Counts by bucket -> trie; its answers to the blocks, and a row (bucket, -1, totals) with its sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.runs(batches, "bucket"):
            key, block, blobs = table["bucket"].to_numpy(), table["block"].to_numpy(), table["blob"].to_pylist()
            at, rows = B.starts_of(key), []
            for a, b in zip(at[:-1], at[1:]):
                parts = [unpack(x) for x in blobs[a:b]]
                word, count, degree, hi, lo, n = (np.concatenate(x) for x in zip(*parts))
                contexts, own = np.unique(word, return_inverse=True)
                total = np.bincount(own, count, len(contexts)).astype(np.int64)
                low = hi.astype(np.uint64) << _32 | lo.astype(np.uint64)
                ranks, rank = np.unique(low, return_inverse=True)
                pairs, pair = np.unique(np.repeat(own, degree).astype(np.uint64) << _32 | rank.astype(np.uint64), return_inverse=True)
                seen = np.bincount(pair, n, len(pairs)).astype(np.int64)
                context, r = (pairs >> _32).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
                known = seen > 0
                trie = Trie(context[known], r[known], seen[known], len(contexts), p)
                code = trie.lookup(context, r)[pair]
                w, g = np.cumsum([0, *[len(x[0]) for x in parts]]), np.cumsum([0, *[len(x[3]) for x in parts]])
                for k, to in enumerate(block[a:b].tolist()):
                    mine = own[w[k]:w[k + 1]]
                    rows.append((int(key[a]), to, pack(total[mine], trie.backoff[mine], code[g[k]:g[k + 1]])))
                rows.append((int(key[a]), -1, np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()))
            yield message(rows)
    return run


def score(p: LmParams, buckets: int, n: int, v: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({k: pa.array([], t) for k, t in KINDS})
        x = Block(*B.text_bytes(docs["text"]), buckets)
        got = [unpack(b) for _, b in sorted(zip(answers["bucket"].to_pylist(), answers["blob"].to_pylist()))]
        count, back, code = (np.concatenate(y) for y in zip(*got))
        total = n + 0.5 * (v + 1)
        unigram = (count + 0.5) / total
        prob = decode(code, p)[x.pair] + np.minimum(decode(back, p), 1.0)[x.before] * unigram[x.token]
        rows = len(x.sizes)
        base = np.bincount(x.row, np.log10(unigram)[x.token], rows)
        full = np.bincount(x.row, np.log10(prob), rows)
        known = np.bincount(x.row, count[x.token] > 0, rows).astype(np.int64)
        cols = [docs["doc_id"], docs["held_out"], pa.array(x.sizes.astype(np.int64)), pa.array(known), pa.array(np.full(rows, n)), pa.array(base), pa.array(full)]
        return pa.table({k: c for (k, _), c in zip(KINDS, cols)})
    return run


KINDS = (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))
SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_documents(docs: DataFrame, p: LmParams = LmParams()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs (doc_id, text)."""
    n = B.parts(docs.sparkSession)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    x = B.documents(docs).withColumns({"held_out": held, "block": F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")})
    x = x.repartition(n, "block").sortWithinPartitions("block", "doc_id", "text")
    sent = x.mapInArrow(send_counts(n), MESSAGE).repartition(n, "bucket").sortWithinPartitions("bucket")
    answers = B.cut(sent.mapInArrow(answer(p), MESSAGE))
    sums = [np.frombuffer(r.blob, np.int64) for r in answers.where("block = -1").select("blob").collect()]  # a row a bucket
    tokens, types = (int(sum(s[k] for s in sums)) for k in (0, 1))
    return x.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(score(p, n, tokens, types), SCHEMA)
