"""Removal of repeated 100-byte strings by blockwise suffix sorting with a difference cover.

No two texts are compared directly. Each window of `length` bytes belongs to one anchor: the leftmost smallest hash of
a 32-byte string inside it, so equal windows have equal anchors at equal distances. Anchors that occur once in the
whole corpus cannot hold a repeated window and end there; that is found by one exchange of anchor hashes. The other
anchors send the text around them to the suffix bucket of their hash.

Buckets are sorted one at a time, so memory is bounded by the largest bucket and not by the corpus. In a bucket a
suffix is sorted by its first 24 bytes; longer ties are resolved by the ranks of a difference-cover sample (residues D
modulo 16, closed under steps of 16), which are computed before by doubling from 16 to 96 bytes. Neighbours that
agree on all `length` bytes are one string; all but its first occurrence are marked. Equal surroundings within a block
of documents are marked before they are sent, which keeps very common passages small.

Blocks are the documents of one hash partition; their number is the session's shuffle partitions.

Rows without doc_id are left out; null text is empty; a text shorter than `length` keeps all its bytes. Rows of one doc_id
are one document: a byte goes if its string starts in a smaller doc_id or earlier in any row of its own, so equal rows are
no repeats of each other, as neither starts earlier.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from readloom.llm import base as B

GRAM = 32
#: Fixed difference cover of the residues modulo 16: every difference occurs between two of these.
COVER = (0, 1, 2, 5, 8)
_IN_COVER = np.isin(np.arange(16), COVER)
#: For a coordinate, the smallest step of at least 4 onto the cover; the sample's 96 bytes then reach beyond 100.
_STEP = np.array([next(k for k in range(4, 24) if (c + k) % 16 in COVER) for c in range(16)])
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def word_at_each(raw: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of n places as one big-endian number, so numbers sort as strings do."""
    padded = np.zeros(n + 16, np.uint8)
    padded[:min(len(raw), n + 16)] = raw[:n + 16]
    out = np.empty((n + 7) // 8 * 8, np.uint64)
    for o in range(8):
        piece = padded[o:o + (n + 7) // 8 * 8]
        if len(piece) % 8:
            piece = np.concatenate([piece, np.zeros(8 - len(piece) % 8, np.uint8)])
        out[o::8] = piece.view(">u8")
    return out[:n]


def gram_hash(w: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place; w has 24 more places than the result."""
    n = len(w) - 24
    h = w[:n] * _C[0]
    for j in range(1, 4):
        h ^= h >> np.uint64(29)
        h += w[8 * j:n + 8 * j] * _C[j]
    return B.mix(h)


def anchors(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of rows: row, place in the row, hash, and how far before it its windows start (most and least)."""
    out = []
    for i, j in B.slices(off):
        for a in range(off[i], off[j], B.SLICE) if j == i + 1 else [off[i]]:
            b = min(off[j], a + B.SLICE + length - 1) if j == i + 1 else off[j]
            n = b - a
            if n < length:
                continue
            h = gram_hash(word_at_each(raw[a:b], n + 24))[:n]
            bits = np.uint64(max(1, int(n).bit_length()))
            low = (np.uint64(1) << bits) - np.uint64(1)
            v = (h & ~low) | np.arange(n, dtype=np.uint64)
            span, width = length - GRAM + 1, 1
            while width * 2 <= span:
                v = np.minimum(v[:-width], v[width:])
                width *= 2
            if span > width:
                v = np.minimum(v[:width - span], v[span - width:])
            m = min(len(v), n - length + 1)
            place = (v[:m] & low).astype(np.int64)
            row = np.searchsorted(off[i:j + 1] - a, np.arange(m), "right") - 1 + i
            ok = np.arange(m) + length <= off[row + 1] - a
            new = ok.copy()
            new[1:] &= (place[1:] != place[:-1]) | ~ok[:-1]
            last = ok.copy()
            last[:-1] &= (place[1:] != place[:-1]) | ~ok[1:]
            s, e = np.flatnonzero(new), np.flatnonzero(last)
            p = place[s]
            out.append((row[s], p + a - off[row[s]], h[p], (p - s).astype(np.uint8), (p - e).astype(np.uint8)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint8), z.astype(np.uint8)
    return tuple(np.concatenate(x) for x in zip(*out))


# --- packed messages between stages: whole arrays, as rows would cost several times their size -------------------------

def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[len(a) for a in arrays]], np.int64).tobytes() + b"".join(a.dtype.str.encode().ljust(4) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    k = int(np.frombuffer(data, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(data, np.int64, k, 8), 8 + 8 * k, []
    kinds = [data[at + 4 * i:at + 4 * i + 4].decode().strip() for i in range(k)]
    at += 4 * k
    for n, kind in zip(sizes.tolist(), kinds):
        d = np.dtype(kind)
        out.append(np.frombuffer(data, d, n, at))
        at += n * d.itemsize
    return out


def gather(blobs: Iterator[bytes]) -> list[np.ndarray] | None:
    parts = [unpack(b) for b in blobs]
    return [np.concatenate(x) for x in zip(*parts)] if parts else None


def message(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), B.binary_column([r[2] for r in rows])], names=["bucket", "block", "blob"])


MESSAGE = "bucket int, block int, blob binary"


def _by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for k in range(n):
        if edges[k] < edges[k + 1]:
            yield k, order[edges[k]:edges[k + 1]]


def text_numbers(ids: np.ndarray, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which of the different texts of its doc_id a row has; 0 unless rows share a doc_id."""
    out = np.zeros(len(ids), np.uint16)
    order = np.argsort(ids, kind="stable")
    at = B.starts_of(ids[order])
    for a, b in zip(*(x[np.diff(at) > 1].tolist() for x in (at[:-1], at[1:]))):
        texts = [raw[off[k]:off[k + 1]].tobytes() for k in order[a:b]]
        number = {t: i for i, t in enumerate(sorted(set(texts)))}
        out[order[a:b]] = [number[t] for t in texts]
    return out


def send_anchors(length: int, buckets: int):
    """Documents by block -> anchors by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.runs(batches, "block"):
            block = table["block"].to_numpy()
            at = B.starts_of(block)
            for a, b in zip(at[:-1], at[1:]):
                docs = B.long_array(table["doc_id"])[a:b]
                raw, off = B.text_bytes(table["text"].slice(a, b - a))
                row, place, h, lo, hi = anchors(raw, off, length)
                nth = text_numbers(docs, raw, off)
                rows = [(k, int(block[a]), pack(h[i], docs[row[i]], nth[row[i]], place[i].astype(np.uint32), lo[i], hi[i])) for k, i in _by_bucket((h % np.uint64(buckets)).astype(np.int64), buckets)]
                if rows:
                    yield message(rows)
    return run


def find_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors by bucket -> those whose hash occurs again, to the blocks they came from."""
    for table in B.runs(batches, "bucket"):
        key, block, blobs = table["bucket"].to_numpy(), table["block"].to_numpy(), table["blob"].to_pylist()
        at, rows = B.starts_of(key), []
        for a, b in zip(at[:-1], at[1:]):
            parts = [unpack(x) for x in blobs[a:b]]
            h = np.concatenate([x[0] for x in parts])
            s = np.sort(h)
            again = np.unique(s[1:][s[1:] == s[:-1]])
            if len(again):
                for x, to in zip(parts, block[a:b].tolist()):
                    hit = np.isin(x[0], again)
                    if hit.any():
                        rows.append((0, to, pack(*[y[hit] for y in x])))
        if rows:
            yield message(rows)


def send_contexts(length: int, buckets: int):
    """A block's documents and repeated anchors -> text around them by bucket; what the block itself repeats, marked."""
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        got = gather(found["blob"].to_pylist()) if found.num_rows else None
        if got is None or not docs.num_rows:
            return pa.Table.from_batches([message([])])
        h, doc, nth, place, lo, hi = got
        block = docs["block"][0].as_py()
        ids = B.long_array(docs["doc_id"])
        raw, off = B.text_bytes(docs["text"])
        number = text_numbers(ids, raw, off)
        order = np.lexsort((number, ids))
        back = np.lexsort((lo, nth, place, doc))
        h, doc, nth, place, lo, hi = (x[back] for x in (h, doc, nth, place.astype(np.int64), lo.astype(np.int64), hi.astype(np.int64)))
        twice = np.concatenate([[True], (doc[1:] != doc[:-1]) | (nth[1:] != nth[:-1]) | (place[1:] != place[:-1]) | (lo[1:] != lo[:-1])])
        h, doc, nth, place, lo, hi = (x[twice] for x in (h, doc, nth, place, lo, hi))  # equal rows are one
        row = np.searchsorted(ids[order], doc)
        several = np.flatnonzero(np.searchsorted(ids[order], doc, "right") - row > 1)
        for i in several.tolist():  # among the few rows of its doc_id, the one with its text
            while number[order[row[i]]] != nth[i]:
                row[i] += 1
        row = order[row]
        start, size = place - lo, lo - hi + length
        flat = raw.tobytes()
        first, keep, marked = {}, np.ones(len(h), bool), []
        base = off[row] + start
        for i, (x, n, c) in enumerate(zip(base.tolist(), size.tolist(), lo.tolist())):
            key = (c, flat[x:x + n])
            if (j := first.setdefault(key, i)) != i:
                keep[i] = doc[j] == doc[i] and start[j] == start[i]  # in two texts of a document neither starts earlier
        rows = []
        if not keep.all():
            m = ~keep
            rows.append((block % buckets, block, b"\x01" + pack(doc[m], nth[m], start[m], (start + size)[m])))
        kept = np.flatnonzero(keep)
        for k, some in _by_bucket((h[kept] % np.uint64(buckets)).astype(np.int64), buckets):
            i = kept[some]
            n = size[i]
            text = np.frombuffer(b"".join(flat[x:x + m] for x, m in zip(base[i].tolist(), n.tolist())), np.uint8)
            rows.append((k, block, b"\x00" + pack(doc[i], nth[i], start[i], lo[i].astype(np.uint8), (n - length + 1).astype(np.uint8), (B.mix(h[i]) >> np.uint64(48)).astype(np.uint16), text)))
        return pa.Table.from_batches([message(rows)])
    return run


def dense(key: np.ndarray) -> np.ndarray:
    """Ranks of values, equal for equal ones."""
    order = np.argsort(key)
    s = key[order]
    step = np.zeros(len(key), np.uint64)
    step[1:] = s[1:] != s[:-1]
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(step)
    return out


_32 = np.uint64(32)


def repeated_windows(text: np.ndarray, at: np.ndarray, windows: np.ndarray, c0: np.ndarray, length: int) -> np.ndarray:
    """Of the windows of one bucket's records, in order: the first one that is equal, which may be the window itself.

    Record r is text[at[r]:at[r + 1]] and holds windows[r] windows from its start; c0 is the coordinate of its first
    byte, counted so that equal windows have equal coordinates.
    """
    n = len(text)
    words = word_at_each(text, n)
    r8 = np.concatenate([dense(words), np.zeros(128, np.uint64)])
    place = np.arange(n)
    record = np.repeat(np.arange(len(windows)), np.diff(at))
    coordinate = place - at[record] + c0[record]
    # the sample: residues in the cover, ranked by 16, 32, 64 and 96 bytes; places near the end of the text rank by what is there
    sample = np.flatnonzero(_IN_COVER[coordinate & 15])
    rank = np.zeros(n + 128, np.uint64)
    rank[sample] = dense(r8[sample] << _32 | r8[sample + 8])
    for step in (16, 32, 32):
        rank[sample] = dense(rank[sample] << _32 | rank[sample + step])
    suffix = np.repeat(at[:-1], windows) + np.arange(windows.sum()) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    c = coordinate[suffix]
    r24 = dense(dense(r8[suffix] << _32 | r8[suffix + 8]) << _32 | r8[suffix + 16])
    tie = rank[suffix + _STEP[c & 15]]
    order = np.argsort(r24 << np.uint64(36) | (c & 255).astype(np.uint64) << np.uint64(28) | tie)
    s, cs = suffix[order], c[order]
    same = (r24[order[1:]] == r24[order[:-1]]) & (cs[1:] == cs[:-1])
    check = np.flatnonzero(same)
    for j in [*range(24, length - 7, 8), length - 8]:
        x = words[s[check] + j] == words[s[check + 1] + j]
        same[check[~x]] = False
        check = check[x]
    group = np.concatenate([[0], np.cumsum(~same)])
    out = np.empty(len(suffix), np.int64)
    out[order] = np.minimum.reduceat(order, np.flatnonzero(np.concatenate([[True], ~same])))[group]
    return out


def sort_buckets(length: int):
    """Text by bucket -> marked ranges, to the blocks they came from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.runs(batches, "bucket"):
            key, block, blobs = table["bucket"].to_numpy(), table["block"].to_numpy(), table["blob"].to_pylist()
            at, rows = B.starts_of(key), []
            for a, b in zip(at[:-1], at[1:]):
                parts, origin = [], []
                for to, blob in zip(block[a:b].tolist(), blobs[a:b]):
                    if blob[0] == 1:
                        rows.append((0, to, blob[1:]))
                    else:
                        parts.append(unpack(blob[1:]))
                        origin.append(np.full(len(parts[-1][0]), to))
                if parts:
                    rows += mark_all(parts, np.concatenate(origin), length)
            if rows:
                yield message(rows)
    return run


#: Text bytes of a suffix bucket; what a partition received is sorted in buckets of about this size, by anchor.
BUCKET = 1 << 20


def mark_all(parts: list[list[np.ndarray]], origin: np.ndarray, length: int) -> list[tuple[int, int, bytes]]:
    doc, nth, start, lo, windows, h, text = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    windows = windows.astype(np.int64)
    size = windows + length - 1
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    n = max(1, len(text) // BUCKET)
    rows = []  # h is mixed once more: anchors are smallest hashes, so their own high bits are all small
    for _, r in _by_bucket(h.astype(np.int64) * n >> 16, n):
        rows += mark(doc[r], nth[r], start[r], lo[r], windows[r], begin[r], text, origin[r], length)
    return rows


def mark(doc, nth, start, lo, windows, begin, text, origin, length: int) -> list[tuple[int, int, bytes]]:
    """Ranges of one suffix bucket's records that are to go, for each block."""
    order = np.lexsort((nth, start, doc))
    size = windows[order] + length - 1
    at = np.concatenate([[0], np.cumsum(size)])
    text = text[np.repeat(begin[order] - at[:-1], size) + np.arange(at[-1])]
    doc, nth, start, origin, windows = doc[order], nth[order], start[order], origin[order], windows[order]
    earliest = repeated_windows(text, at, windows, 128 - lo[order].astype(np.int64), length)
    record = np.repeat(np.arange(len(windows)), windows)
    place = start[record] + np.arange(len(record)) - np.repeat(np.cumsum(windows) - windows, windows)
    again = (place[earliest] != place) | (doc[record[earliest]] != doc[record])
    if not again.any():
        return []
    w = np.flatnonzero(again)
    new = np.concatenate([[True], (np.diff(w) != 1) | (record[w[1:]] != record[w[:-1]])])
    first, last = np.flatnonzero(new), np.concatenate([np.flatnonzero(new)[1:] - 1, [len(w) - 1]])
    r = record[w[first]]
    out, a, b = origin[r], place[w[first]], place[w[last]] + length
    return [(0, int(o), pack(doc[r][out == o], nth[r][out == o], a[out == o], b[out == o])) for o in np.unique(out)]


def cut_out(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """A block's documents and marked ranges -> what is left of each."""
    got = gather(marks["blob"].to_pylist()) if marks.num_rows else None
    ids = B.long_array(docs["doc_id"]) if docs.num_rows else np.zeros(0, np.int64)
    raw, off = B.text_bytes(docs["text"]) if docs.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    flat, out, number = raw.tobytes(), [], text_numbers(ids, raw, off).tolist()
    if got is not None:
        doc, nth, a, b = got
        order = np.lexsort((a, doc))
        doc, nth, a, b = doc[order], nth[order], a[order], b[order]
    for i, x in enumerate(ids.tolist()):
        text = flat[off[i]:off[i + 1]]
        spans = []
        if got is not None:
            for m, s, e in zip(*(y[np.searchsorted(doc, x, "left"):np.searchsorted(doc, x, "right")].tolist() for y in (nth, a, b))):
                if m != number[i]:
                    continue
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
        ends = [0, *[y for s in spans for y in s], len(text)]
        left = b"".join(text[ends[j]:ends[j + 1]] for j in range(0, len(ends), 2))
        out.append((x, len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left, [y for s in spans for y in s]))
    cols = list(zip(*out)) or [[]] * 7
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary, spans array of starts and ends) of each row."""
    if not 40 <= length <= 100:
        raise ValueError("length must lie in 40..100: anchors take 32 bytes and the sample reaches 100")
    n = B.parts(docs.sparkSession)
    x = B.documents(docs).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).repartition(n, "block")
    by = lambda df: df.repartition(n, "bucket").sortWithinPartitions("bucket")
    sent = x.sortWithinPartitions("block").mapInArrow(send_anchors(length, n), MESSAGE)
    found = by(sent).mapInArrow(find_repeated, MESSAGE).drop("bucket")
    around = x.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(send_contexts(length, n), MESSAGE)
    marks = by(around).mapInArrow(sort_buckets(length), MESSAGE).drop("bucket")
    return x.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(cut_out, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, spans array<bigint>")


#: op8 over the table documents, for DuckDB: bytes are pairs of hexadecimal digits.
ORACLE = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents),
  w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(generate_series(0, n_bytes - 100)) AS i FROM b WHERE n_bytes >= 100)),
  again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM w) WHERE nth > 1),
  runs AS (SELECT *, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM again)),
  spans AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM runs GROUP BY doc_id, run),
  gaps AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS f FROM spans),
  kept AS (SELECT b.doc_id, any_value(n_bytes) AS n_bytes, coalesce(sum(e - s), 0) AS n_removed, count(e) AS n_spans,
    coalesce(string_agg(substr(h, 2 * f + 1, 2 * (s - f)), '' ORDER BY s), '') || substr(any_value(h), 2 * coalesce(max(e), 0) + 1) AS h
    FROM b LEFT JOIN gaps ON gaps.doc_id = b.doc_id GROUP BY b.doc_id)
  SELECT doc_id, n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(h)) AS kept_sha256 FROM kept"""
