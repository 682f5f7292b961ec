"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time, on a bounded sample of labelled rows (at most
`per_lang` documents of each language, a crop of `crop` characters of each; the crop bounds training only). Prediction
reads every byte of every text in segments of `segment` bytes, gives each position a distribution over languages, and
pools them to the document's: the mean over positions.

A null text, or one without a letter, is `und` with score 0. Language, source and doc_id are no inputs. Ties between
languages go to the first in alphabetical order. Rows without doc_id are left out; repeated rows give equal results.
With nothing to learn from, everything is `und`.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from readloom.llm import base as B

LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageParams:
    hidden: int = 8
    per_lang: int = 1000
    crop: int = 256
    segment: int = 128
    steps: int = 500
    batch: int = 256
    unroll: int = 48
    rate: float = 0.02
    seed: int = 11


class ByteGru:
    """Weights of both directions. Arrays are feature-major: (features, batch)."""

    def __init__(self, langs: list[str], hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        f = lambda *s: rng.normal(0, 0.2, s).astype(np.float32)
        # x: what a byte adds to the gates (update, reset, new); u: what the state adds
        self.w = {f"{k}{d}": v for d in "fb" for k, v in (("x", f(3 * hidden, 256)), ("u", f(3 * hidden, hidden)))}
        self.w |= {"o": f(len(langs), 2 * hidden), "c": np.zeros((len(langs), 1), np.float32)}

    def scan(self, d: str, ids: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States (time, hidden, batch) of one direction, in text order. mask is 0 where a segment has ended."""
        time, n = ids.shape
        hid, x, u = self.hidden, self.w["x" + d], self.w["u" + d]
        h, out = np.zeros((hid, n), np.float32), np.empty((time, hid, n), np.float32)
        buf = np.empty((3 * hid, n), np.float32)
        for t in range(time) if d == "f" else range(time - 1, -1, -1):
            a = np.take(x, ids[t], axis=1, out=buf, mode="clip")
            s = u @ h
            g = np.tanh((a[:2 * hid] + s[:2 * hid]) * np.float32(0.5))
            g += 1
            g *= np.float32(0.5)  # a sigmoid
            new = np.tanh(a[2 * hid:] + g[hid:] * s[2 * hid:])
            if keep is not None:
                keep.append((t, h, g, new, s[2 * hid:]))
            h = new + g[:hid] * (h - new)
            if mask is not None:
                h *= mask[t]
            out[t] = h
        return out

    def positions(self, ids: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Distribution over languages of each position: (time, languages, batch)."""
        hid, o = self.hidden, self.w["o"]
        y = np.matmul(o[:, :hid], self.scan("f", ids, mask))
        y += np.matmul(o[:, hid:], self.scan("b", ids, mask))
        y += self.w["c"]
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y

    def gradients(self, ids: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean loss over all positions, and its gradients through time."""
        hid, w = self.hidden, self.w
        kept, states = {"f": [], "b": []}, {}
        for d in "fb":
            states[d] = self.scan(d, ids, mask, kept[d])
        both = np.concatenate([states["f"], states["b"]], 1)
        y = np.matmul(w["o"], both) + w["c"]
        y -= y.max(1, keepdims=True)
        p = np.exp(y)
        p /= p.sum(1, keepdims=True)
        n = np.arange(len(target))
        total = float(mask.sum())
        loss = -float((np.log(p[:, target, n] + 1e-9) * mask).sum()) / total
        p[:, target, n] -= 1
        p *= (mask / total)[:, None, :]
        g = {"o": np.einsum("tln,thn->lh", p, both), "c": p.sum((0, 2))[:, None]}
        back = np.matmul(w["o"].T, p)
        for k, d in enumerate("fb"):
            gx, gu, dh = np.zeros_like(w["x" + d]), np.zeros_like(w["u" + d]), np.zeros((hid, len(target)), np.float32)
            u = w["u" + d]
            for t, h, gate, new, su in reversed(kept[d]):
                dh = (dh + back[t, k * hid:(k + 1) * hid]) * mask[t]
                z, r = gate[:hid], gate[hid:]
                dn = dh * (1 - z) * (1 - new * new)
                da = np.concatenate([dh * (h - new) * z * (1 - z), dn * su * r * (1 - r), dn])
                ds = np.concatenate([da[:2 * hid], dn * r])
                for j in range(3 * hid):
                    gx[j] += np.bincount(ids[t], da[j], 256)
                gu += ds @ h.T
                dh = dh * z + u.T @ ds
            g |= {"x" + d: gx, "u" + d: gu}
        return loss, g


def segments(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and row of the segments of all rows."""
    size = np.diff(off)
    n = -(-size // length)
    row = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    start = off[row] + k * length
    return start, np.minimum(length, off[row + 1] - start), row


def train(samples: list[tuple[str, str]], p: LanguageParams = LanguageParams()) -> ByteGru | None:
    """A network for (text, lang) samples; None if there are none."""
    langs = sorted({l for _, l in samples})
    if not langs:
        return None
    net, rng = ByteGru(langs, p.hidden, p.seed), np.random.default_rng(p.seed)
    col = pa.array([t for t, _ in samples])
    raw, off = B.text_bytes(col)
    raw = B.lower_ascii(raw)
    start, size, row = segments(raw, off, p.unroll)
    label = np.array([langs.index(l) for _, l in samples])[row]
    by = [np.flatnonzero(label == i) for i in range(len(langs))]
    by = [x for x in by if len(x)]
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    t = np.arange(p.unroll)[:, None]
    for step in range(p.steps if by else 0):
        pick = np.concatenate([x[rng.integers(0, len(x), -(-p.batch // len(by)))] for x in by])
        mask = (t < size[pick]).astype(np.float32)
        ids = raw[np.minimum(start[pick] + t, len(raw) - 1)].astype(np.int64)
        _, g = net.gradients(ids, mask, label[pick])
        rate = p.rate * min(1.0, 2 * (1 - step / p.steps))
        for k, v in net.w.items():  # Adam
            a, b = m[k]
            a += 0.1 * (g[k] - a)
            b += 0.01 * (g[k] * g[k] - b)
            v -= (rate * (a / (1 - 0.9 ** (step + 1))) / (np.sqrt(b / (1 - 0.99 ** (step + 1))) + 1e-7)).astype(np.float32)
    return net


def predict(net: ByteGru, raw: np.ndarray, off: np.ndarray, length: int, labels: bool = False, width: int = 2048) -> tuple[np.ndarray, np.ndarray | None]:
    """Mean distribution of each row, and each byte's label if wanted. Rows without bytes have zeros."""
    raw = B.lower_ascii(raw)
    start, size, row = segments(raw, off, length)
    total = np.zeros((len(off) - 1, len(net.langs)))
    each = np.zeros(len(raw), np.uint8) if labels else None
    full = size == length
    for which in (np.flatnonzero(full), np.flatnonzero(~full)):
        which = which[np.argsort(size[which], kind="stable")]
        for i in range(0, len(which), width):
            s = which[i:i + width]
            t = np.arange(int(size[s].max()))[:, None]
            mask = None if size[s[0]] == len(t) else (t < size[s]).astype(np.float32)
            place = np.minimum(start[s] + t, len(raw) - 1)
            y = net.positions(raw[place], mask)
            if labels:
                live = t < size[s]
                each[place[live]] = y.argmax(1).astype(np.uint8)[live]
            pooled = y.sum(0, dtype=np.float64) if mask is None else np.einsum("tln,tn->ln", y, mask, dtype=np.float64)
            for k in range(len(net.langs)):
                total[:, k] += np.bincount(row[s], pooled[k], len(total))
    return total / np.maximum(np.diff(off), 1)[:, None], each


def sample(docs: DataFrame, p: LanguageParams) -> list[tuple[str, str]]:
    """At most per_lang labelled crops of each language, from documents that are not held out. Its order is fixed by hashes."""
    h = F.xxhash64("doc_id", "text")
    crop = F.substr("text", (F.pmod(h, F.greatest(F.length("text") - p.crop, F.lit(1))) + 1).cast("int"), F.lit(p.crop))
    t = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", h.alias("h"), crop.alias("crop"))
    slot = F.shiftright("h", 52)  # 4096 ranges of hashes, so that only those few rows are put in order that can be taken
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in t.groupBy("lang", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r.lang, []).append((r.slot, r.n))
    if not counts:
        return []
    last = []
    for lang, own in sorted(counts.items()):
        own.sort()
        enough = np.searchsorted(np.cumsum([n for _, n in own]), p.per_lang)
        last += [F.lit(lang), F.lit(own[min(int(enough), len(own) - 1)][0])]
    few = t.where(slot <= F.element_at(F.create_map(*last), F.col("lang")))
    n = F.row_number().over(W.partitionBy("lang").orderBy("h", "crop"))
    rows = few.withColumn("n", n).where(F.col("n") <= p.per_lang).orderBy("lang", "n").collect()  # bounded by per_lang and the languages
    return [(r.crop, r.lang) for r in rows]


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, p: LanguageParams = LanguageParams(), positions: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score[, labels binary of one language index a byte]) of each row of docs (doc_id, text, lang)."""
    d = B.documents(docs, "lang")
    net = train(sample(d, p), p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = B.text_bytes(batch.column("text"))
            for i, j in B.slices(at):
                part = batch.slice(i, j - i)
                raw, off = B.text_bytes(part.column("text"))
                texts = part.column("text").to_pylist()
                mean, each = predict(net, raw, off, p.segment, positions) if net else (np.zeros((j - i, 1)), None)
                best = mean.argmax(1)
                ok = [net is not None and t is not None and LETTER.search(t) is not None for t in texts]
                cols = [part.column("doc_id"), part.column("held_out"), pa.array([net.langs[b] if good else "und" for b, good in zip(best.tolist(), ok)], pa.string()),
                        pa.array([min(1.0, float(mean[k, b])) if ok[k] else 0.0 for k, b in enumerate(best.tolist())], pa.float64())]
                if positions:
                    cols.append(B.binary_column([each[off[k]:off[k + 1]].tobytes() if each is not None else b"" for k in range(j - i)]))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "lang_pred", "score", "labels"][:len(cols)])

    schema = "doc_id bigint, held_out boolean, lang_pred string, score double" + (", labels binary" if positions else "")
    return d.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, schema)


def keep_known(docs: DataFrame, p: LanguageParams = LanguageParams(), min_score: float = 0.5) -> DataFrame:
    """docs without those that have no language or an uncertain one; every column stays."""
    good = identify(docs, p).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(good, docs["doc_id"] == good["__kept"], "left_semi")
