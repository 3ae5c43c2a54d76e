"""Benchmark decontamination by edit distance: CGK embedding, bit-sampling LSH over item-sized windows, exact verification.

Texts and items become bytes: A-Z lower-cased, white space one blank. Places where a text may hold an item come first: of the item's runs of RUN bytes a share
of 1 / SHARE must stand in the text at distances within the edit bound of each other. At random edits of a fifth of all characters some 13 % of such runs stay whole, three times as many.
Items so short that this might fail get the run length at which, by the q-gram lemma, one run always stays whole.
Each place gives item-sized windows at the ends and quartiles of the starts that its runs tell. The CGK embedding walks a window with a pointer that a
shared random function of step and byte moves on or not, and writes the byte it stands on; strings at a small edit distance run in step again after
each edit, so their outputs are at a small Hamming distance. LSH samples SAMPLE places of the output per band; a window that agrees with its item on a band is a candidate.
REPEATS functions with BANDS bands each bring the recall up. Candidates are verified exactly: the smallest edit distance, in characters, between the item and any part of the text
around the window (Myers' bit-vectors) must be at most (1 - similarity) of the item's length.

Cases: null and empty texts and items match nothing; items of equal text are one; texts shorter than an item may hold most of it and are still found;
a match across the end of a text doesn't count; extra columns pass through unread; every document row gives an output row; without items every row gets an empty array.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, addressed, materialize, table

SIMILARITY = 0.8
#: Bytes of a run; of an item's runs 1 / SHARE must be found, LEAST at least; shorter items than SHORT get shorter runs.
RUN, SHARE, LEAST, SHORT = 9, 24, 3, 64
REPEATS, BANDS, SAMPLE = 6, 48, 3
SEED = 20_240_229
#: Items that go to the executors at a time; more items take more passes over the documents.
BLOCK = 20_000
#: Bytes of texts that are searched at a time.
PIECE = 1 << 21


def embed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """CGK: the outputs, a row for each step of moves and a column for each window data[start:end]; 0 after a window's end.

    All windows are walked at once. moves[j, byte]: whether a pointer that stands on the byte at step j moves on, alike for all strings.
    """
    out = np.zeros((len(moves), len(starts)), np.uint8)
    at = starts.copy()
    for j, move in enumerate(moves):
        live = at < ends
        read = np.where(live, data[np.minimum(at, len(data) - 1)], 0)
        out[j] = read
        at += move[read] & live
    return out


def band_keys(outputs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A key for each band and window: the bytes at the band's sampled places. places: bands x SAMPLE, or windows x bands x SAMPLE."""
    if places.ndim == 2:
        picked = outputs[places]  # bands x SAMPLE x windows
    else:
        picked = np.moveaxis(outputs[places, np.arange(outputs.shape[1])[:, None, None]], 0, 2)
    key = np.zeros((picked.shape[0], picked.shape[2]), np.uint64)
    for x in range(picked.shape[1]):
        key = key << np.uint64(8) | picked[:, x].astype(np.uint64)
    return key


def edit_within(pattern: str, text: str, most: int) -> int | None:
    """The least edit distance between the pattern and any part of the text, or None if it is over most."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full  # a match may begin anywhere: no 1 comes in
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        best = min(best, score)
    return best if best <= most else None


def _plain(text: bytes | str | None) -> bytes:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return b" ".join(raw.lower().split())


def _runs(text: bytes, n: int) -> np.ndarray:
    """The runs of n bytes of a text, each as a number: the bytes themselves up to 8, else mixed."""
    m = len(text) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    first = np.ndarray((m,), "<u8", text + b"\0" * 8, strides=(1,))
    if n <= 8:
        return first & np.uint64((1 << 8 * n) - 1)
    return first * np.uint64(0x9E3779B97F4A7C15) + np.ndarray((m,), "<u8", text[n - 8 :] + b"\0" * 8, strides=(1,))


def _slot(runs: np.ndarray) -> np.ndarray:
    return (runs * np.uint64(0xD1342543DE82EF95) >> np.uint64(44)).astype(np.int64)


class _Places:
    """Where texts may hold some of the items, by runs of one length."""

    WIDTH = 4096  # offsets in an item are told apart by their rest to this

    def __init__(self, of: np.ndarray, texts: list[bytes], run: int, edits: np.ndarray, need: np.ndarray):
        self.run, self.edits, self.need = run, edits, need
        grams = [_runs(t, run) for t in texts]
        flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.known, begin = np.unique(flat[order], return_index=True)
        self.begin = np.r_[begin, len(flat)]
        self.item = np.repeat(of, [len(g) for g in grams])[order]
        self.at = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])[order].astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[_slot(self.known)] = True
        self.longest = max(map(len, texts))

    def find(self, data: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(item, starts that the runs at a place tell, in order)."""
        g = _runs(data, self.run)
        place = np.flatnonzero(self.maybe[_slot(g)])
        slot = np.minimum(np.searchsorted(self.known, g[place]), len(self.known) - 1)
        same = self.known[slot] == g[place]
        place, slot = place[same], slot[same]
        many = self.begin[slot + 1] - self.begin[slot]
        flat = np.repeat(self.begin[slot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        if not len(flat):
            return
        span, at = len(data) + 2 * self.longest + 2, self.at[flat]
        key = np.sort((self.item[flat] * span + np.repeat(place, many) - at + self.longest) * self.WIDTH + at % self.WIDTH)
        key, at = key // self.WIDTH, key % self.WIDTH
        item = key // span
        upto = np.searchsorted(key, key + self.edits[item], side="right")
        dense = upto - np.arange(len(key))
        hit = np.flatnonzero(dense >= self.need[item])
        a = 0
        while a < len(hit):  # hits whose starts lie within the edit bound of the first are one place, told by the densest
            first = hit[a]
            z = int(np.searchsorted(hit, upto[first]))
            best = hit[a + int(np.argmax(dense[hit[a:z]]))]
            inside = slice(int(best), int(upto[best]))
            i = int(item[first])
            if len(np.unique(at[inside])) >= min(int(self.need[i]), self.WIDTH):  # not the same few runs of the item again and again
                yield i, key[inside] - i * span - self.longest
            a = max(z, int(np.searchsorted(hit, upto[best])))


@dataclass
class ItemIndex:
    """The items' runs and the band keys of their embeddings. Bounded by the number of items it is made of."""

    items: list[tuple[int, str]]
    similarity: float = SIMILARITY
    repeats: int = REPEATS
    bands: int = BANDS
    sample: int = SAMPLE

    def __post_init__(self) -> None:
        self.raw = [_plain(t) for _, t in self.items]
        self.text = [t.decode("utf-8", "replace") for t in self.raw]
        self.size = np.array([len(t) for t in self.raw], np.int64)
        self.most = [int((1 - self.similarity) * len(t) + 1e-9) for t in self.text]
        edits = np.floor((1 - self.similarity) * self.size + 1e-9).astype(np.int64)
        self.edits = edits
        self.places = []
        whole = np.maximum(1, (self.size - edits) // (edits + 1))  # a run of this length always stays whole
        run = np.where(self.size < SHORT, np.minimum(RUN, whole), np.minimum(RUN, self.size))
        need = np.where((self.size < SHORT) | (run < RUN), 1, np.maximum(LEAST, self.size // SHARE))
        for n in np.unique(run[self.size > 0]).tolist():
            of = np.flatnonzero((run == n) & (self.size > 0))
            self.places.append(_Places(of, [self.raw[i] for i in of], n, edits, need))
        rng = np.random.default_rng(SEED)
        longest = int(self.size.max(initial=1))
        self.moves = [rng.integers(0, 2, (longest, 256), np.int64) for _ in range(self.repeats)]
        self.spots = rng.random((self.repeats, self.bands, self.sample))  # of an item's length
        data, ends = np.frombuffer(b"".join(self.raw) or b"\0", np.uint8), np.cumsum(self.size)
        self.keys = [band_keys(embed(data, ends - self.size, ends, m), self._sampled(r, self.size)) for r, m in enumerate(self.moves)]

    def _sampled(self, r: int, size: np.ndarray) -> np.ndarray:
        return (self.spots[r] * np.maximum(1, size)[:, None, None]).astype(np.int64)

    def near(self, data: np.ndarray, item: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which windows agree with their item on a band."""
        out = np.zeros(len(item), bool)
        for r, moves in enumerate(self.moves):
            todo = np.flatnonzero(~out)
            if len(todo):
                size = self.size[item[todo]]
                walked = embed(data, starts[todo], ends[todo], moves[: int(size.max())])
                out[todo] = (band_keys(walked, self._sampled(r, size)) == self.keys[r][:, item[todo]]).any(0)
        return out

    def search(self, texts: list[bytes | str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text, (item id, words before the window, edit distance in characters) of the items it holds, one window each."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        rows = [_plain(t) for t in texts]
        buf = b"\0".join(rows)
        if not self.places or not buf:
            return out
        data = np.frombuffer(buf, np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in rows)])
        windows: list[tuple[int, int, int, int]] = []  # item, text, start, end
        for a in range(0, len(buf), PIECE):
            for by in self.places:  # a piece reads on so far that an item which begins in it is whole
                for i, starts in by.find(buf[a : a + PIECE + 2 * by.longest]):
                    size = int(self.size[i])
                    for s in {int(starts[x * (len(starts) - 1) // 4]) for x in range(5)}:  # inserts shift starts to the last, deletes to the first
                        s += a
                        t = int(np.searchsorted(begins, min(max(s + size // 2, 0), len(buf) - 1), side="right")) - 1
                        ts = {t} if 0 <= s >= begins[t] and s + size < begins[t + 1] else {t - 1, t, t + 1}  # texts meet here
                        for t in ts:
                            if 0 <= t < len(rows) and (low := max(s, int(begins[t]))) < (high := min(s + size, int(begins[t + 1]) - 1)):
                                windows.append((i, t, low, high))
        found: dict[tuple[int, int], tuple[int, int]] = {}
        windows = sorted(set(windows), key=lambda w: (w[1], w[0], w[2]))
        for b in range(0, len(windows), 4096):
            some = np.array(windows[b : b + 4096], np.int64)
            hits = some[self.near(data, some[:, 0], some[:, 2], some[:, 3])]
            seen = (-1, -1, 0)
            for i, t, low, high in hits.tolist():
                slack = int(self.edits[i]) + 4
                if found.get((t, i), (1, 0))[0] == 0 or seen[:2] == (t, i) and low - seen[2] <= slack // 2:
                    continue  # found as it is, or within what the last window was verified with
                seen = (t, i, low)
                begin, end = int(begins[t]), int(begins[t + 1]) - 1
                around = buf[max(begin, low - 2 * slack) : min(end, low + int(self.size[i]) + 3 * slack)].decode("utf-8", "replace")
                distance = edit_within(self.text[i], around, self.most[i])
                if distance is not None and ((t, i) not in found or distance < found[t, i][0]):
                    found[t, i] = (distance, buf.count(b" ", begin, low))
        for (t, i), (distance, at) in sorted(found.items()):
            out[t].append((self.items[i][0], at, distance))
        return [sorted(x) for x in out]


def find_items(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, out: str = "matches", block: int = BLOCK) -> DataFrame:
    """docs with an array of struct(item_id, at, distance): the items that each text holds.

    The items are the stated query set: they go to the executors in blocks of at most about `block` rows. One block is a map over the documents; more are one pass each, one
    after another, whose matches are written by row and joined back.
    """
    spark = docs.sparkSession
    Batches.small(spark)
    listed = items.filter(F.col(item_text).isNotNull()).groupBy(F.col(item_text).alias("text")).agg(F.min(item_id).alias("item_id")).select(F.coalesce("item_id", F.lit(-1)).alias("item_id"), "text")
    blocks = max(1, -(-listed.count() // block))
    d, parts = docs if blocks == 1 else addressed(docs), []
    for b in range(blocks):
        part = listed if blocks == 1 else listed.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        rows = [(int(r[0]), r[1]) for r in part.orderBy("item_id").toLocalIterator()]  # about `block` rows
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(ItemIndex(rows, similarity)))
        found = _searcher(sent)(F.col(text).cast("binary"))
        if blocks == 1:
            return docs.select(*[c for c in docs.columns if c != out], found.alias(out))
        parts.append(materialize(d.select("__rid", found.alias("__found")).filter(F.size("__found") > 0), keep=True))
        sent.unpersist()
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    every = every.groupBy("__rid").agg(F.array_sort(F.flatten(F.collect_list("__found"))).alias("__found"))
    empty = F.array().cast("array<struct<item_id:bigint,at:bigint,distance:bigint>>")
    return d.join(every, "__rid", "left").withColumn(out, F.coalesce("__found", empty)).select(*[c for c in docs.columns if c != out], out)


def _searcher(sent):
    @F.pandas_udf("array<struct<item_id:long,at:long,distance:long>>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = pickle.loads(sent.value)
        for texts in batches:
            yield pd.Series([[{"item_id": a, "at": b, "distance": c} for a, b, c in found] for found in index.search(list(texts))])

    return search


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: the items it holds, and whether it is to go."""
    d = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.transform("matches", lambda m: m["item_id"])
    return d.select("doc_id", F.size("matches").cast("long").alias("n_items"), F.array_join(ids.cast("array<string>"), ",").alias("item_ids"), (F.size("matches") > 0).alias("contaminated"))
