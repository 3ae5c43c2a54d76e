"""Phrase collocation mining by hierarchical pair naming.

Every frequent word gets a number. A frequent phrase of k words is a pair of numbers, those of its first and of its last k - 1 words, and gets a number of its own by one join over all texts, so a
sequence of numbers of (k-1)-grams becomes one of k-grams by naming neighbours, and no phrase is ever spelled out while it is counted. The pairs double as parent pointers: the counts of the parts of any cut are found
on the way down the first parents (first words) and the last parents (last words), and the longer phrases that hold a phrase are reached through its children.

Texts are packed into blocks of about BLOCK bytes with a dictionary each; what is shuffled is a row for each different word or pair of a block with its count, so frequent words are added up before they travel
and no key has more rows than there are blocks. From the second level on only pairs of frequent parents are left. Numbers come back to the blocks by a join; while a level has no more than SENT of them, they are
sent to the tasks instead, which comes to the same.

Cases: a null or empty text has no words; a null lang is `und`. Repeated rows are texts like any others. Columns other than lang and text are ignored. A text of any length is cut into blocks between its
pieces. Counts are exact at any size; the score is whole-number arithmetic of 38 digits, enough while 1000 * a * n is below 10^38. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, few_rows, large_rows, materialize, scratch, table

LONGEST = 5
LEAST = 100
MOST = 2000
#: Of 100 occurrences of a phrase, how many inside one longer phrase make it a part of that.
SUBSUMED = 100
#: Bytes of text in a block, about.
BLOCK = 1 << 20
#: Most frequent phrases of one length whose numbers are sent to all tasks (some 50 MB); beyond, blocks and numbers are joined.
SENT = 2_000_000
#: The same for words, which take some 300 bytes each in every Python worker.
SENT_WORDS = 250_000
#: Slices of a language from which the best phrases are taken first.
SLICES = 64

BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = re.compile(b"[" + re.escape(BREAKS) + b"]")
_IS_BREAK, _IS_GAP = np.zeros(256, bool), np.zeros(256, bool)
_IS_BREAK[list(BREAKS)] = True
_IS_GAP[[*BREAKS, *b" \t"]] = True


def packed(texts: list[bytes], langs: list[str]) -> tuple[np.ndarray, list[str], list[str], np.ndarray]:
    """(sequence, languages, words, counts) of a block: the sequence holds places in the block's dictionary from 1, and 0 where a piece ends."""
    buf = np.frombuffer(b"\n".join(texts).lower(), np.uint8)  # lowers A-Z only
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_IS_GAP[buf]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.zeros(0, np.int64), [], [], np.zeros(0, np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
    lang = np.array([names[x] for x in langs], np.int64)[np.searchsorted(np.cumsum(size + 1), starts, side="right")]
    piece = np.searchsorted(np.flatnonzero(_IS_BREAK[buf]), starts)
    letters = buf[inside[1:-1].astype(bool)]
    every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(ends - starts)].astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    words = every.dictionary.to_pylist()
    keys, place, counts = np.unique(lang * len(words) + every.indices.to_numpy(), return_inverse=True, return_counts=True)
    at = np.arange(len(starts)) + np.cumsum(np.r_[False, piece[1:] != piece[:-1]])
    seq = np.zeros(at[-1] + 1, np.int64)
    seq[at] = place + 1
    known = list(names)
    return seq, [known[k // len(words)] for k in keys.tolist()], [words[k % len(words)].decode("utf-8", "replace") for k in keys.tolist()], counts


def paired(seq: np.ndarray, places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, left, right, counts) of the next level: neighbours of which both are known. places: known entries of the block's dictionary, ids: their numbers."""
    new = np.zeros(int(seq.max(initial=0)) + 1, np.int64)
    new[places] = np.arange(1, len(places) + 1)
    seq = new[seq]
    a, b = seq[:-1], seq[1:]
    both = (a > 0) & (b > 0)
    keys, place, counts = np.unique(a[both] * (len(places) + 1) + b[both], return_inverse=True, return_counts=True)
    out = np.zeros(len(a), np.int64)
    out[both] = place + 1
    out = out[(out > 0) | np.r_[True, out[:-1] > 0][: len(out)]]  # one 0 stands for a row of them
    return out, ids[keys // (len(places) + 1) - 1], ids[keys % (len(places) + 1) - 1], counts


def _lists(values: np.ndarray | list, kind: pa.DataType) -> pa.Array:
    return pa.array([values], pa.list_(kind))


def _stored(seq: np.ndarray) -> pa.Array:
    return pa.array([seq.astype(np.int32).tobytes()], pa.binary())


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        texts: list[bytes] = []
        langs: list[str] = []
        held = 0

        def given():
            nonlocal number, held
            seq, lang, words, counts = packed(texts, langs)
            texts.clear()
            langs.clear()
            number, held = number + 1, 0
            if len(seq):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), _stored(seq), _lists(lang, pa.string()), _lists(words, pa.string()), _lists(counts, pa.int64())], ["block", "seq", "langs", "words", "counts"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = 0
                while at < len(text):
                    cut = _BREAK.search(text, at + block) if len(text) - at > block else None
                    end = cut.end() if cut else len(text)
                    texts.append(text[at:end])
                    langs.append(lang)
                    at, held = end, held + end - at
                    if held >= block:
                        yield from given()
        yield from given()

    d = docs.select(F.coalesce("lang", F.lit("und")), F.coalesce("text", F.lit("")).cast("binary"))
    return d.mapInArrow(run, "block long, seq binary, langs array<string>, words array<string>, counts array<long>")


class _Numbers:
    """The numbers of frequent words or pairs, to be looked up by a block."""

    def __init__(self, level: pa.Table):
        ids = level.column("id").to_numpy()
        if "word" in level.column_names:
            self.words = dict(zip(zip(level.column("lang").to_pylist(), level.column("word").to_pylist(), strict=True), ids.tolist(), strict=True))
            return
        self.words = None
        left, right = level.column("left").to_numpy(), level.column("right").to_numpy()
        self.lefts, self.rights = np.unique(left), np.unique(right)
        keys = self._keys(left, right)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]

    def _keys(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """One number for each pair of known parts, -1 for others."""
        a, b = np.searchsorted(self.lefts, left), np.searchsorted(self.rights, right)
        a[a == len(self.lefts)] = b[b == len(self.rights)] = 0
        return np.where((self.lefts[a] == left) & (self.rights[b] == right), a * len(self.rights) + b, -1)

    def known(self, first: pa.Array, second: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places from 1, numbers) of a dictionary's known entries."""
        if self.words is not None:
            found = [(i, self.words[x]) for i, x in enumerate(zip(first.to_pylist(), second.to_pylist(), strict=True), 1) if x in self.words]
            places, ids = zip(*found, strict=True) if found else ((), ())
            return np.array(places, np.int64), np.array(ids, np.int64)
        keys = self._keys(first.to_numpy(), second.to_numpy())
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[at] == keys)
        return hit + 1, self.ids[at[hit]]


def _pairs(blocks: DataFrame, numbers: Broadcast | None = None) -> DataFrame:
    """The blocks of the next level. blocks: (block, seq, known: array<struct<place, id>>), or, where numbers are sent, (block, seq, the two columns of the dictionary's key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                if numbers is None:
                    known = b.column(2)[i].values
                    places, ids = known.field("place").to_numpy(), known.field("id").to_numpy()
                else:
                    places, ids = numbers.value.known(b.column(2)[i].values, b.column(3)[i].values)
                seq, left, right, counts = paired(np.frombuffer(b.column(1)[i].as_py(), np.int32), places, ids)
                if len(left):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), _stored(seq), _lists(left, pa.int64()), _lists(right, pa.int64()), _lists(counts, pa.int64())], ["block", "seq", "lefts", "rights", "counts"])

    return blocks.mapInArrow(run, "block long, seq binary, lefts array<long>, rights array<long>, counts array<long>")


def _entries(blocks: DataFrame, key: dict[str, str]) -> DataFrame:
    """A row for each entry of each block's dictionary; key: names of the key's columns and of their arrays."""
    d = blocks.select("block", F.posexplode(F.arrays_zip(*key.values(), "counts")).alias("place", "x"))
    return d.select("block", (F.col("place") + 1).alias("place"), *[F.col(f"x.{v}").alias(k) for k, v in key.items()], F.col("x.counts").alias("c"))


def _dense(level: DataFrame) -> DataFrame:
    """Numbers from 0 without gaps for the rows of a written table with its row ids (the part of the table above 33 bits of the place in it): small numbers travel in few bytes."""
    part = F.shiftrightunsigned("__id", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of the table
    starts = level.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    d = level.join(F.broadcast(starts), part == F.col("__part"))
    return d.withColumn("id", F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__start", "__n")


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, block: int = BLOCK, sent: int = SENT) -> tuple[list[DataFrame], DataFrame]:
    """One table for each length, (id, lang, word, f) and then (id, left, right, f), as far as phrases are frequent; and (lang, n). Written to the shared folder; they belong to the scope around."""
    spark, levels = docs.sparkSession, []
    with scratch(spark), few_rows(spark, 512), ExitStack() as stack:
        blocks = materialize(_blocks(docs, block))
        stack.enter_context(large_rows(spark))  # from here on a row is a block
        key = {"lang": "langs", "word": "words"}
        n = materialize(_entries(blocks, key).groupBy("lang").agg(F.sum("c").alias("n")), keep=True)
        for k in range(1, longest + 1):
            counts = _entries(blocks, key).groupBy(*key).agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
            level = _dense(materialize(counts.withColumn("__id", F.monotonically_increasing_id()), keep=True))
            levels.append(level)
            size = level.count()
            if k == longest or not size:
                break
            if size <= (min(sent, SENT_WORDS) if k == 1 else sent):
                numbers = spark.sparkContext.broadcast(_Numbers(level.toArrow()))
                found = _pairs(blocks.select("block", "seq", *key.values()), numbers)
            else:
                known = _entries(blocks, key).join(level.drop("f"), list(key)).groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("known"))  # at most the block's dictionary
                found = _pairs(blocks.select("block", "seq").join(known, "block").select("block", "seq", "known"))
            with few_rows(spark, 8):  # a row is a block
                after = materialize(found)
            discard(blocks)
            blocks, key = after, {"left": "lefts", "right": "rights"}
    return levels, n


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, subsumed: int = SUBSUMED, block: int = BLOCK, sent: int = SENT) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, part): all candidates; part: whether a longer phrase takes it in. docs: (lang, text)

    The score is that of the worst cut, floor(1000 * a * n / (l * r)); of equal ones the cut after the fewest words is given. As a phrase occurs at least as often as a longer one around it, looking at its children,
    the phrases of one word more, is enough to find whether any longer one takes it in.
    """
    with scratch(docs.sparkSession):
        levels, n = frequent(docs, longest, least, block, sent)
        one = F.array("f")
        named = levels[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", one.alias("firsts"), one.alias("lasts"))
        found = None
        for k, level in enumerate(levels[1:], 2):
            left = named.select(F.col("id").alias("left"), "lang", "phrase", "firsts")
            right = named.select(F.col("id").alias("right"), "last", "lasts")
            d = level.join(left, "left").join(right, "right")
            named = materialize(d.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", F.concat("firsts", one).alias("firsts"), F.concat("lasts", one).alias("lasts")))
            rated = named.withColumn("part", F.lit(False))
            if k < len(levels):
                held = levels[k].select(F.col("left").alias("id"), "f").unionByName(levels[k].select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("most"))
                rated = named.join(held, "id", "left").withColumn("part", F.coalesce(F.col("most") * 100 >= F.col("f") * subsumed, F.lit(False)))
            found = rated.select("lang", "phrase", "f", "firsts", "lasts", "part") if found is None else found.unionByName(rated.select("lang", "phrase", "f", "firsts", "lasts", "part"))
        if found is None:
            return docs.sparkSession.createDataFrame([], "lang string, phrase string, a long, l long, r long, n long, score long, part boolean")
        big = lambda x: f"cast({x} as decimal(19, 0))"
        cut = f"transform(sequence(1, size(firsts) - 1), k -> named_struct('score', ({big('1000 * f')} * {big('n')}) div ({big('firsts[k - 1]')} * {big('lasts[size(firsts) - k - 1]')}), 'k', k, 'l', firsts[k - 1], 'r', lasts[size(firsts) - k - 1]))"
        d = found.join(n, "lang").withColumn("cut", F.expr(f"array_min({cut})"))
        return materialize(d.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", F.col("cut.score").alias("score"), "part"), keep=True)


def best(rated: DataFrame, most: int = MOST) -> DataFrame:
    """Each language's first `most`, with `rank` from 1. Slices of a language are cut first, so none is sorted as a whole in one task."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    d = rated.withColumn("__slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__slice").orderBy(*order))).filter(F.col("rank") <= most)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most).drop("__slice")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = collocations(table(spark, sf_dir, "documents").select("lang", "text")).filter("NOT part")
    return best(rated).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_OP13 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, ws[i : i + k - 1] AS g, CAST(k AS BIGINT) AS k, count(*) AS f FROM w, range(1, 6) AS t(k), range(1, len(ws) - k + 2) AS u(i) GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT f.lang, f.g, f.k, f.f AS a, n.n FROM f JOIN n USING (lang) WHERE f.k >= 2),
x AS (SELECT c.*, j, l.f AS l, r.f AS r, (CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS score FROM c, range(1, c.k) AS t(j) JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : j] JOIN f r ON r.lang = c.lang AND r.g = c.g[j + 1 : ]),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS best FROM x),
s AS (SELECT DISTINCT lang, g[i : i + k - 1] AS g, f AS most FROM (SELECT lang, g, f, k AS length FROM f), range(2, 5) AS t(k), range(1, length - k + 2) AS u(i) WHERE k < length),
m AS (SELECT lang, g, max(most) AS most FROM s GROUP BY 1, 2),
z AS (SELECT y.lang, array_to_string(y.g, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM y LEFT JOIN m ON m.lang = y.lang AND m.g = y.g WHERE best = 1 AND NOT coalesce(100 * most >= 100 * a, false))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z) WHERE rank <= 2000
"""
