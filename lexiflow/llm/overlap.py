"""Same or near-same records across splits.

1. Every record is canonicalised (folded form, runs of letters or digits joined by one blank) and all its letters are hashed,
   so case, spacing and signs don't count; equal hashes are one *class*. Everything below works on classes, so copies are
   compared once.
2. A class that has members on both sides is an exact overlap: evaluation hashes joined with training hashes.
3. Near overlaps: fewer than one word in ``one_in`` was changed, added or dropped, i.e. a word edit distance d with
   ``d * one_in < max(words)``. If d is at most k, then of k + 1 disjoint segments of one text at least one stands
   unchanged in the other. So the training side is cut into that many segments, whose hashes are joined with the hashes of
   all the evaluation side's runs of words that have the size of such a segment. That loses no pair, nothing is capped, and
   the number of keys is linear in the number of words, whatever the length.
4. A segment that more than ``HOT`` training classes share (boilerplate) would pair all of them with all evaluation classes
   that hold it. Such keys are refined: if only hot segments are unchanged, the others share at most k edits, so of k + 1
   pieces of them one is unchanged. Hot keys are therefore joined together with the hash of a piece, against the same key
   together with each run of a piece's size. Again no pair is lost.
5. Candidates are verified exactly by a banded edit distance, which takes two words and their joint spelling for the same,
   then expanded to the members of both classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import MIN_RUNS, cut, cut_table
from lexiflow.llm.forms import Folded, digest
from lexiflow.plans.skew import lookup

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Training classes that may share a segment before it is refined, and words whose keys are made at once; neither changes a result.
HOT, PIECE = 1000, 1 << 20
#: A place is packed into a number: the first and the last start of a run in its text, and the text's words, FAR at most.
FAR = (1 << 21) - 1


def most_edits(n: int, one_in: int) -> int:
    """The largest d with d * one_in < n."""
    return (n - 1) // one_in if n else 0


def longest_partner(n: int, one_in: int) -> int:
    """The largest length that a text of n words can be near to: the largest m with (m - n) * one_in < m."""
    return (one_in * n - 1) // (one_in - 1) if n else 0


def shortest_partner(n: int, one_in: int) -> int:
    """The smallest length that a text of n words can be near to."""
    return -((n * (one_in - 1) + 1) // -one_in) if n else 0


def segment_count(length: int, one_in: int) -> int:
    """One more than there can be edits between a training text and any partner."""
    return most_edits(longest_partner(length, one_in), one_in) + 1


@lru_cache(maxsize=100_000)
def probe_sizes(n: int, one_in: int) -> tuple[int, ...]:
    """Sizes of the segments of all training texts that a text of n words can be near to."""
    out = set()
    for length in range(shortest_partner(n, one_in), longest_partner(n, one_in) + 1):
        count = segment_count(length, one_in)
        out |= {length // count, -(length // -count)}
    return tuple(sorted(s for s in out if s <= n))


def segments(length: int, one_in: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the segments of a training text."""
    count = segment_count(length, one_in)
    small, more = divmod(length, count)
    size = small + (np.arange(count) >= count - more)
    return np.cumsum(size) - size, size


@lru_cache(maxsize=1)
def _known() -> dict[str, int]:
    return {}


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word; a worker remembers those it has met."""
    known = _known()
    try:
        return np.array([known[w] for w in words], dtype=np.uint64)
    except KeyError:
        if len(known) > 1_000_000:
            known.clear()
        known.update((w, int.from_bytes(blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")) for w in set(words) if w not in known)
        return np.array([known[w] for w in words], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


class Hashes:
    """Hashes of any runs of words of some texts, which lie one after the other."""

    def __init__(self, words: list[str]):
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(words), BASE, dtype=np.uint64))
            self.back = np.cumprod(np.full(len(words) + 1, INVERSE, dtype=np.uint64)) * BASE
            self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(word_hashes(words) * power, dtype=np.uint64)])

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[start + size] - self.sums[start]) * self.back[start] ^ size.astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def _spans(n: np.ndarray, probe: bool, one_in: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in it, size) of all segments of texts of n words each, or of all runs to look for."""
    lengths, which = np.unique(n, return_inverse=True)
    made = []
    for length in lengths.tolist():
        if probe:
            sizes = probe_sizes(length, one_in)
            made.append((np.concatenate([np.arange(length - s + 1) for s in sizes]), np.concatenate([np.full(length - s + 1, s) for s in sizes])))
        else:
            made.append(segments(length, one_in))
    count = np.array([len(a) for a, _ in made])
    first = np.cumsum(count) - count
    start, size = (np.concatenate([m[i] for m in made]) for i in (0, 1))
    text = np.repeat(np.arange(len(n)), count[which])
    at = np.arange(len(text)) - np.repeat(np.cumsum(count[which]) - count[which], count[which]) + np.repeat(first[which], count[which])
    return text, start[at], size[at]


def keys_of(texts: list[list[str]], probe: bool, one_in: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, place): different hashes of the segments (training side) or of the runs to look for (evaluation side) of
    each text, and where the text has them."""
    n = np.array([len(t) for t in texts])
    text, start, size = _spans(n, probe, one_in)
    key = Hashes([w for t in texts for w in t]).of(start + (np.cumsum(n) - n)[text], size)
    order = np.lexsort((start, key, text))
    text, key, start = text[order], key[order], start[order]
    new = np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))
    last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
    place = np.minimum(start[new], FAR) << 42 | np.minimum(start[last], FAR) << 21 | np.minimum(n[text[new]], FAR)
    return text[new], key[new].view(np.int64), place


def may_be_near(a: Column, b: Column, one_in: int) -> Column:
    """Whether texts with a common run at these places can be near: what is before and behind it differs in length by no more
    words than there can be edits. A place that is too far to be told is taken for a fitting one."""
    lo, hi, n = (lambda x: F.shiftright(x, 42)), (lambda x: F.shiftright(x, 21).bitwiseAND(FAR)), (lambda x: x.bitwiseAND(FAR))
    before = F.greatest(F.lit(0), lo(a) - hi(b), lo(b) - hi(a))
    behind = F.greatest(F.lit(0), n(a) - hi(a) - n(b) + lo(b), n(b) - hi(b) - n(a) + lo(a))
    return (n(a) == FAR) | (n(b) == FAR) | ((before + behind) * one_in < F.greatest(n(a), n(b)))


def refined_keys(words: list[str], hot: np.ndarray, probe: bool, one_in: int) -> tuple[np.ndarray, int]:
    """Hot keys of a text (a row each), together with the hash of each piece of its other segments, or of each run of a
    piece's size; and how many pieces of each hot key are needed.

    Pieces are parts of the segments that aren't hot. One more than there can be edits are needed, so that a pair that has
    none of those segments in common still has a piece; any of them will do. Where the words outside of hot segments are too few for that, all of them may be
    edited, and the hot key stands alone (all such texts are near then, but for a few words).
    """
    hashes, hot = Hashes(words), np.unique(hot.view(np.uint64))
    alone = np.array([0x2545F4914F6CDD1D], dtype=np.uint64)
    if probe:
        most = max((-(s // -2) for s in probe_sizes(len(words), one_in)), default=0)
        sizes = range(1, min(most, len(words)) + 1)
        at = [np.arange(len(words) - s + 1) for s in sizes]
        piece = np.concatenate([hashes.of(a, np.full(len(a), s)) for a, s in zip(at, sizes, strict=True)] + [alone])
        with np.errstate(over="ignore"):
            return _mix(hot[:, None] * np.uint64(3) + piece[None, :]).view(np.int64), len(piece)
    start, size = segments(len(words), one_in)
    key = hashes.of(start, size)
    mine, cold = np.unique(key[np.isin(key, hot)]), ~np.isin(key, hot)
    edits, parts, needed = len(key) - 1, 2, len(key)
    if size[cold].sum() <= edits:
        piece, needed = alone, 1
    else:
        while np.minimum(size[cold], parts).sum() <= edits:
            parts += 1
        borders = [(a, a + s * np.arange(min(parts, s) + 1) // min(parts, s)) for a, s in zip(start[cold].tolist(), size[cold].tolist(), strict=True)]
        first, last = np.concatenate([x[:-1] for _, x in borders]), np.concatenate([x[1:] for _, x in borders])
        piece = hashes.of(first, last - first)
    with np.errstate(over="ignore"):
        return _mix(mine[:, None] * np.uint64(3) + piece[None, :]).view(np.int64), needed


def joined(a: list[str], b: list[str]) -> int:
    """How many neighbours of one text stand joined in the other."""
    x, y = set(a), set(b)
    return sum(v + w in y for v, w in zip(a, a[1:], strict=False)) + sum(v + w in x for v, w in zip(b, b[1:], strict=False))


def _plain_distance(a: list[str], b: list[str], most: int) -> int:
    """By the furthest place that d edits reach on each diagonal, so near texts cost little more than their length."""
    n, m = len(a), len(b)
    reach: dict[int, int] = {-1: -1}
    for d in range(most + 1):
        now = {}
        for k in range(-d, d + 1):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2) + 1, reach.get(k + 1, -2)) if d else 0
            i = min(i, n, m + k)
            if i < max(0, k):
                continue
            while i < n and i - k < m and a[i] == b[i - k]:
                i += 1
            now[k] = i
        if now.get(n - m, -1) >= n:
            return d
        reach = now
    return most + 1


def _joining_distance(a: list[str], b: list[str], most: int) -> int:
    """By all places near the diagonal, which joined words shift without an edit."""
    far, n, m = most + 1, len(a), len(b)
    band = most + joined(a, b)
    before, row = None, {j: min(j, far) for j in range(m + 1)}
    for i in range(1, n + 1):
        w, now = a[i - 1], {}
        for j in range(max(0, i - band), min(m, i + band) + 1):
            if not j:
                now[0] = min(i, far)
                continue
            v = b[j - 1]
            d = min(row.get(j - 1, far) + (w != v), row.get(j, far) + 1, now.get(j - 1, far) + 1, far)
            if before is not None and a[i - 2] + w == v:
                d = min(d, before.get(j - 1, far))
            if j > 1 and b[j - 2] + v == w:
                d = min(d, row.get(j - 2, far))
            now[j] = d
        if min(now.values(), default=far) > most and min(row.values(), default=far) > most:
            return far
        before, row = row, now
    return row.get(m, far)


def edit_distance(a: list[str], b: list[str], most: int) -> int:
    """Word edit distance, or most + 1 if it is larger. Two words against their joint spelling are no edit."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    x, y = len(a), len(b)
    while x > lo and y > lo and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    a, b = a[lo:x], b[lo:y]
    x, y = set(a), set(b)
    different = max(len(x - y), len(y - x))
    if joined(a, b):
        return _joining_distance(a, b, most)
    return most + 1 if max(different, abs(len(a) - len(b))) > most else _plain_distance(a, b, most)


def canonical(df: DataFrame, key: str, column: str, side: str, min_runs: int = MIN_RUNS) -> DataFrame:
    """(k, side, h, words): canonical words of each record, joined by one blank, and the hash of its letters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Folded(batch.column(2).to_pylist())
            raw, start, end = own.letters()
            words, kept = own.words(), np.flatnonzero(own.runs() >= max(1, min_runs))
            hs = [digest(raw[s:e]) for s, e in zip(start[kept].tolist(), end[kept].tolist(), strict=True)]
            rows = pa.array(own.row[kept])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(hs, pa.binary()), pa.array([words[i] for i in kept.tolist()], pa.string())], ["k", "side", "h", "words"])

    src = df.where(F.col(key).isNotNull() & F.col(column).isNotNull() & F.col(side).isNotNull())
    return src.select(F.col(key).cast("long").alias("k"), F.col(side).alias("side"), F.col(column).cast("string").alias("t")).mapInArrow(work, "k long, side string, h binary, words string")


def _emitted(classes: DataFrame, probe: bool, one_in: int) -> DataFrame:
    """(key, c, place) of all keys of each class."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, texts = batch.column(0), [w.split(" ") for w in batch.column(1).to_pylist()]
            i = 0
            while i < len(texts):
                j, n = i, 0
                while j < len(texts) and (j == i or n + len(texts[j]) <= PIECE):
                    n += len(texts[j])
                    j += 1
                text, key, place = keys_of(texts[i:j], probe, one_in)
                yield pa.RecordBatch.from_arrays([pa.array(key), c.take(pa.array(text + i)), pa.array(place)], ["key", "c", "place"])
                i = j

    return classes.select("c", "words").mapInArrow(emit, "key long, c long, place long")


def _refined(classes: DataFrame, keys: DataFrame, hot: DataFrame, probe: bool, one_in: int) -> DataFrame:
    """(key, c, place) of the refined keys of the classes that have hot ones; a class has fewer hot keys than words.

    Of the pieces of a training class those that fewest classes have with the same hot key are taken, as many as are needed;
    so what boilerplate reaches into other segments doesn't count either.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, c, row, needed = [], [], [], []
            for own, w, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                made, need = refined_keys(w.split(" "), np.array(h, dtype=np.int64), probe, one_in)
                key.append(made.ravel())
                c.append(np.full(made.size, own))
                row.append(np.repeat(np.arange(len(made)), made.shape[1]))
                needed.append(np.full(made.size, need))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (key, c, row, needed)], ["key", "c", "base", "needed"])

    own = keys.join(hot, "key", "left_semi").groupBy("c").agg(F.collect_set("key").alias("hot"))
    made = classes.select("c", "words").join(own, "c").select("c", "words", "hot").mapInArrow(emit, "key long, c long, base long, needed long")
    if not probe:
        made = cut_table(made)
        counts = made.groupBy("key").agg(F.count("*").alias("n"))
        place = F.row_number().over(Window.partitionBy("c", "base").orderBy("n", "key"))
        made = lookup(made, counts, ["key"], "n").withColumn("place", place).where("place <= needed")
    return made.select("key", "c").distinct().withColumn("place", F.lit(FAR).cast("long"))


def near_classes(classes: DataFrame, one_in: int = 8, most: int = HOT) -> DataFrame:
    """(eval_h, train_h, edits): pairs of different classes, one of each side, that are near; ``classes`` is (side, c, h, words).

    ``c`` is a number that each row has for itself. Keys go with it, as numbers that follow each other take little room where
    hashes don't.
    """
    train, other = classes.where("side = 'train'"), classes.where("side <> 'train'")
    index, probes = cut_table(_emitted(train, False, one_in)), _emitted(other, True, one_in)
    hot = cut(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key"))

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.select("key", F.col("c").alias("eval_c"), F.col("place").alias("pa")).join(b.select("key", F.col("c").alias("train_c"), F.col("place").alias("pb")), "key")
        return both.where(may_be_near(F.col("pa"), F.col("pb"), one_in)).select("eval_c", "train_c")

    if hot.isEmpty():
        found = pairs(probes, index)
    else:
        probes = cut_table(probes)
        found = pairs(probes, index.join(hot, "key", "left_anti"))
        found = found.unionByName(pairs(_refined(other, probes, hot, True, one_in), _refined(train, index, hot, False, one_in)))
    found = found.distinct()
    found = found.join(train.select(F.col("c").alias("train_c"), F.col("h").alias("train_h"), F.col("words").alias("b")), "train_c")
    found = found.join(other.select(F.col("c").alias("eval_c"), F.col("h").alias("eval_h"), F.col("words").alias("a")), "eval_c")
    found = found.where("eval_h <> train_h")

    @F.pandas_udf("int")
    def edits(a, b):
        import pandas as pd

        out = []
        for x, y in zip(a, b, strict=True):
            x, y = x.split(" "), y.split(" ")
            most = most_edits(max(len(x), len(y)), one_in)
            d = edit_distance(x, y, most)
            out.append(d if d <= most else -1)
        return pd.Series(out, dtype="int32")

    return found.select("eval_h", "train_h", edits("a", "b").alias("edits")).where("edits >= 0")


def overlaps(df: DataFrame, key: str, column: str, side: str, one_in: int = 8, min_runs: int = MIN_RUNS) -> tuple[DataFrame, DataFrame]:
    """Members and links of the overlaps between rows whose ``side`` is 'train' and those with another value.

    The first result is (k, side, h): each record that has ``min_runs`` runs or more, and its class; a key that comes more
    than once on a side counts once. The second is (eval_h, train_h, edits): the linked classes, with edits 0 for a class
    that stands on both sides. A record may have both sides (a path that one descriptor calls train and another one test).
    Rows with a null key, text or side are left out.
    """
    rows = cut_table(canonical(df, key, column, side, min_runs))
    classes = rows.withColumn("side", F.when(F.col("side") == "train", "train").otherwise("eval"))
    classes = cut_table(classes.groupBy("side", "h").agg(F.min("words").alias("words")).withColumn("c", F.monotonically_increasing_id()))
    train, other = classes.where("side = 'train'").select("h"), classes.where("side <> 'train'").select("h")
    same = other.join(train, "h").select(F.col("h").alias("eval_h"), F.col("h").alias("train_h"), F.lit(0).alias("edits"))
    members = rows.groupBy("k", "side").agg(F.min("h").alias("h"))
    return members, cut(same.unionByName(near_classes(classes, one_in)))


def overlap_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): every pair of a training and another record in linked classes, a < b. Large only if the result is."""
    train = members.where("side = 'train'").select(F.col("h").alias("train_h"), F.col("k").alias("kt"))
    other = members.where("side <> 'train'").select(F.col("h").alias("eval_h"), F.col("k").alias("ke"))
    pairs = links.join(other.dropDuplicates(["eval_h", "ke"]), "eval_h").join(train.dropDuplicates(["train_h", "kt"]), "train_h")
    return pairs.where("ke <> kt").select(F.least("ke", "kt").alias("a"), F.greatest("ke", "kt").alias("b")).distinct()


def overlap_records(members: DataFrame, links: DataFrame) -> DataFrame:
    """(k, side, links, edits): each evaluation record that overlaps, with the number of training records and the fewest edits.

    Counted by class: no pair of members is made.
    """
    sizes = members.where("side = 'train'").groupBy(F.col("h").alias("train_h")).agg(F.countDistinct("k").alias("n"))
    by_class = links.join(sizes, "train_h").groupBy(F.col("eval_h").alias("h")).agg(F.sum("n").alias("links"), F.min("edits").alias("edits"))
    return members.where("side <> 'train'").join(by_class, "h").select("k", "side", "links", "edits")


def split_paths(metas: DataFrame) -> DataFrame:
    """(data_path, split, tag): what each path is, from the data-set descriptors; published twice counts once."""
    out = None
    for split in ("train", "valid", "test"):
        part = metas.select(F.col(f"{split}_path").alias("data_path"), F.lit(split).alias("split"), "tag").where("data_path is not null")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
