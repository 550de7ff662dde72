"""Packing documents into sequences whose source mixture is held to target proportions.

Sources are queues of token ids, served by deficit round-robin: in each window
(a sequence of L tokens) a queue's deficit grows by its quantum, L times its
target's share among the queues that aren't empty, and it sends as many whole
tokens as the deficit holds; the fraction is carried to the next window, in
whichever partition that is filled. Once a queue is empty the others take its
quantum in proportion. Targets default to the sources' own sizes: then none
runs out before the last window, and every window has the mixture of the whole.

What a queue has sent after S tokens of all has a closed form, so windows are
filled in parallel, with the deficits that a serial run would have carried to
them. The queues are the leaves of a binary tree. Of the S tokens that a node
has sent, its left half has sent floor(f(S)) and its right half the others,
where f is what the targets say: a line between the points at which a queue
runs empty. Both grow with S, for any number of queues, and each queue stays
within a token for each level of the tree of what its target says.

Documents are tokenised once, into a staged table; their places follow from
counts per task and source. While these counts prove few they are sent to the
tasks, and no token is shuffled; beyond that, a row's ids are, once, by source
and task, of which no group is larger than what a task has tokenised.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import cut, is_small, small_batches, staged
from pagemill.llm.tokens import load, token_ids, vocabulary_path

LENGTH = 4096
#: Tokens of a document whose places are worked out at once.
PART = 1 << 20
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, source string, padded_length long"
)


def scaled(x: np.ndarray, a: np.ndarray, b: np.ndarray, up: bool = False) -> np.ndarray:
    """floor (or ceiling) of x a / b of longs, exact for quotients below 2^50.

    The quotient in doubles is off by a unit or two. Its remainder is a small
    number, which products that wrap around in 64 bits give exactly.
    """
    q = np.floor(x.astype(np.float64) * a / b).astype(np.int64)
    rest = x * a - q * b
    q = q + rest // b
    return q + (rest % b > 0) if up else q


class Split:
    """How the tokens of a node are parted: knots of what both halves, and the left one, have sent."""

    def __init__(self, both: Sequence[int], left: Sequence[int]) -> None:
        both, left = np.array(both, np.int64), np.array(left, np.int64)
        new = np.r_[True, np.diff(both) > 0]
        self.both, self.left = both[new], left[new]
        self.right = self.both - self.left
        self.d_both, self.d_left = np.diff(self.both), np.diff(self.left)
        self.d_right = self.d_both - self.d_left

    def _piece(self, knots: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.clip(np.searchsorted(knots, x, side="right") - 1, 0, len(knots) - 2)

    def left_of(self, sent: np.ndarray) -> np.ndarray:
        """What the left half has sent when both have sent so much."""
        j = self._piece(self.both, sent)
        return self.left[j] + scaled(sent - self.both[j], self.d_left[j], self.d_both[j])

    def place(self, right: bool, at: np.ndarray) -> np.ndarray:
        """Where a half's token at a place stands among those of both: the inverse of ``left_of``."""
        if right:
            j = self._piece(self.right, at)
            return self.both[j] + scaled(at - self.right[j], self.d_both[j], self.d_right[j])
        j = self._piece(self.left, at)
        return self.both[j] + scaled(at + 1 - self.left[j], self.d_both[j], self.d_left[j], up=True) - 1


#: From the root of the tree down to a queue: whether it lies right, and how the node is parted.
Path = list[tuple[bool, Split]]


class Schedule:
    """Which tokens of which queue each window holds."""

    def __init__(self, totals: Sequence[int], length: int = LENGTH, weights: Sequence[float] | None = None) -> None:
        self.totals, self.length, self.total = list(totals), length, sum(totals)
        self.windows = -(-self.total // length)
        if weights is not None and (len(weights) != len(self.totals) or not all(w > 0 for w in weights)):
            raise ValueError("each queue has a weight above zero")
        shares = None if weights is None else [Fraction(w).limit_denominator(10**9) for w in weights]
        self.splits: dict[tuple[int, int], Split] = {}
        ranges = [(0, len(self.totals))]
        while ranges:
            low, high = ranges.pop()
            if high - low > 1:
                middle = (low + high) // 2
                self.splits[low, high] = self._split(low, middle, high, shares)
                ranges += [(low, middle), (middle, high)]

    def _split(self, low: int, middle: int, high: int, shares: list[Fraction] | None) -> Split:
        if shares is None:
            left, both = sum(self.totals[low:middle]), sum(self.totals[low:high])
            return Split([0, both], [0, left])
        empty = sorted((Fraction(self.totals[i]) / shares[i], i) for i in range(low, high))
        open_left, open_right = sum(shares[low:middle], Fraction(0)), sum(shares[middle:high], Fraction(0))
        done_left = done_right = 0
        both, lefts = [0], [0]
        for when, i in empty:
            if i < middle:
                done_left, open_left = done_left + self.totals[i], open_left - shares[i]
            else:
                done_right, open_right = done_right + self.totals[i], open_right - shares[i]
            left, right = done_left + int(open_left * when), done_right + int(open_right * when)
            both.append(left + right)
            lefts.append(left)
        return Split(both, lefts)

    def path(self, queue: int) -> Path:
        low, high, out = 0, len(self.totals), []
        while high - low > 1:
            middle, split = (low + high) // 2, self.splits[low, high]
            out.append((queue >= middle, split))
            low, high = (middle, high) if queue >= middle else (low, middle)
        return out

    def windows_of(self, path: Path, places: np.ndarray) -> np.ndarray:
        """The window of each token of a queue."""
        for right, split in reversed(path):
            places = split.place(right, places)
        return places // self.length

    def _sent(self, path: Path, upto: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(what a queue has sent at ``upto`` and at ``before`` tokens of all, what queues left of it have sent between)."""
        first = np.zeros(len(upto), np.int64)
        for right, split in path:
            a, b = split.left_of(before), split.left_of(upto)
            if right:
                first, before, upto = first + b - a, before - a, upto - b
            else:
                before, upto = a, b
        return upto, before, first

    def pieces(self, queue: int, places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(index of the document, start in it, length, window, offset there) of the pieces of documents
        of a queue, by their places in it and sizes (of at least a token)."""
        path = self.path(queue)
        low, high = self.windows_of(path, places), self.windows_of(path, places + sizes - 1)
        # documents of a queue with few tokens skip windows: they name them token by token
        sparse = high - low >= sizes
        doc, window = _ranges(low[~sparse], (high - low + 1)[~sparse])
        doc = np.flatnonzero(~sparse)[doc]
        if sparse.any():
            of, token = _ranges(places[sparse], sizes[sparse])
            at = np.unique(np.stack([np.flatnonzero(sparse)[of], self.windows_of(path, token)]), axis=1)
            doc, window = np.r_[doc, at[0]], np.r_[window, at[1]]
        upto, before, first = self._sent(path, np.minimum((window + 1) * self.length, self.total), window * self.length)
        begin, end = np.maximum(before, places[doc]), np.minimum(upto, (places + sizes)[doc])
        some = end > begin
        found = (doc, begin - places[doc], end - begin, window, first + begin - before)
        return tuple(x[some] for x in found)


def _ranges(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of each range's values."""
    of = np.repeat(np.arange(len(first)), counts)
    return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, ids, n, task, before): ids as 16-bit words, and how many tokens of the same
    source the task has before the row. Staged, so that rows keep their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = load(path), TaskContext.get().partitionId()
        so_far: dict[str | None, int] = {}
        for whole in batches:
            for batch in small_batches([whole], "text", 2 << 20):
                ids = [token_ids(words, t) for t in batch.column("text").to_pylist()]
                n, before = [len(x) // 2 for x in ids], []
                for source, k in zip(batch.column("source").to_pylist(), n):
                    before.append(so_far.get(source, 0))
                    so_far[source] = before[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("source"), pa.array(ids, pa.binary()), pa.array(n, pa.int64()),
                        pa.array([task] * len(n), pa.int64()), pa.array(before, pa.int64()),
                    ],
                    names=["doc_id", "source", "ids", "n", "task", "before"],
                )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return staged(narrow.mapInArrow(run, "doc_id long, source string, ids binary, n long, task long, before long"))


def pack(
    docs: DataFrame, length: int = LENGTH, path: str | None = None, targets: Mapping[str | None, float] | None = None,
    small: bool | None = None,
) -> DataFrame:
    """The pieces of all documents, as PIECES.

    ``targets`` give each source's weight in a window, as long as it lasts; by
    default it is the source's number of tokens. A document is its ids and the
    end id 2; a null or empty text is just the end id. Texts of any length are
    tokenised whole. Documents are cut freely, each id lies in one piece, and
    the pieces of a sequence lie gapless from offset 0. Null is a source like
    any other. Repeated rows are packed as often as they come; a null doc_id
    stays null. No rows give no pieces. Other columns are ignored, whatever
    their names. ``padded_length`` is the piece's sequence's length with
    padding: ``length``, or for the last sequence its own if that is a power
    of two. The driver holds a name and a count for each source.
    """
    rows = tokenised(docs, path or vocabulary_path())
    per_task = cut(rows.groupBy("source", "task").agg(F.sum("n").alias("n")))
    per_source = per_task.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    if targets is not None and (missing := [r["source"] for r in per_source if r["source"] not in targets]):
        raise ValueError(f"no target for {missing[:5]}")
    names = [r["source"] for r in per_source]
    schedule = Schedule([r["n"] for r in per_source], length, None if targets is None else [targets[s] for s in names])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((schedule, {s: i for i, s in enumerate(names)}))
    before = W.partitionBy("source").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    starts = per_task.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("of"), F.col("task").alias("at"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"),
    )
    starts = cut(starts)
    few = is_small(starts) if small is None else small
    key = F.coalesce(F.concat(F.lit("="), rows["source"]), F.lit(""))
    placed = rows.join(F.broadcast(starts) if few else starts.hint("merge"), (key == starts["of"]) & (rows["task"] == starts["at"]))
    placed = placed.select("doc_id", "source", "ids", "n", (F.col("begin") + F.col("before")).alias("place"))
    last = schedule.windows - 1
    filled = schedule.total - last * length
    padded_last = filled if filled & (filled - 1) == 0 else length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, queues = shared.value
        for whole in batches:
            for batch in small_batches([whole], "ids"):
                doc_ids, source = batch.column("doc_id"), batch.column("source")
                raw = batch.column("ids").to_pylist()
                n, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "place"))
                queue = np.array([queues[s] for s in source.to_pylist()], np.int64)
                for q in np.unique(queue):
                    of = np.flatnonzero(queue == q)
                    # a part of a document at a time, for very long ones
                    at, start = _ranges(np.zeros(len(of), np.int64), -(-n[of] // PART))
                    owner, start = of[at], start * PART
                    for i in range(0, len(owner), 4096):
                        some, skip = owner[i : i + 4096], start[i : i + 4096]
                        doc, begin, size, window, offset = plan.pieces(int(q), place[some] + skip, np.minimum(n[some] - skip, PART))
                        who, begin = some[doc], begin + skip[doc]
                        words = {w: memoryview(np.frombuffer(raw[w], "<u2").astype("<u4").tobytes()) for w in np.unique(who).tolist()}
                        crc = [zlib.crc32(words[w][4 * a : 4 * (a + k)]) for w, a, k in zip(who.tolist(), begin.tolist(), size.tolist())]
                        take = pa.array(who)
                        yield pa.RecordBatch.from_arrays(
                            [
                                doc_ids.take(take), pa.array(begin), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[who]),
                                pa.array(window), pa.array(offset), source.take(take), pa.array(np.where(window == last, padded_last, length)),
                            ],
                            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "padded_length"],
                        )

    return placed.mapInArrow(run, PIECES)
