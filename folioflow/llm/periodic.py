"""Periodic runs of words: suffix classes united by descending common prefix, with their positions in order."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import runs

LEAST_LENGTH = 6
LEAST_POWER = 4
RUN_BYTES = 1_500_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _refined(rank: np.ndarray, at: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order the positions `at` by their rank and then by second, number them anew from their group's rank on, and return those that
    still share their number."""
    order = np.lexsort((second, rank[at]))
    at, second = at[order], second[order]
    old = rank[at]
    fresh = np.concatenate(([True], old[1:] != old[:-1]))
    new = fresh | np.concatenate(([True], second[1:] != second[:-1]))
    place = np.arange(len(at))
    rank[at] = old + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(fresh, place, 0))
    alone = new & np.concatenate((new[1:], [True]))
    return at[~alone]


def suffix_links(codes: np.ndarray, ends: np.ndarray, least: int) -> tuple[list[int], list[int], list[int]]:
    """Neighbours in the order of suffixes that share `least` codes or more: (left, right, how many), by prefix doubling.

    codes are the words of texts laid end to end, and no code occurs in two texts; ends[i] is the end of the text that holds
    i. Only positions whose prefix so far occurs again in their text stay in the doubling."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    found = codes[order]
    new = np.concatenate(([True], found[1:] != found[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    at = order[~(new & np.concatenate((new[1:], [True])))]
    width, held = 1, None
    while len(at):
        if held is None and 2 * width > least:
            held = np.sort(at)  # share `width` codes at least
            floor = width
        behind = at + width
        second = np.where(behind < ends[at], rank[np.minimum(behind, n - 1)], -1)
        at = _refined(rank, at, second)
        width *= 2
    if held is None or not len(held):
        return [], [], []
    sorted_ = held[np.argsort(rank[held], kind="stable")]
    before = np.full(n, -1, np.int64)
    before[sorted_[1:]] = sorted_[:-1]
    left, right, shared = [], [], []
    plain, size, last = codes.tolist(), 0, -2
    stops = ends[held].tolist()
    for i, j, stop in zip(held.tolist(), before[held].tolist(), stops):
        size = size - 1 if i == last + 1 and size > floor else 0
        last = i
        if j < 0:
            size = 0
            continue
        most = stop - max(i, j)
        while size < most and plain[i + size] == plain[j + size]:
            size += 1
        if size >= least:
            left.append(j)
            right.append(i)
            shared.append(size)
    return left, right, shared


def runs_of(codes: np.ndarray, ends: np.ndarray, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in the words of texts laid end to end (see suffix_links).

    Classes of suffixes are united in order of falling shared length l. Each has its positions in order. Where two become
    neighbours at a distance d of at most l, what begins at the first has period d up to l words behind the second, and no word
    goes on with it. Every run is met from its first word, at which d is its smallest period: words nearer
    than d would give the same stretch a smaller period."""
    least = min(max(least_length - d, (least_power - 1) * d, d) for d in range(1, least_length + 1))
    left, right, shared = suffix_links(codes, ends, least)
    home: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    seeds: dict[tuple[int, int], int] = {}

    def root(i: int) -> int:
        top = i
        while home.setdefault(top, top) != top:
            top = home[top]
        while home[i] != top:
            home[i], i = top, home[i]
        return top

    def seed(a: int, b: int, l: int) -> None:
        d = b - a
        if (least_power - 1) * d <= l and d + l >= least_length:
            key = (d, b + l)
            if seeds.get(key, b) > a:
                seeds[key] = a

    for k in sorted(range(len(shared)), key=shared.__getitem__, reverse=True):
        l, a, b = shared[k], root(left[k]), root(right[k])
        big, small = members.setdefault(a, [a]), members.setdefault(b, [b])
        if len(big) < len(small):
            a, b, big, small = b, a, small, big
        home[b] = a
        before = -1
        for p, following in zip(small, [*small[1:], len(codes)]):
            at = bisect_left(big, p)
            if at and big[at - 1] != before:
                seed(big[at - 1], p, l)
            if at < len(big) and big[at] < following:
                seed(p, big[at], l)
            big.insert(at, p)
            before = p
        del members[b]
    return sorted((start, end - start, d) for (d, end), start in seeds.items())


def find_in(texts: pa.StringArray, least_length: int, least_power: int) -> tuple[list[int], list[list[dict]], pa.Array]:
    """Numbers of words, runs, and the texts without repetitions, of a column of texts."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    bounds = np.concatenate(([0], np.cumsum(full)))[split.offsets.to_numpy() - split.offsets[0].as_py()]
    words = words.filter(pa.array(full))
    counts = np.diff(bounds)
    told = words.dictionary_encode()
    text_of = np.repeat(np.arange(len(texts)), counts)
    codes = told.indices.to_numpy().astype(np.int64) + text_of * max(1, len(told.dictionary))
    found = runs_of(codes, np.repeat(bounds[1:], counts), least_length, least_power) if len(codes) else []
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    turn = np.zeros(len(codes) + 1, np.int64)  # how many more repetitions hold a word than the one before
    for start, length, period in found:
        i = int(text_of[start])
        out[i].append({"start": start - int(bounds[i]), "length": length, "period": period})
        turn[start + period] += 1
        turn[start + length] -= 1
    kept = np.cumsum(turn)[:-1] == 0
    left = np.concatenate(([0], np.cumsum(kept)))[bounds].astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), words.filter(pa.array(kept))), " ")
    return counts.tolist(), out, joined


def find_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER, keep: tuple = ()) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row of docs(doc_id, text), with the columns of `keep`.

    Words are what ASCII white space parts. A run is a stretch of words with smallest period q, of at least least_length and
    least_power x q words (least_power is 2 or more), that no neighbouring word goes on with; runs are in order of start, then period. collapsed is the
    words that lie in the first period of every run that holds them, or in none, joined by single spaces. A null or empty text has no
    words, no runs and the collapsed text ''. Repeated rows each give a row; an empty table gives none."""
    if least_power < 2:
        raise ValueError("a run repeats its period twice at least")
    names = [c for c in keep if c not in ("doc_id", "text")]
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in names])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for start, texts in runs(batch.column(1), RUN_BYTES):
                same = batch.slice(start, len(texts))
                counts, found, collapsed = find_in(pa.array(texts.to_pylist(), pa.string()) if texts.offset else texts, least_length, least_power)
                yield pa.RecordBatch.from_arrays(
                    [same.column(0), *same.columns[2:], pa.array(counts, pa.int64()), pa.array(found, kind), collapsed.cast(pa.string())],
                    names=["doc_id", *names, "n_words", "runs", "collapsed"],
                )

    fields = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    told = "".join(f", `{c}` {fields[c]}" for c in names)
    return base.mapInArrow(run, f"doc_id {fields['doc_id']}{told}, n_words long, runs {RUNS}, collapsed string")
