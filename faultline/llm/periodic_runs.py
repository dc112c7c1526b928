"""Periodic runs of words: an online sparse dynamic program over diagonals.

A diagonal is a lag; its match length at a word is the number of words in a row that equal the word `lag` before. Words
are taken in order. Each has at most one earlier occurrence per window size 1, 2, 4, ...: the nearest place where the last
`size` words are the same, and it counts if its lag is above half the size and at most the size. It increments the match
length of its lag, which starts at `size`, as that many words are known to match. A lag that is not incremented at the
next word ends, and gives a run at once if it is long enough.

Nothing is lost by taking only these: a run with smallest period q and three periods or more holds, from q + size words
after its start to its end, the same `size` words q before, for the size from q to below 2q; an occurrence nearer than q
would, by the theorem of Fine and Wilf, give the run a smaller period. So each run is one unbroken stretch of increments on
its own lag, no lag is taken twice, multiples of a period never appear, and the work is the number of words times at most
the logarithm of the longest period that does repeat. Window names come from sorting pairs of half-size names that repeat
inside one text, for a whole batch of texts at a time.

Defined results: null, empty and blank texts have no words and no runs, and collapse to an empty text; repeated rows give a
row each; null ids pass through; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import words

LEAST = 24  # words of the shortest run
PERIODS = 3  # and its periods
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def text_words(text: str | None) -> list[bytes]:
    """bytes.split parts at just the six blanks that part words."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def number(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words, where each text starts); equal words of one text share a number, others never."""
    numbers: list[np.ndarray] = []
    starts, base = [0], 0
    for tokens in texts:
        seen: dict[bytes, int] = {}
        numbers.append(np.fromiter((seen.setdefault(w, len(seen)) for w in tokens), np.int64, len(tokens)) + base)
        base += len(seen)
        starts.append(starts[-1] + len(tokens))
    return np.concatenate(numbers) if numbers else np.zeros(0, np.int64), np.array(starts)


def earlier_occurrences(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, lag, size) in order of place: the nearest earlier occurrence of the `size` words that end there, for the
    sizes 1, 2, 4, ... whose lag is in (size / 2, size]."""
    names = numbers
    places = np.arange(len(numbers))
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    size = 1
    while len(places):
        order = np.argsort(names, kind="stable")
        by_name, at = names[order], places[order]
        same = by_name[1:] == by_name[:-1]
        lag = at[1:] - at[:-1]
        fits = same & (lag <= size) & (2 * lag > size)
        found.append((at[1:][fits], lag[fits], size))
        # windows that are alone in their text take no part in longer ones that repeat
        alone = np.ones(len(at), bool)
        alone[1:] &= ~same
        alone[:-1] &= ~same
        fresh = np.concatenate([[False], ~same])
        name_of = np.full(len(numbers), -1, np.int64)
        name_of[at] = np.where(alone, -1, np.cumsum(fresh))
        right = np.flatnonzero(name_of >= 0)
        right = right[right >= size]
        right = right[name_of[right - size] >= 0]
        names = name_of[right - size] * (len(at) + 1) + name_of[right]
        places = right
        size *= 2
    if not found:
        return places, places, places
    place = np.concatenate([f[0] for f in found])
    lags = np.concatenate([f[1] for f in found])
    sizes = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
    order = np.argsort(place, kind="stable")
    return place[order], lags[order], sizes[order]


def find_runs(texts: list[list[bytes]], least: int = LEAST, periods: int = PERIODS) -> list[list[tuple[int, int, int]]]:
    """Per text its runs (start, length, period), by start and period."""
    numbers, starts = number(texts)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    active: dict[int, list[int]] = {}  # lag: match length, last word

    def end(lag: int) -> None:
        matched, last = active.pop(lag)
        length = matched + lag
        if length >= max(least, periods * lag):
            start = last + 1 - length
            text = int(np.searchsorted(starts, start, "right")) - 1
            runs[text].append((start - int(starts[text]), length, lag))

    now = -1
    for place, lag, size in zip(*(x.tolist() for x in earlier_occurrences(numbers)), strict=True):
        if place != now:
            # what the word before did not increment has ended
            for ended in [k for k, (_, last) in active.items() if last < place - 1]:
                end(ended)
            now = place
        state = active.get(lag)
        if state is None:
            active[lag] = [size, place]
        else:
            state[0] += 1
            state[1] = place
    for lag in list(active):
        end(lag)
    for found in runs:
        found.sort(key=lambda run: (run[0], run[2]))
    return runs


def collapse(tokens: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run holds after its first period, joined by single spaces."""
    if not runs:
        return b" ".join(tokens)
    kept = np.ones(len(tokens), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([tokens[k] for k in np.flatnonzero(kept)])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        texts = [text_words(t) for t in batch.column("text").to_pylist()]
        runs = find_runs(texts)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in found] for found in runs], run_type),
                pa.array([collapse(t, found).decode("utf-8", "surrogatepass") for t, found in zip(texts, runs, strict=True)], pa.string()),
            ],
            ["doc_id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, runs (start, length, period; by start, then period), collapsed."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words bigint, runs {RUNS}, collapsed string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_searched, schema)


def strongest(runs: Column) -> Column:
    """The run with most periods, the first of equals; null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda best, run: run["length"] * best["period"] > best["length"] * run["period"]
    return F.aggregate(runs, none, lambda best, run: F.when(best.isNull() | more(best, run), run).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) in which one document in ten, chosen by the checksum of its id, repeats itself to its end.

    With h the crc32 of the decimal id, g = h // 10 and n words, the documents with h % 10 = 0 have each word from a = g % n
    on replaced by word a + (i - a) % p, where p = 1 + (n - a) // (3 + g % 8). A null id is never chosen.
    """
    hashed = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(hashed / 10)
    split = words(F.col("text"))
    chosen = docs.select("doc_id", "text", F.when(hashed % 10 == 0, split).alias("w"), g.alias("g"))
    n = F.size("w")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    source = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", F.when(i < a, i).otherwise(a + (i - a) % p)))
    return chosen.select("doc_id", F.when(F.size("w") > 0, F.array_join(source, " ")).otherwise(F.col("text")).alias("text"))
