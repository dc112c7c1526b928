"""Mixing sources to target weights by the cube method.

Targets: sources share all words by weight; no source gives more than three times what it has, and what that
leaves over is shared again. Inside a source every document is then due the same number of copies, target over
size. The whole part is taken as it is; the fractional part is a probability that the cube method turns into 0
or 1. Its flight takes three documents at a time and moves their probabilities along the one direction that
changes neither the sum of probabilities (documents) nor that of probability times size (words), until one of
the three is settled; two stay open in the end. Texts that are long against their source are settled first, and
the chances of the others moved to balance them. Flights of sources too large for one group run in groups of bounded
size that hold documents back for the landing, and what they leave open flies again in fewer groups. Its last sixteen documents at most are the landing problem:
all choices are compared, and the one nearest in words is taken.

Random choices are keyed by hashes of the document, so runs agree. Defined results: null text has size 0; a null
source is a source of its own, after all others; repeated rows are separate documents, told apart by a number
among equals; a source without words has target 0; a document of size 0 counts as a document and takes no words;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import beside, saved, word_count

WEIGHTS = (5.0, 2.0, 1.0)  # by rank of the source, repeating
SHARE = 1.0  # of all words
MOST = 3  # times a source's size
GROUP = 4096  # documents that fly together
LONG_MEAN, LONG = 32, 1024  # long: above 32 times the mean of its source, and above 1 in 1024 of its words
LANDING = 14  # documents of a source held back for its landing, besides the two that a flight leaves open


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """`sources` (source, source_size) with target: shared by weight, capped, the excess shared again.

    A source is capped once the level (words per weight) reaches most * size / weight; so with sources in that
    order, the level is what is left over the weights not yet capped, at the first source that does not reach it.
    One row per source goes through the window, the same numbers from any run.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("_weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    ranked = ranked.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_weight, all_size = F.sum("_weight").over(everything), F.sum("source_size").over(everything)
    left = all_size * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / (all_weight - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("_level", level).withColumn("_open", F.col("_cap") > level * F.col("_weight"))
    final = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(final.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), final * F.col("_weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def flight(chance: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Move chances to 0 or 1, keeping their sum and their sum weighted by size; at most two stay between."""
    out = chance.astype(float).copy()
    open_ = [k for k in range(len(out)) if 0 < out[k] < 1]
    at, held = 0, []
    while True:
        while len(held) < 3 and at < len(open_):
            held.append(open_[at])
            at += 1
        if len(held) < 3:
            return out
        s = size[held]
        way = np.array([s[2] - s[1], s[0] - s[2], s[1] - s[0]], float)
        if not way.any():  # equal sizes: moving one against another changes nothing
            way = np.array([1.0, -1.0, 0.0])
        p = out[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(way > 0, (1 - p) / way, np.where(way < 0, -p / way, np.inf)).min()
            down = np.where(way > 0, p / way, np.where(way < 0, (p - 1) / way, np.inf)).min()
        # the chance of either step keeps each document's own chance
        moved = p + up * way if draws[held[0]] * (up + down) < down else p - down * way
        moved = np.where(moved < 1e-9, 0.0, np.where(moved > 1 - 1e-9, 1.0, moved))
        out[held] = moved
        held = [k for k in held if 0 < out[k] < 1]


def _spread(open_: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of the open documents, evenly spread over the sizes, so that their choices reach sums of all kinds."""
    by_size = open_[np.argsort(size[open_], kind="stable")]
    return by_size[np.unique(np.linspace(0, len(by_size) - 1, min(most, len(by_size))).astype(int))] if len(by_size) else by_size


def _fly(group: pd.DataFrame, most: int) -> pd.DataFrame:
    """A flight of all but `most` documents, which are kept for the landing."""
    group = group.sort_values(["draw", "doc_key"], kind="stable").reset_index(drop=True)
    chance, size = group["chance"].to_numpy(float).copy(), group["size"].to_numpy(float)
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    flying = open_[~np.isin(open_, _spread(open_, size, most))]
    chance[flying] = flight(chance[flying], size[flying], group["draw"].to_numpy()[flying])
    group["chance"] = chance
    return group


def _settle_long(group: pd.DataFrame) -> pd.DataFrame:
    """The long documents of a source, settled; `_rest` words are in its other documents.

    What they take above or below what is due, the others give: their chances move by `_move`. Of the choices for the
    two that a flight leaves open, the drawn one is taken if the others can balance it, else the one nearest to that.
    """
    group = group.sort_values(["draw", "doc_key"], kind="stable").reset_index(drop=True)
    before, size, draw = (group[c].to_numpy(float) for c in ("chance", "size", "draw"))
    rest, chance = float(group["_rest"].iloc[0]), flight(before, size, draw)
    left = np.flatnonzero((chance > 0) & (chance < 1))
    choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    over = size @ (chance - before) + (choices - chance[left]) @ size[left]
    move = -over / rest
    beyond = np.maximum(0, np.maximum(before[0] + move - 1, -(before[0] + move)))
    drawn = (choices != (draw[left] < chance[left])).sum(axis=1)
    pick = np.lexsort([drawn, beyond])[0]
    chance[left] = choices[pick]
    group["chance"], group["_move"] = chance, move[pick]
    return group


def _land(group: pd.DataFrame) -> pd.DataFrame:
    """The last flight of a source, and its landing: of all choices for the documents held back and those left
    open, within three documents of what is due, the one whose words come nearest to what is due."""
    group = group.sort_values(["draw", "doc_key"], kind="stable").reset_index(drop=True)
    chance, size = group["chance"].to_numpy(float).copy(), group["size"].to_numpy(float)
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    held = _spread(open_, size, LANDING)
    flying = open_[~np.isin(open_, held)]
    chance[flying] = flight(chance[flying], size[flying], group["draw"].to_numpy()[flying])
    left = np.flatnonzero((chance > 0) & (chance < 1))
    if len(left):
        choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        documents = np.abs((choices - chance[left]).sum(axis=1))
        near = choices[documents <= max(3.0, documents.min())]
        chance[left] = near[np.abs((near - chance[left]) @ size[left]).argmin()]
    group["chance"] = chance
    return group


def _without_long(due: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that are long against their source, settled; the others, due what balances those).

    The flight moves a long text least, so it would stay open to the end, where few others are left to balance it.
    """
    open_ = F.col("chance").between(1e-9, 1 - 1e-9)
    whole = saved(due.where(open_).groupBy("stratum").agg(F.sum("size").alias("_words"), F.count("*").alias("_n")), "words")
    sized = due.join(beside(whole), "stratum", "left")
    # at most LONG of them in a source
    is_long = open_ & (F.col("size") * F.col("_n") > LONG_MEAN * F.col("_words")) & (F.col("size") * LONG > F.col("_words"))
    long = sized.where(is_long)
    rest = long.groupBy("stratum").agg((F.first("_words") - F.sum("size")).alias("_rest")).where("_rest > 0")
    long = long.join(rest, "stratum").select(*due.columns, F.col("_rest").cast("double").alias("_rest"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in long.schema.fields)
    settled = saved(long.groupBy("stratum").applyInPandas(lambda g: _settle_long(g.assign(_move=0.0)), f"{fields}, _move double"), "long")
    moves = saved(settled.groupBy("stratum").agg(F.first("_move").alias("_move")), "moves")
    moved = F.when(open_ & F.col("_move").isNotNull(), F.least(F.greatest(F.col("chance") + F.col("_move"), F.lit(0.0)), F.lit(1.0))).otherwise(F.col("chance"))
    others = sized.where(~F.coalesce(is_long, F.lit(False)) | F.col("_words").isNull()).join(beside(moves), "stratum", "left")
    # a source of long documents alone has nothing to balance them with; they stay as they are
    kept = sized.where(is_long).join(beside(moves), "stratum", "left_anti").select(*due.columns)
    return settled.select(*due.columns), others.withColumn("chance", moved).select(*due.columns).unionByName(kept)


def _settled(due: DataFrame) -> DataFrame:
    """`due` (stratum, doc_key, size, chance, draw) with every chance 0 or 1, in rounds of fewer groups."""
    schema = due.schema
    long, due = _without_long(due)
    parts = [long]
    most = min(LANDING, GROUP // 8)
    due = saved(due, "others")
    while True:
        # every round keeps few documents of up to GROUP, so a few rounds do for any number
        counts = due.groupBy("stratum").agg(F.count("*").alias("_n")).select("stratum", F.ceil(F.col("_n") / GROUP).alias("_groups"))
        counts = saved(counts.where("_groups > 1"), "strata")
        if counts.isEmpty():
            return _union([*parts, due.groupBy("stratum").applyInPandas(_land, schema)])
        # a source of one group waits for its landing, whatever the size of the others
        placed = due.join(beside(counts), "stratum").withColumn("_g", F.pmod(F.xxhash64("doc_key", F.lit(len(parts))), F.col("_groups")))
        flown = saved(placed.drop("_groups").groupBy("stratum", "_g").applyInPandas(lambda g: _fly(g.drop(columns="_g"), most), schema), "flight")
        parts.append(flown.where("chance <= 0 OR chance >= 1"))
        waiting = due.join(beside(counts), "stratum", "left_anti")
        due = saved(waiting.unionByName(flown.where("chance > 0 AND chance < 1")), "open")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, doc_key, _text): the key tells rows apart that are equal in these and in their text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(text).alias("_text"))
    # rows of one document are few; a document is no group of copies
    equal = Window.partitionBy("doc_id", "source", "size", "_text").orderBy(F.lit(1))
    numbered = flat.withColumn("copy", F.row_number().over(equal))
    return numbered.select("doc_id", "source", "size", F.xxhash64("doc_id", "_text", "copy").alias("doc_key"), "_text")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per row of `docs` (doc_id, text, source): doc_id, size, source_size, target, taken, copies."""
    mixed = _mixed(docs, weights, share, most)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _mixed(docs: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    sized = saved(_numbered(docs), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = saved(targets(sources, weights, share, most).withColumn("stratum", F.xxhash64("source")), "targets")
    goal = beside(goals.withColumnRenamed("source", "_source"))
    due = sized.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(copies + 1e-12).cast("bigint")
    due = due.withColumn("_whole", whole).withColumn("chance", F.greatest(copies - whole, F.lit(0.0)))
    due = due.withColumn("draw", F.pmod(F.xxhash64("doc_key", F.lit("draw")), F.lit(1 << 52)) / float(1 << 52))
    due = saved(due, "due")
    settled = _settled(due.select("stratum", "doc_key", "doc_id", "size", "chance", "draw"))
    # rows that are equal in all but their number have different keys; two documents may share one by accident
    rest = due.select(*[F.col(c).alias(f"_{c}") for c in ("stratum", "doc_key", "doc_id")], "source_size", "target", "_whole", "_text")
    same = (F.col("stratum") == F.col("_stratum")) & (F.col("doc_key") == F.col("_doc_key")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    number = F.col("_whole") + (F.col("chance") > 0.5).cast("bigint")
    return settled.join(rest, same).select("doc_id", "_text", "size", "source_size", "target", number.alias("copies"))


def repeat_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with all their columns.

    Texts are shuffled once, by document; rows of one document with one text share its copies out.
    """
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    known = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    taken = _mixed(docs, weights, share, most).select(known.alias("_id"), "_text", "copies")
    taken = taken.groupBy("_id", "_text").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), known.alias("_id"), text.alias("_text")).join(taken, ["_id", "_text"])
    turn = F.row_number().over(Window.partitionBy("_id", "_text").orderBy(F.lit(1)))
    extra = (turn <= F.col("_copies") % F.col("_rows")).cast("bigint")
    times = F.floor(F.col("_copies") / F.col("_rows")) + extra
    rows = rows.withColumn("_times", times).where("_times > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "_times"))).select("_row.*")
