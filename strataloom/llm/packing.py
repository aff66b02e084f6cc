"""Hierarchical packing of texts into containers of several capacities.

Every text is routed to the smallest tier that holds it whole; a text longer than the largest container is cut into
full containers and a rest, which is routed like a text. Tiers are packed from the largest down, best fit in decreasing
order; room left in a tier's containers is filled with the longest fitting texts of the shorter tiers before those are
packed. Containers of a tier are then dealt into step groups of equal size whose attention costs are level.

Items are packed in shards of bounded size drawn by hash, so that no task grows with the data; each shard leaves at most
one poorly filled container in each tier.
"""

from __future__ import annotations

import base64
import bisect
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

TOKENIZER = os.environ.get("STRATALOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the splitting pattern that belongs to the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts a shard holds on average; a shard's task holds three small numbers for each.
SHARD_ITEMS = 50_000
_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, once for each worker process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) for each row; null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["t"]]})

    got = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, "k long, n_tokens long")
    return got.withColumnRenamed("k", key)


def pack(items: list[tuple[int, int]], capacities: list[int]) -> list[tuple[int, list[int]]]:
    """(tier, item numbers) for each container. items: (number, length), each of at most the largest capacity."""
    caps = sorted(capacities)
    tiers: list[dict[int, list[int]]] = [{} for _ in caps]
    for i, n in sorted(items):
        tiers[bisect.bisect_left(caps, n)].setdefault(n, []).append(i)
    lengths = [sorted(t) for t in tiers]

    def take(t: int, room: int) -> tuple[int, int] | None:
        """The longest item of tier t that fits."""
        at = bisect.bisect_right(lengths[t], room) - 1
        if at < 0:
            return None
        n = lengths[t][at]
        i = tiers[t][n].pop()
        if not tiers[t][n]:
            del tiers[t][n]
            lengths[t].pop(at)
        return i, n

    out = []
    for t in reversed(range(len(caps))):
        while lengths[t]:
            room, held = caps[t], []
            # best fit in decreasing order, one container at a time; what is left is filled from the next tiers down
            for s in range(t, -1, -1):
                while room and (got := take(s, room)):
                    held.append(got[0])
                    room -= got[1]
            out.append((t, held))
    return out


def assign(df: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, group_size: int = 8, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row for each piece of a text: (key, piece, start_token, n_tokens, window_id, capacity, container, slot_start, step_group).

    windows: (window_id, capacity), a handful of rows; null, repeated and non-positive capacities are ignored, and none
    at all is an error. Texts that are null or empty take no room and give no row. Equal ids are packed as separate
    texts, and columns other than key and text are never read. A text of at most the largest capacity is never cut.
    """
    rows = windows.where("capacity > 0").groupBy("capacity").agg(F.min("window_id").alias("window_id")).orderBy("capacity").limit(1001).collect()
    if not rows or len(rows) > 1000:
        raise ValueError("between one and 1000 different capacities are needed")
    caps, ids = [r["capacity"] for r in rows], [r["window_id"] for r in rows]
    top = caps[-1]
    shards = max(1, math.ceil(df.count() / shard_items))
    counted = count_tokens(df, key, text, tokenizer).withColumnRenamed(key, "k").where("n_tokens > 0")
    cuts = F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / top).cast("int"))
    items = counted.select("k", "n_tokens", F.explode(cuts).alias("piece")).select(
        "k", "piece", (F.col("piece") * top).cast("long").alias("start"), F.least(F.col("n_tokens") - F.col("piece") * top, F.lit(top)).cast("long").alias("n")
    )
    # the row number, not the id, decides on the shard: many rows may carry one id
    items = materialize(items.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")))

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "piece", "start"], kind="stable").reset_index(drop=True)
        n = pdf["n"].to_numpy()
        held = pack(list(enumerate(n.tolist())), caps)
        out = []
        for t in range(len(caps)):
            mine = [h for tier, h in held if tier == t]
            groups = max(1, math.ceil(len(mine) / group_size))
            # dealt back and forth in the order of attention cost, so that the groups' sums are level
            order = sorted(range(len(mine)), key=lambda j: (-sum(int(n[i]) ** 2 for i in mine[j]), j))
            step = [0] * len(mine)
            for r, j in enumerate(order):
                q, m = divmod(r, groups)
                step[j] = m if q % 2 == 0 else groups - 1 - m
            for j, h in enumerate(mine):
                at = 0
                for i in h:
                    out.append((i, ids[t], caps[t], f"{k[0]}-{ids[t]}-{j}", at, f"{k[0]}-{ids[t]}-{step[j]}"))
                    at += int(n[i])
        got = pd.DataFrame(out, columns=["i", "window_id", "capacity", "container", "slot_start", "step_group"])
        src = pdf.iloc[got["i"].to_numpy()].reset_index(drop=True)
        return pd.DataFrame({"k": src["k"], "piece": src["piece"], "start_token": src["start"], "n_tokens": src["n"]}).join(got.drop(columns="i"))

    schema = "k long, piece int, start_token long, n_tokens long, window_id int, capacity int, container string, slot_start long, step_group string"
    return items.groupBy("shard").applyInPandas(run, schema).withColumnRenamed("k", key)


def usage(assigned: DataFrame) -> DataFrame:
    """For each window: containers, pieces, tokens and the share of room used."""
    return assigned.groupBy("window_id", "capacity").agg(
        F.countDistinct("container").alias("containers"), F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"),
        F.round(F.sum("n_tokens") / (F.countDistinct("container") * F.first("capacity")), 6).alias("used"),
    )
