"""Fills containers of a fixed capacity with documents sized in tokens.

Sizes are whole numbers up to the capacity, so a plan needs only how many documents there are of each size, whatever the
corpus: documents above a third of the capacity go one or two to a container by greedy matching, largest with the largest
that still fits; smaller ones go, largest first, where they leave the least room. Equal containers are planned as one
range. The plan says which ranks of a size go to which containers; every document gets its rank within its size from
counts of hashed buckets and looks its container up. No group of documents of one size is ever in one task.
"""

from __future__ import annotations

import base64
import bisect
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import materialise, table

#: Buckets that the documents of one size are spread over to be ranked; a few thousand documents in each on a large corpus.
BUCKETS = 4096


def default_tokenizer() -> str:
    """Path of a public byte-level BPE vocabulary; any file of ranks in that form may be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, tokens) of every document; null and empty texts have 0."""
    path = tokenizer or default_tokenizer()

    def run(texts: pd.Series) -> pd.Series:
        encoder = _encoder(path)
        return pd.Series([len(encoder.encode_ordinary(t)) if isinstance(t, str) else 0 for t in texts], index=texts.index, dtype="int64")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), pandas_udf(run, "bigint").asNondeterministic()(text_col).alias("tokens"))


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(size, first rank, first container, items per container) of every stretch of a size's ranks, in order of ranks within a size; and how many containers are used.

    A stretch goes on to the next stretch of its size.
    """
    left = {s: n for s, n in counts.items() if 0 < s <= capacity and n > 0}
    rank = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int]] = []
    used = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # free room -> ranges of containers

    def put(size: int, n: int, start: int, each: int) -> None:
        out.append((size, rank[size], start, each))
        rank[size] += n
        left[size] -= n

    def free(room: int, start: int, n: int) -> None:
        if n and room:
            gaps.setdefault(room, []).append((start, n))

    live = sorted(s for s in left if 3 * s > capacity)  # sizes of which some are left
    while live:
        size = live[-1]
        at = bisect.bisect_right(live, min(capacity - size, size)) - 1
        at -= at >= 0 and live[at] == size and left[size] == 1  # one alone is no mate to itself
        mate = live[at] if at >= 0 else None
        n = left[size] if mate is None else left[size] // 2 if mate == size else min(left[size], left[mate])
        put(size, n * (2 if mate == size else 1), used, 2 if mate == size else 1)
        if mate is not None and mate != size:
            put(mate, n, used, 1)
        free(capacity - size - (mate or 0), used, n)
        used += n
        for s in {size, mate} - {None}:
            if not left[s]:
                del live[bisect.bisect_left(live, s)]
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        rooms = sorted(g for g in gaps if g >= size)
        for room in rooms:
            while left[size] and gaps.get(room):
                start, n = gaps[room].pop()
                each = room // size
                full = min(n, left[size] // each)
                if full:
                    put(size, full * each, start, each)
                    free(room - each * size, start, full)
                rest = left[size] if full < n and left[size] < each else 0
                if rest:
                    put(size, rest, start + full, rest)
                    free(room - rest * size, start + full, 1)
                more = n - full - (1 if rest else 0)
                if more:
                    gaps[room].append((start + full + (1 if rest else 0), more))
            if not gaps.get(room):
                gaps.pop(room, None)
            if not left[size]:
                break
        while left[size]:
            each = capacity // size
            full = left[size] // each
            if full:
                put(size, full * each, used, each)
                free(capacity - each * size, used, full)
                used += full
            elif rest := left[size]:
                put(size, rest, used, rest)
                free(capacity - rest * size, used, 1)
                used += 1
    return out, used



def pack(documents: DataFrame, specs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(spec_id, container_id, doc_id, piece_no, tokens): each document in one container of each capacity.

    Only a document larger than the capacity is split, into full pieces and a last one, numbered from 0. Documents
    without tokens take no room and have a null container. Null ids are dropped, repeated rows count once, extra columns
    don't matter. A spec needs a capacity of 1 at least; others are left out.
    """
    spark = documents.sparkSession
    wanted = [(r[0], r[1]) for r in specs.select("spec_id", "capacity_tokens").distinct().collect() if r[0] is not None and (r[1] or 0) > 0]
    schema = "spec_id bigint, container_id bigint, doc_id bigint, piece_no bigint, tokens bigint"
    if not wanted:
        return spark.createDataFrame([], schema)
    sized = materialise(token_counts(documents, id_col=id_col, text_col=text_col, tokenizer=tokenizer).distinct())
    each = F.explode(F.array(*[F.struct(F.lit(s).cast("bigint").alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for s, c in sorted(wanted)]))
    rows = sized.select("doc_id", "tokens", each.alias("s")).select("doc_id", "tokens", "s.*")
    last = F.greatest(F.lit(0), F.floor((F.col("tokens") - 1) / F.col("capacity"))).cast("bigint")
    pieces = rows.withColumn("last", last).select("spec_id", "doc_id", "capacity", "tokens", "last", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("piece_no"))
    items = pieces.select("spec_id", "doc_id", "piece_no", F.when(F.col("piece_no") < F.col("last"), F.col("capacity")).otherwise(F.col("tokens") - F.col("last") * F.col("capacity")).alias("size"))
    keyed = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(BUCKETS)))
    counts = keyed.groupBy("spec_id", "size", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("spec_id", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("before", before).select("spec_id", "size", "bucket", "before")
    within = F.row_number().over(Window.partitionBy("spec_id", "size", "bucket").orderBy("doc_id", "piece_no")) - 1
    ranked = keyed.withColumn("within", within).join(offsets, ["spec_id", "size", "bucket"]).withColumn("rank", F.col("within") + F.col("before"))
    # At most one row per capacity and size.
    histogram: dict[int, dict[int, int]] = {s: {} for s, _ in wanted}
    for r in counts.groupBy("spec_id", "size").agg(F.sum("count").alias("n")).collect():
        histogram[r["spec_id"]][r["size"]] = r["n"]
    lookup = {}
    for spec, capacity in wanted:
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for size, rank, start, n in plan(histogram[spec], capacity)[0]:
            by_size.setdefault(size, []).append((rank, start, n))
        lookup[spec] = {s: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(v))) for s, v in by_size.items()}
    shared = spark.sparkContext.broadcast(lookup)

    def run(spec: pd.Series, size: pd.Series, rank: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(spec), index=spec.index, dtype="Int64")
        for (s, z), at in pd.DataFrame({"s": spec, "z": size}).groupby(["s", "z"]).groups.items():
            if (found := shared.value.get(s, {}).get(z)) is not None:
                ranks, starts, n = found
                r = rank.loc[at].to_numpy()
                k = np.searchsorted(ranks, r, side="right") - 1
                out.loc[at] = starts[k] + (r - ranks[k]) // n[k]
        return out

    run.__annotations__ = {"spec": pd.Series, "size": pd.Series, "rank": pd.Series, "return": pd.Series}
    place = pandas_udf(run, "bigint")("spec_id", "size", "rank")
    return ranked.select("spec_id", place.alias("container_id"), "doc_id", "piece_no", F.col("size").alias("tokens"))


def p8_assignment(spark, sf_dir: str) -> DataFrame:
    """The container of every document, for each capacity."""
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_specs"))


def p8_fill(spark, sf_dir: str) -> DataFrame:
    """Containers used for each capacity, the least any packing needs, and the share of room left unused."""
    packed = p8_assignment(spark, sf_dir).where(F.col("container_id").isNotNull())
    per = packed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("tokens")).groupBy("spec_id").agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    sized = per.join(table(spark, sf_dir, "container_specs").select(F.col("spec_id").cast("bigint").alias("spec_id"), "capacity_tokens"), "spec_id")
    return sized.withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))
