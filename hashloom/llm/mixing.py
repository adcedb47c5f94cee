"""Mixing sources to target weights: systematic sampling along prefix sums of expected copies.

Every source gets the number of expected copies of each of its records that gives it its share of the total size: the size it
should have over the size it has, and never more than its cap on repeats. Where caps or missing sources leave size open, the
others take it over in proportion to their targets. Along a fixed order of a source's records the expected copies are summed up;
with one random offset per source, a record is emitted once for every whole number its stretch of the sum crosses. The order runs
by size, so that the sizes drawn follow the sizes there.

The prefix sum needs no task that sees a whole source: records fall into cells by source, size class and hash, the cells (a bounded
number) are summed up in one small table, and records are ranked within their cell.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashloom.session import checkpointed

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Hash cells per source and size class.
CELLS = 256


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("sizes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The ``keep`` columns and tokens BIGINT, of whole texts; a null or empty text has 0 tokens."""
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for b in batches:
            texts = b.column(b.num_columns - 1)
            sizes = np.fromiter((len(encode(t)) if t else 0 for t in texts.to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(sizes)], names=[*keep, "tokens"])

    return documents.select(*keep, "text").mapInArrow(run, f"{schema}, tokens bigint")


def expected_copies(targets: list[tuple[str, float, int | None]], sizes: dict[str, int], total: float) -> dict[str, float]:
    """Expected copies of each record by source.

    Shares are taken of the sum of the given shares. A source without records, or with a target of 0, gets 0. What a capped source
    can't fill goes to the others in proportion to their targets until no cap is exceeded.
    """
    want = {s: share for s, share, _ in targets if share and share > 0 and sizes.get(s, 0) > 0}
    cap = {s: np.inf if m is None else float(m) for s, _, m in targets}
    out, left, open_ = {s: 0.0 for s, _, _ in targets}, float(total), dict(want)
    while open_:
        whole = sum(open_.values())
        full = [s for s, w in open_.items() if left * w / whole / sizes[s] >= cap[s]]
        if not full:
            return out | {s: left * w / whole / sizes[s] for s, w in open_.items()}
        taken = 0.0
        for s in full:
            out[s] = cap[s]
            taken += cap[s] * sizes[s]
            del open_[s]
        left -= taken
    return out


def _offset(source: str, seed: int) -> float:
    return int.from_bytes(hashlib.md5(f"{seed}:{source}".encode()).digest()[:6]) / float(1 << 48)


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", total: int | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(composition, report).

    ``sized`` has ``key``, source and tokens; it is read several times, so pass a written or checkpointed table. ``targets`` has
    source, target_share and max_repeat (null: no limit) and must be small: it is read to the driver, and more than 10,000 rows are
    refused. ``total`` defaults to the tokens of all of ``sized``, records without source included (they can't be drawn).

    composition: (key, copy_no from 1, source, tokens), one row per use. report: (source, target_share, max_repeat, records, tokens,
    uses, used_tokens, actual_share), one row per target source, zeros where nothing could be drawn.
    """
    spark = sized.sparkSession
    rows = targets.where("source is not null").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 target sources")
    if len({r["source"] for r in rows}) < len(rows):
        raise ValueError("a source has several targets")
    named = [(r["source"], float(r["target_share"] or 0), r["max_repeat"]) for r in rows]
    wanted = spark.createDataFrame([(s,) for s, _, _ in named], "source string")
    own = sized.join(F.broadcast(wanted), "source")  # at most 10,000 names
    per = {r["source"]: (r["n"], r["t"]) for r in own.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).collect()}
    if total is None:
        total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    copies = expected_copies(named, {s: t for s, (_, t) in per.items()}, total)
    plan = spark.createDataFrame([(s, copies[s], _offset(s, seed)) for s, _, _ in named], "source string, copies double, offset double")

    h = F.xxhash64(F.col(key))
    placed = own.where(f"{key} is not null").select(
        F.col(key), "source", "tokens", h.alias("h"), F.floor(F.log2(F.coalesce("tokens", F.lit(0)) + F.lit(1)) * 4).cast("int").alias("size_class"), F.pmod(h, F.lit(CELLS)).cast("int").alias("cell")
    )
    where = ["source", "size_class", "cell"]
    counts = placed.groupBy(*where).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("size_class", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    starts = counts.select(*where, before.alias("before"))
    rank = F.row_number().over(Window.partitionBy(*where).orderBy("tokens", "h", key))
    numbered = placed.withColumn("r", rank).join(starts, where).join(F.broadcast(plan), "source").withColumn("i", F.col("before") + F.col("r"))
    crossed = F.floor(F.col("i") * F.col("copies") + F.col("offset")) - F.floor((F.col("i") - 1) * F.col("copies") + F.col("offset"))
    composition = (
        numbered.withColumn("uses", crossed.cast("int")).where("uses > 0").select(key, F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy_no"), "source", "tokens")
    )
    used = composition.groupBy("source").agg(F.count(F.lit(1)).alias("uses"), F.sum("tokens").alias("used_tokens"))
    base = spark.createDataFrame([(s, share, m, *per.get(s, (0, 0))) for s, share, m in named], "source string, target_share double, max_repeat int, records bigint, tokens bigint")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    report = base.join(used, "source", "left").select("source", "target_share", "max_repeat", "records", "tokens", zero("uses"), zero("used_tokens"))
    everything = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))  # one row per target source
    return composition, report.withColumn("actual_share", F.coalesce(F.try_divide(F.col("used_tokens"), everything), F.lit(0.0)))


def sized_documents(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source and tokens, counted once and written to the shared folder."""
    return checkpointed(token_counts(documents, tokenizer))
