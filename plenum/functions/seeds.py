"""Deterministic seeds and hash orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions.text import content_hash, hex_number

# Seed layouts.
MASK_31 = 2147483647
MASK_32 = 4294967295
MASK_63 = 9223372036854775807
ROUND_STRIDE = 1_000_003
AGENT_STRIDE = 100_003
SHARD_STRIDE = 10_000_019
BATCH_STRIDE = 1_009
MAX_REQUESTS = 1 << 23
MAX_STREAMS = 1 << 8


def text_seed(*parts: Column) -> Column:
    """31-bit seed of a text: first 4 bytes of its sha-256."""
    return hex_number(content_hash(*parts), 8).cast("bigint").bitwiseAND(F.lit(MASK_31))


def joined(*parts) -> Column:
    """Parts separated by colons, as seed text."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in columns])


def batch_seed(base: int, trial: Column, shard: Column, batch: Column) -> Column:
    return text_seed(joined(base, "evaluate", trial, shard, batch))


def preference_seed(
    base: int, stage: Column, iteration: Column, shard: Column, batch: Column
) -> Column:
    return text_seed(joined(base, stage, iteration, shard, batch))


def sft_seed(base: int, index: Column, role: Column, temperature: Column) -> Column:
    return text_seed(
        joined(base, "sft", index, role, F.format_string("%.8f", temperature.cast("double")))
    )


def retry_seed(base: Column, index: Column, attempt: Column) -> Column:
    """63-bit seed for another attempt at an empty answer."""
    high = hex_number(
        content_hash(joined(base, index, "empty-response-retry", attempt)), 16
    )
    # drop the top bit of the unsigned 64-bit value
    limit = F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(high >= limit, high - limit).otherwise(high).cast("bigint")


def request_seed(base: int | Column, index: Column, stream: Column) -> Column:
    """base (32 bits) | request index (23 bits) | stream (8 bits).

    An index or stream outside its field fails the job: its seed would be
    another request's.
    """
    base = base if isinstance(base, Column) else F.lit(base)
    prefix = F.shiftleft(base.cast("bigint").bitwiseAND(F.lit(MASK_32)), 31)
    fits = index.between(0, MAX_REQUESTS - 1) & stream.between(0, MAX_STREAMS - 1)
    message = F.concat(F.lit("request "), index.cast("string"), F.lit(" or stream "), stream.cast("string"), F.lit(" is out of range"))
    value = prefix.bitwiseOR(F.shiftleft(index.cast("bigint"), 8)).bitwiseOR(stream.cast("bigint"))
    return F.when(index.isNull() | stream.isNull(), F.lit(None).cast("bigint")).when(fits, value).otherwise(
        F.raise_error(message).cast("bigint")
    )


def debate_seed(base: int, round_: Column, agent: Column, index: Column) -> Column:
    return (
        F.lit(base).cast("bigint")
        + round_.cast("bigint") * ROUND_STRIDE
        + agent.cast("bigint") * AGENT_STRIDE
        + index.cast("bigint")
    )


def offset_seed(base: int, round_: Column, offset: Column) -> Column:
    return F.lit(base).cast("bigint") + round_.cast("bigint") * 100 + offset.cast("bigint")


def shard_batch_seed(base: int, shard: Column, batch: Column) -> Column:
    return (
        F.lit(base).cast("bigint")
        + shard.cast("bigint") * SHARD_STRIDE
        + batch.cast("bigint") * BATCH_STRIDE
    )


def order_hash(seed: int | Column, key: Column) -> Column:
    """Hex text that orders rows in a repeatable, seed dependent way."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return content_hash(seed.cast("string"), F.lit(":"), key.cast("string"))
