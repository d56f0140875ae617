"""What a provider was seen to refuse: one row a provider, whose learned capacity only falls."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.config import CHARS_PER_TOKEN, ChunkerConfig
from marginalia.functions import ids
from marginalia.operators.chunking import embedding_text

#: Texts of this many characters are tried last: no learned capacity is below it.
FLOOR_CHARS = int(ids.MIN_TOKENS * CHARS_PER_TOKEN)


def refused_tokens(attempts: DataFrame) -> DataFrame:
    """Learned tokens by provider, from attempts (provider, heading, content, reason) that were too long for it."""
    tokens = ids.approx_tokens(embedding_text(F.col("heading"), F.col("content")))
    after = ids.ratcheted_tokens(F.lit(None).cast("int"), tokens)
    return attempts.where("reason = 'too-long'").groupBy("provider").agg(F.min(after).alias("learned"))


def advertised_tokens(rows: DataFrame, at: int) -> DataFrame:
    """Rows (provider, advertised) as a table in which nothing is learned yet."""
    return rows.select(
        "provider", F.col("advertised").cast("int").alias("advertised"), F.lit(None).cast("int").alias("discovered"),
        F.lit(None).cast("bigint").alias("discovered_at"), F.lit(at).cast("bigint").alias("fetched_at"))


def upserted(stored: DataFrame, asked: DataFrame, learned: DataFrame, at: int) -> DataFrame:
    """The table after a pass: ``asked`` (of :func:`advertised_tokens`) renews what providers say, ``learned`` lowers what is known.

    Providers that took no part keep their rows. A provider that says nothing keeps what it said before. Each provider has one
    row in every input; the inputs are as small as the number of providers.
    """
    old = stored.select("provider", *[F.col(c).alias(f"_{c}") for c in ("advertised", "discovered", "discovered_at", "fetched_at")])
    rows = old.join(asked.select("provider", "advertised", "fetched_at"), "provider", "full").join(learned, "provider", "full")
    falls = F.col("learned").isNotNull() & (F.col("_discovered").isNull() | (F.col("learned") < F.col("_discovered")))
    return rows.select(
        "provider", F.coalesce("advertised", "_advertised").alias("advertised"), F.least("_discovered", "learned").alias("discovered"),
        F.when(falls, F.lit(at)).otherwise(F.col("_discovered_at")).cast("bigint").alias("discovered_at"),
        F.coalesce("fetched_at", "_fetched_at", F.lit(at)).cast("bigint").alias("fetched_at"))


def effective() -> Column:
    return ids.effective_tokens(F.col("advertised"), F.col("discovered"))


def budget() -> Column:
    """Characters that a chunk may have."""
    return F.floor(effective() * F.lit(CHARS_PER_TOKEN)).cast("int")


def within(config: ChunkerConfig, known: DataFrame, provider: str) -> ChunkerConfig:
    """The chunker's settings with chunks no longer than the provider is known to take; unchanged if nothing is known."""
    row = known.where((F.col("provider") == provider) & F.coalesce("advertised", "discovered").isNotNull()).select(budget().alias("chars")).first()
    return config if row is None else shortened(config, row["chars"])


def shortened(config: ChunkerConfig, chars: int) -> ChunkerConfig:
    return replace(config, chunk_size=min(config.chunk_size, chars))
