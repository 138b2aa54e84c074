"""Streams of turns (conversation_id, turn_id, role, content, timestamp in milliseconds).

The gateway commits each micro-batch in order: rows first, then the marks of
its conversations, in one version of each table, keyed so that a batch that
is delivered again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import facts as O

TURN = "conversation_id string, turn_id string, role string, content string, timestamp long"
MARK = "conversation_id string, last_turn_id string, last_timestamp long"


@dataclass(frozen=True)
class Gate:
    """When a turn is worth keeping; fixed defaults."""

    least_tokens: int = 24
    most_tokens: int = 5000
    duplicate: float = 0.95


def source(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Turns of JSON files that arrive in a folder; the number of files in a batch is the back-pressure."""
    return spark.readStream.schema(TURN).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def chunk_rows(turns: DataFrame) -> DataFrame:
    """The chunk of each turn: its id follows from conversation and turn, so a second delivery makes the same row."""
    key = F.concat("conversation_id", F.lit("\u0001"), "turn_id")
    return turns.select(F.concat(F.lit("turn-"), F.md5(key)).alias("chunk_id"), F.concat(F.lit("conv-"), "conversation_id").alias("full_doc_id"), F.concat("role", F.lit(": "), "content").alias("content"), session_meta().alias("meta"), "conversation_id", "turn_id", "timestamp")


def session_meta() -> Column:
    """What a vector row carries of its session."""
    return F.to_json(F.struct("conversation_id", "turn_id", "role", (F.col("timestamp") / 1000).cast("long").alias("timestamp")))


def fresh(turns: DataFrame, marks: DataFrame, known: DataFrame) -> DataFrame:
    """Turns that no mark covers and whose chunk (chunk_id) isn't there yet, once each."""
    return chunk_rows(O.pending(turns, marks)).dropDuplicates(["chunk_id"]).join(known.select("chunk_id"), "chunk_id", "left_anti")


def verdict(tokens: Column, nearest: Column, gate: Gate = Gate()) -> Column:  # noqa: B008
    """Why a chunk is not kept, or that it is; nearest: the similarity to what was kept before."""
    return F.when(tokens < gate.least_tokens, "TooShort").when(tokens > gate.most_tokens, "OverBudget").when(nearest >= gate.duplicate, "Duplicate").otherwise("Keep")


def screened(chunks: DataFrame, gate: Gate = Gate()) -> DataFrame:  # noqa: B008
    """chunks (conversation_id, timestamp, chunk_id, content) with verdict: a chunk is a duplicate if its 5-word shingles are those of one kept before it in its conversation.

    The order matters, so each conversation is read in turn by one task.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import re

        kept: list[set] = []
        out = []
        for content in rows.sort_values(["timestamp", "chunk_id"])["content"]:
            words = [w for w in re.split(r"[\W_]+", (content or "").lower()) if w]
            own = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
            if len(words) < gate.least_tokens:
                out.append("TooShort")
            elif len(words) > gate.most_tokens:
                out.append("OverBudget")
            elif any(len(own & k) >= gate.duplicate * len(own | k) for k in kept):
                out.append("Duplicate")
            else:
                kept.append(own)
                out.append("Keep")
        return rows.sort_values(["timestamp", "chunk_id"]).assign(verdict=out)[["chunk_id", "verdict"]]

    return chunks.groupBy("conversation_id").applyInPandas(run, "chunk_id string, verdict string")


class Gateway:
    """Commits batches of turns to a workspace of three Parquet tables: chunks, marks and refused texts.

    Tables are versions named by the batch: batch n writes version n from
    version n - 1, so a batch that runs again writes the same rows again.
    """

    def __init__(self, spark: SparkSession, folder: str, gate: Gate | None = None) -> None:
        self.spark, self.folder, self.gate = spark, folder.rstrip("/"), gate or Gate(least_tokens=1)

    def _read(self, name: str, schema: str, before: int) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)
        return rows.where(F.col("batch") < before).drop("batch")

    CHUNK = "chunk_id string, full_doc_id string, content string, meta string, conversation_id string, turn_id string, timestamp long, verdict string"

    def chunks(self, before: int = 1 << 62) -> DataFrame:
        return self._read("chunks", self.CHUNK, before)

    def marks(self, before: int = 1 << 62) -> DataFrame:
        """The furthest mark of each conversation; marks never move back."""
        rows = self._read("marks", MARK, before)
        return rows.groupBy("conversation_id").agg(F.max_by("last_turn_id", "last_timestamp").alias("last_turn_id"), F.max("last_timestamp").alias("last_timestamp"))

    def tombstones(self) -> DataFrame:
        return self._read("tombstones", "tombstone string", 1 << 62)

    def refuse(self, texts: DataFrame, batch: int) -> None:
        """Remember texts (content) that are never to be committed again."""
        texts.select(self._key().alias("tombstone"), F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(f"{self.folder}/tombstones")

    @staticmethod
    def _key() -> Column:
        return F.md5(F.lower(T.folded_space(F.col("content"))))

    def commit(self, turns: DataFrame, batch: int) -> None:
        """Screen the batch's new turns, write them, then the marks of all its conversations."""
        allowed = turns.withColumn("__t", self._key()).join(self.tombstones(), F.col("__t") == F.col("tombstone"), "left_anti").drop("__t")
        new = fresh(allowed, self.marks(batch), self.chunks(batch))
        told = new.join(screened(new, self.gate), "chunk_id")
        for name, rows in (("chunks", told), ("marks", O.advance(self.spark.createDataFrame([], MARK), turns))):
            rows.select(*[c.split()[0] for c in (self.CHUNK if name == "chunks" else MARK).split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def start(self, turns: DataFrame, checkpoint: str) -> StreamingQuery:
        """Commit a stream, all that is there now; the checkpoint makes each batch keep its number."""
        return turns.writeStream.foreachBatch(self.commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(turns: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream with each turn once, as long as copies come within the delay."""
    timed = turns.withColumn("at", F.timestamp_millis("timestamp")).withWatermark("at", delay)
    return timed.dropDuplicatesWithinWatermark(["conversation_id", "turn_id"])


def windows(events: DataFrame, time: str, size: str, slide: str | None = None, delay: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts by event-time window; an extension of what the store itself does. Rows later than the delay are dropped in a stream."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, delay).groupBy(window, *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, key: str, delay: str = "10 minutes") -> DataFrame:
    """Counts by runs of events of a key with no gap that long."""
    out = events.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select("session_window.start", "session_window.end", key, "n")


STATE = "sessions array<string>, promoted boolean"


def promotions(refs: DataFrame, least: int = 2) -> DataFrame:
    """(id, sessions) of facts, once each, when references (id, session_id) of enough different sessions have come; state is kept by fact."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, done = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
        for rows in batches:
            known += [s for s in dict.fromkeys(rows["session_id"]) if s not in known]
        now = len(known) >= least
        state.update((known[: max(least, 16)], done or now))
        if now and not done:
            yield pd.DataFrame({"id": [key[0]], "sessions": [len(known)]})

    return refs.groupBy("id").applyInPandasWithState(step, "id string, sessions long", STATE, "append", "NoTimeout")


def replayed(gateway: Gateway, batches: list[DataFrame], commit: Callable | None = None) -> Gateway:
    """Commit the batches in turn, as a stream would."""
    for i, rows in enumerate(batches):
        (commit or gateway.commit)(rows, i)
    return gateway


def positions(turns: DataFrame) -> DataFrame:
    """turns with their place in the conversation, from 1."""
    return turns.withColumn("position", F.row_number().over(Window.partitionBy("conversation_id").orderBy("timestamp", "turn_id")))
