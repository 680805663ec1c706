"""The summary of each dialog, window by window and pass by pass: summary k is the client's answer to summary k-1 and
window k. Parallel over dialogs; a dialog's windows are one after the other by nature.

Every answer is a row. Written to a state table, the rows let a later job go on where this one stopped: a window whose row is
there is not asked again. Rows are keyed by the dialog and a hash of its texts, so another dialog of that name starts anew.
Turn speculation off for this stage: a second attempt asks the client twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import PlanConfig
from ..operators.fold import ordered_fold
from ..operators.planning import chunk_plan, chunk_texts, second_pass, token_sizes
from .clients import ChatClient, DryRun
from .messages import Prompts, conversation, fragment, recheck
from .policy import ChatError, RateLimited

RECHECK = -1


def prompts_of(segments: DataFrame, keys: Sequence[str], config: PlanConfig = PlanConfig(), prompts: Prompts = Prompts()) -> DataFrame:
    """``keys, content_hash, pass, chunk, chunks, blocks``: all windows of all passes. Passes beyond the second repeat it."""
    keys = list(keys)
    sized = segments.join(token_sizes(segments, keys, config).select(*keys, "chunks"), keys)
    first = chunk_plan(sized, keys, "chunks", config.overlap)
    plans = [first] + [second_pass(segments, keys, first, config.overlap)] * (config.passes - 1)
    rows = []
    for k, plan in enumerate(plans):
        texts = chunk_texts(segments, plan, keys)
        rows.append(texts.select(*keys, F.lit(k).alias("pass"), F.col("chunk").cast("int").alias("chunk"), F.count("*").over(Window.partitionBy(*keys)).alias("chunks"), "body"))
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    # of each segment its hash is gathered, not its text
    own = F.md5(F.concat_ws("\x1f", F.col("index").cast("string"), "speaker", "text").cast("binary"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "own"))), lambda x: x["own"]), "\x1e")
    hashed = segments.select(*keys, "index", own.alias("own")).groupBy(*keys).agg(F.md5(whole.cast("binary")).alias("content_hash"))
    return every.join(hashed, keys).select(*keys, "content_hash", "pass", "chunk", "chunks", fragment(prompts, config.passes, F.col("pass"), F.col("chunk"), F.col("chunks"), F.col("body")).alias("blocks"))


def summarise(windows: DataFrame, keys: Sequence[str], make: Callable[[], ChatClient] = DryRun, prompts: Prompts = Prompts(), state: DataFrame | None = None, check: bool = True) -> DataFrame:
    """A row for each window answered: ``keys, content_hash, pass, chunk, summary, status, attempts, error``; the last of a
    finished dialog has pass ``RECHECK`` and its final summary.

    Status: done, limited or failed; after the latter two a dialog stops, its last summary kept in the row. A blank answer
    leaves the summary as it was. ``state`` are rows of earlier jobs; what is done there is not asked again. With
    ``check`` the finished summary is sent once more; a blank or failed answer to that keeps it, a rate limit stops.
    """
    keys = list(keys)
    rows = windows
    if state is not None:
        done = state.filter("status = 'done'").select(*keys, "content_hash", "pass", "chunk", F.col("summary").alias("__done"))
        final = done.filter(F.col("pass") == RECHECK).select(*keys, "content_hash")
        rows = windows.join(final, [*keys, "content_hash"], "left_anti").join(done, [*keys, "content_hash", "pass", "chunk"], "left")
    else:
        rows = windows.withColumn("__done", F.lit(None).cast("string"))

    def start(key):
        return {"key": dict(zip([*keys, "content_hash"], key, strict=True)), "client": make(), "summary": "", "stopped": False, "pass": 0}

    def row(s, pass_no, chunk, status, attempts=0, error=None):
        return s["key"] | {"pass": pass_no, "chunk": chunk, "summary": s["summary"], "status": status, "attempts": attempts, "error": error}

    def ask(s, messages, pass_no, chunk):
        try:
            answer = (s["client"].chat(messages) or "").strip()
        except RateLimited as e:
            s["stopped"] = True
            return row(s, pass_no, chunk, "limited", e.attempts, str(e))
        except ChatError as e:
            if pass_no != RECHECK:
                s["stopped"] = True
                return row(s, pass_no, chunk, "failed", 0, str(e))
            answer = ""
        s["summary"] = answer or s["summary"]
        return row(s, pass_no, chunk, "done", 1)

    def step(s, r):
        if s["stopped"]:
            return
        s["pass"] = r["pass"]
        if r["__done"] is not None:
            s["summary"] = r["__done"]
            return
        yield ask(s, conversation(prompts, r["pass"], r["blocks"], s["summary"]), r["pass"], r["chunk"])

    def finish(s):
        if not s["stopped"]:
            if check and s["summary"]:
                yield ask(s, recheck(prompts, s["summary"]), RECHECK, 0)
            else:
                yield row(s, RECHECK, 0, "done")

    schema = T.StructType([f for f in windows.schema.fields if f.name in (*keys, "content_hash")] + [T.StructField("pass", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("summary", T.StringType()), T.StructField("status", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())])
    return ordered_fold(rows, [*keys, "content_hash"], ["pass", "chunk"], schema, start, step, finish)


def final_summaries(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, summary, status``: the final summary of finished dialogs, the last kept one of the others."""
    place = F.struct((F.col("pass") == RECHECK).alias("final"), "pass", "chunk")
    return rows.groupBy(*keys).agg(F.max_by("summary", place).alias("summary"), F.max_by("status", place).alias("status"))


def write_state(rows: DataFrame, path: str) -> DataFrame:
    """Adds a job's rows to the state table at ``path`` and reads the whole table back: what ``summarise`` takes as ``state``."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def open_state(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``state`` that a later job still needs: those of dialogs that are not finished. Written over the table, it is
    cleared of the others."""
    done = state.filter((F.col("pass") == RECHECK) & (F.col("status") == "done")).select(*keys, "content_hash").distinct()
    return state.join(done, [*keys, "content_hash"], "left_anti")


def partial_summaries(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of dialogs that stopped: the last summary, why, and the window to go on with."""
    stopped = rows.filter("status <> 'done'")
    return stopped.select(*keys, "summary", "status", "error", F.col("pass").alias("failed_pass"), F.col("chunk").alias("failed_chunk"))
