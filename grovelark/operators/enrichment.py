"""Text functions applied to tables of files, directories and projects."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions import pystr as S
from ..sources.change_log import Folder
from ..sources.durable import cut
from .ranking import assemble, ordinal, parts_of

#: takes a pandas batch, returns one text per row (``None`` counts as blank)
BatchFunction = Callable[[pd.DataFrame], "pd.Series"]

_OUTCOME = [
    T.StructField("success", T.BooleanType()),
    T.StructField("summary", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("elapsed_time", T.DoubleType()),
]


def _outcomes(fn: BatchFunction, batch: pd.DataFrame) -> pd.DataFrame:
    """Run a batch; when it raises, run its rows alone so that one bad row fails alone."""
    start = time.monotonic()
    texts: list[str | None] = []
    errors: list[str | None] = [None] * len(batch)
    try:
        texts = list(fn(batch))
    except Exception:  # noqa: BLE001 - any failure of the user's function is an outcome
        for i in range(len(batch)):
            try:
                texts.append(next(iter(fn(batch.iloc[i : i + 1].reset_index(drop=True)))))
            except Exception as e:  # noqa: BLE001
                texts.append(None)
                errors[i] = str(e) or type(e).__name__
    seconds = (time.monotonic() - start) / max(len(batch), 1)
    blank = [t is None or not str(t).strip() for t in texts]
    return pd.DataFrame(
        {
            "success": [not b for b in blank],
            "summary": [None if b else t for t, b in zip(texts, blank)],
            "error": [(e or "blank output") if b else None for e, b in zip(errors, blank)],
            "elapsed_time": seconds,
        }
    )


def apply_text_function(rows: DataFrame, fn: BatchFunction, keep: list[str]) -> DataFrame:
    """``keep`` columns plus ``success, summary, error, elapsed_time``.

    Texts stay where they are: one task per partition of ``rows``. A service
    that bears few calls at a time is spared by the cluster's own limits (task
    resources of the stage) or inside ``fn``. ``fn`` may run again for a row
    when a task is retried, so it has to be idempotent.
    """
    schema = T.StructType([rows.schema[c] for c in keep] + _OUTCOME)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = _outcomes(fn, batch)
            yield pd.concat([batch[keep].reset_index(drop=True), done], axis=1)

    return rows.mapInPandas(run, schema)


def retry_delay(attempt: Column | str, jitter: Column | None = None) -> Column:
    """``min(base·factor^attempt, cap)``, then up to a quarter more."""
    plain = F.least(F.lit(V.RETRY_BASE) * F.pow(F.lit(V.RETRY_FACTOR), S.col(attempt)), F.lit(V.RETRY_CAP))
    return plain if jitter is None else plain * (1 + F.lit(V.RETRY_JITTER) * jitter)


def run_with_retries(
    rows: DataFrame, fn: BatchFunction, key: list[str],
    max_retries: int = V.MAX_RETRIES, seed: int = 0,
) -> DataFrame:
    """Outcome per row after at most ``max_retries + 1`` rounds.

    Each round is one job over the rows that failed so far; its outcomes are
    written before the next one starts. Rows of later rounds carry ``attempt``
    and ``delay`` (seconds), which ``fn`` can honour.
    """
    todo = rows.withColumns({"attempt": F.lit(0), "delay": F.lit(0.0)})
    done: DataFrame | None = None
    for attempt in range(max_retries + 1):
        out = cut(apply_text_function(todo, fn, [*key, "attempt"]))
        final = out if attempt == max_retries else out.where("success")
        done = final if done is None else done.unionByName(final)
        failed = out.where(~F.col("success"))
        if attempt == max_retries or failed.isEmpty():
            break
        todo = rows.join(failed.select(*key), key, "left_semi").withColumns(
            {"attempt": F.lit(attempt + 1), "delay": retry_delay(F.lit(attempt), F.rand(seed + attempt))}
        )
    return done


LEDGER = "call_id string, attempt int, success boolean, summary string, error string, elapsed_time double"


def ledger(spark: SparkSession, base: str) -> DataFrame:
    """Every call that was finished: one row per input, version and attempt; none where there is no ledger yet."""
    known = Folder(spark, base).names("calls")
    return spark.read.schema(LEDGER).parquet(f"{base}/calls") if known else spark.createDataFrame([], LEDGER)


def _record(calls: DataFrame, base: str) -> None:
    calls.select([f.split()[0] for f in LEDGER.split(", ")]).write.mode("append").parquet(f"{base}/calls")


def run_with_ledger(
    rows: DataFrame, fn: BatchFunction, key: list[str], base: str, version: str,
    max_retries: int = V.MAX_RETRIES, seed: int = 0, pieces: int = 8,
) -> DataFrame:
    """As :func:`run_with_retries`, but no call is made twice: not by a run that broke off and is started again, nor for rows
    that say the same.

    A call is named by a hash of ``version`` (of ``fn``) and of everything but ``key`` that a row holds; ``fn`` must not look at
    the key, so add to the row what it needs. The ledger below ``base`` is joined before each round, so that only open
    calls are made; a round is ``pieces`` jobs by hash, each recorded when it is done: a broken one costs that piece.
    """
    spark = rows.sparkSession
    inputs = [c for c in rows.columns if c not in key]
    named = rows.withColumn("call_id", F.sha2(F.to_json(F.struct(F.lit(version).alias("_version"), *inputs), {"ignoreNullFields": "false"}).cast("binary"), 256))
    ids = cut(named.select(*key, "call_id"))
    one = cut(ids.groupBy("call_id").agg(F.min(F.struct(*key)).alias("_one")))  # the row that is asked for each call

    for attempt in range(max_retries + 1):
        for piece in range(pieces):
            known = ledger(spark, base).groupBy("call_id").agg(F.bool_or("success").alias("_ok"), F.max("attempt").alias("_last"))
            mine = one.where(F.pmod(F.xxhash64("call_id"), F.lit(pieces)) == piece).join(known, "call_id", "left")
            todo = cut(mine.where(f"NOT coalesce(_ok, false) AND coalesce(_last, -1) < {attempt}").select("call_id", "_one.*"))
            if todo.isEmpty():
                continue
            wait = F.lit(0.0) if attempt == 0 else retry_delay(F.lit(attempt - 1), F.rand(seed + attempt - 1))
            asked = named.join(todo, ["call_id", *key], "left_semi").withColumns({"attempt": F.lit(attempt), "delay": wait})
            _record(apply_text_function(asked, fn, ["call_id", "attempt"]).dropDuplicates(["call_id"]), base)
    best = F.max_by(F.struct("attempt", "success", "summary", "error", "elapsed_time"), F.struct("success", "attempt"))
    done = ledger(spark, base).groupBy("call_id").agg(best.alias("r"), F.count(F.lit(1)).alias("calls"))
    return ids.join(done, "call_id").select(*key, "r.*", "calls")


def validated(results: DataFrame, text: str = "summary") -> DataFrame:
    """Blank output becomes a failed outcome."""
    blank = S.is_blank(text)
    return results.withColumns(
        {
            "success": ~blank,
            text: F.when(~blank, F.col(text)),
            "error": F.when(blank, F.lit("blank output")),
        }
    )


def split_outcomes(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    return results.where("success"), results.where(~F.col("success"))


# ------------------------------------------------------- deterministic stand-in


def standin_file(path: Column | str = "relative_path", content: Column | str = "content") -> Column:
    return F.format_string(V.STANDIN_FILE, S.col(path), S.line_count(content))


def standin_directories(parts: DataFrame) -> DataFrame:
    """Counts rule marks over all parts of a directory's joined child documents.

    The parts are counted where they are; the marks between parts are added.
    """
    marks = F.sum(S.count_literal("text", "---")) + F.count(F.lit(1)) - 1
    return parts.groupBy("repo", "relative_path", "name").agg(marks.alias("n")).select(
        "repo", "relative_path", F.format_string(V.STANDIN_DIR, "name", "n").alias("summary")
    )


def standin_project(project: Column | str, path: Column | str) -> Column:
    return F.format_string(V.STANDIN_PROJECT, S.col(project), S.col(path))


def staged(fn: BatchFunction, rows_per_part: int = 256) -> Callable[[DataFrame], DataFrame]:
    """A directory function from a batch function, by one rule for all sizes.

    Every directory is summarised part by part, then its part summaries are
    joined and summarised, again by parts, until one text is left. So every
    child counts, no row grows without bound, and even a single part passes
    through both steps.
    """
    key = ["repo", "relative_path", "name"]

    def run(parts: DataFrame) -> DataFrame:
        done: DataFrame | None = None
        step = 0
        while True:
            step += 1
            sizes = parts.groupBy(*key).agg(F.count(F.lit(1)).alias("n_parts"))
            out = cut(apply_text_function(parts.join(sizes, key), fn, [*key, "part", "n_parts"]))
            whole = (F.col("n_parts") == 1) & F.lit(step > 1)
            lost = out.where(~F.col("success") & ~whole).select(*key).distinct()
            final = out.where(whole).select("repo", "relative_path", "summary").unionByName(
                lost.select("repo", "relative_path", F.lit(None).cast("string").alias("summary"))
            )
            done = final if done is None else done.unionByName(final)
            more = out.where(~whole).join(lost, key, "left_anti")
            if more.isEmpty():
                return done
            numbered = more.select(*key, F.col("part").alias("p"), F.col("summary").alias("t"))
            parts = parts_of(numbered.withColumn("p", F.col("p") + 1), key, "t", V.DOC_SEPARATOR, rows_per_part, "p")

    return run


# ------------------------------------------------------- chunks and messages


def decode_event_lines(lines: DataFrame) -> DataFrame:
    """Chunks from event lines ``(request_id, seq, line)``.

    Lines after the first ``[DONE]`` of a request are ignored, as are lines
    without the data prefix, broken JSON and other event types.
    """
    data = lines.where(F.startswith("line", F.lit("data: "))).withColumn("body", F.substring("line", 7, 1 << 30))
    stop = data.where("body = '[DONE]'").groupBy("request_id").agg(F.min("seq").alias("_stop"))
    live = data.join(stop, "request_id", "left").where("_stop is null or seq < _stop")
    event = F.try_parse_json("body")

    def at(path: str) -> Column:
        return F.try_variant_get("_e", path, "string")

    kind = at("$.type")
    text = F.nullif(at("$.delta.text"), F.lit(""))
    reason = F.nullif(at("$.delta.stop_reason"), F.lit(""))
    content = F.when((kind == "content_block_delta") & (at("$.delta.type") == "text_delta"), text)
    finish = F.when(kind == "message_delta", reason).when(kind == "message_stop", F.lit("stop"))
    return (
        live.withColumn("_e", event)
        .select("request_id", "seq", content.alias("content"), finish.alias("finish_reason"))
        .where("content is not null or finish_reason is not null")
    )


_MODES = {"content_only": (True, False), "with_reasoning": (True, True), "reasoning_only": (False, True)}


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """Chunk count and last non-empty finish reason per request."""
    reason = F.nullif("finish_reason", F.lit(""))
    return chunks.groupBy("request_id").agg(
        F.max_by(reason, F.when(reason.isNotNull(), F.col("seq"))).alias("finish_reason"),
        F.count(F.lit(1)).alias("chunk_count"),
    )


def collected_text(chunks: DataFrame, mode: str = "content_only", rows_per_part: int = 256) -> DataFrame:
    """Joined content and reasoning per request as ordered parts."""
    content, reasoning = _MODES[mode]
    kinds = [F.struct(F.lit(n).alias("kind"), F.col(c).alias("text")) for n, c, on in (
        ("content", "content", content), ("reasoning", "reasoning_content", reasoning)) if on]
    rows = chunks.select("request_id", "seq", F.inline(F.array(*kinds))).where("text is not null and text <> ''")
    return assemble(rows, ["request_id", "kind"], ["seq"], "text", "", rows_per_part, unique=False)


def system_messages(messages: DataFrame) -> DataFrame:
    """The last system message of each conversation."""
    return messages.where("role = 'system'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("system"))


def ordered_messages(messages: DataFrame) -> DataFrame:
    rest = messages.where("role <> 'system'").select("conv_id", "turn", "role", F.col("text").alias("content"))
    return ordinal(rest, ["conv_id"], ["turn"], "pos").select("conv_id", "pos", "role", "content")
