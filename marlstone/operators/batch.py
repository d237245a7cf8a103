"""Batches of tasks that depend on each other's results, one pass over DataFrames for each level."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import sanitize
from marlstone.sources.shared import written

MAX_DEPTH, SUCCESS, ERROR, FAILED = 20, "success", "error", "dependency_failed"


def edges(tasks: DataFrame) -> DataFrame:
    """(task_id, dependency) of tasks (task_id, dependencies, question)."""
    return tasks.select("task_id", F.explode("dependencies").alias("dependency")).distinct()


def depths(tasks: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """(task_id, depth): the longest chain of dependencies below a task; null on a circle, behind one, and beyond ``most`` + 1.

    Tasks are peeled off level by level: a level lacks nothing but what the levels
    before it gave. What is still lacking is written after each level, so that a
    level costs its own edges, however many paths lead to it.
    """
    links = written(edges(tasks), "links")
    lacks = links.groupBy("task_id").agg(F.count("*").alias("lacks"))
    nodes = tasks.select("task_id").union(links.select("dependency")).distinct().join(lacks, "task_id", "left")
    state = written(nodes.select("task_id", F.coalesce("lacks", F.lit(0)).cast("long").alias("lacks")), "state")
    found = []
    for depth in range(most + 2):
        level = state.filter("lacks = 0").select("task_id")
        if level.isEmpty():
            break
        found.append(level.withColumn("depth", F.lit(depth)))
        given = links.join(level.withColumnRenamed("task_id", "dependency"), "dependency").select("task_id", F.lit(-1).cast("long").alias("lacks"))
        state = written(state.filter("lacks > 0").unionByName(given).groupBy("task_id").agg(F.sum("lacks").alias("lacks")), "state")
    none = tasks.sparkSession.createDataFrame([], f"task_id {dict(tasks.dtypes)['task_id']}, depth int")
    return tasks.select("task_id").distinct().join(reduce(DataFrame.unionByName, found, none), "task_id", "left")


def substitute(question: Column, results: Column) -> Column:
    """``{{ id.result }}`` (and ``{id_result}``) replaced by the result of that id from a map; what is not in the map stays."""

    def put(text: Column, e: Column) -> Column:
        for form in ("{{{{ {}.result }}}}", "{{{{{}.result}}}}", "{{{}_result}}"):
            before, after = form.format("\0").split("\0")
            text = F.replace(text, F.concat(F.lit(before), e["key"], F.lit(after)), sanitize(e["value"]))
        return text

    return F.aggregate(F.map_entries(results), question, put)


def echo(question: Column) -> Column:
    """A stand-in for a model: fails on questions that say so."""
    return F.when(question.contains("fail"), F.lit(None).cast("string")).otherwise(F.concat(F.lit("answer: "), question))


def run(tasks: DataFrame, call: Callable[[Column], Column] = echo) -> DataFrame:
    """(task_id, status, result) of all tasks, run in the order of their dependencies.

    ``call`` makes a result of a question, null for a failure. A failure marks the
    direct dependents; what waits on those, or on a circle, ends unresolved.
    Chains beyond MAX_DEPTH raise ValueError.
    """
    if not depths(tasks).filter(F.col("depth") > MAX_DEPTH).isEmpty():
        raise ValueError(f"a chain of dependencies is longer than {MAX_DEPTH}")
    tasks = written(tasks.select("task_id", "dependencies", "question"), "tasks")
    links = edges(tasks)
    waiting = F.size(F.array_distinct("dependencies"))
    none = F.create_map().cast("map<string,string>")

    def answered(ready: DataFrame) -> DataFrame:
        result = call(substitute(F.col("question"), F.col("results")))
        return ready.select("task_id", F.when(result.isNull(), ERROR).otherwise(SUCCESS).alias("status"), F.coalesce(result, F.lit("the call failed")).alias("result"))

    level = written(answered(tasks.filter(waiting == 0).withColumn("results", none)), "level")
    done = level
    while not level.isEmpty():
        state = links.join(done.select(F.col("task_id").alias("dependency"), "status", "result"), "dependency")
        gathered = state.groupBy("task_id").agg(F.count_if(F.col("status") == SUCCESS).alias("good"), F.min(F.when(F.col("status") == ERROR, F.col("dependency"))).alias("bad"), F.map_from_entries(F.collect_list(F.struct("dependency", "result"))).alias("results"))
        fresh = tasks.join(done.select("task_id"), "task_id", "left_anti").join(gathered, "task_id")
        failed = fresh.filter("bad IS NOT NULL").select("task_id", F.lit(FAILED).alias("status"), F.concat(F.lit("Dependency "), "bad", F.lit(" failed.")).alias("result"))
        level = written(answered(fresh.filter(F.col("bad").isNull() & (F.col("good") == waiting))).unionByName(failed), "level")
        done = done.unionByName(level)
    rest = tasks.join(done.select("task_id"), "task_id", "left_anti").select("task_id", F.lit(ERROR).alias("status"), F.lit("Unresolved dependencies or cycle detected.").alias("result"))
    return done.unionByName(rest)


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def cached(tasks: DataFrame, cache: DataFrame, days: int = 2) -> tuple[DataFrame, DataFrame]:
    """Tasks whose question has an answer (prompt_hash, result, at) not older than ``days``, and the others."""
    keyed = tasks.withColumn("prompt_hash", F.sha2("question", 256))
    fresh = cache.filter(F.col("at") >= F.current_timestamp() - F.make_dt_interval(F.lit(days))).select("prompt_hash", "result")
    return keyed.join(fresh, "prompt_hash"), keyed.join(fresh, "prompt_hash", "left_anti")


#: Checks by name: each takes an answer and gives True or what is wrong with it.
VALIDATORS: dict[str, Callable[[str], bool | str]] = {
    "not_empty": lambda answer: True if answer and answer.strip() else "the answer is empty",
    "json": lambda answer: True if _is_json(answer) else "the answer is no JSON",
}


def _is_json(text: str | None) -> bool:
    try:
        json.loads(text or "")
    except ValueError:
        return False
    return True


def validator(name: str) -> Callable[[str], bool | str] | None:
    """A check by its name, None for an unknown one."""
    return VALIDATORS.get(name)


def messages_for(question: Column, json_answer: bool = True) -> Column:
    """What a model is sent: a system message (asking for JSON) and the question."""
    system = "You are a helpful assistant." + (" Answer in well-formed JSON." if json_answer else "")
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), question.alias("content")))


def call_with_retries(tasks: DataFrame, call: Callable[[list[dict]], str], validators: Sequence[Callable[[str], bool | str]] = (), max_retries: int = 3) -> DataFrame:
    """(task_id, status, result, retry_count) of tasks (task_id, question) answered by a function of messages.

    An answer that a validator rejects is sent back with what is wrong; an
    exception counts as a try. After ``max_retries`` tries the task has failed.
    Calls run where the rows are, in Arrow batches.
    """

    def answered(question: str | None) -> tuple[str, str, int]:
        messages = [{"role": "user", "content": question}]
        for attempt in range(max_retries):
            try:
                answer = call(messages)
            except Exception as e:  # what a model's client raises is its own affair
                messages = [*messages, {"role": "user", "content": f"The call failed: {e}"}]
                continue
            wrong = [str(x) for x in (check(answer) for check in validators) if x is not True]
            if not wrong:
                return SUCCESS, answer, attempt
            messages = [*messages, {"role": "assistant", "content": answer}, {"role": "user", "content": "The answer is not valid: " + ", ".join(wrong)}]
        return ERROR, f"Max retries ({max_retries}) exceeded.", max_retries

    def run_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [answered(q) for q in batch["question"]]
            yield pd.DataFrame({"task_id": batch["task_id"], "status": [r[0] for r in rows], "result": [r[1] for r in rows], "retry_count": [r[2] for r in rows]})

    return tasks.select("task_id", "question").mapInPandas(run_batches, f"task_id {dict(tasks.dtypes)['task_id']}, status string, result string, retry_count int")


def delays(tries: int = 3, least: float = 1.0, most: float = 10.0) -> list[float]:
    """Seconds between tries: each twice the one before, within bounds."""
    return [min(most, max(least, least * 2.0**k)) for k in range(tries - 1)]


def with_backoff(action: Callable[[], object], tries: int = 3, again: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of an action, tried several times with growing delays; the last exception, and one that is not to be tried ``again``, is raised."""
    for delay in [*delays(tries), None]:
        try:
            return action()
        except Exception as e:
            if delay is None or not again(e):
                raise
            sleep(delay)
    raise AssertionError("unreachable")


class ServiceError(Exception):
    """What a service answers with instead of a result."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def call_service(df: DataFrame, text_col: str, service: Callable[[str, int], str], tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``df`` with ``answer`` and ``service_error``: a service (text, attempt) is tried again where it is busy or broken (429, 5xx), other errors end the row alone."""

    def asked(text: str | None) -> tuple[str | None, str | None]:
        attempt = itertools.count()
        try:
            return str(with_backoff(lambda: service(text or "", next(attempt)), tries, lambda e: isinstance(e, ServiceError) and (e.status == 429 or e.status >= 500), sleep)), None
        except ServiceError as e:
            return None, str(e)

    @F.pandas_udf("struct<answer:string,service_error:string>")
    def answers(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([asked(t) for t in texts], columns=["answer", "service_error"])

    return df.withColumn("_a", answers(F.col(text_col))).select(*df.columns, "_a.answer", "_a.service_error")


def tracked(steps: Mapping[str, DataFrame]) -> DataFrame:
    """A row for each named step of a workflow, with its rows, its errors (rows whose status is one) and its state."""
    rows = [df.agg(F.lit(name).alias("step"), F.count("*").alias("rows"), F.count_if(F.col("status") == ERROR).alias("errors")) for name, df in steps.items()]
    out = reduce(lambda a, b: a.unionByName(b), rows)
    return out.withColumn("state", F.when(F.col("errors") > 0, "failed").otherwise("done"))
