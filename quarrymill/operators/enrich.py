"""Enrichment by an external service: prompts, rate limits, retries and a replaceable client.

Only distinct names are sent. With a ``store`` every answer is appended to a table there before it is used and names
that have one are not sent again, so a resumed run does not pay twice.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.assign import assign_keys
from quarrymill.functions.json_text import parse_answer


class Client(Protocol):
    """Sends a prompt, returns the answer. Made once per partition."""

    def __call__(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class Limits:
    """Budgets of a service, shared by all partitions."""

    requests_per_minute: int = 60
    tokens_per_minute: int = 100_000
    tokens_per_day: int = 1_000_000
    tokens_per_call: int = 2_000

    @property
    def calls_per_minute(self) -> int:
        return max(1, min(self.requests_per_minute, self.tokens_per_minute // self.tokens_per_call))

    def share(self, partitions: int) -> Limits:
        """The part of one partition: there is no lock across executors. Shares never add up to more than the whole."""
        n = max(1, partitions)
        return Limits(self.requests_per_minute // n, self.tokens_per_minute // n, self.tokens_per_day // n, self.tokens_per_call)

    def most_partitions(self, wanted: int) -> int:
        """As many partitions as wanted, but each must be able to make a call."""
        return max(1, min(wanted, self.calls_per_minute, self.tokens_per_day // max(1, self.tokens_per_call)))


class DailyBudgetSpent(RuntimeError):
    """The day's tokens are spent; the rows left keep their place for a later run."""


class RateLimiter:
    """Sliding window over calls and tokens; a hard stop at the daily budget."""

    def __init__(self, limits: Limits, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.limits, self.clock, self.sleep = limits, clock, sleep
        self.calls: deque[tuple[float, int]] = deque()
        self.today, self.began = 0, clock()

    def wait(self, tokens: int) -> None:
        if self.clock() - self.began >= 86_400:
            self.today, self.began = 0, self.clock()
        if self.today + tokens > self.limits.tokens_per_day:
            raise DailyBudgetSpent
        while True:
            now = self.clock()
            while self.calls and now - self.calls[0][0] >= 60:
                self.calls.popleft()
            used = sum(t for _, t in self.calls)
            if len(self.calls) < self.limits.requests_per_minute and used + tokens <= max(self.limits.tokens_per_minute, tokens):
                break
            self.sleep(max(0.01, 60 - (now - self.calls[0][0])))
        self.calls.append((self.clock(), tokens))
        self.today += tokens


def build_prompt(name: Column, attributes: Sequence[str], ident: Column | None = None) -> Column:
    wanted = "、".join(attributes)
    known = F.when(F.coalesce(ident, F.lit("")) != "", F.concat(F.lit("（编号 "), ident, F.lit("）"))).otherwise("") if ident is not None else F.lit("")
    return F.concat(F.lit("请以JSON给出“"), name, F.lit("”"), known, F.lit(f"的以下属性：{wanted}"))


def enrich(
    df: DataFrame, name: str, attributes: Sequence[str], make_client: Callable[[], Client], limits: Limits = Limits(), partitions: int = 3, attempts: int = 3,
    store: str | None = None,
) -> DataFrame:
    """``name``, the attributes and ``status`` of every distinct name that is not blank.

    Keys of an answer that differ from the attributes' names are assigned to the likest. ``partitions`` is lowered to what the
    limits allow. ``store``: a folder that all executors share; failures are sent again by the next run.
    """
    partitions = limits.most_partitions(partitions)
    own = limits.share(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, limiter = make_client(), RateLimiter(own)
        for batch in batches:
            rows = []
            for key, prompt in zip(batch[name], batch["__prompt"], strict=True):
                found, status = None, "失败"
                for attempt in range(attempts):
                    try:
                        limiter.wait(own.tokens_per_call)
                        found = parse_answer(client(prompt), attributes, loose_first=False)
                        found = assign_keys(found, attributes) if found else None
                        status = "成功" if found else "失败: 无法解析"
                        if found:
                            break
                    except DailyBudgetSpent:
                        status = "待处理: 当日额度用尽"
                        break
                    except Exception as error:  # noqa: BLE001 - any failure of a service is retried, then reported
                        status = f"失败: {error}"[:200]
                        limiter.sleep(min(5.0, 0.1 * (attempt + 1)))
                rows.append([key, *[(found or {}).get(a) for a in attributes], status])
            yield pd.DataFrame(rows, columns=[name, *attributes, "status"])

    names = df.select(name).where(F.trim(name) != "").distinct().withColumn("__prompt", build_prompt(F.col(name), attributes))
    schema = ", ".join(f"`{c}` string" for c in (name, *attributes, "status"))
    if store is None:
        return names.repartition(partitions, name).mapInPandas(run, schema)
    spark, part = df.sparkSession, f"{store}/answers.parquet"
    spark.createDataFrame([], schema).write.mode("append").parquet(part)
    done = spark.read.schema(schema).parquet(part).where("status = '成功'").select(name)
    pending = names.join(done, name, "left_anti")
    pending.repartition(partitions, name).mapInPandas(run, schema).write.mode("append").parquet(part)
    answers = spark.read.schema(schema).parquet(part).join(names.select(name), name, "left_semi")
    best = F.struct((F.col("status") == "成功").alias("good"), *[F.col(f"`{c}`") for c in (*attributes, "status")])
    return answers.groupBy(name).agg(F.max(best).alias("a")).select(name, *[F.col(f"a.`{c}`") for c in (*attributes, "status")])


def stub_client() -> Client:
    """A deterministic client for tests and dry runs."""

    def answer(prompt: str) -> str:
        name, wanted = prompt.split("“")[1].split("”")[0], prompt.rsplit("：", 1)[1].split("、")
        return "```json\n{" + ", ".join(f'"{a}": "{a} of {name}"' for a in wanted) + "}\n```"

    return answer
