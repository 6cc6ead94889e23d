"""The engine: a session over named tables that answers specifications, SQL text and stored templates."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import sql_import
from .plans.catalog import Catalog
from .plans.compile import Compiler, check_grain
from .plans.spec import Diagnostics, Query, Refusal
from .plans.templates import Store
from .sources import results


@dataclass(frozen=True)
class Limits:
    """Caps of an answer; they bound what reaches the driver, never what a query computes over."""

    rows: int = 100_000
    bytes: int = 268_435_456
    seconds: float = 30.0
    plan_bytes: int | None = None  # estimated bytes read, by the optimizer's statistics


@dataclass
class Answer:
    frame: DataFrame
    query: Query | None
    diagnostics: Diagnostics


@dataclass
class Engine:
    spark: SparkSession
    frames: dict[str, DataFrame]
    catalog: Catalog
    limits: Limits = Limits()
    now: date = date(2000, 1, 1)
    templates: Store = field(default_factory=Store)

    def ask(self, q: Query, params: dict | None = None, question: str = "") -> Answer:
        """A lazy answer; with a question, the specification is kept as a template."""
        compiler = Compiler(self.frames, self.catalog, self.now, params or {})
        df = compiler.compile(q)
        self.check_plan(df, compiler.diagnostics)
        if question:
            self.templates.insert(question, q)
        return Answer(df, q, compiler.diagnostics)

    def ask_sql(self, text: str) -> Answer:
        """SELECT text, by way of the specification: the same semantics and refusals hold."""
        return self.ask(sql_import.parse(text, self.catalog))

    def warm_up(self, statements: list[str]) -> dict[str, str]:
        """Keeps the statements (of a file or a query log) as pending templates; what each one became, or why it was refused."""
        out = {}
        for text in statements:
            try:
                q = sql_import.parse(text, self.catalog)
                Compiler(self.frames, self.catalog, self.now, {}).compile(q)
                out[text] = self.templates.insert(text, q).handle
            except ValueError as error:  # a refusal
                out[text] = f"refused: {error}"
        return out

    def ask_template(self, handle: str, **values) -> Answer:
        return self.ask(self.templates.replay(handle, **values))

    def check_plan(self, df: DataFrame, diagnostics: Diagnostics) -> None:
        """Refuses plans whose estimate is over the cap; warns of products of unrelated rows."""
        plan = df._jdf.queryExecution()
        if self.limits.plan_bytes is not None:
            size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
            if size > self.limits.plan_bytes:
                raise Refusal(f"the plan is estimated at {size} bytes")
        text = plan.executedPlan().toString()
        diagnostics.warnings += [f"the plan holds a {n}" for n in ("CartesianProduct", "BroadcastNestedLoopJoin") if n in text]

    def rows(self, answer: Answer, strict: bool = False) -> list:
        """The rows under the caps; a query over its time is interrupted."""
        if strict and answer.query is not None:
            check_grain(answer.query, answer.frame)
        tag = f"tessera-{uuid.uuid4().hex}"
        self.spark.addTag(tag)
        timer = threading.Timer(self.limits.seconds, self.spark.interruptTag, [tag])
        timer.start()
        try:
            return results.capped(answer.frame, self.limits.rows, self.limits.bytes)
        finally:
            timer.cancel()
            self.spark.removeTag(tag)

    def describe(self) -> DataFrame:
        """The catalog as a table: what columns there are, of which type and role."""
        rows = [(t.name, c.name, c.type, c.value_type, c.role, c.nullable, c.name in t.primary_key) for t in self.catalog.tables.values() for c in t.columns.values() if c.sensitivity != "hidden"]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, type string, value_type string, role string, nullable boolean, is_key boolean").orderBy(F.col("table_name"), F.col("column_name"))
