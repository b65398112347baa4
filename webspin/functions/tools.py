"""User tools as table functions: a Python function over the columns of a row,
registered under a name, is called from SQL with a lateral join (or as
``spark.tvf``). Rows go to Python in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from webspin.functions import dom


def register_tool(spark: SparkSession, name: str, function: Callable[..., Iterable[tuple]], returns: str, deterministic: bool = True) -> None:
    """Register ``function``, which yields tuples of ``returns`` (a schema) for the values of
    one call. A call that fails gives no rows and does not fail the job when the schema's
    last column is ``error string``: it then holds the message."""
    told = returns.rstrip().lower().endswith("error string")
    width = len(returns.split(","))

    class Tool:
        def eval(self, *values):
            try:
                yield from function(*values)
            except Exception as problem:  # noqa: BLE001 - the row says so, if the schema has room
                if not told:
                    raise
                yield (None,) * (width - 1) + (f"{type(problem).__name__}: {problem}",)

    made = udtf(Tool, returnType=returns, useArrow=True)
    spark.udtf.register(name, made.asDeterministic() if deterministic else made)


def page_elements(html: str | None, selectors: list[str] | None) -> Iterable[tuple]:
    """(selector, n, tag, text) of the elements of a page that selectors meet."""
    page = dom.FlatPage(html or "")
    gone = bytearray(len(page.tags))
    nodes, _, elements, number = page.rows(gone, True)
    wanted = tuple(selectors or ())
    for selector, hits in zip(wanted, dom.selectors(wanted).match(page, gone)):
        for i in hits:
            x = elements[number[i]]
            yield selector, x["n"], x["tag"], "".join(nodes[x["s"]:x["e"]])


def register_page_elements(spark: SparkSession, name: str = "page_elements") -> None:
    register_tool(spark, name, page_elements, "selector string, n int, tag string, text string")
