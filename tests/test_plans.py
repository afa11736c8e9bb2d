"""Every registered query of the engine runs on the smallest tables within a
time limit, and no plan computes tokens again for a filter or an item."""

import threading

import pytest

from quillmark.plans import registry

SF = "/root/testdata/sf0.001"
#: Seconds for a query on 200 documents, whatever it starts.
LIMIT_S = 120
#: Fits of many models, which ``test_tuning``, ``test_attribution`` and the
#: tests of metrics hold in parts.
LONG = ("mod", "xai", "inf", "src22", "eva08", "eva10", "eva11", "eva17")
NAMES = [n for n in registry.queries() if not n.startswith(LONG)]


@pytest.mark.parametrize("name", NAMES)
def test_query_ends(spark, name):
    overdue = threading.Timer(LIMIT_S, spark.sparkContext.cancelAllJobs)
    overdue.start()
    try:
        registry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        overdue.cancel()


def lambdas(plan):
    """The text inside each lambda function of a plan."""
    for at in range(len(plan)):
        if plan.startswith("lambdafunction(", at):
            depth, end = 1, at + len("lambdafunction(")
            while depth and end < len(plan):
                depth += {"(": 1, ")": -1}.get(plan[end], 0)
                end += 1
            yield plan[at:end]


@pytest.mark.parametrize("name", [n for n in NAMES if n.startswith(("fea0", "fea1", "fea21", "txt0"))])
def test_texts_are_parsed_once(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    parse = "regexp_extract_all(text"
    filters = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Filter")]
    assert not [line[:200] for line in filters if parse in line]
    assert not [part[:200] for part in lambdas(plan) if parse in part]
