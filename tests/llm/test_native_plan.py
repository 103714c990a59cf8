"""The native operator's plan."""

import re

from coterie.llm import mixing


def test_mixing_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, "d e", None)], "doc_id long, text string, source string")
    for df in (mixing.mix(docs), mixing.mixed_texts(docs)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", text)
