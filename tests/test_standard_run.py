"""The standard run over questions that are long expressions of their documents."""

import __spark_entry__ as entry
from tessera import catalog

SF = "/root/testdata/sf0.001"


def test_every_question_is_answered(spark):
    asked = {r.qid: r.question for r in catalog.page_questions(spark, SF).collect()}
    rows = entry.queries()["pl_standard"](spark, SF).collect()
    assert asked and {r.qid: r.question for r in rows} == asked and len(rows) == len(asked)
    assert all(r.status == "direct" or r.status == "answered" and r.answer for r in rows)
