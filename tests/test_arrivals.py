"""Which run did a file, in how many batches soever."""

import functools

from sparkroom import catalog
from sparkroom.plans import convert
from sparkroom.streaming import jobs


def copied(files, folder, names):
    return convert.write_files(files, folder, names).select("path", "status", "error")


def test_a_run_of_many_batches(spark, monkeypatch):
    monkeypatch.setattr(jobs, "convert_arriving", functools.partial(jobs.convert_arriving, per_batch=1, job=copied))
    rows = catalog.QUERIES["arriving_files"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 10 and all(r.times == 1 for r in rows)
    assert {(r.name[0], r.batch) for r in rows} == {("a", 0), ("b", 1)}
