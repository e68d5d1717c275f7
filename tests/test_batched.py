"""Jobs of many pages: every page has its answer, and none is paid for twice, whatever fails."""

import json
import os

import pytest

from pagelathe.functions.coerce import Field
from pagelathe.plans import batched
from pagelathe.plans.batched import DONE, FAILED, RUNNING, Job

FIELDS = [Field("title", "string"), Field("size", "integer")]


def providers(folder, mode):
    """One of jobs and one of single calls; classes of a function, so that workers get them whole."""

    class Desk:
        """A provider of jobs whose books are files; it fails jobs, answers wrongly, or takes its time, by the job's name."""

        def __init__(self, folder, mode):
            self.folder, self.mode = str(folder), mode

        def submit(self, name, requests):
            if self.mode == "closed":
                raise RuntimeError("503")
            try:
                with open(f"{self.folder}/{name}", "x") as f:
                    json.dump([r.text for r in requests], f)
                with open(f"{self.folder}/paid", "a") as f:
                    f.writelines(f"{r.text}\n" for r in requests)
            except FileExistsError:
                pass

        def look(self, name):
            texts = json.load(open(f"{self.folder}/{name}"))
            if self.mode == "slow" and not os.path.exists(f"{self.folder}/{name}.seen"):
                open(f"{self.folder}/{name}.seen", "w").close()
                return Job(RUNNING)
            if self.mode == "never":
                return Job(RUNNING)
            if self.mode == "half" and int(name, 16) % 2:
                return Job(FAILED)
            answers = tuple({"title": t, "size": len(t)} for t in texts)
            if self.mode == "short":
                return Job(DONE, answers[1:])
            if self.mode == "broken" and int(name, 16) % 2:
                return Job(DONE, (*answers[:-1], '{"title": '))
            return Job(DONE, answers, tuple(5 for _ in texts))

    class Single:
        def extract(self, request):
            if request.text == "page 3":
                raise RuntimeError("400 invalid argument")
            return {"title": request.text, "size": "many"}

    return Desk(folder, mode), Single()


def clock_of():
    now = [0.0]

    def clock():
        now[0] += 100.0
        return now[0]

    return clock


@pytest.mark.parametrize("mode", ["good", "half", "short", "broken", "slow", "never", "closed"])
def test_every_page_has_its_answer(spark, tmp_path, mode):
    rows = [(i, f"page {i}") for i in range(95)] + [(95, None), (96, "")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    out = batched.extract_batched(df, FIELDS, *providers(tmp_path, mode), pages=10, sleep=lambda s: None, clock=clock_of())
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 97
    for i, t in rows[:95]:
        r = got[i]
        if r["model"] == "primary-batch":
            assert (r["data"]["title"], r["data"]["size"], r["tokens"], r["error"]) == (t, len(t), 5, None)
        elif i == 3:
            assert (r["data"], r["error"]) == (None, "LLM_BAD_REQUEST")
        else:
            assert (r["data"]["title"], r["data"]["size"], r["error"]) == (t, None, None) and len(r["warnings"]) == 1
    models = {r["model"] for r in got.values()}
    assert models == {"primary-batch"} if mode in ("good", "slow") else models == {"primary"} if mode in ("short", "never", "closed") else models == {"primary", "primary-batch"}


def test_no_page_is_paid_twice(spark, tmp_path):
    df = spark.createDataFrame([(i, f"page {i}") for i in range(60)], "id long, text string").repartition(2).cache()
    for _ in range(2):  # the second run stands for tasks that are run again
        assert batched.extract_batched(df, FIELDS, *providers(tmp_path, "good"), pages=7).where("error is null").count() == 60
    paid = open(tmp_path / "paid").read().split("\n")[:-1]
    assert sorted(paid) == sorted(f"page {i}" for i in range(60))
    assert batched.extract_batched(df.limit(0), FIELDS, *providers(tmp_path, "closed")).count() == 0
