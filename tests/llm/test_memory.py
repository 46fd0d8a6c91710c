import builtins

import psutil
import pytest

import corpus_pipeline
from tessera.llm.shared import freed


def held() -> float:
    """MB of this session's largest Python worker."""
    found = [p for p in psutil.Process().children(recursive=True) if "pyspark" in " ".join(p.cmdline()) and p.name() != "java"]
    return max(p.memory_full_info().uss / 1e6 for p in found)


@pytest.mark.skipif(not psutil.LINUX, reason="malloc_trim is glibc's")
def test_workers_give_memory_back(spark):
    def run(batches):
        for batch in batches:
            made = [bytes(3000) for _ in range(100_000)]
            builtins.pinned = made[-1]  # stays at the heap's end, so that the allocator keeps what lies before it
            del made
            yield batch

    rows = spark.range(0, 8, 1, 1)
    rows.mapInArrow(lambda batches: batches, "id long").collect()
    before = held()
    assert rows.mapInArrow(freed(run), "id long").count() == 8
    assert held() < before + 100
    assert rows.mapInArrow(run, "id long").count() == 8
    assert held() > before + 200


@pytest.mark.parametrize("stage", ["language", "near_duplicates", "substrings", "pack"])
def test_functions_of_stages_give_memory_back(spark, data, monkeypatch, stage):
    docs, used = spark.read.parquet(f"{data}/documents.parquet"), []
    plain = type(docs).mapInArrow

    def noted(self, func, *args, **more):
        used.append(func)
        return plain(self, func, *args, **more)

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    dict(corpus_pipeline.STAGES)[stage](spark, docs, data).count()
    assert used and all(getattr(f, "__module__", "").startswith("tessera.llm") and f.__code__.co_name == "wrapped" for f in used)
