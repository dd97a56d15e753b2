"""Written intermediate tables."""

import re
import time
import tracemalloc
from pathlib import Path

import pyarrow as pa

from granary.llm import bpe, scratch, textkit


def test_shuffle_files_go_with_the_written_table(spark, tmp_path):
    """They do not wait for the driver's garbage collector."""
    local = Path(spark.conf.get("spark.local.dir"))
    files = lambda: {f for f in local.rglob("shuffle_*.data")}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(setting, "false")
    out = scratch.written(spark.range(100_000).repartition("id"))
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and out.count() == 100_000 and spark.conf.get(setting, "false") == was


def test_a_block_of_texts_is_all_that_is_held_twice():
    texts = pa.array(["word " * 400 + str(i) for i in range(10_000)])  # 20 MB
    tracemalloc.start()
    try:
        n = sum(len(starts) - 1 for _, _, starts in textkit.blocks(texts)) + sum(len(x) for _, x in bpe._runs(texts))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 20_000 and most < 5_000_000


def test_a_worker_gives_memory_back_after_its_task():
    """Many small objects beside few that stay are freed, but the C library keeps their pages for the process."""
    held = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    def run(batches):
        for batch in batches:
            rows, stay = [], []
            for i in range(200_000):
                rows.append(bytes(1000))
                if not i % 2000:
                    stay.append(bytes(1000))
            keep.append(stay)
            del rows
            yield batch

    after = []
    for f in (run, scratch.lean(run)):
        keep: list = []
        scratch.give_back()
        before = held()
        assert [len(b) for b in f(iter([pa.record_batch({"x": [1, 2]})]))] == [2]
        after.append(held() - before)
    assert after[1] < 50 < after[0]
