"""Memory of a Python worker while it runs the stages of the pipeline."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import random, re, sys
import pyarrow as pa
from stratalog.llm import bpe, common, decontam, neardup, setsketch, textstats
from stratalog.llm.queries import WORD_BPE

rng = random.Random(1)
words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(5000)]
texts = [" ".join(rng.choices(words, k=400)) for _ in range(1000)]
batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 100])], names=["t"]) for i in range(0, 1000, 100)] * 8
hashes = common.WordHashes()
bench = decontam.Benchmark(["1"], [texts[0].encode()], 13)
encoder = bpe.Encoder(bpe._load(WORD_BPE))
stage = {
    "statistics": lambda x: textstats.measure(common.utf8(x), hashes),
    "sketches": lambda x: setsketch.sketches(setsketch.shingle_sets(common.utf8(x), hashes, 5)),
    "shards": lambda x: decontam.search_shard(bench, *common.split_words(common.utf8(x), common.ALNUM)),
    "encoding": lambda x: list(encoder.encode(x.to_pylist())),
}[sys.argv[1]]
mb = lambda name: int(re.search(name + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
before = mb("VmRSS")
open("/proc/self/clear_refs", "w").write("5")
for block in common.blocks(iter(batches)):
    stage(block.column(0))
print(sum(b.nbytes for b in batches) / 2**20, mb("VmHWM") - before)
"""


@pytest.mark.parametrize("stage", ["statistics", "sketches", "shards", "encoding"])
def test_worker_memory_of_a_stage(stage):
    """An executor of 3000 MB, 60 % of them heap, has some 400 MB for each of two workers."""
    run = subprocess.run([sys.executable, "-c", SCRIPT, stage], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    text_mb, worker_mb = map(float, run.stdout.split())
    assert text_mb > 12
    assert worker_mb < 200, f"{worker_mb:.0f} MB"


def test_long_texts_travel_in_small_pieces(spark, tmp_path):
    """Rows do not bound bytes: what a stage sends to Python at once and each row group that it writes stay near their bounds."""
    pa, pq = pytest.importorskip("pyarrow"), pytest.importorskip("pyarrow.parquet")
    import corpus_pipeline
    from stratalog.llm import common

    words = "array_join(transform(sequence(1, 120000), x -> lower(hex(x * 7919 + id))), ' ')"
    docs = spark.range(0, 40, 1, 1).selectExpr("id doc_id", f"{words} text")
    docs.write.parquet(f"{tmp_path}/docs")
    out = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
    one = docs.selectExpr("max(octet_length(text)) n").first().n
    assert 500_000 < one < common.BLOCK_BYTES

    def sizes(batches):
        for block in common.blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block.nbytes])], names=["n"])

    sent = [r.n for r in docs.coalesce(1).mapInArrow(sizes, "n long").collect()]
    assert sum(sent) >= 40 * 500_000 and max(sent) <= common.BLOCK_BYTES + 2 * one
    out.coalesce(1).write.parquet(f"{tmp_path}/out")
    (part,) = (tmp_path / "out").glob("*.parquet")
    groups = [pq.ParquetFile(part).metadata.row_group(i) for i in range(pq.ParquetFile(part).num_row_groups)]
    assert sum(g.num_rows for g in groups) == 40
    assert max(g.total_byte_size for g in groups) <= 16 * 2**20 + 5 * one
