"""What translating each line once leaves on disk while it works."""

import os
import random
import time

from made import docs

from interlinear.plans import jobs as J
from interlinear.plans.catalog import STUB
from interlinear.session import checkpoint_dir

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _bytes(top):
    return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(top) for n in names)


def _shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_steps_are_written_compressed_and_dropped_when_read(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(500)]
    texts = ["\n\n".join(" ".join(rnd.choices(words, k=20)) for _ in range(20)) + "\n\nsame\n" for _ in range(300)]
    d = docs(spark, *texts).repartition(4)
    scratch = checkpoint_dir(spark).removeprefix("file:")
    held, shuffles = _bytes(scratch), _shuffle_files(spark)
    out = J.translate_each_line_once(d, J.JobConfig(), STUB)
    held = _bytes(scratch) - held
    assert spark.conf.get(CLEAN, "false") == "false"
    for _ in range(40):  # they go in the background
        left = _shuffle_files(spark) - shuffles
        if not left:
            break
        time.sleep(0.25)
    got = {r.doc_id: (r.rendered, r.status) for r in out.collect()}
    assert held < sum(map(len, texts))  # one copy, compressed: the translated places
    assert not left
    assert got == {n: ("".join(f"{x}\n\n[zh] {x}\n\n" for x in t[:-1].split("\n\n"))[:-1], "ok") for n, t in enumerate(texts)}


def test_places_of_blank_lines_and_null_keys_stay(spark):
    d = spark.createDataFrame([(1, "![](x.png)\n\na"), (1, "a"), (None, "a"), (2, None), (3, "")], "doc_id long, text string")
    out = {(r.doc_id, r.rendered, r.n_segments, r.status) for r in J.translate_each_line_once(d, J.JobConfig(materialize="none"), STUB).collect()}
    each = {(r.doc_id, r.rendered, r.n_segments, r.status) for r in J.translate_corpus(d, J.JobConfig(materialize="none"), STUB).collect()}
    assert out == each and len(out) == 3
