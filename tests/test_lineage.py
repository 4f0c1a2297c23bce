import gc
import os
import time

from tidewire.operators.lineage import cut, ensure_checkpoint_dir


def test_checkpoints_go_with_their_rows(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    folder = "/" + folder.lstrip("/")

    def parts():
        return {d for d, _, names in os.walk(folder) if any(n.startswith("part-") for n in names)}

    before = parts()
    kept, gone = cut(spark.range(1000)), cut(spark.range(2000))
    assert gone.count() == 2000 and len(parts() - before) == 2
    del gone
    for _ in range(40):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.25)
        if len(parts() - before) < 2:
            break
    assert len(parts() - before) == 1 and kept.count() == 1000
