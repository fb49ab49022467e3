"""Intermediate tables: where they are written, and that they go."""

import glob

import numpy as np
import pytest

from seekframe.llm import _common, line_dedup, token_files

from .test_operators import table


def test_release_deletes_what_was_written(spark):
    docs = table(spark, [(i, f"one line of text\nand line {i % 3} of it", "s") for i in range(20)])
    since = len(_common.WRITTEN)
    rows = line_dedup.dedup_lines(docs).collect()
    own = list(_common.WRITTEN[since:])
    exists = lambda path: bool(glob.glob(path.removeprefix("file://")))
    assert len(rows) == 20 and own and all(exists(x) for x in own)
    _common.release(spark, since)
    assert len(_common.WRITTEN) == since and not any(exists(x) for x in own)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Found:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("sc", (), {"getCheckpointDir": lambda self: Found()})()

    class Session:
        sparkContext = Context()
        conf = type("conf", (), {"get": lambda self, *a: None})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _common.shared_dir(Session())


def test_samples_of_the_dictionary_are_spread_over_the_text():
    ids = np.arange(100_000, dtype=np.uint32)
    got = token_files.spread(ids)
    assert len(got) == token_files.SAMPLE_IDS and got[0] == 0 and got[-1] == 99_999
    assert np.diff(got).max() < 7000 and (token_files.spread(ids[:50]) == ids[:50]).all()
