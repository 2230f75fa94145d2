import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.01"
SF_TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tamis.session import get_spark
    s = get_spark(8, shuffle_partitions=8, app="tamis-tests")
    yield s
    s.stop()


def texts_df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


def naive_occurrences(text, words):
    out = set()
    for w in words:
        if not w:
            continue
        i = text.find(w)
        while i >= 0:
            out.add((w, i))
            i = text.find(w, i + 1)
    return out
