import os
import sys

import pandas as pd
import pytest

os.environ.setdefault("COLVET_DRIVER_MEMORY", "8g")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from colvet.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=4, app="colvet-tests")
    yield s
    s.stop()


def make_audit(spark, pdf: pd.DataFrame, numeric=(), text=(), segment=None, train=(0.0, 0.5),
               holdout=(0.5, 1.0), bins=10, max_levels=20):
    """An Audit over a small planted frame with columns row_id, t, y + features."""
    from colvet.operators import windows as Wn
    from colvet.plans.pipeline import Audit
    from colvet.sources.frames import FrameSpec
    spec = FrameSpec(name="fixture", numeric=tuple(numeric), text=tuple(text), segment=segment)
    df = spark.createDataFrame(pdf)
    win = Wn.time_windows(df, "t", train, holdout)
    return Audit(spark, spec, df, win, bins, max_levels)
