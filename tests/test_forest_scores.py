"""What forest scores hold at once, and what they are."""
import tracemalloc

import numpy as np
import pandas as pd

from alarmspan.detectors import forest


def test_forest_scores_hold_a_few_trees_of_a_few_rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8192, 7))
    x[9, 3] = np.nan
    trees = pd.DataFrame([{"tree": t, "psi": 256, **forest._grow(x[rng.choice(np.arange(10, 8192), 256, replace=False)], np.random.default_rng(t), 8)}
                          for t in range(200)])
    tracemalloc.start()
    got = forest._mean_depth(x, trees)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 5 << 20

    def path(row, tree):
        node = 0
        while tree["feature"][node] >= 0:
            node = tree["left" if row[tree["feature"][node]] <= tree["cut"][node] else "right"][node]
        return tree["depth"][node] + float(forest.expected_depth(tree["cover"][node]))
    some = [0, 9, 2047, 2048, 8191]
    assert np.allclose(got[some], [np.mean([path(x[i], t) for t in trees.to_dict("records")]) for i in some], rtol=1e-12)
